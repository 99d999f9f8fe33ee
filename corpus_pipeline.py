"""A training-data pipeline: language, quality, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between
stages the documents are a written table. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import language, neardup, packing, quality, secrets
from lexispark.llm.common import cut, read
from lexispark.llm.tokens import vocabulary


def _same_columns(found: DataFrame, docs: DataFrame, **replaced: str) -> DataFrame:
    """The columns of ``docs`` out of an operator's result that passes them on; some come from the operator itself."""
    return found.select(*(F.col(replaced.get(c, c if c == "doc_id" else f"_passing_{c}")).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with it as their ``lang``.

    Null and empty texts, texts without letters, and those told with a score below
    ``language.ACCEPTED`` go; repeated rows are each told; an empty table gives no rows.
    """
    found = language.identify(docs, language.learn(docs), passing=tuple(c for c in docs.columns if c != "doc_id"))
    return _same_columns(found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= language.ACCEPTED)), docs, lang="lang_pred")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, judged by the language that the stage before told.

    Null and empty texts go; a null language is judged by the script; repeated rows are each
    judged; a long text is judged whole; an empty table gives no rows.
    """
    found = quality.rules(docs, passing=tuple(c for c in docs.columns if c != "doc_id")).where("kept")
    return _same_columns(found, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id (a null one comes last), then by a hash of the text.

    Every row is a document of its own here, so rows that share an id, or have none, leave
    only if their texts are copies. Documents without words are in no group and stay.
    """
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        kept = neardup.near_duplicates(docs).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    # ids that say nothing of the row: number the rows, in a written table so that a task that runs again numbers them alike
    rows = cut(docs.select("*", F.monotonically_increasing_id().alias("_row")), "rows")
    found = neardup.near_duplicates(rows, id_col="_row").select("_row", "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col("_row"))
    first = rows.join(found, "_row").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first._row").alias("_row"))
    return rows.join(first, "_row", "left_semi").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by marks and the length counted anew.

    Null and empty texts stay as they are; repeated rows are each scanned; a long text is
    scanned whole; an empty table gives no rows.
    """
    return secrets.redacted(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences.

    A null or empty text is its end token alone; repeated rows are each packed; a long text
    is packed whole; an empty table gives no rows.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", packed),
]

#: SQL has no tokenizer, signature or classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
