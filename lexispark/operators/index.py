"""Tables of an inverted index: postings, dictionary, grams, packed bitmaps, counts.

Postings are keyed by term and made without a shuffle. A stored index holds them dealt by
ranges of (term, document), so that files and row groups are skipped by term and a hot term
lies in several of them; beside them lie its terms with their counts, so that patterns are
matched once for each term and never for each posting. Dense term ids are only made where asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kgrams
from ..functions.text import Pipeline
from .numbering import dense

BLOCK = 1024

#: Postings that one task gets where they are dealt by their number, and packed bitmaps (4 KB each).
ROWS, PACKED = 1 << 21, 1 << 15


def parts(spark: SparkSession, rows: int, most: int = ROWS) -> int:
    """Into how many partitions to deal so many rows: small tables into no more than a session's own number, larger ones into as many as bound each."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // most), min(own, rows >> 16))


def tokens(docs: DataFrame, pipeline: Pipeline) -> DataFrame:
    """``doc_id, position, term``: a position counts all tokens, also dropped ones."""
    found = pipeline.analysed(docs.select("doc_id", "text"))
    return found.select("doc_id", F.posexplode("terms").alias("position", "term")).where(F.col("term").isNotNull())


def postings(docs: DataFrame, pipeline: Pipeline) -> DataFrame:
    """Distinct ``term, doc_id``. Terms are distinct inside a document before any row is made, so no shuffle is needed."""
    found = pipeline.analysed(docs.select("doc_id", "text"), positions=False)
    return found.select(F.explode(F.array_distinct(F.array_compact("terms"))).alias("term"), "doc_id")


def placed(docs: DataFrame, pipeline: Pipeline) -> DataFrame:
    """``term, doc_id, place``: postings with each term's place among the distinct terms of its document."""
    found = pipeline.analysed(docs.select("doc_id", "text"), positions=False)
    return found.select("doc_id", F.posexplode(F.array_distinct(F.array_compact("terms"))).alias("place", "term")).select("term", "doc_id", "place")


def dictionary(docs: DataFrame, pipeline: Pipeline) -> DataFrame:
    """``feature_id, term``: dense ids by first occurrence.

    Inside a document the order of first occurrence is that of its distinct terms, so only
    these are compared.
    """
    return numbered(counted(placed(docs, pipeline)))


def numbered(terms: DataFrame) -> DataFrame:
    """``feature_id, term`` of terms with their first places; the ids come from sorted ranges, see :func:`numbering.dense`."""
    return dense(terms.select("term", "first_doc", "first_place"), "first_doc", "first_place", number="feature_id").select("feature_id", "term")


def lookup(ids: DataFrame, wanted: list[str]) -> DataFrame:
    """``term, feature_id`` of those of some terms that a dictionary has."""
    return ids.where(F.col("term").isin(*wanted)).select("term", "feature_id") if wanted else ids.select("term", "feature_id").where(F.lit(False))


def counted(found: DataFrame) -> DataFrame:
    """``term, documents, first_doc, first_place``: the distinct terms of placed postings, in how many documents and where first."""
    return found.groupBy("term").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"), F.min_by("place", "doc_id").alias("first_place"))


def arranged(found: DataFrame, n: int) -> DataFrame:
    """Postings as a stored index wants them: dealt by ranges into ``n`` parts, sorted inside each."""
    return found.repartitionByRange(n, "term", "doc_id").sortWithinPartitions("term", "doc_id")


def terms(found: DataFrame) -> DataFrame:
    """Distinct terms of postings."""
    return found.select("term").distinct()


def prefixed(found: DataFrame, prefix: str) -> DataFrame:
    """Distinct terms with a prefix; the empty one gives all."""
    return terms(found.where(F.startswith(F.col("term"), F.lit(prefix))))


def gram_index(found: DataFrame, k: int = kgrams.K) -> DataFrame:
    """Distinct ``gram, term`` of the distinct terms of postings."""
    return terms(found).select(F.explode(F.array_distinct(kgrams.grams(F.col("term"), k))).alias("gram"), "term")


def gram_search(index: DataFrame, pattern: str, k: int = kgrams.K) -> DataFrame:
    """Terms that have all grams of a pattern and fit it; none if it has no grams."""
    wanted = kgrams.pattern_grams(pattern, k)
    if not wanted:
        return index.select("term").where(F.lit(False))
    held = index.where(F.col("gram").isin(*wanted)).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
    return held.where(kgrams.matching(F.col("term"), pattern)).select("term")


def having_all(found: DataFrame, wanted: list[str]) -> DataFrame:
    """``doc_id`` of the documents that have every one of some terms; none for no terms."""
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        return found.select("doc_id").where(F.lit(False))
    held = found.where(F.col("term").isin(*wanted)).groupBy("doc_id").agg(F.count("*").alias("n"))
    return held.where(F.col("n") == len(wanted)).select("doc_id")


def blocks(found: DataFrame, size: int = BLOCK, n: int | None = None) -> DataFrame:
    """``term, block, documents``: sizes of postings in blocks of ids, made in ``n`` parts if that is given."""
    block = F.floor(F.col("doc_id") / size)
    return _dealt(found.select("term", block.alias("block")), n, "block").groupBy("term", "block").agg(F.count("*").alias("documents"))


def bitmaps(found: DataFrame, n: int | None = None) -> DataFrame:
    """Packed postings ``term, bucket, bitmap``; a bucket is the built-in functions' one.

    In ``n`` parts the postings themselves are dealt and sorted, and each bitmap of 4 KB is
    made where it stays, instead of one in each task for every term that it has.
    """
    places = found.select("term", F.bitmap_bucket_number("doc_id").alias("bucket"), F.bitmap_bit_position("doc_id").alias("at"))
    return _dealt(places, n, "bucket").groupBy("term", "bucket").agg(F.bitmap_construct_agg("at").alias("bitmap"))


def union_bitmaps(packed: DataFrame, n: int | None = None) -> DataFrame:
    """Bitmaps of one term and bucket as one: the union merge of packed postings."""
    return _dealt(packed, n, "bucket").groupBy("term", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def _dealt(found: DataFrame, n: int | None, second: str) -> DataFrame:
    return found if n is None else found.repartition(n, "term", second)


def and_bitmaps(packed: DataFrame, wanted: list[str]) -> DataFrame:
    """``bucket, documents``: how many documents of a bucket have all terms; every term must have a bitmap there."""
    wanted = list(dict.fromkeys(wanted))
    held = packed.where(F.col("term").isin(*wanted)).groupBy("bucket").agg(F.count_distinct("term").alias("n"), F.bitmap_and_agg("bitmap").alias("bitmap"))
    return held.where(F.col("n") == len(wanted)).select("bucket", F.bitmap_count("bitmap").alias("documents")).where("documents > 0")


def stats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row: documents, terms, and features (terms with postings)."""
    counts = docs.select(F.lit(1).alias("docs"), F.lit(0).alias("terms")).unionByName(terms(found).select(F.lit(0).alias("docs"), F.lit(1).alias("terms")))
    return counts.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).select("docs", "terms", F.col("terms").alias("features"))
