"""Plumbing shared by the training-data operators: tables, durable cuts, batch slicing.

Nothing here keeps state on one machine: intermediate tables go to the folder that the
session names in ``spark.checkpoint.dir``, so a lost executor only costs the tasks it ran.
"""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that a Python kernel handles at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, a local master
    (tests, notebooks) uses a folder under /tmp; any other master raises, since a
    machine-local folder would lose data there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: cuts lineage durably.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0)


def give_back() -> None:
    """Returns what this worker has freed to the system, which would else count as the worker's."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def typed(df: DataFrame, name: str) -> T.DataType:
    """Type of a column, by exact name."""
    return next(f.dataType for f in df.schema.fields if f.name == name)


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in pieces of about ``limit`` bytes of the text column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = 0
        start = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        yield batch.slice(start)
    give_back()  # the worker stays for other tasks


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    schema: T.StructType,
    kernel: Callable[[list, list[str]], dict[str, list]],
    keep_null: bool = False,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Rows that ``kernel(ids, texts)`` makes of each slice; a null text is an empty one unless ``keep_null``."""
    fields = schema.fieldNames()
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, limit=limit):
            texts = piece.column(1).to_pylist()
            if not keep_null:
                texts = ["" if t is None else t for t in texts]
            made = kernel(piece.column(0).to_pylist(), texts)
            yield pa.RecordBatch.from_arrays([pa.array(made[f], arrow.field(f).type) for f in fields], schema=arrow)

    return two_columns(df, id_col, text_col).mapInArrow(run, schema)


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, so that other columns are neither read nor able to clash."""
    return df.select(df[f"`{id_col}`"].alias("_id"), df[f"`{text_col}`"].cast("string").alias("_text"))


def passed_on(df: DataFrame, text_col: str, passing: tuple[str, ...]) -> tuple[list, Callable[[pa.RecordBatch, int], list]]:
    """Columns to send besides the text so that ``passing`` ones come out as they came, and how to take those from a batch whose first such column is at a place.

    The text itself, which is nearly all there is, is sent once: where it is passed on, it is
    the batch's second column.
    """
    twice = text_col in passing and isinstance(typed(df, text_col), T.StringType)
    sent = [c for c in passing if not (twice and c == text_col)]

    def take(batch: pa.RecordBatch, first: int) -> list:
        rest = iter(batch.columns[first:])
        return [batch.column(1) if twice and c == text_col else next(rest) for c in passing]

    return [df[f"`{c}`"].alias(f"_passing_{c}") for c in sent], take


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


#: White space of str.split() that the word rule [^\x20\x09-\x0D]+ doesn't split at.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile("[^\x20\x09-\x0d]+")


def words_of(text: str) -> list[str]:
    """Words by the rule [^\\x20\\x09-\\x0D]+."""
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()
