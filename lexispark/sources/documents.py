"""Documents from a directory or a table, with dates from a metadata file."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parsed
from ..operators.numbering import dense

METADATA = "metadata.yaml"
SCHEMA = "doc_id long, filename string, text string, date date, start_date date, end_date date"


def has_extension(filename: Column, extensions: list[str]) -> Column:
    """Whether a file name's lower-cased extension is one of those given (as written)."""
    return F.lower(F.regexp_extract(filename, r"(\.[^.]*)$", 1)).isin(*extensions)


def directory(spark: SparkSession, path: str, extensions: list[str] | None = None, encoding: str = "utf-8") -> DataFrame:
    """``filename, text`` of the files directly in a directory that have one of the extensions."""
    raw = spark.read.format("binaryFile").load(path).where(~F.col("path").rlike(r"/\.[^/]*$"))
    found = raw.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    return found.where(has_extension(F.col("filename"), extensions or [".txt"])).select("filename", F.decode("content", encoding).alias("text"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """``filename`` and dates of the directory's metadata file.

    No file gives no rows; one that can't be read gives none and a warning; a bad date is
    null, as an empty one is.
    """
    import yaml

    schema = "filename string, date string, start_date string, end_date string"
    rows: list[tuple] = []
    names = spark.read.format("binaryFile").load(path).where(F.col("path").endswith("/" + METADATA)).select("content").take(1)
    if names:
        try:
            found = yaml.safe_load(bytes(names[0]["content"]).decode()) or {}
            rows = [(str(k), *(None if v.get(c) is None else str(v[c]) for c in ("date", "start_date", "end_date"))) for k, v in found.items()]
        except (yaml.YAMLError, AttributeError, UnicodeDecodeError) as e:
            print(f"warning: {os.path.join(path, METADATA)}: {e}")
    table = spark.createDataFrame(rows, schema)
    return table.select("filename", *(parsed(F.col(c)).alias(c) for c in ("date", "start_date", "end_date")))


def numbered(files: DataFrame, dates: DataFrame | None = None, first: int = 0) -> DataFrame:
    """Documents with ids from ``first`` by file name. Only the names are sorted, not the texts, and not in one place."""
    ids = dense(files.select("filename").distinct(), "filename", number="doc_id", first=first)
    found = files.join(ids, "filename")
    if dates is None:
        none = F.lit(None).cast("date")
        return found.select("doc_id", "filename", "text", none.alias("date"), none.alias("start_date"), none.alias("end_date"))
    return found.join(dates, "filename", "left").select("doc_id", "filename", "text", "date", "start_date", "end_date")
