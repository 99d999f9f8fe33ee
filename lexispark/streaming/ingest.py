"""Append ingestion: documents that arrive in a stream become postings batches.

An extension: each micro-batch appends to the tables of documents and postings under one
folder. Batches are named by their number and overwritten, so a batch that runs again after
a failure leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import Pipeline
from ..operators import index


def ingest(stream: DataFrame, pipeline: Pipeline, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write ``doc_id, text`` rows of a stream as tables ``docs`` and ``postings``."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.select("doc_id", "text")
        rows.write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        stored = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/docs/batch={number}")
        made = index.postings(stored, pipeline)
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        index.arranged(made, n).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingested(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents and postings that a stream has written so far."""
    docs = spark.read.parquet(f"{path}/docs").drop("batch")
    return docs.select(F.col("doc_id").cast("long"), "text"), spark.read.parquet(f"{path}/postings").drop("batch")
