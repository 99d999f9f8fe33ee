"""Dense numbers in an order, without sorting in one place."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

_BITS = 33


def dense(df: DataFrame, *order: str, number: str = "number", first: int = 0) -> DataFrame:
    """``df`` with the numbers from ``first`` that its rows have in the order of some columns.

    Rows are dealt by ranges of the order and sorted inside each; the driver gets one size
    for each range, whose sums say where each range begins.
    """
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", _BITS)
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    spark = df.sparkSession
    bases = spark.createDataFrame(list(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=first))), "_part long, _base long")
    found = placed.withColumn("_part", part).join(F.broadcast(bases), "_part")
    return found.withColumn(number, F.col("_base") + F.col("_at").bitwiseAND((1 << _BITS) - 1)).drop("_part", "_base", "_at")
