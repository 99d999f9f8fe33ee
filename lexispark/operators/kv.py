"""Versioned key-value tables: a log of writes, read through a merge policy.

A log has ``key, value, seq, deleted``. The policy says what a key's writes mean: ``LATEST``
keeps the newest one, ``UNION`` joins the packed bitmaps of all writes since the last
deletion. Both are aggregates with partial results before their shuffle; filters on the key
go to the files, which are dealt by ranges of keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Manifest, delete, size_of

LOG = "key string, value binary, seq long, deleted boolean"


def latest(log: DataFrame, drop_deleted: bool = True) -> DataFrame:
    """Each key's newest write, deleted keys left out unless asked for."""
    newest = log.groupBy("key").agg(F.max_by(F.struct("value", "seq", "deleted"), "seq").alias("w"))
    found = newest.select("key", "w.value", "w.seq", "w.deleted")
    return found.where("NOT deleted").select("key", "value") if drop_deleted else found


def union(log: DataFrame) -> DataFrame:
    """``key, value``: the sorted distinct members of a key's arrays over all writes since its last deletion."""
    gone = log.where("deleted").groupBy("key").agg(F.max("seq").alias("gone"))
    live = log.where("NOT deleted").join(gone, "key", "left").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    members = live.select("key", F.explode("value").alias("member")).distinct()
    return members.groupBy("key").agg(F.array_sort(F.collect_list("member")).alias("value"))


def get(log: DataFrame, key: str) -> DataFrame:
    """The value of a key, if it has one."""
    return latest(log.where(F.col("key") == key))


def scan(log: DataFrame, start: str, end: str) -> DataFrame:
    """Live keys in ``[start, end)``, by key."""
    return latest(log.where((F.col("key") >= start) & (F.col("key") < end))).orderBy("key")


def compact(log: DataFrame, keep_deleted: bool = True) -> DataFrame:
    """A log with one write for each key that reads the same; deletions stay unless nothing older is left elsewhere."""
    newest = latest(log, drop_deleted=False)
    return newest if keep_deleted else newest.where("NOT deleted")


def compact_bitmaps(log: DataFrame, keep_deleted: bool = True) -> DataFrame:
    """A log that reads the same under ``UNION``: a key's live bitmaps as one, and its last deletion while something older may lie elsewhere."""
    last = F.max(F.when(F.col("deleted"), F.col("seq")))
    gone = log.groupBy("key").agg(last.alias("gone"))
    live = log.where("NOT deleted").join(gone, "key").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    joined = live.groupBy("key").agg(F.bitmap_or_agg("value").alias("value"), F.max("seq").alias("seq")).withColumn("deleted", F.lit(False))
    if not keep_deleted:
        return joined
    return joined.unionByName(gone.where("gone IS NOT NULL").select("key", F.lit(None).cast("binary").alias("value"), F.col("gone").alias("seq"), F.lit(True).alias("deleted")))


def bit(position: Column) -> Column:
    """A packed bitmap of one bit position (from 0), without the zeros that would follow: unions and counts take it as one of 4 KB."""
    last = F.get(F.array(*(F.lit(f"{1 << i:02x}") for i in range(8))), (position % 8).cast("int"))
    return F.unhex(F.concat(F.repeat(F.lit("00"), F.floor(position / 8).cast("int")), last))


@dataclass(frozen=True)
class Policy:
    """``compact(log, keep_deleted)`` gives a smaller log that reads the same; without deletions it is what readers see."""

    compact: Callable[[DataFrame, bool], DataFrame]

    def read(self, log: DataFrame) -> DataFrame:
        return self.compact(log, False).select("key", "value")


LATEST = Policy(compact)
UNION = Policy(compact_bitmaps)


@dataclass
class Stats:
    """What was written and asked for; ``bytes_read`` counts the whole tables that a read had to look into."""

    bytes_written: int = 0
    bytes_read: int = 0
    reads: int = 0
    flushes: int = 0
    compactions: int = 0


@dataclass
class Hooks:
    """Callbacks: ``on_write(key, value_size)``, ``on_flush(level, rows, size)``, ``on_compaction(from_level, to_level, inputs)``."""

    on_write: Callable[[str, int], None] | None = None
    on_flush: Callable[[int, int, int], None] | None = None
    on_compaction: Callable[[int, int, int], None] | None = None


@dataclass
class Options:
    """``memory_bytes`` of writes are held before they are flushed; ``tables_per_level`` tables make a level full.

    ``page_bytes`` is the size of a file's blocks; ``bloom`` adds a filter of keys with the
    share ``false_positives``; ``writer`` has any further options of the files.
    """

    memory_bytes: int = 4 << 20
    tables_per_level: int = 10
    levels: int = 4
    page_bytes: int = 4 << 10
    bloom: bool = True
    false_positives: float = 0.01
    policy: Policy = LATEST
    writer: dict[str, str] = field(default_factory=dict)
    hooks: Hooks = field(default_factory=Hooks)


class Table:
    """A key-value table in a folder, written in sorted batches and compacted by levels.

    The folder's manifest says which files live, so a table opened again finds all that was
    flushed, and a write that fails leaves the state before it. A level that is full is
    merged into the next; the last level is never merged. Deletions are kept until nothing
    older can be below them.
    """

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        self.manifest = Manifest(spark, self.path)
        found = self.manifest.read() or {"levels": [], "seq": 0}
        self.levels: list[list[str]] = found["levels"] + [[] for _ in range(self.options.levels - len(found["levels"]))]
        self.seq: int = found["seq"]
        self.stats = Stats()
        self.held: dict[str, list[tuple[bytes | None, int, bool]]] = {}
        self.held_bytes = 0

    # -- writing

    def put(self, key: str, value: bytes) -> None:
        self._write(key, bytes(value), False)

    def delete(self, key: str) -> None:
        """Hides a key; one that isn't there is fine."""
        self._write(key, None, True)

    def write_all(self, rows: DataFrame) -> None:
        """A large batch ``key, value, deleted`` at once, newer than all before; its own repeated keys need a ``seq``."""
        self.flush()
        base = self.seq
        rows = rows if "seq" in rows.columns else rows.withColumn("seq", F.lit(0).cast("long"))
        rows = rows.select("key", F.col("value").cast("binary").alias("value"), F.col("seq") + base + 1, "deleted").toDF("key", "value", "seq", "deleted")
        path, size = self._written(self.options.policy.compact(rows, True), 0)
        count, top = self._table([path]).agg(F.count("*"), F.max("seq")).first()
        self.seq = int(base if top is None else top)
        self._flushed(path, count, size)

    def _write(self, key: str, value: bytes | None, deleted: bool) -> None:
        if self.options.hooks.on_write:
            self.options.hooks.on_write(key, len(value or b""))
        self.seq += 1
        kept = self.held.get(key, [])
        if kept and (self.options.policy is LATEST or deleted):
            self.held_bytes -= sum(len(v or b"") + len(key.encode()) for v, _, _ in kept)
            kept = []
        self.held[key] = [*kept, (value, self.seq, deleted)]
        self.held_bytes += len(value or b"") + len(key.encode())
        if self.held_bytes >= self.options.memory_bytes:
            self.flush()

    def _held(self) -> DataFrame:
        return self.spark.createDataFrame([(k, None if v is None else bytearray(v), s, d) for k, own in self.held.items() for v, s, d in own], LOG)

    def flush(self) -> None:
        """Held writes become a table of level 0, and full levels are compacted."""
        if not self.held:
            return
        rows, size = sum(map(len, self.held.values())), self.held_bytes
        path, _ = self._written(self._held(), 0)
        self.held, self.held_bytes = {}, 0
        self._flushed(path, rows, size)

    def _flushed(self, path: str, rows: int, size: int) -> None:
        self.levels[0].append(path)
        self._commit()
        self.stats.flushes += 1
        if self.options.hooks.on_flush:
            self.options.hooks.on_flush(0, rows, size)
        self._cascade()

    def _commit(self) -> None:
        self.manifest.commit({"levels": self.levels, "seq": self.seq})

    def _written(self, batch: DataFrame, level: int) -> tuple[str, int]:
        """A batch as files dealt by ranges of keys; not live until the manifest names it."""
        path = f"{self.path}/level={level}/{uuid.uuid4().hex}"
        writer = batch.repartitionByRange("key").sortWithinPartitions("key", "seq").write.option("parquet.page.size", str(self.options.page_bytes))
        if self.options.bloom:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(self.options.false_positives))
        writer.options(**self.options.writer).parquet(path)
        size = size_of(self.spark, path)
        self.stats.bytes_written += size
        return path, size

    def _cascade(self) -> None:
        for level in range(self.options.levels - 1):
            if len(self.levels[level]) < self.options.tables_per_level:
                return
            self.compact_level(level)

    def compact_level(self, level: int) -> None:
        """All tables of a level as one of the next; the old ones go once the new one is named."""
        inputs = self.levels[level]
        if not inputs or level + 1 >= self.options.levels:
            return
        below = any(self.levels[level + 1 :])
        path, _ = self._written(self.options.policy.compact(self._table(inputs), below), level + 1)
        self.levels[level] = []
        self.levels[level + 1].append(path)
        self._commit()
        for old in inputs:
            delete(self.spark, old)
        self.stats.compactions += 1
        if self.options.hooks.on_compaction:
            self.options.hooks.on_compaction(level, level + 1, len(inputs))

    def _table(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*paths)

    # -- reading

    def log(self) -> DataFrame:
        """All writes that are still kept."""
        paths = [p for level in self.levels for p in level]
        self.stats.reads += 1
        self.stats.bytes_read += sum(size_of(self.spark, p) for p in paths)
        return self._table(paths).unionByName(self._held()) if paths else self._held()

    def get(self, key: str) -> bytes | None:
        if key in self.held and self.options.policy is LATEST:
            return self.held[key][-1][0]
        row = self.options.policy.read(self.log().where(F.col("key") == key)).first()
        return None if row is None else bytes(row["value"])

    def scan(self, start: str, end: str) -> DataFrame:
        """Live keys in ``[start, end)``, by key."""
        return self.options.policy.read(self.log().where((F.col("key") >= start) & (F.col("key") < end))).orderBy("key")

    def tables_per_level(self) -> list[int]:
        return [len(x) for x in self.levels]

    def held_size(self) -> tuple[int, int]:
        """Bytes and keys held in memory."""
        return self.held_bytes, len(self.held)

    def measures(self) -> DataFrame:
        """``measure, value``: statistics, tables of each level, and what is held."""
        rows = list(vars(self.stats).items()) + [(f"tables_level_{i}", len(x)) for i, x in enumerate(self.levels)] + [("held_bytes", self.held_bytes), ("held_keys", len(self.held))]
        return self.spark.createDataFrame(rows, "measure string, value long")

    def close(self) -> None:
        self.flush()


def keyed(key: Column) -> Column:
    """A 64-bit number as a key whose byte order is its own order: 19 digits, negative ones after a minus from the least one up."""
    up = F.lpad(key.cast("long").bitwiseAND((1 << 63) - 1).cast("string"), 19, "0")
    return F.when(key < 0, F.concat(F.lit("-"), up)).otherwise(F.lpad(key.cast("string"), 19, "0"))
