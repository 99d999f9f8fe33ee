import random

import pytest
from pyspark.sql import functions as F

from lexispark.operators import kv


@pytest.fixture
def table(spark, tmp_path):
    return kv.Table(spark, str(tmp_path / "kv"), kv.Options(memory_bytes=10_000, tables_per_level=2, levels=3))


def rows(df):
    return [(r["key"], bytes(r["value"])) for r in df.collect()]


def test_put_get_delete(table):
    for v in (b"v1", b"v2", b"v3"):
        table.put("a", v)
    assert table.get("a") == b"v3" and table.get("b") is None
    table.put("e", b"")
    assert table.get("e") == b""
    table.delete("a")
    table.delete("nothing")
    assert table.get("a") is None
    table.put("a", b"again")
    table.flush()
    assert table.get("a") == b"again"


def test_scan(table):
    for k in "edcba":
        table.put(k, k.encode())
    assert rows(table.scan("b", "d")) == [("b", b"b"), ("c", b"c")]
    table.flush()
    table.delete("b")
    assert rows(table.scan("a", "d")) == [("a", b"a"), ("c", b"c")]
    assert rows(table.scan("x", "z")) == []


def test_deletions_survive_flush_and_compaction(table):
    table.put("k", b"1")
    table.put("l", b"1")
    table.flush()
    table.delete("k")
    table.flush()
    assert table.tables_per_level() == [0, 1, 0]
    assert table.get("k") is None and table.get("l") == b"1"
    table.delete("l")
    table.flush()
    assert table.get("l") is None and rows(table.scan("a", "z")) == []


def test_random_writes_against_a_dict(spark, tmp_path):
    seen = []
    hooks = kv.Hooks(on_write=lambda k, n: seen.append(k), on_flush=lambda *a: seen.append("flush"), on_compaction=lambda *a: seen.append("compaction"))
    table = kv.Table(spark, str(tmp_path / "kv"), kv.Options(memory_bytes=500, tables_per_level=2, levels=3, hooks=hooks))
    rng, model = random.Random(42), {}
    for _ in range(150):
        key = f"key_{rng.randrange(40):04d}"
        if rng.random() < 0.25:
            table.delete(key)
            model.pop(key, None)
        else:
            model[key] = str(rng.random()).encode()
            table.put(key, model[key])
    assert rows(table.scan("key_0000", "key_9999")) == sorted(model.items())
    assert table.stats.flushes > 2 and table.stats.compactions >= 1 and table.stats.bytes_written > 0
    assert "flush" in seen and "compaction" in seen and len(seen) > 150


def test_batches(spark, table):
    table.put("a", b"old")
    table.write_all(spark.createDataFrame([("a", bytearray(b"1"), False, 1), ("a", bytearray(b"2"), False, 2), ("b", None, True, 1)], kv.LOG.replace("value binary, seq long, deleted boolean", "value binary, deleted boolean, seq long")))
    assert table.get("a") == b"2" and table.get("b") is None
    table.put("a", b"3")
    assert table.get("a") == b"3"


def test_merges(spark):
    log = spark.createDataFrame([("a", [1, 2], 1, False), ("a", [2, 3], 2, False), ("b", [9], 1, False), ("b", None, 2, True), ("b", [7], 3, False)], "key string, value array<int>, seq long, deleted boolean")
    assert {(r["key"], tuple(r["value"])) for r in kv.union(log).collect()} == {("a", (1, 2, 3)), ("b", (7,))}
    assert {(r["key"], tuple(r["value"])) for r in kv.latest(log).collect()} == {("a", (2, 3)), ("b", (7,))}
    once = kv.compact(log)
    assert sorted(map(str, kv.compact(once).collect())) == sorted(map(str, once.collect()))


def test_a_table_opened_again_finds_all(spark, tmp_path):
    path, options = str(tmp_path / "kv"), kv.Options(tables_per_level=2, levels=3)
    for n in range(5):
        table = kv.Table(spark, path, options)
        table.put(f"k{n}", b"%d" % n)
        table.put("same", b"%d" % n)
        table.close()
        assert table.seq == 2 * n + 2
    assert kv.Table(spark, path, options).get("same") == b"4" and len(rows(kv.Table(spark, path, options).scan("", "z"))) == 6


def test_a_failed_write_changes_nothing(spark, table, monkeypatch):
    table.put("a", b"1")
    table.flush()
    table.put("b", b"2")

    def fails(*_):
        raise OSError("disk")

    monkeypatch.setattr(table, "_written", fails)
    with pytest.raises(OSError, match="disk"):
        table.flush()
    monkeypatch.undo()
    assert table.get("b") == b"2" and table.tables_per_level() == [1, 0, 0]
    table.flush()
    monkeypatch.setattr(table, "_written", fails)
    with pytest.raises(OSError, match="disk"):
        table.compact_level(1)
    monkeypatch.undo()
    assert rows(kv.Table(spark, table.path, table.options).scan("", "z")) == [("a", b"1"), ("b", b"2")]


def test_two_writers_cannot_both_commit(spark, table):
    other = kv.Table(spark, table.path, table.options)
    table.put("a", b"1")
    other.put("b", b"2")
    table.flush()
    with pytest.raises(RuntimeError, match="another writer"):
        other.flush()


def test_batches_cascade_and_count(spark, tmp_path):
    told = []
    hooks = kv.Hooks(on_flush=lambda *a: told.append(a[:2]), on_compaction=lambda *a: told.append(a))
    table = kv.Table(spark, str(tmp_path / "kv"), kv.Options(tables_per_level=2, levels=3, hooks=hooks))
    for n in range(4):
        table.write_all(spark.createDataFrame([(f"k{n}", bytearray(b"v"), False)], "key string, value binary, deleted boolean"))
    assert table.tables_per_level() == [0, 0, 1] and told == [(0, 1), (0, 1), (0, 1, 2), (0, 1), (0, 1), (0, 1, 2), (1, 2, 2)]
    assert table.stats.flushes == 4 and table.stats.compactions == 3
    assert len(rows(table.scan("", "z"))) == 4 and table.stats.reads == 1 and table.stats.bytes_read > 0
    assert {r["measure"]: r["value"] for r in table.measures().collect()}["tables_level_2"] == 1


def bits(*places):
    out = bytearray(4096)
    for p in places:
        out[p // 8] |= 1 << p % 8
    return bytes(out)


def test_union_policy(spark, tmp_path):
    table = kv.Table(spark, str(tmp_path / "kv"), kv.Options(tables_per_level=2, levels=3, policy=kv.UNION))
    table.put("a", bits(1))
    table.put("a", bits(2))
    table.put("b", bits(9))
    assert table.get("a") == bits(1, 2)
    table.flush()
    table.delete("b")
    table.put("b", bits(7))
    table.put("a", bits(4))
    table.flush()
    assert table.get("a") == bits(1, 2, 4) and table.get("b") == bits(7) and table.tables_per_level() == [0, 1, 0]
    table.delete("a")
    table.put("b", bits(8))
    table.flush()
    assert table.get("a") is None and rows(table.scan("", "z")) == [("b", bits(7, 8))]
    halves = [kv.compact_bitmaps(table.log()), kv.compact_bitmaps(kv.compact_bitmaps(table.log()))]
    assert len({str(sorted(map(str, h.collect()))) for h in halves}) == 1


def test_numbers_as_keys(spark):
    numbers = [0, 7, -1, -5, 1234567890123, 1234567890129, (1 << 63) - 1, -(1 << 63), -(1 << 63) + 1, 10**12]
    keys = {r["n"]: r["k"] for r in spark.createDataFrame([(n,) for n in numbers], "n long").select("n", kv.keyed(F.col("n")).alias("k")).collect()}
    assert len(set(keys.values())) == len(numbers) and sorted(numbers) == sorted(numbers, key=keys.get)


def test_files_are_dealt_by_ranges_of_keys(spark, tmp_path):
    table = kv.Table(spark, str(tmp_path / "kv"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table.write_all(spark.range(2000).select(kv.keyed(F.col("id")).alias("key"), F.lit(b"v").alias("value"), F.lit(False).alias("deleted")))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    files = table.log().groupBy(F.input_file_name()).agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> ''").orderBy("a").collect()
    assert len(files) > 1 and all(x["b"] < y["a"] for x, y in zip(files, files[1:]))


def test_a_bitmap_of_one_bit_is_short_and_unites_like_a_packed_one(spark):
    rows = spark.createDataFrame([(p,) for p in (0, 7, 8, 15, 999, 32_767)], "p long")
    short = rows.select("p", kv.bit(rows["p"]).alias("b"))
    assert {r["p"]: bytes(r["b"]) for r in short.collect()} == {r["p"]: bytes(r["p"] // 8) + bytes([1 << r["p"] % 8]) for r in rows.collect()}
    log = short.where("p < 1000").selectExpr("'k' AS key", "b AS value", "p AS seq", "false AS deleted")
    packed = rows.where("p < 1000").selectExpr("bitmap_construct_agg(p) AS b").first()["b"]
    assert [bytes(r["value"]) for r in kv.UNION.read(log).collect()] == [bytes(packed)]
