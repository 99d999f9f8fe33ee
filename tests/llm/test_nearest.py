import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import nearest


def brute(ids, vectors, query, k=10):
    d = np.sqrt(((vectors - vectors[query]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[query]]
    return [int(ids[i]) for i in order[:k]], d


@pytest.mark.parametrize("clusters", [1, 12])
def test_recall_and_scores(spark, clusters):
    rng = np.random.default_rng(clusters)
    centres = rng.standard_normal((clusters, 24)) * 2
    vectors = (centres[rng.integers(clusters, size=4000)] + rng.standard_normal((4000, 24))).astype(np.float32)
    ids = np.arange(4000)
    table = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, label int")
    found = {}
    for r in nearest.search(table, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 4000, 100))
    hits = 0
    for q, own in found.items():
        expected, d = brute(ids, vectors.astype(float), q)
        assert [x[0] for x in sorted(own)] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(expected))
    assert hits >= 0.9 * 10 * len(found)


def test_block_scan_without_rejections_is_exact():
    rng = np.random.default_rng(0)
    rows, queries = rng.standard_normal((300, 40)), rng.standard_normal((7, 40))
    ids = np.arange(300)
    q, r, d = nearest.scan(ids, rows, rows @ nearest.rotation(40), queries, 5)
    for i in range(7):
        exact = np.sqrt(((rows - queries[i]) ** 2).sum(axis=1))
        got = set(r[q == i].tolist())
        assert len(got & set(np.argsort(exact)[:5].tolist())) >= 4


def answers(table, **options):
    found = {}
    for r in nearest.search(table, F.col("vec_id") % 100 == 0, **options).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [x[1] for x in sorted(own)] for q, own in found.items()}


def test_a_limit_leaves_out_only_what_lies_beyond():
    rng = np.random.default_rng(7)
    rows, queries = rng.standard_normal((3000, 32)), rng.standard_normal((5, 32))
    q, r, d = nearest.scan(np.arange(3000), rows, rows @ nearest.rotation(32), queries, 5)
    limits = np.array([d[q == i].max() for i in range(5)])
    again = nearest.scan(np.arange(3000), rows, rows @ nearest.rotation(32), queries, 5, limits)
    assert len(set(zip(q.tolist(), r.tolist())) & set(zip(again[0].tolist(), again[1].tolist()))) >= 24
    assert len(nearest.scan(np.arange(3000), rows, rows @ nearest.rotation(32), queries, 5, np.zeros(5))[0]) == 0


def test_many_copies_of_one_vector(spark):
    """A third of all rows are one vector: exact answers, ties to the smaller ids."""
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((3000, 8)).astype(np.float32)
    vectors[rng.permutation(3000)[:1000]] = vectors[0]
    vectors[100] = vectors[0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = answers(table)
    for q in (0, 100):
        assert found[q] == brute(np.arange(3000), vectors.astype(float), q)[0]
    hits = sum(len(set(own) & set(brute(np.arange(3000), vectors.astype(float), q)[0])) for q, own in found.items())
    assert len(found) == 30 and hits >= 0.9 * 300


def test_few_rows_in_the_nearest_list(spark, monkeypatch):
    """A query alone in its list goes on to the next ones until it has all its neighbours."""
    monkeypatch.setattr(nearest, "LIST_ROWS", 10)
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.standard_normal((200, 6)) * 0.01, [[50.0] * 6], [[-50.0] * 6]])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = answers(table)
    assert sorted(found) == [0, 100, 200] and all(len(own) == 10 for own in found.values())


def test_repeated_ids_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [1.0, 0.2]), (1, [9.0, 9.0]), (2, [1.0, 0.3]), (100, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.5]), (0, [5.0, 5.0])]
    found = sorted(tuple(r) for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect())
    assert [(q, n, v, round(s, 6)) for q, n, v, s in found] == [(0, 1, 1, 0.2), (0, 2, 2, 0.3), (100, 1, 3, 0.5)]


def test_odd_rows(spark):
    same = [1.0, 0.0, 0.0]
    rows = [(0, same), (100, same), (1, same), (2, same), (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 1.0, 0.0]), (None, same), (9, [1.0]), (200, [0.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (10, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 AS id", "2 AS v", "3 AS rank")
    found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in nearest.search(table, F.col("vec_id") % 100 == 0).collect())
    far = round(2**0.5, 9)
    assert found == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 0.0), (0, 4, 3, far), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 0.0), (100, 4, 3, far)]
    assert nearest.search(table.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert nearest.search(table.where("vec_id = 5"), F.lit(True)).collect() == []


def test_rotation_keeps_distances():
    r = nearest.rotation(30)
    assert np.allclose(r @ r.T, np.eye(30))
