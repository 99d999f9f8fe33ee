"""Approximate nearest neighbours: inverted lists with an adaptive dimension scan.

Centroids are fitted on a bounded sample; every row is indexed under its nearest one. Rows
are turned by a random rotation, so that a few dimensions stand for all of them. Inside a
probed list, distances are summed over column blocks of the rotated vectors, and after each
block a hypothesis test drops the candidates whose partial distance already shows, at the
test's level, that they are beyond the current k-th nearest. Survivors are measured exactly.

Each query first scans its nearest list (and the next ones, until they hold enough rows).
Its k-th distance there goes along to its other lists: those whose whole ball lies beyond it
are left out, and in the rest the test starts with it.

How many lists are probed is decided on the sample too: the least number whose lists hold
``TARGET`` of the sample's own exact neighbours. Data with clusters needs few, data without
needs many; the rule is the same at every size.

Of equal vectors only the k + 1 with the smallest ids can be among anyone's nearest, and
equal queries have equal answers but for themselves: both are made one before anything is
dealt, so that no number of copies makes a list or a task large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Rows that the index is fitted on (expected number), and queries of it that decide the probes.
SAMPLE, SAMPLE_QUERIES = 20_000, 200
#: Rows to a list on average; rows of the sample to a list at least, so that there can be more lists only with a larger sample.
LIST_ROWS, LIST_SAMPLE = 1024, 4
#: Rows and queries that meet in one task's group.
BLOCK, QUERY_BLOCK = 1024, 512
#: Share of the sample's exact neighbours that the probed lists must hold.
TARGET = 0.97
#: Level of the hypothesis test, and rotated dimensions in a column block.
EPSILON, COLUMNS = 2.1, 16
_SEED = 20


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix; always the same for a number of dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)


def centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from a fixed start; an empty list keeps its centre."""
    distinct = np.unique(sample, axis=0)
    lists = min(lists, len(distinct))
    centres = distinct[np.random.default_rng(_SEED).choice(len(distinct), lists, replace=False)].copy()
    for _ in range(rounds):
        nearest = _squares(sample, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=lists)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def probes(sample: np.ndarray, centres: np.ndarray, k: int, target: float = TARGET) -> int:
    """The least number of nearest lists that hold ``target`` of the sample's exact neighbours."""
    if len(centres) == 1 or len(sample) < 2:
        return len(centres)
    asked = np.random.default_rng(_SEED).choice(len(sample), min(SAMPLE_QUERIES, len(sample)), replace=False)
    near = _squares(sample[asked], sample)
    near[np.arange(len(asked)), asked] = np.inf
    exact = np.argsort(near, axis=1)[:, : min(k, len(sample) - 1)]
    lists = _squares(sample, centres).argmin(axis=1)
    order = np.argsort(np.argsort(_squares(sample[asked], centres), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(order, lists[exact], axis=1).reshape(-1))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1


def scan(
    ids: np.ndarray, rows: np.ndarray, turned: np.ndarray, queries: np.ndarray, k: int, limits: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest rows of each query inside one block: query position, row position, distance.

    ``limits`` are distances beyond which a query wants nothing. Rows come in growing
    chunks. The first column block is measured for all pairs by one product; after it and
    each further one the test keeps a pair only while
    ``partial * D / d <= (1 + EPSILON / sqrt(d))**2 * r**2``, with r the query's k-th
    nearest distance so far. An id that rows repeat counts once.
    """
    dims = rows.shape[1]
    turned_queries = queries @ rotation(dims)
    best_q, best_r, best_d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bound = np.full(len(queries), np.inf) if limits is None else limits**2
    slack = 1e-9 * ((queries * queries).sum(1).max(initial=0) + (rows * rows).sum(1).max(initial=0))
    repeated = len(np.unique(ids)) < len(ids)
    first = min(COLUMNS, dims)
    a, size = 0, 128 if limits is None else 1024
    while a < len(rows):
        b = min(len(rows), a + size)
        near = np.maximum(_squares(turned_queries[:, :first], turned[a:b, :first]), 0)
        level = dims / first / (1 + EPSILON / first**0.5) ** 2 if first < dims else 1 / (1 + 1e-9)
        q, r = np.nonzero(near * level <= bound[:, None] + slack)
        partial, r = near[q, r], r + a
        for c in range(first, dims, COLUMNS):
            d = min(dims, c + COLUMNS)
            diff = turned[r, c:d] - turned_queries[q, c:d]
            partial += np.einsum("ij,ij->i", diff, diff)
            keep = partial * (dims / d) <= ((1 + EPSILON / d**0.5) ** 2 if d < dims else 1 + 1e-9) * bound[q] + slack
            q, r, partial = q[keep], r[keep], partial[keep]
        exact = rows[r] - queries[q]
        best_q, best_r = np.concatenate([best_q, q]), np.concatenate([best_r, r])
        best_d = np.concatenate([best_d, np.sqrt(np.einsum("ij,ij->i", exact, exact))])
        order = np.lexsort((ids[best_r], best_d, best_q))
        best_q, best_r, best_d = best_q[order], best_r[order], best_d[order]
        if repeated and len(best_q):
            _, once = np.unique(np.stack([best_q, ids[best_r]]), axis=1, return_index=True)
            once.sort()
            best_q, best_r, best_d = best_q[once], best_r[once], best_d[once]
        begin = np.searchsorted(best_q, best_q)
        keep = np.arange(len(best_q)) - begin < k
        full = np.flatnonzero(np.arange(len(best_q)) - begin == k - 1)
        bound[best_q[full]] = np.minimum(bound[best_q[full]], best_d[full] ** 2)
        best_q, best_r, best_d = best_q[keep], best_r[keep], best_d[keep]
        a, size = b, min(1024, 2 * size)
    return best_q, best_r, best_d


RESULT = "query_id long, rank int, id long, score double"


def search(table: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, <id_col>, score``: nearest rows of each row for which ``queries`` holds.

    Every usable row (see :func:`usable`) with an id is a candidate for every query of as
    many dimensions but its own id's; vectors of different lengths have no distance and are
    searched apart. Nearest first by Euclidean distance in double precision, ties to the
    smaller id. Rows that repeat an id count once, at their nearest; of a query's id each row
    is searched. No usable rows give no rows. Other columns are ignored.
    """
    own = table.select(table[f"`{id_col}`"].cast("long").alias("id"), table[f"`{vector_col}`"].cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    own = own.where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = own.groupBy(F.size("v").alias("dims")).count().orderBy("dims").collect()
    near = [_search(own.where(F.size("v") == r["dims"]), r["dims"], r["count"], k, sample) for r in sizes]
    if not near:
        return own.sparkSession.createDataFrame([], RESULT).withColumnRenamed("id", id_col)
    found = near[0]
    for n in near[1:]:
        found = found.unionByName(n)
    return found.withColumnRenamed("id", id_col)


def _search(own: DataFrame, dims: int, n: int, k: int, sample: int) -> DataFrame:
    """Neighbours among ``n`` vectors of one length."""
    places = 1 << 30
    taken = own.where(F.pmod(F.xxhash64("id"), F.lit(places)) < min(places, -(-places * sample // n))).select("v").toArrow()
    fitted = taken.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims) if taken.num_rows else np.zeros((1, dims))
    fitted = fitted[np.lexsort(fitted.T)]
    centres = centroids(fitted, max(1, min(len(fitted) // LIST_SAMPLE, round(n / LIST_ROWS))))
    probed = probes(fitted, centres, k)
    # equal vectors: the k + 1 smallest ids (the window's limit works before its shuffle); equal queries: one
    copies = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = _indexed(own.select("id", "v").withColumn("copy", copies).where(F.col("copy") <= k + 1).select("id", "v"), centres, dims)
    asked = own.where("asked").select("id", "v").distinct()
    distinct = cut(asked.groupBy("v").agg(F.min("id").alias("rep")), "queries")
    lists = rows.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # as many as centres
    counts, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in lists:
        counts[r["list"]], radii[r["list"]] = r["n"], r["far"]
    routed = cut(_routed(distinct, centres, dims, probed, counts, k + 1), "probes")
    nearest = cut(_scanned(rows, routed.select("rep", "v", F.explode("near").alias("list"), F.lit(None).cast("double").alias("bound")), dims, k + 1), "nearest")
    ranked = nearest.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("score", "id"))).where(F.col("place") <= k + 1)
    bounds = ranked.groupBy("rep").agg(F.count("*").alias("n"), F.max("score").alias("bound")).where(F.col("n") > k).select("rep", "bound")
    beyond = routed.select("rep", "v", F.posexplode("rest").alias("at", "list"), "far").join(bounds, "rep", "left")
    balls = own.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(radii)], "list int, radius double")
    beyond = beyond.join(F.broadcast(balls), "list")  # a number for each centre
    reached = F.col("bound").isNull() | (F.get("far", F.col("at")) - F.col("radius") <= F.col("bound") * (1 + 1e-9) + 1e-9)
    other = _scanned(rows, beyond.where(reached).select("rep", "v", "list", "bound"), dims, k + 1)
    near = nearest.unionByName(other).groupBy("rep", "id").agg(F.min("score").alias("score"))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("score", "id"))).where(F.col("place") <= k + 1).drop("place")
    # back to every query: its representative's answer without itself
    each = asked.join(distinct, "v").select(F.col("id").alias("query_id"), "rep").distinct().join(near, "rep").where("query_id <> id")
    each = each.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def _scanned(rows: DataFrame, asked: DataFrame, dims: int, k: int) -> DataFrame:
    """``rep, id, score``: what each block of a list's rows has for each block of the queries (``rep, v, list, bound``) that probe it."""
    sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    chunks = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("chunks"))
    deal = F.broadcast(sizes.join(chunks, "list"))  # at most a row for each centre
    left = rows.join(deal, "list").select("list", "id", "v", "turned", F.pmod(F.xxhash64("id", F.lit(1)), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    right = asked.join(deal, "list").select("list", "rep", F.col("v").alias("query"), "bound", F.pmod(F.xxhash64("rep", F.lit(2)), "chunks").alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    keys = ["list", "block", "chunk"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, reps = left.column("id").to_numpy(), right.column("rep").to_numpy()
        if not (len(ids) and len(reps)):
            at = row = np.zeros(0, np.int64)
            score = np.zeros(0)
        else:
            v, t = (np.frombuffer(b"".join(left.column(c).to_pylist()), np.float64).reshape(-1, dims) for c in ("v", "turned"))
            q = right.column("query").combine_chunks().flatten().to_numpy().reshape(-1, dims)
            limits = right.column("bound").to_numpy(zero_copy_only=False).astype(float)
            at, row, score = scan(ids, v, t, q, k, None if np.isnan(limits).any() else limits)
        return pa.table({"rep": reps[at], "id": ids[row], "score": score})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "rep long, id long, score double")


def _vectors(batch: pa.RecordBatch, column: int, dims: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _indexed(own: DataFrame, centres: np.ndarray, dims: int) -> DataFrame:
    """Every row with its list, its distance to the centre, and its vector and the rotated one as bytes of doubles; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dims)
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                v = _vectors(part, 1, dims)
                lists = _squares(v, centres).argmin(axis=1).astype(np.int32)
                far = np.sqrt(((v - centres[lists]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lists), pa.array(far), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in v @ turn], pa.binary())],
                    names=["id", "list", "far", "v", "turned"],
                )

    return cut(own.mapInArrow(run, "id long, list int, far double, v binary, turned binary"), "lists")


#: Rows whose distances to all centres are held at once.
_BATCH = 2048


def _routed(asked: DataFrame, centres: np.ndarray, dims: int, probed: int, counts: np.ndarray, least: int) -> DataFrame:
    """Queries (``rep, v``) with their ``near`` lists, nearest first until these hold ``least`` rows, and the ``rest`` of the probed ones with their distances ``far``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                far = np.sqrt(np.maximum(_squares(_vectors(part, 1, dims), centres), 0))
                order = np.argsort(far, axis=1, kind="stable")
                held = np.cumsum(counts[order], axis=1)
                first = np.minimum((held < least).sum(axis=1) + 1, len(centres)).tolist()
                near = [o[:n].tolist() for o, n in zip(order, first)]
                rest = [o[n : max(n, probed)] for o, n in zip(order, first)]
                away = [f[r].tolist() for f, r in zip(far, rest)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(near, pa.list_(pa.int32())), pa.array([r.tolist() for r in rest], pa.list_(pa.int32())), pa.array(away, pa.list_(pa.float64()))],
                    names=["rep", "v", "near", "rest", "far"],
                )

    return asked.select("rep", "v").mapInArrow(run, "rep long, v array<double>, near array<int>, rest array<int>, far array<double>")
