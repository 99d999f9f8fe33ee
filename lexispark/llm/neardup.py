"""Near-duplicates: SuperMinHash signatures, banding, verification on full sets, union-find.

1. Each document becomes a set of word shingles, a digest (BLAKE2b) of the whole sorted set, and a
   SuperMinHash signature. Documents with equal sets are one class from here on (a group of
   exact copies is one row, summed before any shuffle), represented by its smallest id.
2. Signatures are cut into bands. In each bucket every representative is paired with the
   bucket's smallest one only, never with all others.
3. Pairs are verified on the full shingle sets, in rounds: first one pair for each document,
   then what still joins two components, then, for buckets that still hold several
   components, the pairs across them, block by block: only sets whose sizes allow the
   similarity meet, signatures drop what can't reach it, and full sets decide on the rest
   inside the task. No pair is capped or sampled; only pairs inside one verified component
   are left out, as they can change nothing. Blocks are bounded by the bytes of their sets.
4. Components of the verified links are found by large-star and small-star rounds.

At similarity 0.8 a pair shares no band with probability (1 - 0.8**5)**32, about 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _arrow_schema, cut, slices, two_columns
from .hashing import mix, shingle_sets

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 32, 5
#: Documents of a still divided bucket that are compared with as many others in one task, and bytes of their sets at most (or one set).
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Signature agreement below which a pair can't reach the similarity: six deviations of an ordinary MinHash below it.
_SLACK = 6.0
#: Elements that the signature kernel handles at once.
_ELEMENTS = 150_000
_ROUNDS = 50


def superminhash(values: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (``uint64``) of the sets ``values[offsets[i]:offsets[i+1]]``.

    Each element draws a random permutation of the ``m`` slots, one swap at a time, and
    offers rank ``j`` plus a random fraction to the slot that its j-th swap gives. A slot
    keeps the least offer. As every offer of rank j is above all of lower ranks, a set is
    finished when all its slots are filled, which takes about m*ln(m)/n ranks for n
    elements. The result is the sequential algorithm's: the minimum has no order.
    """
    sets = len(offsets) - 1
    out = np.full((sets, m), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.diff(offsets)
    first = 0
    while first < sets:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _ELEMENTS, side="right")) - 1)
        for a in range(int(offsets[first]), int(offsets[last]), _ELEMENTS):  # more than once only for one very large set
            b = min(a + _ELEMENTS, int(offsets[last]))
            owner = np.repeat(np.arange(first, last), sizes[first:last]) if last > first + 1 else np.full(b - a, first)
            _offer(values[a:b], owner, out, m)
        first = last
    return out


def _offer(elements: np.ndarray, owner: np.ndarray, out: np.ndarray, m: int) -> None:
    slots = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
    flat, seeds = out.reshape(-1), mix(elements ^ np.uint64(0x5851F42D4C957F2D))
    for j in range(m):
        if not len(seeds):
            return
        draw = mix(seeds + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        rows = np.arange(len(seeds))
        swap = j + ((draw >> np.uint64(40)) % np.uint64(m - j)).astype(np.int64)
        slot = slots[rows, swap].astype(np.int64)
        slots[rows, swap] = slots[:, j]
        np.minimum.at(flat, owner * m + slot, (np.uint64(j) << np.uint64(40)) | (draw & np.uint64((1 << 40) - 1)))
        live = np.unique(owner)
        open_ = live[out[live].max(axis=1) >= np.uint64(j + 1) << np.uint64(40)]
        if len(open_) < len(live):
            keep = np.isin(owner, open_)
            slots, owner, seeds = slots[keep], owner[keep], seeds[keep]


def signed(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """``id, n, print, bands, signature``: set size, fingerprint of the set, band hashes, and one byte of each slot."""
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("print", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("signature", T.BinaryType()),
        ]
    )
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow_schema(schema)
        for piece in slices(batches):
            values, offsets = shingle_sets([t or "" for t in piece.column(1).to_pylist()], shingle)
            signature = superminhash(values, offsets, m)
            keys = np.zeros((len(signature), bands), np.uint64)
            for i in range(rows):
                keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + signature[:, i::rows])
            keys = mix(keys + np.arange(bands, dtype=np.uint64))
            small = mix(signature).astype(np.uint8)
            raw, ends = memoryview(values).cast("B"), (8 * offsets).tolist()
            prints = [blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0).cast(pa.int64()),
                    pa.array(np.diff(offsets)),
                    pa.array(prints, pa.binary()),
                    pa.array(list(keys.view(np.int64)), arrow.field("bands").type),
                    pa.array([s.tobytes() for s in small], pa.binary()),
                ],
                schema=arrow,
            )

    return two_columns(docs, id_col, text_col).mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """``id, root`` for every id of ``links(a, b)``; the root is the smallest id that links lead to.

    Large-star and small-star rounds until nothing changes. Minima are taken by partial
    aggregates and joined back, so that a star of any size is never one task's group; each
    round is a written table.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(_ROUNDS):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = cut(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "links")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = cut(small.union(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")


def extended(roots: DataFrame, more: DataFrame) -> DataFrame:
    """Roots after more links: only the components that these join are gone through again."""
    ends = [roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
    between = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    top = cut(components(between), "roots")
    moved = roots.join(top.select(F.col("id").alias("root"), F.col("root").alias("new")), "root", "left")
    return cut(moved.select("id", F.coalesce("new", "root").alias("root")).union(top), "roots")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the similarity; ``sets`` has ``id, n, shingles``."""
    sides = [sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _shingles(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id, shingles``: sorted 64-bit shingle hashes of the wanted documents."""
    texts = two_columns(docs, id_col, text_col).join(wanted.select(F.col("id").alias("_id")), "_id", "left_semi").dropDuplicates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            values, offsets = shingle_sets([t or "" for t in piece.column(1).to_pylist()], shingle)
            raw = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.array(raw, pa.binary())], names=["id", "shingles"])

    return texts.mapInArrow(run, "id long, shingles binary")


def _divided(buckets: DataFrame, roots: DataFrame, reps: DataFrame, percent: int, m: int) -> DataFrame:
    """Members of still divided buckets that could be linked with another component there.

    Buckets whose largest component is the same are compared together, so that a member of
    a large group comes once and not once for each band. The largest component's own
    members are never compared with each other. Members fall into classes of size, of which
    only neighbours can be similar; each class is dealt into blocks, by number and by bytes
    of the sets; a task compares one pair of blocks by signatures. Returns the task (group,
    lower class, whether the classes differ, blocks, and whether the main component's
    members are the right side) and ``id, root, n, rest, upper, signature`` of each member with a
    candidate in the task: one row for a member and task, however many candidates it has there.
    """
    joined = buckets.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    parts = joined.groupBy("key", "root").agg(F.count("*").alias("size"))
    heads = parts.groupBy("key").agg(F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("all"), F.count("*").alias("parts"))
    heads = heads.where("parts > 1 AND all > 2").select("key", F.col("top.root").alias("main"))  # two members were a star
    step = 1.0001 * log(100 / percent)
    rest = F.col("root") != F.col("main")
    members = joined.join(heads, "key").select("main", "id", "root").distinct().join(reps.select("id", "n", "signature"), "id")
    members = cut(members.withColumn("rest", rest).withColumn("class", F.floor(F.log("n") / step).cast("int")), "members")
    fit = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES / 8) / F.exp((F.col("class") + 1) * step))))
    blocks = members.groupBy("main", "rest", "class").agg(F.ceil(F.count("*") / fit).cast("int").alias("blocks"))

    def beside(shift: int, of_rest: bool, name: str) -> DataFrame:
        """Blocks of the class beside each class, none being 0."""
        return blocks.where(F.col("rest") == of_rest).select("main", (F.col("class") - shift).alias("class"), F.col("blocks").alias(name))

    names = {(shift, of_rest): f"{'rest' if of_rest else 'main'}_{shift + 1}" for shift in (-1, 0, 1) for of_rest in (True, False)}
    plan = blocks.select("main", "class").distinct()
    for (shift, of_rest), name in names.items():
        plan = plan.join(beside(shift, of_rest, name), ["main", "class"], "left")
    # a table of its own, so that its size is known, or else a large group is split in the join
    members = members.join(cut(plan.fillna(0, list(names.values())), "blocks"), ["main", "class"])
    count = F.when(F.col("rest"), F.col(names[0, True])).otherwise(F.col(names[0, False]))
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), count).cast("int"))

    def tasks_with(shift: int, other_rest: bool, own_rest: bool) -> Column:
        """Tasks of a member with the blocks of a class beside its own; ``x`` is a block of the rest, of the lower class if both are."""
        own, other = F.col("block"), F.sequence(F.lit(0), F.col(names[shift, other_rest]) - 1)
        low = F.least(F.col("class"), F.col("class") + shift)

        def task(b):
            if own_rest and other_rest:
                x, y = (own, b) if shift > 0 else (b, own) if shift < 0 else (F.greatest(own, b), F.least(own, b))
                mode = 0
            else:
                # which side of the class pair the rest is on makes another task
                x, y = (own, b) if own_rest else (b, own)
                mode = 1 + (0 if shift == 0 else 1 if (shift > 0) == own_rest else 2)
            return F.struct(low.alias("low"), F.lit(shift != 0).alias("apart"), x.alias("x"), y.alias("y"), F.lit(mode).alias("mode"), F.lit(shift < 0).alias("upper"))

        empty = F.array().cast("array<struct<low:int,apart:boolean,x:int,y:int,mode:int,upper:boolean>>")
        return F.when(F.col(names[shift, other_rest]) > 0, F.transform(other, task)).otherwise(empty)

    for_rest = F.concat(*(tasks_with(shift, other, True) for shift in (-1, 0, 1) for other in (True, False)))
    for_main = F.concat(*(tasks_with(shift, True, False) for shift in (-1, 0, 1)))
    tasks = members.select("main", F.explode(F.when(F.col("rest"), for_rest).otherwise(for_main)).alias("task"), "id", "root", "n", "rest", "signature")
    least = percent / 100 - _SLACK * float(np.sqrt(percent / 100 * (1 - percent / 100) / m))

    def compare(table: pa.Table) -> pa.Table:
        near = np.zeros(len(table), bool)
        for i, j in _candidates(table, percent, m, least):
            near[i] = True
            near[j] = True
        return table.filter(pa.array(near))

    schema = "main long, low int, apart boolean, x int, y int, mode int, id long, root long, n long, rest boolean, upper boolean, signature binary"
    columns = [c.split()[0] for c in schema.split(", ")]
    tasks = tasks.select("main", "task.*", "id", "root", "n", "rest", "signature").select(columns)
    return tasks.groupBy(TASK).applyInArrow(compare, schema)


#: What names a task of :func:`_divided`.
TASK = ["main", "low", "apart", "x", "y", "mode"]


def _candidates(table: pa.Table, percent: int, m: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each position of a task's left side with those on its right that size and signature allow, of other components."""
    roots, n, rest = (table.column(c).to_numpy() for c in ("root", "n", "rest"))
    signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(n), m)
    if table.column("mode")[0].as_py():  # the rest against members of the main component
        left, right = np.flatnonzero(rest), np.flatnonzero(~rest)
    elif table.column("apart")[0].as_py():  # two classes of the rest
        upper = table.column("upper").to_numpy()
        left, right = np.flatnonzero(~upper), np.flatnonzero(upper)
    else:
        left = right = np.flatnonzero(rest)
    for i in left.tolist():
        near = right[(roots[right] != roots[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
        near = near[(signatures[near] == signatures[i]).mean(axis=1) >= least] if len(near) else near
        if len(near):
            yield i, near


def _joining(tasks: DataFrame, sets: DataFrame, percent: int, m: int) -> DataFrame:
    """Links ``a, b`` that join components in the tasks of :func:`_divided`, on full sets.

    Every candidate whose ends are in different components is compared in full; a task
    gives out only links that join something not yet joined in it, so fewer than members.
    """
    least = percent / 100 - _SLACK * float(np.sqrt(percent / 100 * (1 - percent / 100) / m))

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = x = parent.get(y, y)
            return x

        roots = table.column("root").to_pylist()
        found = []
        for i, near in _candidates(table, percent, m, least):
            owned = own[i]
            for j in near.tolist():
                a, b = top(roots[i]), top(roots[j])
                if a == b:
                    continue
                at = np.minimum(np.searchsorted(owned, own[j]), len(owned) - 1)
                shared = int((owned[at] == own[j]).sum())
                if 100 * shared >= percent * (len(owned) + len(own[j]) - shared):
                    parent[a] = b
                    found.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
        return pa.table({"a": pa.array([int(a) for a, _ in found], pa.int64()), "b": pa.array([int(b) for _, b in found], pa.int64())})

    grouped = tasks.join(sets.select("id", "shingles"), "id").groupBy(TASK)
    return grouped.applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` of each row; ``id_col`` must be an integer column.

    Documents are linked if ``100 * intersection >= percent * union`` of their distinct
    ``shingle``-word shingles (fewer words: the whole sequence is one shingle). Documents
    without words (null, empty, white space) have no shingles and link with nothing.
    Repeated rows come back as often as they came, with one component; rows of one id with
    different sets are one document that links by each of them. A row with a null id links
    with nothing and is kept. An empty table gives no rows; other columns are ignored. A very
    long text is one set, hashed block by block; a task holds no more than two blocks of
    sets, or two single sets that are larger.
    """
    base = cut(signed(docs, id_col, text_col, shingle, bands, rows), "signatures")
    with_set = base.where("n > 0 AND id IS NOT NULL")
    # equal sets: one class, by partial aggregates
    reps = cut(with_set.groupBy("print").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "classes")
    buckets = reps.select(F.explode("bands").alias("key"), "id")
    centres = buckets.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("size")).where("size > 1").drop("size")
    shared = cut(buckets.join(centres, "key").select("key", "id", "b"), "buckets")
    stars = cut(shared.where("id <> b").select(F.col("id").alias("a"), "b").distinct(), "stars")
    sets = cut(_shingles(docs, shared.select("id").distinct(), id_col, text_col, shingle), "sets")
    first = stars.groupBy("a").agg(F.min("b").alias("b"))
    # a repeated id with several sets is one document: it is linked with the class of each
    repeated = with_set.groupBy("id").agg(F.min("print").alias("least"), F.max("print").alias("most")).where("least <> most").select("id")
    repeated = with_set.join(repeated, "id").select("print", F.col("id").alias("a")).join(reps.select("print", F.col("id").alias("b")), "print")
    links = cut(verified(first, sets, percent).union(repeated.where("a <> b").select("a", "b")).distinct(), "verified")
    roots = cut(components(links), "roots")
    rest = _open(stars.join(first, ["a", "b"], "left_anti"), roots)
    more = cut(verified(rest, sets, percent), "verified")
    if not more.isEmpty():
        roots = extended(roots, more)
    tasks = cut(_divided(shared.select("key", "id").distinct(), roots, reps, percent, bands * rows), "divided")
    if not tasks.isEmpty():
        more = cut(_joining(tasks, sets, percent, bands * rows), "verified")
        if not more.isEmpty():
            roots = extended(roots, more)
    labelled = reps.join(roots, "id", "left").select("print", F.coalesce("root", "id").alias("root"))
    out = with_set.join(labelled, "print").select("id", "n", "root")
    out = out.union(base.where("NOT (n > 0 AND id IS NOT NULL)").select("id", "n", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("root").alias("component_id"),
        F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept"),
    )


def _open(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component."""
    ends = [roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
    both = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
    return both.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def shingle_similarity(x: set, y: set, percent: int = PERCENT) -> bool:
    """The link rule on plain sets, for tests."""
    return bool(x) and bool(y) and 100 * len(x & y) >= percent * len(x | y)
