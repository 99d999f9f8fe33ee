"""Packing: concatenate and cut.

All documents, each closed by an end token, are one stream of ids. A first pass tokenises
every document once and writes its ids with the running token count inside its task. The
totals of the tasks (one number each) are summed into the offset at which each task's part
of the stream starts. The second pass reads the written ids and cuts them at multiples of
the sequence length by arithmetic on those offsets: no shuffle and no task that sees more
than its own part. Only the records at the two ends of a part share a window with another
part; :func:`sequences` merges those, and only those, by sequence id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _arrow_schema, cut, slices, two_columns, typed
from .tokens import TOKEN_SLICE, FastWords, by_text, split_words

SEQUENCE = 2048
END = 1
#: Pieces or ids that a task gives out at once.
_ROWS = 4096


def tokenised(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """First pass: ``part, start, n, ids`` of each document, written to the shared folder.

    ``ids`` holds little-endian unsigned ids of :func:`width` bytes; ``start`` is the number
    of ids before the document in its part. A null text has the end token alone. A text
    beyond ``TOKEN_SLICE`` is tokenised stretch by stretch, so only its ids are held whole.
    """
    schema = T.StructType(
        [
            T.StructField("_id", typed(docs, id_col)),
            T.StructField("part", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    table = FastWords(vocabulary)
    kind = f"<u{width(max(table.size, end + 1))}"
    shared, closing = docs.sparkSession.sparkContext.broadcast(table), np.array([end], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, words_of, part, before = _arrow_schema(schema), shared.value, TaskContext.get().partitionId(), 0
        for piece in slices(batches, limit=TOKEN_SLICE):
            if piece.num_rows == 1 and piece.column(1)[0].is_valid and piece.column(1).nbytes > 2 * TOKEN_SLICE:
                out = [b"".join(x.astype(kind).tobytes() for x in words_of.ids(piece.column(1)[0].as_py())) + closing]
            else:
                words, per_text = split_words(piece.column(1))
                ids, counts = words_of.lookup(words)
                raw, size = memoryview(ids.astype(kind).tobytes()), np.dtype(kind).itemsize
                ends = (np.cumsum(by_text(counts, per_text)) * size).tolist()
                out = [bytes(raw[a:b]) + closing for a, b in zip([0, *ends], ends)]
            ns = [len(b) // len(closing) for b in out]
            starts = list(accumulate(ns, initial=before))
            before = starts.pop()
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array([part] * len(ns), pa.int32()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64()), pa.array(out, pa.binary())], schema=arrow
            )

    return cut(two_columns(docs, id_col, text_col).mapInArrow(run, schema), "packing-ids")


def width(ids: int) -> int:
    """Bytes of an id of a vocabulary of so many."""
    return 2 if ids <= 1 << 16 else 4


def placed(ids: DataFrame) -> DataFrame:
    """``ids`` with ``begin``, each document's offset in the whole stream.

    The driver gets one total per task of the first pass, never anything per document.
    """
    totals = {r["part"]: r["total"] for r in ids.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("total")).collect()}
    parts = sorted(totals)
    bases = dict(zip(parts, accumulate([0] + [totals[p] for p in parts[:-1]])))
    spark = ids.sparkSession
    if not parts:
        return ids.withColumn("begin", F.lit(0).cast("long"))
    base = spark.createDataFrame(list(bases.items()), "part int, base long")
    return ids.join(F.broadcast(base), "part").withColumn("begin", F.col("base") + F.col("start")).drop("base")


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, end: int = END) -> DataFrame:
    """Pieces of all documents in sequences of exactly ``length`` ids (the last may be shorter).

    Returns ``doc_id`` (under the name and type of ``id_col``), ``start`` (the document's
    ids before the piece), ``length``, ``ids_crc32`` (of little-endian unsigned 32-bit ids),
    ``doc_tokens``, ``sequence_id`` and ``offset``. Only the last sequence needs padding.
    Null and empty texts are the end token alone; repeated rows are packed once each; an
    empty table has no pieces; order within the stream is the order of the input's rows. A
    very long text is tokenised in stretches and its pieces are given out in batches.
    """
    schema = T.StructType(
        [T.StructField(id_col, typed(docs, id_col))]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, rows = _arrow_schema(schema), []
        for batch in batches:
            for key, begin, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                size, at = len(raw) // n, 0
                while at < n:
                    sequence, offset = divmod(begin + at, length)
                    take = min(length - offset, n - at)
                    own = raw[size * at : size * (at + take)]
                    own = own if size == 4 else np.frombuffer(own, "<u2").astype("<u4").tobytes()
                    rows.append((key, at, take, zlib.crc32(own), n, sequence, offset))
                    at += take
                    if len(rows) < _ROWS:
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

    return placed(tokenised(docs, vocabulary, id_col, text_col, end)).select("_id", "begin", "n", "ids").mapInArrow(run, schema)


def sequences(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, end: int = END, pad: int = 0) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, n_tokens, ids`` (array of int, padded to ``length``).

    Windows inside one task's part are given out where they are made. The boundary records
    (at most the first and last window of each part) are merged by sequence id.
    """
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, held, begin = _arrow_schema(schema), np.zeros(0, np.int32), None
        for batch in batches:
            for at, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if begin is None or begin + len(held) != at:  # another part starts
                    if begin is not None and len(held):
                        yield _piece(arrow, begin, held, length)
                    begin, held = at, np.zeros(0, np.int32)
                held = np.concatenate([held, np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int32)])
                while len(held) >= (room := length - begin % length):
                    yield _piece(arrow, begin, held[:room], length)
                    begin, held = begin + room, held[room:]
        if begin is not None and len(held):
            yield _piece(arrow, begin, held, length)

    made = placed(tokenised(docs, vocabulary, id_col, text_col, end)).select("begin", "n", "ids").mapInArrow(run, schema)
    made = cut(made, "packing-windows")
    whole = made.where(F.size("ids") == length).select("sequence_id", "ids")
    joined = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    rest = made.where(F.size("ids") < length).groupBy("sequence_id").agg(F.flatten(joined).alias("ids"))
    padded = F.concat("ids", F.array_repeat(F.lit(pad), F.lit(length) - F.size("ids")))
    return whole.unionByName(rest).select("sequence_id", F.size("ids").cast("long").alias("n_tokens"), padded.alias("ids"))


def _piece(arrow: pa.Schema, begin: int, ids: np.ndarray, length: int) -> pa.RecordBatch:
    values = pa.array([ids], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([begin // length]), pa.array([begin % length]), values.cast(arrow.field("ids").type)], schema=arrow)
