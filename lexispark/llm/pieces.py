"""SentencePiece encoding and decoding: n-best segmentation over the piece lattice.

A text's lattice has an edge for each piece of the vocabulary at each place. A forward
Viterbi pass gives the best score from the start to every place. These scores are an exact
heuristic for an A-star search backwards from the end, which so pops complete segmentations
in order of their scores, expanding nothing that can't be on one of them.

No piece runs across a space mark that follows another character, so a text's lattice is a
chain of independent ones, each of one word. Words are solved many at a time in vector
passes (forward and backward scores, best path, and the loss of the second-best path), and
distinct words mostly once per worker. Only the few words of a text whose second-best path
loses least can take part in its n best segmentations; the search runs on those.

Scores are rounded to multiples of 2**-20, so that sums are exact and ties are ties. Of
equal paths through a word, the one whose last differing piece is longer comes first; of
equal segmentations of a text, the one with fewer words unlike the best one, then the one
where those come earlier.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import nsmallest
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts, typed
from .hashing import mix
from .tokens import TOKEN_SLICE, WordTable, sentence_processor

NBEST = 5
MARK = "▁"
_BASE = 0x9E3779B97F4A7C15
_PENALTY = 10.0
#: Words longer than this are solved one by one, by the same rules.
_LONG = 64
#: Bytes of words that a worker's table holds, words whose n best ways it holds, and words of a text that are solved at once.
_HELD, _WAYS, _CHUNKS = 40 << 20, 60_000, 1 << 18
_GRAIN = 1 << 20


class Lattice:
    """Pieces and scores of a model file, and lattices over them."""

    def __init__(self, path: str):
        p = sentence_processor(path)
        probe = "a  \uff21\ufb01 e\u0301\tb "
        if p.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("only models that keep texts as they are, with a space before them, can be searched")
        size = p.vocab_size()
        self.unknown = p.unk_id()
        self.pieces = [p.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if p.is_byte(i)}
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = np.round(np.array([p.get_score(i) for i in range(size)], np.float64) * _GRAIN) / _GRAIN
        self.unknown_score = float(min(self.score[plain])) - _PENALTY
        self.longest = max(len(self.pieces[i]) for i in plain)
        self.sizes = np.array([1 if p.is_unknown(i) else len(s) for i, s in enumerate(self.pieces)], np.int64)
        self.raw = [bytes([int(s[3:5], 16)]) if p.is_byte(i) else b"" if p.is_control(i) else s.encode() for i, s in enumerate(self.pieces)]
        several = [self.pieces[i] for i in plain if len(self.pieces[i]) > 1]
        apart = all(MARK not in s.lstrip(MARK) for s in several)
        breaks = "".join(c for c in "\n\t\r" if not any(c in s for s in several))
        cut = f"[{re.escape(breaks)}]" if breaks else "(?!)"
        self.chunk = re.compile(f"{cut}|{MARK}*[^{MARK}{re.escape(breaks)}]+|{MARK}+") if apart else re.compile("(?s:.+)")
        hashes = np.array([self._hash_of(self.pieces[i]) for i in plain], np.uint64)
        self.keys = np.zeros(size + 1, np.uint64)
        self.keys[plain] = hashes
        self.slots, self.next = np.full(1 << 20, -1, np.int32), np.full(size + 1, -1, np.int32)
        for i, slot in zip(plain, (hashes >> np.uint64(44)).tolist()):
            self.next[i], self.slots[slot] = self.slots[slot], i

    @staticmethod
    def _hash_of(text: str) -> int:
        h = 0
        for c in text:
            h = (h * _BASE + ord(c) + 1) & (1 << 64) - 1
        return int(mix(np.array([h], np.uint64))[0])

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is none."""
        found = self.slots[hashes >> np.uint64(44)]
        while True:
            wrong = (found >= 0) & (self.keys[found] != hashes)
            if not wrong.any():
                return found
            found = np.where(wrong, self.next[found], found)

    def chunks(self, text: str) -> list[str]:
        """The parts of a text with independent lattices; the space before the text is part of the first."""
        return self.chunk.findall(MARK + text.replace(" ", MARK)) if text else []

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The same parts, ``_CHUNKS`` at a time."""
        found = (m[0] for m in self.chunk.finditer(MARK + text.replace(" ", MARK))) if text else iter(())
        while own := list(islice(found, _CHUNKS)):
            yield own

    def solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of words of one length: pieces of the best path (rows flattened), their counts, best scores, and the second path's loss.

        Of equal paths, the one whose last differing piece is longer is the best one.
        """
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(np.uint64)
        prefix = np.zeros((n, size + 1), np.uint64)
        for j in range(size):
            prefix[:, j + 1] = prefix[:, j] * np.uint64(_BASE) + codes[:, j] + np.uint64(1)
        ids, worth = [], []
        for k in range(1, min(self.longest, size) + 1):
            own = self._find(mix(prefix[:, k:] - prefix[:, : size - k + 1] * np.uint64(pow(_BASE, k, 1 << 64))))
            value = np.where(own >= 0, self.score[own], self.unknown_score if k == 1 else -np.inf)
            ids.append(np.where(own < 0, self.unknown, own) if k == 1 else own)
            worth.append(value)
        forward, backward = np.full((n, size + 1), -np.inf), np.full((n, size + 1), -np.inf)
        forward[:, 0] = backward[:, size] = 0
        last = np.zeros((n, size + 1), np.int32)
        for j in range(1, size + 1):
            for k in range(1, min(len(ids), j) + 1):
                value = forward[:, j - k] + worth[k - 1][:, j - k]
                better = value >= forward[:, j]
                forward[better, j] = value[better]
                last[better & (value > -np.inf), j] = k
        for i in range(size - 1, -1, -1):
            for k in range(1, min(len(ids), size - i) + 1):
                np.maximum(backward[:, i], worth[k - 1][:, i] + backward[:, i + k], out=backward[:, i])
        path, taken, at, rows = np.full((n, size), -1, np.int32), np.zeros((n, size), np.int32), np.full(n, size), np.arange(n)
        while len(rows):
            k = last[rows, at]
            at = at - k
            taken[rows, at] = k
            rows, at = rows[at > 0], at[at > 0]
        second = np.full(n, -np.inf)
        for k in range(1, len(ids) + 1):
            here = taken[:, : size - k + 1] == k
            path[:, : size - k + 1][here] = ids[k - 1][here]
            through = forward[:, : size - k + 1] + worth[k - 1] + backward[:, k:]
            np.maximum(second, np.where(here, -np.inf, through).max(axis=1), out=second)
        best = forward[:, size]
        return path[path >= 0], (path >= 0).sum(axis=1), best, best - second

    def _edges(self, chunk: str, j: int) -> list[tuple[int, int, float]]:
        """Length, id and score of the pieces that end at a place."""
        out = []
        for k in range(1, min(self.longest, j) + 1):
            i = self.ids.get(chunk[j - k : j])
            if i is not None:
                out.append((k, i, float(self.score[i])))
            elif k == 1:
                out.append((1, self.unknown, self.unknown_score))
        return out

    def nbest(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best (score, ids) of one chunk, best first.

        The forward scores are exact, so an open suffix stands for a whole path already: its
        own pieces, then the best way back. It is held as the places where it leaves the best
        way (none for the best path), and the agenda never needs more than the ``n`` best of
        these. Memory is a few numbers for each character, whatever the lattice.
        """
        size = len(chunk)
        forward, last = np.zeros(size + 1), np.zeros(size + 1, np.int32)
        for j in range(1, size + 1):
            best = -np.inf
            for k, _, worth in self._edges(chunk, j):
                value = forward[j - k] + worth
                if value >= best:
                    best, last[j] = value, k
            forward[j] = best

        def leaving(score: float, key: tuple, left: tuple, start: int) -> Iterator[tuple]:
            """Suffixes that follow one to ``start``, then the best way, and leave it once more."""
            j = start
            while j > 0:
                own = int(last[j])
                for k, i, worth in self._edges(chunk, j):
                    if k != own:
                        side = (-1, -j, -k) if k > own else (1, j, -k)
                        yield score + float(forward[j] - forward[j - k] - worth), (*key, side), (*left, (j, k)), j - k
                j -= own

        out: list[tuple[float, tuple[int, ...]]] = []
        agenda: list[tuple] = [(-float(forward[size]), (), (), size)]
        order = lambda x: (x[0], (*x[1], (0,)))  # noqa: E731 - the end of the list stands for the best way
        while agenda and len(out) < n:
            score, key, left, start = agenda.pop(0)
            out.append((-score, self._path(chunk, last, dict(left))))
            rest = n - len(out)
            agenda = sorted(agenda + nsmallest(rest, leaving(score, key, left, start), key=order), key=order)[:rest] if rest else []
        return out

    def _path(self, chunk: str, last: np.ndarray, left: dict[int, int]) -> tuple[int, ...]:
        out, j = [], len(chunk)
        while j > 0:
            k = left.get(j, int(last[j]))
            out.append(self.ids.get(chunk[j - k : j], self.unknown))
            j -= k
        return tuple(out[::-1])

    def spelled(self, ids: list[int], chunk: str) -> list[int]:
        """Ids with each unknown character as its bytes, if the model has byte pieces."""
        if self.unknown not in ids or len(self.byte_ids) < 256:
            return ids
        out, at = [], 0
        for i in ids:
            if i == self.unknown:
                out += [self.byte_ids[b] for b in chunk[at].encode("utf-8", "surrogatepass")]
                at += 1
            else:
                out.append(i)
                at += len(self.pieces[i])
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: marks are spaces, byte pieces are bytes, and the first space goes."""
        ids = np.asarray(ids, np.int64)
        blocks = (ids[a : a + _CHUNKS].tolist() for a in range(0, len(ids), _CHUNKS))
        text = b"".join(b"".join(map(self.raw.__getitem__, own)) for own in blocks).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


class _Solved(WordTable):
    """A word table that also has each chunk's best score and second path's loss."""

    def __init__(self, lattice: Lattice, limit: int = _HELD):
        super().__init__(lambda w: [], limit)
        self.lattice = lattice
        self.best, self.loss = np.zeros(1 << 12), np.full(1 << 12, np.inf)

    def _store(self, row: int, words: list[str]) -> None:
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        best, loss = np.zeros(n), np.full(n, np.inf)
        ids, owner = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        order = np.argsort(lengths, kind="stable")
        bounds = np.searchsorted(lengths[order], np.arange(1, _LONG + 2))
        for size, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist()), 1):
            for start in range(a, b, max(1, 200_000 // size)):
                part = order[start : min(b, start + max(1, 200_000 // size))]
                found, counts, best[part], loss[part] = self.lattice.solve([words[i] for i in part.tolist()])
                ids.append(found)
                owner.append(np.repeat(part, counts))
        for i in order[bounds[-1] :].tolist():
            found = self.lattice.nbest(words[i], 2)
            ids.append(np.array(found[0][1], np.int32))
            owner.append(np.full(len(found[0][1]), i))
            best[i], loss[i] = found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf
        flat, own = np.concatenate(ids), np.concatenate(owner)
        order = np.argsort(own, kind="stable")
        flat, own = self._spelled(flat[order], own[order], words)
        while row + n > len(self.best):
            self.best, self.loss = np.concatenate([self.best, np.zeros(len(self.best))]), np.concatenate([self.loss, np.full(len(self.loss), np.inf)])
        self.best[row : row + n], self.loss[row : row + n] = best, loss
        self._put(row, np.bincount(own, minlength=n).astype(np.int64), flat)

    def _spelled(self, flat: np.ndarray, own: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all words with unknown characters as bytes, as :meth:`Lattice.spelled` does for one."""
        at = np.flatnonzero(flat == self.lattice.unknown)
        if not len(at) or len(self.lattice.byte_ids) < 256:
            return flat, own
        sizes = self.lattice.sizes[flat]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        first = starts[np.searchsorted(own, own[at])]
        spelled = [[self.lattice.byte_ids[b] for b in words[w][c].encode("utf-8", "surrogatepass")] for w, c in zip(own[at].tolist(), (starts[at] - first).tolist())]
        times = np.ones(len(flat), np.int64)
        times[at] = list(map(len, spelled))
        out = np.repeat(flat, times)
        begin = (np.cumsum(times) - times)[at]
        for a, b in zip(begin.tolist(), spelled):
            out[a : a + len(b)] = b
        return out, np.repeat(own, times)


@lru_cache(maxsize=1)
def _table(path: str) -> tuple[Lattice, _Solved, dict]:
    lattice = Lattice(path)
    return lattice, _Solved(lattice), {}


def _ways(lattice: Lattice, known: dict, chunk: str, n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best ways of a chunk with unknown characters spelled."""
    found = known.get((chunk, n))
    if found is None:
        found = [(s, lattice.spelled(list(ids), chunk)) for s, ids in lattice.nbest(chunk, n)]
        if len(known) < _WAYS and len(chunk) < WordTable.LONGEST:
            known[chunk, n] = found
    return found


class _Text:
    """The best segmentation of a text, block by block, and the words that lose least by leaving it."""

    def __init__(self, n: int):
        self.n, self.score, self.words, self.pieces = n, 0.0, 0, 0
        self.ids: list[np.ndarray] = []
        self.open: list[tuple[float, int, str, int, int]] = []

    def add(self, chunks: list[str], best: np.ndarray, loss: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """More words: their best scores, losses, and pieces."""
        self.score += float(best.sum())
        self.ids.append(ids)
        if self.n > 1 and len(chunks):
            at = np.flatnonzero(loss <= np.partition(loss, self.n - 1)[self.n - 1]) if len(loss) > self.n else np.arange(len(loss))
            ends = np.cumsum(counts)
            for i in at[np.argsort(loss[at], kind="stable")][: self.n].tolist():
                if loss[i] < np.inf:
                    self.open.append((float(loss[i]), self.words + i, chunks[i], self.pieces + int(ends[i] - counts[i]), int(counts[i])))
            self.open = sorted(self.open)[: self.n]
        self.words += len(chunks)
        self.pieces += len(ids)

    def nbest(self, lattice: Lattice, known: dict) -> Iterator[tuple[float, np.ndarray, bool]]:
        """Score, ids, and whether each changed word still spells the same, of the ``n`` best segmentations, one after the other."""
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32)
        totals: list[tuple[float, int, tuple]] = [(0.0, 0, ())]
        for _, i, chunk, start, count in sorted(self.open, key=lambda x: x[1]):
            ways = _ways(lattice, known, chunk, self.n)
            more = [(lost + ways[0][0] - s, m + 1, (*key, (i, r, start, count, tuple(w), chunk))) for lost, m, key in totals for r, (s, w) in enumerate(ways[1:], 1)]
            totals = nsmallest(self.n, totals + more)
        for lost, _, key in totals:
            own, at, same = [], 0, True
            for _, _, start, count, way, chunk in key:
                own += [ids[at:start], np.array(way, np.int32)]
                at = start + count
                same &= b"".join(map(lattice.raw.__getitem__, way)) == chunk.encode("utf-8", "surrogatepass")
            yield self.score - lost, np.concatenate([*own, ids[at:]]) if own else ids, same


def _solved(texts: list[str], path: str, n: int) -> Iterator[_Text]:
    """The texts in order; a long one is solved block by block, short ones together."""
    lattice, table, _ = _table(path)

    def solve(flat: list[str]) -> tuple[np.ndarray, ...]:
        rows = table.index(pa.array(flat, pa.string()))
        return table.best[rows], table.loss[rows], *table.gather(rows)

    if len(texts) == 1 and len(texts[0]) > TOKEN_SLICE // 4:
        made = _Text(n)
        for block in lattice.blocks(texts[0]):
            made.add(block, *solve(block))
        yield made
        return
    lists = [lattice.chunks(t) for t in texts]
    best, loss, ids, counts = solve([c for x in lists for c in x])
    at = piece = 0
    for own in lists:
        made, end = _Text(n), at + len(own)
        size = int(counts[at:end].sum())
        made.add(own, best[at:end], loss[at:end], ids[piece : piece + size], counts[at:end])
        yield made
        at, piece = end, piece + size


def encode_nbest(text: str, path: str, n: int = NBEST) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of a text with their scores, best first; an empty text has one, without pieces."""
    lattice, _, known = _table(path)
    return [(s, ids.tolist()) for t in _solved([text], path, n) for s, ids, _ in t.nbest(lattice, known)]


def segment(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", n: int = NBEST, ids: bool = False) -> DataFrame:
    """The ``n`` best segmentations of each row.

    Columns: the id, ``n_pieces``, ``n_bytes`` (byte pieces among them) and ``score`` of the
    best one; ``nbest_crc32`` (of little-endian unsigned 32-bit ids) and ``nbest_scores`` of
    all, best first (fewer if the text has fewer); ``round_trip`` (whether decoding each of
    them gives the text; false if it has the space mark itself or lone surrogates); and
    ``nbest_ids`` if asked for. Null and empty texts have one segmentation, without pieces
    and with score 0; repeated rows are each encoded; other columns are ignored; an empty
    table gives no rows. A very long text is solved block by block, and a very long word in
    memory that grows with its length; ties are settled as the module says.
    """
    fields = [
        T.StructField(id_col, typed(docs, id_col)),
        T.StructField("n_pieces", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("nbest_crc32", T.ArrayType(T.LongType())),
        T.StructField("nbest_scores", T.ArrayType(T.DoubleType())),
        T.StructField("round_trip", T.BooleanType()),
    ]
    schema = T.StructType(fields + [T.StructField("nbest_ids", T.ArrayType(T.ArrayType(T.IntegerType())))] * ids)

    def kernel(keys: list, texts: list[str]) -> dict[str, list]:
        lattice, _, known = _table(path)
        is_byte = np.zeros(len(lattice.pieces), bool)
        is_byte[list(lattice.byte_ids.values())] = True
        out: dict[str, list] = {f.name: [] for f in schema.fields}
        for key, text, made in zip(keys, texts, _solved(texts, path, n)):
            scores, sums, every, whole = [], [], [], True
            for k, (score, own, same) in enumerate(made.nbest(lattice, known)):
                scores.append(score)
                sums.append(zlib.crc32(own.astype("<u4").tobytes()))
                whole &= same
                if k == 0:
                    size, n_bytes, whole = len(own), int(np.count_nonzero(is_byte[own])), lattice.decode(own) == text
                if ids:
                    every.append(own.tolist())
            row = (key, size, n_bytes, scores[0], sums, scores, whole, every)
            for name, value in zip(out, row):
                out[name].append(value)
        return out

    return map_texts(docs, id_col, text_col, schema, kernel, limit=TOKEN_SLICE)
