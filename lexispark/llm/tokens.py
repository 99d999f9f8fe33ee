"""Public tokenizers over many texts at once.

The vocabularies used here never join text across the white space that the callers cut at,
so each distinct word of a slice of texts is tokenised once. Nothing is held from slice to
slice but the vocabularies themselves, so a worker's memory doesn't grow with its work.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose words are looked up at once.
TOKEN_SLICE = 2 << 20
#: Byte-pair merging by rows of symbols takes parts of up to so many bytes, and so many symbols at once.
ROW_BYTES = 64
_SYMBOLS = 1 << 19
_NONE = np.iinfo(np.int32).max
_SPACES = re.compile("[\x20\x09-\x0d]+")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts by the rule [^\\x20\\x09-\\x0D]+ (with empty strings at outer white space), and their number by text; a null text has none."""
    lists = pc.ascii_split_whitespace(texts)
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over runs of ``counts`` neighbours."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def stretches(text: str, limit: int) -> Iterator[str]:
    """A text in stretches of about ``limit`` characters that end at white space; a longer word is not cut."""
    at = 0
    while len(text) - at > limit and (space := _SPACES.search(text, at + limit)):
        yield text[at : space.start()]
        at = space.end()
    yield text[at:]


def picked(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[starts[i] : starts[i] + counts[i]]`` for all ``i`` of an index, joined, and their lengths."""
    sizes = counts[index]
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[index] - ends + sizes, sizes)], sizes


class Merges:
    """Byte-pair merging of many short strings at once.

    ``pairs`` are (left, right, made) symbols by rank. Every string is a row of symbols; a
    round merges in each row the leftmost pair of the lowest rank, so all rows are one
    symbol shorter after it; rows without a pair to merge are finished and leave.
    """

    def __init__(self, pairs: np.ndarray):
        self.made = np.ascontiguousarray(pairs[:, 2], np.int32)
        self.keys = pairs[:, 0].astype(np.uint64) << np.uint64(32) | pairs[:, 1].astype(np.uint64)
        self.bits = max(10, int(len(pairs)).bit_length() + 2)
        self.slots, self.next = np.full(1 << self.bits, -1, np.int32), np.full(len(pairs) + 1, -1, np.int32)
        for i, slot in enumerate(self._slot(self.keys).tolist()):
            self.next[i], self.slots[slot] = self.slots[slot], i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, a large number where there is none; negative symbols have none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        found = self.slots[self._slot(keys)]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(wrong):
            found[wrong] = self.next[found[wrong]]
            own = found[wrong]
            wrong = wrong[(own >= 0) & (self.keys[own] != keys[wrong])]
        return np.where(found >= 0, found, _NONE).astype(np.int32)

    def merge(self, rows: np.ndarray) -> np.ndarray:
        """Rows of symbols, -1 at their ends, after all merges."""
        n, width = rows.shape
        out, own = np.full((n, width), -1, np.int32), np.arange(n)
        ranks = self.rank(rows[:, :-1].reshape(-1), rows[:, 1:].reshape(-1)).reshape(n, width - 1)
        while len(own):
            if rows.shape[1] == 1:
                out[own, :1] = rows
                break
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(own)), at]
            done = low == _NONE
            if done.any():
                out[own[done], : rows.shape[1]] = rows[done]
                more = ~done
                rows, ranks, own, at, low = rows[more], ranks[more], own[more], at[more], low[more]
            if not len(own):
                break
            all_ = np.arange(len(own))
            rows[all_, at] = self.made[low]
            places = np.arange(rows.shape[1] - 1)
            rows = np.take_along_axis(rows, places + (places > at[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, places[:-1] + (places[:-1] >= at[:, None]), axis=1)
            for shift, some in ((-1, np.flatnonzero(at > 0)), (0, np.flatnonzero(at < rows.shape[1] - 1))):
                j = at[some] + shift
                ranks[some, j] = self.rank(rows[some, j], rows[some, j + 1])
        return out


@lru_cache(maxsize=1)
def fast_tokenizer(path: str):
    """A tokenizer file of the ``tokenizers`` library; strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


#: Characters of the plain Latin words that are cut and lower-cased here as the tokenizer file says.
_LATIN = "^[!-~\xa1-\xff]+$"
_PARTS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\na-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class FastWords:
    """Token ids of white-space words by a ``tokenizers`` file, for a vocabulary that drops white space.

    Where the file is a byte-level byte-pair model with the lower-casing word splitter that
    ``_SPLIT`` names, plain Latin words are cut here and their distinct parts merged by
    :class:`Merges`; all other words and files go through the library. The file is read
    where this is made; workers get the merges as arrays and open the file only for the rest.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        model = spec["model"]
        vocab = model.get("vocab", {})
        self.size = len(vocab) + len(spec.get("added_tokens", []))
        end, characters = model.get("end_of_word_suffix") or "", _byte_characters()
        self.merges = None
        plain = steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("pattern", {}).get("Regex") == _SPLIT and cuts[-1].get("type") == "ByteLevel"
        plain = plain and model.get("type") == "BPE" and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
        if plain and all(c + e in vocab for c in characters.values() for e in ("", end)):
            pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
            self.merges = Merges(np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3))
            self.first, self.last = (np.array([vocab[characters[b] + e] for b in range(256)], np.int32) for e in ("", end))

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, joined, and the number of tokens of each word."""
        coded = words.dictionary_encode()
        flat, starts, counts = self._distinct(coded.dictionary)
        return picked(flat, starts, counts, coded.indices.to_numpy())

    def ids(self, text: str) -> Iterator[np.ndarray]:
        """Token ids of a text of any length, stretch by stretch."""
        for part in stretches(text, TOKEN_SLICE):
            yield self.lookup(split_words(pa.array([part], pa.string()))[0])[0]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: all joined, and where each word's begin and how many they are."""
        starts, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        plain = np.zeros(len(words), bool)
        if self.merges is not None and len(words):
            plain = pc.match_substring_regex(words, _LATIN).to_numpy(zero_copy_only=False)
        made = np.zeros(0, np.int32)
        at = np.flatnonzero(plain)
        if len(at):
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), words.filter(pa.array(plain))), "\n")
            parts = pa.array(_PARTS.findall(joined[0].as_py().lower()), pa.string()).dictionary_encode()
            index = parts.indices.to_numpy()
            made, sizes = picked(*self._parts(parts.dictionary), index)
            word = np.cumsum(index == pc.index(parts.dictionary, "\n").as_py())
            counts[at] = np.bincount(word, sizes, minlength=len(at)).astype(np.int64)
            starts[at] = np.cumsum(counts[at]) - counts[at]
        rest = np.flatnonzero(~plain)
        if len(rest):
            coded = [e.ids for e in fast_tokenizer(self.path).encode_batch_fast(words.take(pa.array(rest)).to_pylist(), add_special_tokens=False)]
            counts[rest] = list(map(len, coded))
            starts[rest] = len(made) + np.cumsum(counts[rest]) - counts[rest]
            made = np.concatenate([made, np.fromiter(chain.from_iterable(coded), np.int32, int(counts[rest].sum()))])
        return made, starts, counts

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of distinct lower-case parts; the line mark between words has none."""
        parts = parts.cast(pa.large_string())
        offsets = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
        begin, sizes = offsets[:-1], np.diff(offsets)
        data = np.frombuffer(parts.buffers()[2], np.uint8)
        starts, counts = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        flat, total, order = [np.zeros(0, np.int32)], 0, np.argsort(sizes, kind="stable")
        a = 0
        while a < len(order) and sizes[order[a]] <= ROW_BYTES:
            width = int(sizes[order[a]]) + 1  # parts of two lengths share their rows
            b = min(int(np.searchsorted(sizes[order], width, side="right")), a + max(1, _SYMBOLS // width))
            own = order[a:b]
            places, lengths = np.arange(width), sizes[own]
            inside = places < lengths[:, None]
            raw = data[np.minimum(begin[own][:, None] + places, len(data) - 1)]
            rows = np.where(inside, self.first[raw], np.int32(-1))
            rows[np.arange(len(own)), lengths - 1] = self.last[raw[np.arange(len(own)), lengths - 1]]
            rows[raw[:, 0] == 10] = -1
            out = self.merges.merge(rows)
            counts[own] = (out >= 0).sum(axis=1)
            starts[own] = total + np.cumsum(counts[own]) - counts[own]
            flat.append(out[out >= 0])
            total += len(flat[-1])
            a = b
        characters = _byte_characters()
        for i in order[a:].tolist():
            ids = [t.id for t in fast_tokenizer(self.path).model.tokenize("".join(characters[c] for c in data[begin[i] : begin[i] + sizes[i]].tolist()))]
            starts[i], counts[i] = total, len(ids)
            flat.append(np.array(ids, np.int32))
            total += len(ids)
        return np.concatenate(flat), starts, counts


class WordTable:
    """Token ids by word, held from slice to slice up to ``limit`` bytes of words; ``encode`` maps a list of words to a list of id sequences."""

    #: The longest word held, and what a held word costs beside its characters.
    LONGEST, EACH = 48, 128

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], limit: int = 24 << 20):
        self.encode, self.room = encode, limit
        self.rows: dict[str, int] = {"": 0}
        self.ids = np.zeros(1 << 16, np.int32)
        self.offsets = np.zeros(1 << 12, np.int64)

    def index(self, words: pa.Array) -> np.ndarray:
        """Rows of all words; rows beyond the bound hold until the next call only."""
        coded = words.dictionary_encode()
        texts = coded.dictionary.to_pylist()
        rows = self.rows
        found = list(map(rows.get, texts))
        if None in found:
            keep, rest = [], []
            for w, r in zip(texts, found):
                if r is None:
                    cost = self.EACH + len(w)
                    held = len(w) <= self.LONGEST and cost <= self.room
                    self.room -= cost * held
                    (keep if held else rest).append(w)
            order = keep + rest
            first = len(rows)
            self._store(first, order)
            at = {w: first + i for i, w in enumerate(order)}
            found = [at[w] if r is None else r for w, r in zip(texts, found)]
            rows.update((w, at[w]) for w in keep)
        return np.fromiter(found, np.int64, len(found))[coded.indices.to_numpy()]

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of rows, joined, and the number of tokens of each."""
        return picked(self.ids, self.offsets[:-1], np.diff(self.offsets), index)

    def _store(self, row: int, words: list[str]) -> None:
        coded = self.encode(words)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        self._put(row, sizes, np.fromiter(chain.from_iterable(coded), np.int32, int(sizes.sum())))

    def _put(self, row: int, sizes: np.ndarray, ids: np.ndarray) -> None:
        if row + len(sizes) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros(max(len(self.offsets), len(sizes) + 1), np.int64)])
        start = int(self.offsets[row])
        self.offsets[row + 1 : row + 1 + len(sizes)] = start + np.cumsum(sizes)
        if start + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
        self.ids[start : start + len(ids)] = ids


@lru_cache(maxsize=1)
def sentence_processor(path: str):
    """A processor of the ``sentencepiece`` library."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=1)
def ranks_coding(path: str):
    """The coding of a ``tiktoken`` ranks file."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; every operator also takes another path."""
    import public_tokenizers

    return public_tokenizers.path(name)
