"""Quality rules: tokeniser fertility beside counts of words, symbols and repeats.

Public vocabularies measure each text: characters per token in two of them, the share of
byte-fallback tokens, and the entropy of the token distribution. Text that a vocabulary was
not made for (symbol noise, shouting, menus, broken encodings) needs more tokens for its
characters; text that repeats itself has little entropy. Bands by language, or else by
script, say what is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _arrow_schema, passed_on, slices, typed, words_of
from .hashing import mix, windows, word_hashes
from .tokens import by_text, picked, ranks_coding, sentence_processor, split_words, stretches, vocabulary

#: Bytes of text handled at once.
_SLICE = 1 << 20
WINDOW = 5
#: Characters of a text that are tokenised at once, and of a word: a longer one counts as several of so many.
_STRETCH, _WORD = 1 << 18, 4096


@dataclass(frozen=True)
class Band:
    """What is kept: at least so many characters per token of the two vocabularies, at most such a byte share, at least such an entropy.

    Entropy is divided by that of as many different tokens, up to ``FULL`` of them.
    """

    pieces: float
    ranks: float
    bytes: float
    entropy: float


#: By language; fitted once to labelled documents so that about 1 % of the good ones fall below a bound.
LANGUAGES = {"en": Band(2.07, 1.98, 0.2, 0.62), "de": Band(2.08, 1.98, 0.2, 0.62), "fr": Band(1.885, 1.8, 0.2, 0.62), "es": Band(1.845, 1.8, 0.2, 0.62)}
#: By script, for texts whose language is unknown or has no band.
SCRIPTS = {"latin": Band(1.8, 1.75, 0.3, 0.6), "cyrillic": Band(1.5, 1.2, 0.3, 0.6), "other": Band(0.3, 0.3, 0.97, 0.5)}
FULL = 512
#: Measures of a short text scatter: the lower bounds give way by this over the root of its tokens.
SLACK = 0.3

_SCRIPT = np.zeros(256, np.int8)  # 0: no letter, or a continuation byte
_SCRIPT[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCB)]] = 1
_SCRIPT[0xD0:0xD5] = 2
_SCRIPT[[*range(0xCC, 0xD0), *range(0xD5, 0xF5)]] = 3


def script(text: str) -> str:
    """The script of most letters of a text."""
    counts = np.bincount(_SCRIPT[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=4)[1:]
    return ("latin", "cyrillic", "other")[int(counts.argmax())]


def repeated_words(hashes: np.ndarray, first: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """By text, the words that lie in a ``k``-word window that its text has twice or more."""
    runs = windows(hashes, k)
    if not len(runs):
        return np.zeros(len(first) - 1, np.int64)
    if len(first) == 2:
        keys, at = runs, None
    else:
        own = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = np.flatnonzero(own[: len(runs)] == own[k - 1 :])
        keys = mix(runs[at] + own[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.sort(keys)
    several = np.unique(order[1:][order[1:] == order[:-1]])
    cover = np.zeros(len(hashes) + 1, np.int8)
    if len(several):
        place = np.minimum(np.searchsorted(several, keys), len(several) - 1)
        twice = np.flatnonzero(several[place] == keys)
        twice = twice if at is None else at[twice]
        for i in range(k):
            cover[twice + i] = 1
    return by_text(cover[:-1], np.diff(first))


def _cut(word: str) -> str:
    """A word, or a very long one as several with spaces between."""
    return word if len(word) <= _WORD else " ".join(word[a : a + _WORD] for a in range(0, len(word), _WORD))


def _piece_ids(texts: list[str], processor) -> tuple[list[np.ndarray], np.ndarray]:
    """Piece ids of each text, of which each distinct word is encoded once, and the characters in its words."""
    words, per_text = split_words(pa.array(texts, pa.string()))
    coded = words.dictionary_encode()
    made = processor.encode([_cut(w) for w in coded.dictionary.to_pylist()], num_threads=1)
    sizes = np.fromiter(map(len, made), np.int64, len(made))
    flat = np.fromiter(chain.from_iterable(made), np.int32, int(sizes.sum()))
    ids, counts = picked(flat, np.cumsum(sizes) - sizes, sizes, coded.indices.to_numpy())
    return np.split(ids, np.cumsum(by_text(counts, per_text))[:-1]), by_text(pc.utf8_length(words).to_numpy(), per_text)


def fertility(texts: list[str], pieces: str, ranks: str) -> dict[str, np.ndarray]:
    """Of each text: tokens, characters per token in both vocabularies, byte share and entropy; a word counts with a space before it."""
    processor, coding = sentence_processor(pieces), ranks_coding(ranks)
    is_byte = np.fromiter(map(processor.is_byte, range(processor.vocab_size())), bool)
    tokens, others, characters, in_bytes = (np.zeros(len(texts), np.int64) for _ in range(4))
    entropy, times = np.zeros(len(texts)), [np.zeros(1, np.int64)] * len(texts)
    long = len(texts) == 1 and len(texts[0]) > 2 * _STRETCH
    for group in ([part] for part in stretches(texts[0], _STRETCH)) if long else [texts]:
        found, sizes = _piece_ids(group, processor)
        characters += sizes
        for k, (text, ids) in enumerate(zip(group, found)):
            own = np.bincount(ids, minlength=len(times[k]))
            own[: len(times[k])] += times[k]
            times[k] = own
            joined = " ".join(map(_cut, words_of(text)))
            others[k] += len(coding.encode_ordinary(" " + joined)) if joined else 0
    for k, own in enumerate(times):
        tokens[k] = own.sum()
        in_bytes[k] = own[is_byte[: len(own)]].sum()
        share = own[own > 0] / max(1, tokens[k])
        entropy[k] = -(share * np.log2(share)).sum()
    some = np.maximum(tokens, 1)
    return {
        "n_tokens": tokens,
        "pieces": characters / some,
        "ranks": characters / np.maximum(others, 1),
        "bytes": in_bytes / some,
        "entropy": entropy / np.log2(np.clip(tokens, 2, FULL)),
    }


def reasons(measured: dict[str, float], band: Band) -> list[str]:
    """Names of the measures outside the band."""
    give = 1 - SLACK / max(1.0, measured["n_tokens"]) ** 0.5
    low = [m for m in ("pieces", "ranks", "entropy") if measured[m] < getattr(band, m) * give]
    return low + ["bytes"] * (measured["bytes"] > band.bytes)


def rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    pieces: str | None = None,
    ranks: str | None = None,
    languages: dict[str, Band] = LANGUAGES,
    scripts: dict[str, Band] = SCRIPTS,
    passing: tuple[str, ...] = (),
) -> DataFrame:
    """Counts, measures and verdict of each row.

    Columns: the id, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long),
    ``base_failed`` (under 10 words, or over a fifth of them in repeated windows), ``kept``,
    ``n_tokens``, the measures (double), ``rejected_by`` (comma-joined), then the columns
    named in ``passing`` as they came. A null or empty text has no words and fails; a null
    or unknown language is judged by its script; repeated rows are each judged; other
    columns are ignored; an empty table gives no rows. A very long text is hashed and
    tokenised in stretches (about 6 bytes of memory for each of its bytes); a word of more
    than 4,096 characters is tokenised as several of so many.
    """
    pieces, ranks = pieces or vocabulary("piece_bpe_32k.model"), ranks or vocabulary("byte_bpe_multi_50k.tiktoken")
    count_names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    measures = ("pieces", "ranks", "bytes", "entropy")
    schema = T.StructType(
        [T.StructField(id_col, typed(docs, id_col))]
        + [T.StructField(c, T.LongType()) for c in count_names]
        + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
        + [T.StructField("n_tokens", T.LongType())]
        + [T.StructField(f"fertility_{c}", T.DoubleType()) for c in measures]
        + [T.StructField("rejected_by", T.StringType())]
        + [T.StructField(f"_passing_{c}", typed(docs, c)) for c in passing]
    )

    sent, take = passed_on(docs, text_col, passing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow_schema(schema)
        for piece in slices(batches, limit=_SLICE):
            column = pc.fill_null(piece.column(1), "")
            texts = column.to_pylist()
            hashes, first, points = word_hashes(texts, fold=False)
            n_words = np.diff(first)
            lines = [[x for x in t.split("\n") if x.strip(" \t\n\v\f\r")] for t in texts]
            counts = {
                "n_words": n_words,
                "word_chars": by_text(points, n_words),
                "n_symbols": np.array([sum(map(t.count, "#*$%&|<>")) for t in texts], np.int64),
                "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
                "n_repeat_words": repeated_words(hashes, first),
            }
            failed = (n_words < 10) | (100 * counts["n_repeat_words"] > 20 * n_words)
            found = fertility(texts, pieces, ranks)
            rejected = []
            for i, (lang, text) in enumerate(zip(piece.column(2).to_pylist(), texts)):
                band = languages.get(lang) or scripts[script(text)]
                rejected.append(",".join(reasons({k: float(v[i]) for k, v in found.items()}, band)))
            kept = ~failed & np.array([not r for r in rejected])
            out = [piece.column(0), *(pa.array(counts[c]) for c in count_names), pa.array(failed), pa.array(kept), pa.array(found["n_tokens"])]
            out += [pa.array(found[c]) for c in measures] + [pa.array(rejected), *take(piece, 3)]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, arrow)], schema=arrow)

    lang = docs[f"`{lang_col}`"].cast("string") if lang_col else F.lit(None).cast("string")
    own = docs.select(docs[f"`{id_col}`"].alias("_id"), docs[f"`{text_col}`"].cast("string").alias("_text"), lang.alias("_lang"), *sent)
    return own.mapInArrow(run, schema)
