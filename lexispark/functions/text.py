"""The text pipeline: split, normalise, stop words, stems.

Splitting, composition (NFC), lower-casing, length and stop words are column expressions.
Accents and stems have no built-in function: they run in one Arrow-batched function on the
arrays of tokens, which sees each distinct token of a batch once.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config, PipelineConfig
from . import stem_en, stem_ru
from .stopwords import BY_LANGUAGE

SEPARATORS = r"[^\p{L}\p{Nd}]+"
_CYRILLIC = r"\p{IsCyrillic}"


def tokens(text: Column) -> Column:
    """Runs of letters and decimal digits, in order; marks and underscores separate."""
    return F.filter(F.split(text, SEPARATORS), lambda t: t != "")


def token_language(term: Column) -> Column:
    """``russian`` if a term has a Cyrillic letter, else ``english``."""
    return F.when(term.rlike(_CYRILLIC), "russian").otherwise("english")


def text_language(text: Column) -> Column:
    """``mixed``, ``russian``, ``english`` or ``unknown`` by the share of Cyrillic and Latin letters."""
    count = lambda letters: F.length(text) - F.length(F.regexp_replace(text, letters + "+", ""))
    cyrillic = count(r"[\p{L}&&\p{IsCyrillic}]")
    latin = count(r"[a-zA-ZÀ-ÖØ-öø-ÿ[\p{L}&&\p{IsLatin}]]")  # the common ones are found before their script is looked up

    def label(n: Column) -> Column:
        total = n["cyrillic"] + n["latin"]
        share = n["cyrillic"] / total
        return (
            F.when(total == 0, "unknown")
            .when((share > 0.2) & (n["latin"] / total > 0.2), "mixed")
            .when(share > 0.5, "russian")
            .otherwise("english")
        )

    # through an array, so that the counts are made once and not in every branch
    return F.transform(F.array(F.struct(cyrillic.alias("cyrillic"), latin.alias("latin"))), label)[0]


@lru_cache(maxsize=1)
def composing() -> str:
    """A character class of letters and digits that composition can change."""
    last = None
    ranges: list[list[int]] = []
    for c in range(0xC0, sys.maxunicode + 1):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L" and not 0xAC00 <= c <= 0xD7A3:
            if unicodedata.normalize("NFC", ch) != ch or 0x1161 <= c <= 0x1175 or 0x11A8 <= c <= 0x11C2:
                if last == c - 1:
                    ranges[-1][1] = c
                else:
                    ranges.append([c, c])
                last = c
    return f"[{_halved(ranges)}]"


def _halved(ranges: list[list[int]]) -> str:
    """Sorted ranges as nested classes: most characters fall out at the first bounds, others after a few halvings, instead of a look at every range."""
    if len(ranges) <= 4:
        return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    half = len(ranges) // 2
    return "".join(f"[\\x{{{part[0][0]:x}}}-\\x{{{part[-1][1]:x}}}&&[{_halved(part)}]]" for part in (ranges[:half], ranges[half:]))


@lru_cache(maxsize=1)
def _singletons() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Letters that composition replaces: by one character each (as two strings), and by several."""
    one, several = [], []
    for c in range(0xC0, sys.maxunicode + 1):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L" and (to := unicodedata.normalize("NFC", ch)) != ch:
            (one if len(to) == 1 else several).append((ch, to))
    return "".join(a for a, _ in one), "".join(b for _, b in one), tuple(several)


def composed(token: Column) -> Column:
    """NFC of a run of letters and digits, with column functions.

    Without combining marks only three things can change: letters that stand for one other,
    letters that stand for a letter with marks, and Hangul parts, which join.
    """
    old, new, several = _singletons()
    token = F.translate(token, old, new)
    for a, b in several:
        token = F.replace(token, F.lit(a), F.lit(b))
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int")
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")

    def join(done: Column, c: Column) -> Column:
        last, head = F.right(done, F.lit(1)), F.substring(done, F.lit(1), F.length(done) - 1)
        syllable = char(F.lit(0xAC00) + ((code(last) - 0x1100) * 21 + code(c) - 0x1161) * 28)
        closed = char(code(last) + code(c) - 0x11A7)
        open_ = last.rlike("^[\\x{AC00}-\\x{D7A3}]$") & ((code(last) - 0xAC00) % 28 == 0)
        return (
            F.when(c.rlike("^[\\x{1161}-\\x{1175}]$") & last.rlike("^[\\x{1100}-\\x{1112}]$"), F.concat(head, syllable))
            .when(c.rlike("^[\\x{11A8}-\\x{11C2}]$") & open_, F.concat(head, closed))
            .otherwise(F.concat(done, c))
        )

    hangul = F.aggregate(F.split(token, ""), F.lit(""), join)
    return F.when(token.rlike("[\\x{1161}-\\x{1175}\\x{11A8}-\\x{11C2}]"), hangul).otherwise(token)


def without_accents(term: str) -> str:
    """Decomposed, without non-spacing marks, composed again."""
    if term.isascii():
        return term
    plain = "".join(c for c in unicodedata.normalize("NFD", term) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", plain)


@lru_cache(maxsize=1 << 12)
def _is_cyrillic(c: str) -> bool:
    return "CYRILLIC" in unicodedata.name(c, "")


def is_cyrillic(term: str) -> bool:
    return not term.isascii() and any(map(_is_cyrillic, term))


def stem(term: str, language: str) -> str:
    """Stem by language; of another language, the term itself."""
    if language == "english":
        return stem_en.stem(term)
    return stem_ru.stem(term) if language == "russian" else term


def stem_any(term: str) -> str:
    return stem(term, "russian" if is_cyrillic(term) else "english")


@dataclass(frozen=True)
class Pipeline:
    """Stages of the pipeline; every stage can be replaced or left out.

    ``split`` maps a text column to an array of tokens; ``stem_with`` maps a term (in
    Python) to its stem. ``forced`` is only the label of a text's language: stop words and
    stems go by each token's own script.
    """

    split: Callable[[Column], Column] = tokens
    normalize: bool = True
    strip_accents: bool = False
    min_length: int = 1
    stop_words: frozenset[str] | None = None
    stem_with: Callable[[str], str] | None = None
    forced: str | None = None

    def language(self, text: Column) -> Column:
        """A text's language label; unknown counts as English unless forced."""
        if self.forced:
            return F.lit(self.forced)
        found = text_language(text)
        return F.when(found == "unknown", "english").otherwise(found)

    def _plain(self, found: Column) -> Column:
        """Stages that column functions can do, on an array of tokens: dropped ones are null."""

        def one(t: Column) -> Column:
            x = F.trim(F.lower(t)) if self.normalize else t
            keep = F.length(x) >= max(1, self.min_length) if self.normalize else F.lit(True)
            if self.stop_words:
                keep = keep & ~x.isin(*sorted(self.stop_words))
            return F.when(keep, x)

        return F.transform(found, one)

    def _whole_text_will_do(self) -> bool:
        """Whether lower-casing is all there is to do, which built-in functions do on the text as a whole."""
        return self.split is tokens and self.normalize and not (self.strip_accents or self.stem_with or self.stop_words) and self.min_length <= 1

    def term(self, token: str) -> str | None:
        """All stages after splitting on one token."""
        if self.normalize:
            token = unicodedata.normalize("NFC", token).lower()
            token = (without_accents(token) if self.strip_accents else token).strip()
            if len(token) < max(1, self.min_length):
                return None
        if self.stop_words and token in self.stop_words:
            return None
        if self.stem_with:
            token = self.stem_with(token)
        return token or None

    def analysed(self, df: DataFrame, text: str = "text", out: str = "terms", positions: bool = True) -> DataFrame:
        """``df`` with an array of terms, one for each token in its place; dropped tokens are null.

        Without ``positions`` each distinct token is analysed once and the order is that of first occurrence.
        """
        found = self.split(F.col(text))
        found = found if positions else F.array_distinct(found)
        if self._whole_text_will_do():
            odd = F.col(text).rlike("[\u0130\u03a3" + composing() + "]")  # NFC, or lower case that looks at its neighbours
            low = F.array_remove(F.split(F.lower(F.col(text)), SEPARATORS), "")
            slow = self._plain(F.transform(found, composed))
            return df.withColumn(out, F.when(odd, slow).otherwise(low if positions else F.array_distinct(low)))
        if not self.stem_with and not (self.strip_accents and self.normalize):
            if self.normalize:
                found = F.when(F.col(text).rlike(composing()), F.transform(found, composed)).otherwise(found)
            return df.withColumn(out, self._plain(found))
        return df.withColumn(out, self._function()(found))

    def _function(self):
        own = self

        @F.arrow_udf("array<string>")
        def analyse(batch: pa.Array) -> pa.Array:
            return _mapped(batch, own)

        return analyse

    def terms_of(self, text: str) -> list[str]:
        """Distinct terms of a query string, in order, on the driver."""
        found, own = [], []
        for c in text:
            if c.isalpha() or c.isdecimal():
                own.append(c)
            elif own:
                found.append("".join(own))
                own = []
        found += ["".join(own)] if own else []
        return list(dict.fromkeys(t for t in map(self.term, found) if t))


def process(df: DataFrame, pipeline: Pipeline, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang, terms`` (distinct, by first occurrence) and ``tokens`` (``position, term``) of each text."""
    done = pipeline.analysed(df.select(F.col(id_col), F.col(text_col).alias("text")))
    placed = F.filter(F.transform("terms", lambda t, i: F.struct(i.alias("position"), t.alias("term"))), lambda x: x["term"].isNotNull())
    return done.select(id_col, pipeline.language(F.col("text")).alias("lang"), F.array_distinct(F.filter("terms", lambda t: t.isNotNull())).alias("terms"), placed.alias("tokens"))


def stop_words(custom: dict[str, Iterable[str]] | None = None) -> frozenset[str]:
    """Built-in and extra stop words. Scripts differ, so one set serves all tokens."""
    custom = custom or {}
    return frozenset().union(*BY_LANGUAGE.values(), *(set(w) for w in custom.values()))


def is_stop_word(term: str, language: str, custom: dict[str, Iterable[str]] | None = None) -> bool:
    """Exact match in a language's list; a language without a list has no stop words."""
    return term in BY_LANGUAGE.get(language, ()) or term in (custom or {}).get(language, ())


def pipeline(config: Config, stages: PipelineConfig) -> Pipeline:
    """The pipeline that a configuration asks for."""
    custom = {"english": config.custom_stop_words.english, "russian": config.custom_stop_words.russian}
    return Pipeline(
        normalize=stages.normalize,
        strip_accents=stages.strip_accents,
        min_length=stages.min_term_length,
        stop_words=stop_words(custom) if stages.stop_words else None,
        stem_with=stem_any if stages.stemming else None,
        forced=None if config.language == "auto" else config.language,
    )


#: Distinct tokens of which a worker remembers the terms, and tokens that it handles at once.
REMEMBERED, TOKENS = 1 << 17, 1 << 19


@lru_cache(maxsize=1)
def _remembered(pipeline: Pipeline) -> dict[str, str | None]:
    """Terms by token in this worker."""
    return {}


def _mapped(batch: pa.Array, pipeline: Pipeline) -> pa.Array:
    """The terms of arrays of tokens. Tokens stay in Arrow's memory, only distinct ones become Python's strings."""
    known = _remembered(pipeline)
    starts = batch.offsets.to_numpy()
    values = batch.values
    pieces = []
    at = int(starts[0])
    while at < int(starts[-1]):
        to = min(at + TOKENS, int(starts[-1]))
        coded = values.slice(at, to - at).dictionary_encode()
        if len(known) > REMEMBERED:
            known.clear()
        found = []
        for token in coded.dictionary.to_pylist():
            if token not in known:
                known[token] = pipeline.term(token)
            found.append(known[token])
        pieces.append(pa.array(found, pa.string()).take(coded.indices))
        at = to
    terms = pa.concat_arrays(pieces) if pieces else pa.array([], pa.string())
    return pa.ListArray.from_arrays(pa.array(starts - starts[0], pa.int32()), terms, mask=batch.is_null() if batch.null_count else None)


PLAIN = Pipeline()
FULL = replace(PLAIN, stop_words=stop_words(), stem_with=stem_any)
