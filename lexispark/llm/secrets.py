"""Secret scans: an Aho-Corasick keyword prefilter, anchored regular expressions at hits, checksums.

One automaton over all keywords finds the only places where a keyed kind can start. The
kind's expression is then matched anchored at that place, so no expression is ever searched
for in running text (but for plain hexadecimal runs, which have no keyword). Kinds whose
format embeds a checksum or a checkable header are kept only if it holds; private key
blocks have no such sum and are kept if their marks fit and their body is whole base 64.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts, slices, typed


@dataclass(frozen=True)
class Kind:
    """``keywords`` (lower case) start a match of ``pattern``; ``valid`` says whether a match is kept."""

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]


_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_B32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def base62_crc32(body: str, width: int = 6) -> str:
    """CRC32 of ``body`` in base 62, padded with zeros: the last digits of several forges' tokens."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _B62[r] + out
    return out.rjust(width, "0")


def _crc_suffix(m: re.Match) -> bool:
    return base62_crc32(m[1]) == m[2]


def _base58check(m: re.Match) -> bool:
    n = 0
    for c in m[0]:
        n = n * 58 + _B58.index(c)
    raw = n.to_bytes(82 if m[0][0] == "x" else (n.bit_length() + 7) // 8, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _bech32(m: re.Match) -> bool:
    text = m[0].lower()
    prefix, _, data = text.rpartition("1")
    if m[0] not in (text, m[0].upper()):
        return False
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [_B32.index(c) for c in data]
    check = 1
    for v in values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    return check == 1


def _web_token(m: re.Match) -> bool:
    head = m[0].split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


#: The base kinds that have keywords; hex has none and is found by its run.
ASSIGN = Kind(
    "assign",
    ("password", "passwd", "secret", "token", "apikey", "api_key"),
    re.compile("((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII),
    lambda m: len(m[2]) >= 6,
)
ACCESS = Kind("access", ("akia",), re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20)
HEX = re.compile("[0-9a-f]{24,}")
#: What the method adds. Each has a checksum or a header that can be checked. Left edges and
#: lengths are bounded, so that a text full of hits still takes time in proportion to it.
MORE = (
    Kind("forge", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), re.compile("(?:gh[opsur]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _crc_suffix),
    Kind("wallet", ("xprv",), re.compile("xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])"), _base58check),
    Kind("agekey", ("age-secret-key-1",), re.compile("(?:AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}|age-secret-key-1[02-9ac-hj-np-z]{58})(?![A-Za-z0-9])"), _bech32),
    Kind("nsec", ("nsec1",), re.compile("nsec1[02-9ac-hj-np-z]{58}(?![A-Za-z0-9])"), _bech32),
    Kind("webtoken", ("eyj",), re.compile("(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]{20,}"), _web_token),
)
#: Private key blocks: found from both their marks, which the automaton gives, so that a block may have any length.
_BEGIN = re.compile("-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----")
_END = re.compile("-----END ((?:[A-Z]+ )*PRIVATE KEY)-----")
_NOT_KEY = re.compile("[^A-Za-z0-9+/=:,\\s-]")
_LEAST_KEY = 64
KINDS = (ASSIGN, ACCESS, *MORE)
_PEM_BEGIN, _PEM_END = len(KINDS), len(KINDS) + 1
#: Order of kinds that start at one place: the base ones as their contract lists them, then the added ones.
ORDER = ("assign", "access", "hex", *(k.name for k in MORE), "pem")
BASE = ("assign", "access", "hex")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    owners: dict[str, list[int]] = {}
    for i, kind in enumerate(KINDS):
        for word in kind.keywords:
            owners.setdefault(word, []).append(i)
    owners |= {"-----begin ": [_PEM_BEGIN], "-----end ": [_PEM_END]}
    for word, kinds in owners.items():
        found.add_word(word, (len(word), kinds))
    found.make_automaton()
    return found


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def find(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of all secrets of a text in code points, by start and then kind.

    Of one kind, matches are leftmost and don't overlap; a match that fails its check is
    dropped after it has taken its place, and nothing inside it is tried again.
    """
    low = text.lower()
    if len(low) != len(text):  # some letters lower-case to two characters
        low = text.translate(_ASCII_LOWER)
    spans, taken = [], [0] * len(KINDS)
    hits = sorted((end + 1 - n, i) for end, (n, kinds) in _automaton().iter(low) for i in kinds)
    for start, i in hits:
        if i >= _PEM_BEGIN or start < taken[i]:
            continue
        kind = KINDS[i]
        if m := kind.pattern.match(text, start):
            taken[i] = m.end()
            if kind.valid(m):
                spans.append((start, ORDER.index(kind.name), m.end()))
    if any(i == _PEM_BEGIN for _, i in hits):
        spans += [(a, ORDER.index("pem"), b) for a, b in _keys(text, [a for a, i in hits if i == _PEM_BEGIN], [a for a, i in hits if i == _PEM_END])]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, ORDER[k], b) for a, k, b in sorted(spans)]


def _keys(text: str, begins: list[int], ends: list[int]) -> Iterator[tuple[int, int]]:
    """Private key blocks: a BEGIN mark, then the nearest END mark of the same label with ``_LEAST_KEY`` characters of a key between.

    Each character between marks is looked at once, however many marks there are.
    """
    closing: dict[str, list[re.Match]] = {}
    for at in ends:
        if m := _END.match(text, at):
            closing.setdefault(m[1], []).append(m)
    starts = {label: [m.start() for m in found] for label, found in closing.items()}
    taken = wrong = 0
    for at in begins:
        m = _BEGIN.match(text, at) if at >= taken else None
        if not m or m[1] not in closing:
            continue
        k = bisect_left(starts[m[1]], m.end() + _LEAST_KEY)
        if k == len(starts[m[1]]):
            continue
        end = closing[m[1]][k]
        if wrong < m.end():  # the next character that no key has, not yet known
            found = _NOT_KEY.search(text, m.end())
            wrong = found.start() if found else len(text)
        if wrong >= end.start() and _is_base64(text[m.end() : end.start()]):
            yield at, end.end()
            taken = end.end()


def _is_base64(body: str) -> bool:
    """Whether the lines of a key block without the header lines (``Name: value``) are whole base 64."""
    plain = "".join("".join(line.split()) for line in body.splitlines() if ":" not in line)
    return len(plain) % 4 == 0 and re.fullmatch("[A-Za-z0-9+/]+={0,2}", plain) is not None


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each run of overlapping spans replaced by a mark with the first span's kind."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans array<struct<kind,start,end>>, redacted`` of each row.

    A null or empty text has no spans (and a null redacted text if it was null). Rows with
    one id, or a null id, are each scanned; other columns are ignored; no rows give no rows.
    A text of any length is scanned whole, in time in proportion to it.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField(id_col, typed(docs, id_col)), T.StructField("spans", T.ArrayType(span)), T.StructField("redacted", T.StringType())])

    def kernel(ids: list, texts: list) -> dict[str, list]:
        found = [find(t or "") for t in texts]
        return {
            id_col: ids,
            "spans": [[{"kind": k, "start": a, "end": b} for a, k, b in f] for f in found],
            "redacted": [None if t is None else redact(t, f) for t, f in zip(texts, found)],
        }

    return map_texts(docs, id_col, text_col, schema, kernel, keep_null=True)


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with secrets in the text replaced by marks; a null text stays null.

    ``length_col``, if given, becomes the new text's length in code points (null for null).
    """
    fields = docs.schema.fieldNames()
    text_at, length_at = fields.index(text_col), fields.index(length_col) if length_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, column=text_at):
            texts = [None if t is None else redact(t, find(t)) for t in piece.column(text_at).to_pylist()]
            columns = list(piece.columns)
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if length_at is not None:
                columns[length_at] = pa.array([None if t is None else len(t) for t in texts], columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=piece.schema)

    schema = T.StructType([T.StructField(f.name, f.dataType, f.nullable or f.name == length_col) for f in docs.schema.fields])
    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans of each row; empty texts as in :func:`scan`."""
    schema = T.StructType(
        [T.StructField(id_col, typed(docs, id_col))]
        + [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
        + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    )

    def kernel(ids: list, texts: list) -> dict[str, list]:
        found = [find(t) for t in texts]
        base = [[s for s in f if s[1] in BASE] for f in found]
        return (
            {id_col: ids}
            | {f"n_{k}": [sum(s[1] == k for s in b) for b in base] for k in BASE}
            | {"base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], "spans": [joined(f) for f in found]}
        )

    return map_texts(docs, id_col, text_col, schema, kernel)
