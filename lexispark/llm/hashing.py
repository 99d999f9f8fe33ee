"""Vectorised word and shingle hashing over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes hashed at once.
_BLOCK = 1 << 19
_WHITE = re.compile(rb"[\x20\x09-\x0d]")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _hashed(raw: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`word_hashes`, of at most ``_BLOCK`` bytes or so."""
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=bounds[1:])
    first = np.searchsorted(starts, bounds + 1)
    up, down = _powers(2 * _BLOCK)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data] if fold else data).astype(np.uint64) * up[: len(data)] + up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    points = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    return hashes, first, points[ends] - points[starts]


def _long_word(word: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and code points of one word of any length."""
    total, points, up = 0, 0, _powers(2 * _BLOCK)[0][:_BLOCK]
    for a in range(0, len(word), _BLOCK):
        data = np.frombuffer(word, np.uint8, min(_BLOCK, len(word) - a), a)
        own = int(((_LOWER[data] if fold else data).astype(np.uint64) * up[: len(data)] + up[: len(data)]).sum(dtype=np.uint64))
        total = (total + own * pow(_BASE, a, 1 << 64)) & (1 << 64) - 1
        points += int(((data & 0xC0) != 0x80).sum())
    return mix(np.array([total], np.uint64)), np.array([points])


def _long_text(raw: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and code points of the words of a text of any length, block by block."""
    hashes, points, at = [], [], 0
    while at < len(raw):
        space = _WHITE.search(raw, at + _BLOCK // 2)
        end = space.start() if space else len(raw)
        middle = end
        if end - at > _BLOCK:  # its last word is long
            middle = max(raw.rfind(c, at, at + _BLOCK // 2) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) + 1 or at
        own, _, size = _hashed([raw[at:middle]], fold)
        hashes.append(own)
        points.append(size)
        if middle < end:
            own, size = _long_word(raw[middle:end], fold)
            hashes.append(own)
            points.append(size)
        at = end
    return np.concatenate(hashes), np.concatenate(points)


def word_hashes(texts: list[str], fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of all texts, the first word's index of each text (with the end), and each word's code points.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; ``fold`` lower-cases A-Z first.
    Texts are hashed in blocks, so that beside the texts only their words' numbers are held.
    """
    hashes, points, counts, group, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [0], [], 0

    def close() -> None:
        nonlocal size
        if group:
            own, first, n = _hashed(group, fold)
            hashes.append(own)
            points.append(n)
            counts.extend(np.diff(first).tolist())
            group.clear()
            size = 0

    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        if size + len(raw) > _BLOCK:
            close()
        if len(raw) > _BLOCK:
            own, n = _long_text(raw, fold)
            hashes.append(own)
            points.append(n)
            counts.append(len(own))
        else:
            group.append(raw)
            size += len(raw) + 1
    close()
    return np.concatenate(hashes), np.cumsum(counts), np.concatenate(points)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` neighbouring words (runs across texts too; callers cut those)."""
    if len(hashes) < k:
        return hashes[:0]
    out = hashes[: len(hashes) - k + 1].copy()
    for i in range(1, k):
        out = out * _STEP + hashes[i : len(hashes) - k + 1 + i]
    return mix(out)


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``k``-word shingle hashes of each text, joined, and their offsets.

    A text of 1 to k-1 words has its whole word sequence as one shingle; one without words has none.
    """
    hashes, first, _ = word_hashes(texts)
    runs = windows(hashes, k)
    found = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            found.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                short = mix(short * _STEP + h)
            found.append(short)
        else:
            found.append(hashes[:0])
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(f) for f in found], out=offsets[1:])
    return (np.concatenate(found) if found else hashes[:0]), offsets
