"""Grams of terms and patterns, and wildcard matching."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

K = 2
EDGE = "$"


def grams(term: Column, k: int = K) -> Column:
    """Overlapping grams of a term between edge marks, with repeats; all of it if shorter."""
    padded = F.concat(F.lit(EDGE), term, F.lit(EDGE))
    count = F.length(padded) - k + 1
    return F.when(count < 1, F.array(padded)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(padded, i, F.lit(k))))


def pattern_grams(pattern: str, k: int = K) -> list[str]:
    """Distinct grams that every term matching a pattern has; parts too short give none."""
    parts = pattern.split("*")
    parts[0] = EDGE + parts[0]
    parts[-1] += EDGE
    return list(dict.fromkeys(p[i : i + k] for p in parts for i in range(len(p) - k + 1)))


def matches(term: str, pattern: str) -> bool:
    """Whether a whole term fits a pattern in which each ``*`` stands for any run of characters."""
    return re.fullmatch("(?s)" + ".*".join(map(re.escape, pattern.split("*"))), term) is not None


def matching(term: Column, pattern: str) -> Column:
    """The same on a column."""
    quoted = ("\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E" if p else "" for p in pattern.split("*"))
    return term.rlike("(?s)^" + ".*".join(quoted) + "\\z")
