"""Dates of documents and ranges over them."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("DATE", "VALID", "APPEARED")


def parse(text: str, name: str) -> datetime.date:
    """A strict ``YYYY-MM-DD`` date of a query; anything else raises."""
    try:
        if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
            raise ValueError
        return datetime.date.fromisoformat(text)
    except ValueError:
        raise ValueError(f'bad \'{name}\' date "{text}"') from None


def parsed(text: Column) -> Column:
    """A strict date of a metadata column; anything else is null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def in_range(kind: str, start: str, end: str) -> Column:
    """The predicate of a date range on ``date``, ``start_date`` and ``end_date``.

    A document without an end is valid for ever; one without a start never is. A range that
    ends before it starts has nothing, but for VALID, where it asks for what covers both ends.
    """
    a, b = F.lit(parse(start, "from")), F.lit(parse(end, "to"))
    if kind == "DATE":
        found = F.col("date").between(a, b)
    elif kind == "VALID":
        found = (F.col("start_date") <= b) & ((F.col("end_date") >= a) | F.col("end_date").isNull())
    else:
        found = F.col("start_date").between(a, b)
    return F.coalesce(found, F.lit(False))


def at_most(date: Column, end: str) -> Column:
    """Whether a date is not after a day; a null one isn't."""
    return F.coalesce(date <= F.lit(parse(end, "to")), F.lit(False))


def at_least(date: Column, start: str) -> Column:
    """Whether a date is not before a day; a null one isn't."""
    return F.coalesce(date >= F.lit(parse(start, "from")), F.lit(False))


def day(date: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(date).cast("long")
