"""Answers: immutable, chainable sets of documents."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from .engine import Engine


class Result:
    """A set of documents; every operation gives another one and runs nothing."""

    def __init__(self, ids: DataFrame, engine: Engine):
        self.ids, self.engine = ids, engine

    def and_result(self, other: Result) -> Result:
        return Result(self.ids.join(other.ids, "doc_id", "left_semi"), self.engine)

    def or_result(self, other: Result) -> Result:
        return Result(self.ids.union(other.ids).distinct(), self.engine)

    def not_result(self, other: Result) -> Result:
        return Result(self.ids.join(other.ids, "doc_id", "left_anti"), self.engine)

    def and_(self, *terms: str) -> Result:
        """Those that a search for all terms finds too: unknown terms are left out there, and no terms find nothing."""
        return self.and_result(self.engine.search(*terms))

    def or_(self, *terms: str) -> Result:
        found = self
        for t in terms:
            found = found.or_result(self.engine.search(t))
        return found

    def not_(self, *terms: str) -> Result:
        found = self
        for t in terms:
            found = found.not_result(self.engine.search(t))
        return found

    def is_empty(self) -> bool:
        return self.ids.isEmpty()

    def count(self) -> int:
        return self.ids.count()

    def doc_ids(self) -> DataFrame:
        return self.ids.orderBy("doc_id")

    def documents(self) -> DataFrame:
        """The documents themselves, by id; ids without a document are left out."""
        return self.engine.docs.join(self.ids, "doc_id", "left_semi").drop("text").orderBy("doc_id")
