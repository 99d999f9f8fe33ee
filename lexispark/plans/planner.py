"""From a syntax tree to one DataFrame plan.

NOT only takes from what stands left of it, so every answer lies in the union of the leaves'
answers. A query therefore scans the postings once under the OR of its leaf predicates,
which reach the files as filters, aggregates one flag for each leaf and document (partly
before the one shuffle), and keeps the documents whose flags make the expression true.
Date leaves are predicates on the documents, to which the flags are joined. Where the
index has a table of its terms, patterns are matched on that, and the postings are joined
with the terms found; a literal start of a pattern still reaches the files as a filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, kgrams
from .parser import And, AndNot, DateRange, Node, Or, Prefix, Term, Wildcard


def leaf_predicate(node: Node, strict: bool = True) -> Column:
    """The predicate on ``term`` of a prefix or pattern, both only lower-cased.

    A pattern without grams finds nothing, as the gram index would have it, unless ``strict`` is off.
    """
    if isinstance(node, Prefix):
        return F.startswith(F.col("term"), F.lit(node.prefix.lower()))
    pattern = node.pattern.lower()
    if strict and not kgrams.pattern_grams(pattern):
        return F.lit(False)
    return kgrams.matching(F.col("term"), pattern)


def leaf_start(node: Prefix | Wildcard) -> str:
    """What every term that fits a prefix or pattern starts with."""
    return (node.prefix if isinstance(node, Prefix) else node.pattern.split("*")[0]).lower()


def known(terms: DataFrame, wanted: list[str]) -> list[str]:
    """Those of a few terms that occur at all, in their order; ``terms`` is an index's table of terms, or else its postings."""
    found = {r["term"] for r in terms.where(F.col("term").isin(*wanted)).select("term").distinct().collect()}
    return [t for t in wanted if t in found]


class Plan:
    """Leaf predicates of a tree and the expression over their flags."""

    def __init__(self, tree: Node, postings: DataFrame, terms_of, strict: bool = True, terms: DataFrame | None = None):
        self.postings, self.terms_of, self.strict, self.terms = postings, terms_of, strict, terms
        self.starts: dict[str, Column] = {}
        self.patterns = False
        self.leaves: dict[str, Column] = {}
        self.dates: dict[str, Column] = {}
        self._names: dict[Node | str, str] = {}
        self.expression = self._visit(tree)

    def _flag(self, key: Node | str, predicate: Column) -> Column:
        name = self._names.setdefault(key, f"f{len(self._names)}")
        self.leaves[name] = predicate
        return F.col(name)

    def _visit(self, node: Node) -> Column:
        if isinstance(node, And):
            return self._visit(node.left) & self._visit(node.right)
        if isinstance(node, Or):
            return self._visit(node.left) | self._visit(node.right)
        if isinstance(node, AndNot):
            return self._visit(node.left) & ~self._visit(node.right)
        if isinstance(node, DateRange):
            name = self._names.setdefault(node, f"f{len(self._names)}")
            self.dates[name] = dates.in_range(node.kind, node.start, node.end)
            return F.col(name)
        if isinstance(node, Term):
            return self._words(self.terms_of(node.raw))
        self.patterns |= isinstance(node, Wildcard)
        found = self._flag(node, leaf_predicate(node, self.strict))
        self.starts[self._names[node]] = F.startswith(F.col("term"), F.lit(leaf_start(node)))
        return found

    def _words(self, terms: list[str]) -> Column:
        # one term: an unknown one is simply false; of several, the unknown ones are left out
        terms = terms if len(terms) < 2 else known(self.postings if self.terms is None else self.terms, terms)
        if not terms:
            return F.lit(False)
        return reduce(lambda a, b: a & b, (self._flag(t, F.col("term") == t) for t in terms))

    def documents(self, docs: DataFrame) -> DataFrame:
        """``doc_id`` of the documents that the tree finds."""
        if self.leaves:
            wanted = reduce(lambda a, b: a | b, self.leaves.values())
            if self.patterns and self.terms is not None:
                start = reduce(lambda a, b: a | b, (self.starts.get(n, p) for n, p in self.leaves.items()))
                fitting = self.terms.where(start & wanted).select("term", *(p.alias(n) for n, p in self.leaves.items()))
                flags = self.postings.where(start).join(fitting, "term").groupBy("doc_id").agg(*(F.max(n).alias(n) for n in self.leaves))
            else:
                flags = self.postings.where(wanted).groupBy("doc_id").agg(*(F.max(p).alias(n) for n, p in self.leaves.items()))
        else:
            flags = None
        if not self.dates:
            return docs.select("doc_id").where(F.lit(False)) if flags is None else flags.where(self.expression).select("doc_id")
        base = docs.select("doc_id", *(p.alias(n) for n, p in self.dates.items()))
        if flags is not None:
            base = base.join(flags, "doc_id", "left").fillna(False, list(self.leaves))
        return base.where(self.expression).select("doc_id")


def chain(tree: Node, evaluate) -> DataFrame:
    """The same answer by semi-joins, unions and anti-joins of leaf answers ``evaluate(leaf)``; for tests and for :class:`Result`."""
    if isinstance(tree, And):
        return chain(tree.left, evaluate).join(chain(tree.right, evaluate), "doc_id", "left_semi")
    if isinstance(tree, Or):
        return chain(tree.left, evaluate).union(chain(tree.right, evaluate)).distinct()
    if isinstance(tree, AndNot):
        return chain(tree.left, evaluate).join(chain(tree.right, evaluate), "doc_id", "left_anti")
    return evaluate(tree)
