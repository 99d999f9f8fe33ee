"""The search engine: documents in, boolean queries out."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as configs
from .functions import dates, text
from .operators import index
from .plans.parser import DateRange, Prefix, Wildcard, parse
from .plans.planner import Plan, known, leaf_predicate, leaf_start
from .result import Result
from .sources import documents as sources
from .storage import Manifest, delete, size_of


@dataclass(frozen=True)
class Stats:
    docs: int
    terms: int
    features: int

    def __str__(self) -> str:
        return f"docs: {self.docs}, terms: {self.terms}, features: {self.features}"


class Engine:
    """An index over documents ``doc_id, filename, text, date, start_date, end_date``.

    Documents are only ever added; a file that is added again is another document. With the
    ``memory`` backend postings are cached. With ``lsm`` documents, postings and terms are
    tables under ``data_dir``, dealt and sorted by term, with a manifest of those that live:
    a batch counts once it is written whole, and an engine on the same folder finds it again.
    """

    def __init__(self, spark: SparkSession, config: configs.Config | None = None):
        self.spark = spark
        self.config = config or configs.Config()
        self.index_pipeline = text.pipeline(self.config, self.config.index)
        self.query_pipeline = text.pipeline(self.config, self.config.query)
        self.docs = spark.createDataFrame([], sources.SCHEMA)
        self.postings = spark.createDataFrame([], "term string, doc_id long")
        self.terms: DataFrame | None = None
        self.strict = True
        self._cached: list[DataFrame] = []
        self._state: dict = {"docs": [], "postings": [], "terms": [], "count": 0, "rows": 0}
        self._manifest = None
        if self.config.storage.backend == "lsm":
            self._manifest = Manifest(spark, self.config.storage.data_dir)
            if found := self._manifest.read():
                self._state = found
                self._read()

    @classmethod
    def from_path(cls, spark: SparkSession, path: str) -> Engine:
        """An engine by a YAML file."""
        return cls(spark, configs.load(path))

    @classmethod
    def over(cls, docs: DataFrame, config: configs.Config | None = None) -> Engine:
        """An engine over a table; columns of documents that it lacks are null. Nothing is cached or written."""
        found = cls(docs.sparkSession, config)
        have = set(docs.columns)
        found.docs = docs.select(*(F.col(c) if c in have else F.lit(None).cast("string" if c == "filename" else "date").alias(c) for c in found.docs.columns))
        found.postings = index.postings(found.docs, found.index_pipeline)
        return found

    # -- adding documents

    def add(self, files: DataFrame, meta: DataFrame | None = None) -> None:
        """Index ``filename, text`` rows; ids go on from those there are."""
        self.add_documents(sources.numbered(files, meta, self._state["count"]))

    def add_documents(self, docs: DataFrame) -> None:
        """Index documents that have ids of their own, which must be new."""
        if self._manifest:
            docs = self._stored(docs, "docs")
            made = self._arranged(docs)
            self._stored(index.counted(made).repartitionByRange("term").sortWithinPartitions("term"), "terms")
        else:
            docs = docs.persist(StorageLevel.MEMORY_AND_DISK)
            made = index.postings(docs, self.index_pipeline).persist(StorageLevel.MEMORY_AND_DISK)
            self._cached += [docs, made]
        self._state["count"] += docs.count()
        if self._manifest:
            self._manifest.commit(self._state)
            self._read()
        else:
            self.docs, self.postings = self.docs.unionByName(docs), self.postings.unionByName(made)

    def _arranged(self, docs: DataFrame) -> DataFrame:
        """Stored postings of documents. They are first written as they come: dealing by ranges reads its input twice, and texts are analysed once."""
        raw = f"{self.config.storage.data_dir}/raw/{uuid.uuid4().hex}"
        found = index.placed(docs, self.index_pipeline)
        found.write.parquet(raw)
        found = self.spark.read.schema(found.schema).parquet(raw)
        rows = found.count()
        made = self._stored(index.arranged(found, index.parts(self.spark, rows)), "postings")
        self._state["rows"] = self._state.get("rows", 0) + rows
        delete(self.spark, raw)
        return made

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.config.storage.data_dir}/{name}/batch={uuid.uuid4().hex}"
        df.write.parquet(path)
        self._state[name] = [*self._state[name], path]
        return self.spark.read.schema(df.schema).parquet(path)

    def _read(self) -> None:
        """The tables that the manifest names; terms of several batches are added up."""
        read = lambda name, schema: self.spark.read.schema(schema).parquet(*self._state[name])
        if not self._state["docs"]:
            return
        self.docs, self.postings = read("docs", sources.SCHEMA), read("postings", "term string, doc_id long")
        terms = read("terms", "term string, documents long, first_doc long, first_place int")
        once = F.sum("documents").alias("documents"), F.min("first_doc").alias("first_doc"), F.min_by("first_place", "first_doc").alias("first_place")
        self.terms = terms if len(self._state["terms"]) == 1 else terms.groupBy("term").agg(*once)

    def index_dir(self, path: str) -> None:
        files = sources.directory(self.spark, path, self.config.source.extensions, self.config.source.encoding)
        self.add(files, sources.metadata(self.spark, path))

    def index_source(self) -> None:
        self.index_dir(self.config.source.dir)

    def index_file(self, path: str, date: str | None = None, start_date: str | None = None, end_date: str | None = None) -> None:
        """One file, whatever its extension, with its dates."""
        raw = self.spark.read.format("binaryFile").load(path)
        files = raw.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.decode("content", self.config.source.encoding).alias("text"))
        meta = files.select("filename", *(dates.parsed(F.lit(d).cast("string")).alias(c) for c, d in (("date", date), ("start_date", start_date), ("end_date", end_date))))
        self.add(files, meta)

    # -- asking

    def query(self, text_: str) -> Result:
        """The answer to a query of the query language, as one plan."""
        return Result(self.plan(text_).documents(self.docs), self)

    def plan(self, text_: str) -> Plan:
        return Plan(parse(text_), self.postings, self.query_pipeline.terms_of, self.strict, self.terms)

    def search(self, *raw: str) -> Result:
        """Documents with all terms of some strings; unknown terms are left out, and if none is known nothing is found."""
        terms = list(dict.fromkeys(t for r in raw for t in self.query_pipeline.terms_of(r)))
        terms = terms if len(terms) < 2 else known(self.vocabulary, terms)
        return Result(index.having_all(self.postings, terms), self)

    @property
    def count(self) -> int:
        """Documents that were added."""
        return self._state["count"]

    @property
    def vocabulary(self) -> DataFrame:
        """A table with all terms, each once where the index has stored them."""
        return self.postings if self.terms is None else self.terms

    def _matching(self, node: Prefix | Wildcard) -> Result:
        found, fits = self.postings, leaf_predicate(node, self.strict)
        if self.terms is None or isinstance(node, Prefix):
            found = found.where(fits)
        else:
            start = F.startswith(F.col("term"), F.lit(leaf_start(node)))
            found = found.where(start).join(self.terms.where(start & fits), "term", "left_semi")
        return Result(found.select("doc_id").distinct(), self)

    def dictionary(self) -> DataFrame:
        """``feature_id, term``: dense ids by first occurrence, which a stored index has beside its terms."""
        return index.dictionary(self.docs, self.index_pipeline) if self.terms is None else index.numbered(self.terms)

    def parts(self, most: int = index.ROWS) -> int | None:
        """Into how many parts to deal the stored postings, so that none has many more than ``most``."""
        return None if self.terms is None else index.parts(self.spark, self._state["rows"], most)

    def search_prefix(self, prefix: str) -> Result:
        return self._matching(Prefix(prefix))

    def search_wildcard(self, pattern: str) -> Result:
        return self._matching(Wildcard(pattern))

    def search_dates(self, kind: str, start: str, end: str) -> Result:
        """``DATE``, ``VALID`` or ``APPEARED`` in a range."""
        found = DateRange(kind, start, end)
        return Result(self.docs.where(dates.in_range(found.kind, found.start, found.end)).select("doc_id"), self)

    def stats(self) -> Stats:
        row = index.stats(self.docs, self.vocabulary).first()
        return Stats(row["docs"], row["terms"], row["features"])

    def document(self, doc_id: int) -> DataFrame:
        """The document of an id, if there is one."""
        return self.docs.where(F.col("doc_id") == doc_id).drop("text")

    def storage_report(self) -> str:
        """Batches, files and bytes of the stored tables; empty for the memory backend."""
        if not self._manifest:
            return ""
        lines = []
        for name in ("postings", "terms"):
            paths = self._state[name]
            files = len(self.spark.read.parquet(*paths).inputFiles()) if paths else 0
            lines += [f"  [{name.capitalize()}]", f"    Batches      : {len(paths)}", f"    Files        : {files}", f"    Bytes        : {sum(size_of(self.spark, p) for p in paths)}"]
        return "\n".join(lines) + "\n"

    def close(self) -> None:
        for df in self._cached:
            df.unpersist()
        self._cached = []
