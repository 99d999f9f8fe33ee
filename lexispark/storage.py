"""Tables in shared folders: durable intermediate tables, and manifests that say which tables live."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a local master uses a folder under /tmp and any other raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def located(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as the JVM has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read back, which cuts its lineage; the table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = located(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def size_of(spark: SparkSession, path: str) -> int:
    where, files = located(spark, path)
    return files.getContentSummary(where).getLength()


def delete(spark: SparkSession, path: str) -> None:
    where, files = located(spark, path)
    files.delete(where, True)


class Manifest:
    """The state of a folder as numbered JSON files, of which the last one counts.

    A version is written beside the others and then renamed, so a reader sees it whole or
    not at all, and what it names is already written. Older versions than the last few go.
    """

    KEPT = 3

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.version = spark, f"{path.rstrip('/')}/_manifest", 0

    def _versions(self) -> list[int]:
        where, files = located(self.spark, self.path)
        names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self) -> dict | None:
        """The newest state, if there is one."""
        found = self._versions()
        if not found:
            return None
        self.version = found[-1]
        where, files = located(self.spark, f"{self.path}/{self.version}.json")
        stream = files.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, state: dict) -> None:
        """A new version; raises if another writer made one since this one was read."""
        part, files = located(self.spark, f"{self.path}/.{uuid.uuid4().hex}")
        out = files.create(part, False)
        out.write(json.dumps(state).encode())
        out.close()
        whole, _ = located(self.spark, f"{self.path}/{self.version + 1}.json")
        if files.exists(whole) or not files.rename(part, whole):
            files.delete(part, False)
            raise RuntimeError(f"another writer has changed {self.path}")
        self.version += 1
        for old in self._versions()[: -self.KEPT]:
            delete(self.spark, f"{self.path}/{old}.json")
