import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    found = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture
def engine_of(spark):
    """Builds an engine over (filename, text) pairs, optionally with dates, ids in order."""
    from lexispark.config import Config, PipelineConfig
    from lexispark.engine import Engine

    def build(rows, stemming=False, stop_words=False):
        rows = [(i, *r, *([None] * (5 - len(r)))) for i, r in enumerate(rows)]
        table = spark.createDataFrame(rows, "doc_id long, filename string, text string, d string, s string, e string")
        table = table.selectExpr("doc_id", "filename", "text", "to_date(d) AS date", "to_date(s) AS start_date", "to_date(e) AS end_date")
        stages = PipelineConfig(stemming=stemming)
        return Engine.over(table, Config(index=PipelineConfig(stemming=stemming, stop_words=stop_words), query=stages))

    return build
