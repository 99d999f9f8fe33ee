import pytest


@pytest.fixture
def docs_of(spark):
    """A table of (doc_id, text) rows, with other columns whose names could clash."""

    def build(rows, extra=True):
        table = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            table = table.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars", "7 AS id", "8 AS _id", "'x' AS spans", "9 AS part", "true AS kept", "0 AS n")
        return table

    return build
