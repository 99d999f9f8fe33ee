import glob
import os

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
from lexispark.llm import queries as llm  # noqa: E402

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, name):
    rows = llm.queries()[name](spark, SF)
    found = [tuple(map(str, r)) for r in rows.select(*sorted(rows.columns)).collect()]
    assert found
    sql = llm.oracle_sql().get(name)
    if sql:
        duck = duckdb.connect()
        for path in glob.glob(f"{SF}/*.parquet"):
            files = f"{path}/*.parquet" if os.path.isdir(path) else path
            duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
        expected = duck.execute(sql)
        names = [d[0] for d in expected.description]
        order = [names.index(c) for c in sorted(names)]
        assert sorted(found) == sorted(tuple(str(r[i]) for i in order) for r in expected.fetchall())


@needs_tables
def test_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.where("length(text) > 2000 AND lang = 'en'").orderBy("doc_id").limit(3).collect()
    secret = 'token = "' + "ab12" * 10 + '"'
    planted = clean[0]["text"][::-1].replace(" ", " a") + " " + clean[1]["text"] + " the " + secret  # like no other document
    odd = [
        (10_001, None, None, None, None), (10_002, "", "en", "s", 0), (10_003, "12 34", "en", "s", 5), (None, clean[0]["text"], "en", "s", 1),
        (10_004, planted, "en", "s", 2), (10_005, clean[0]["text"], "en", "s", 1), (10_005, clean[2]["text"] + " " + clean[1]["text"][::-1], "en", "s", 1),
    ]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.where("doc_id < 3"))
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns and docs.count() <= before
        before = docs.count()
        rows = docs.collect()
        ids = [r["doc_id"] for r in rows]
        if name == "language_id":
            assert not {10_001, 10_002, 10_003} & set(ids) and {r["lang"] for r in rows} <= {"en", "de", "fr", "es"}
        if name == "quality_rules":
            docs = docs.unionByName(spark.createDataFrame([r for r in odd if r[0] in (10_004, 10_005, None)], docs.schema)).distinct()
            before = docs.count()
        if name == "near_duplicates":
            assert len({r["text"] for r in rows}) == len(rows) and None not in ids
            # of one id's two texts, the copy of another document goes and the other stays
            assert ids.count(10_005) == 1 and clean[0]["text"] in {r["text"] for r in rows if r["doc_id"] <= clean[0]["doc_id"]}
            assert secret in next(r["text"] for r in rows if r["doc_id"] == 10_004)
        if name == "secret_scan":
            own = next(r for r in rows if r["doc_id"] == 10_004)
            assert secret not in own["text"] and "[ASSIGN]" in own["text"] and own["n_chars"] == len(own["text"])
    name, last = pipeline.STAGES[-1]
    pieces = last(spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert pipeline.run(spark, SF).count() > 0 and pipeline.ORACLE_SQL is None


@needs_tables
def test_told_language_replaces_the_given_one(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wrong = docs.where("lang = 'de' AND length(text) > 500 AND crc32(cast(doc_id AS string)) % 3 = 1").limit(5).selectExpr("doc_id + 50000 AS doc_id", "text", "'en' AS lang", "source", "n_chars")
    found = pipeline.language_id(spark, docs.unionByName(wrong), SF).where("doc_id >= 50000").collect()
    assert found and {r["lang"] for r in found} == {"de"}
