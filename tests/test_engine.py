import pytest

from lexispark import cli, config
from lexispark.engine import Engine
from lexispark.functions.text import PLAIN
from lexispark.sources import documents as sources
from lexispark.streaming import ingest


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "b.txt").write_text("A fox, a dog.", encoding="utf-8")
    (tmp_path / "a.TXT").write_text("Foxes run in Москва", encoding="utf-8")
    (tmp_path / "c.md").write_text("not indexed", encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.txt").write_text("nested fox", encoding="utf-8")
    (tmp_path / "metadata.yaml").write_text("a.TXT: {date: 2024-01-05, start_date: '2024-1-1', end_date: ''}\nz.txt: {date: '2024-01-01'}\n", encoding="utf-8")
    return tmp_path


@pytest.mark.parametrize("backend", ["memory", "lsm"])
def test_directory(spark, corpus, tmp_path_factory, backend):
    found = Engine(spark, config.Config(storage=config.StorageConfig(backend=backend, data_dir=str(tmp_path_factory.mktemp("data")))))
    found.index_dir(str(corpus))
    docs = {r["doc_id"]: r for r in found.docs.collect()}
    assert [docs[i]["filename"] for i in sorted(docs)] == ["a.TXT", "b.txt"]
    assert str(docs[0]["date"]) == "2024-01-05" and docs[0]["start_date"] is None and docs[1]["date"] is None
    assert {r[0] for r in found.query("fox").ids.collect()} == {0, 1}
    assert {r[0] for r in found.query("москва").ids.collect()} == {0}
    found.index_file(str(corpus / "c.md"), date="2024-02-01", end_date="2024-99-01")
    assert {r["doc_id"]: r["filename"] for r in found.query("indexed").documents().collect()} == {2: "c.md"}
    assert {r[0] for r in found.query("DATE:[2024-01-01,2024-12-31]").ids.collect()} == {0, 2}
    assert found.stats().docs == 3 and bool(found.storage_report()) == (backend == "lsm")
    assert found.document(99).count() == 0
    if backend == "lsm":
        again = Engine(spark, found.config)
        assert again.count == 3 and {r[0] for r in again.query("fox").ids.collect()} == {0, 1}
    found.close()


def test_metadata_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "metadata.yaml").write_text("a: [", encoding="utf-8")
    assert sources.metadata(spark, str(tmp_path)).count() == 0


def test_empty_directory(spark, tmp_path):
    found = Engine(spark)
    found.index_dir(str(tmp_path))
    assert found.stats().docs == 0 and found.query("x").count() == 0


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("source: {dir: /data}\nindex: {stemming: false}\nquery: {stemming: false}\nstorage: {backend: lsm, block_size: -1}\n", encoding="utf-8")
    found = config.load(str(path))
    assert found.source.dir == "/data" and found.index.stop_words and found.storage.block_size == 1024
    for bad, message in (
        ("source: {dir: ''}", "no source.dir given"),
        ("language: french", "unknown language 'french'"),
        ("index: {stemming: false}", "same stemming"),
        ("index: {normalize: false}", "same normalize"),
        ("storage: {backend: disk}", "unknown storage.backend"),
        ("source: [", "not YAML"),
    ):
        path.write_text(bad, encoding="utf-8")
        with pytest.raises(ValueError, match=message):
            config.load(str(path))
    with pytest.raises(ValueError, match="cannot open"):
        config.load(str(tmp_path / "none.yaml"))


def test_prompt(engine_of):
    found = engine_of([("x.txt", "fox"), ("y.txt", "dog")])
    assert cli.answer(found, "fox") == "  Found 1 document(s):\n    [0] x.txt"
    assert cli.answer(found, "zebra") == "  No documents found."
    assert cli.answer(found, "fox AND") == "  Error: unexpected end of query"
    assert cli.answer(found, ":stats") == "  docs: 2, terms: 2, features: 2"
    assert cli.answer(found, ":q") is None and ":stats" in cli.answer(found, ":help")
    lines, said = iter(["dog", "", ":quit"]), []
    cli.loop(found, lambda prompt: next(lines), said.append)
    assert len(said) == 1 and "backend" in cli.banner(found)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a fox"), (1, "a dog")], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        ingest.ingest(stream, PLAIN, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    docs, postings = ingest.ingested(spark, str(tmp_path / "out"))
    assert docs.count() == 2 and {(r["term"], r["doc_id"]) for r in postings.collect()} == {("a", 0), ("fox", 0), ("a", 1), ("dog", 1)}
