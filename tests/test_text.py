import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.functions import stem_en, stem_ru, text
from lexispark.functions.stopwords import ENGLISH, RUSSIAN


def terms(spark, pipeline, value, positions=True):
    df = spark.createDataFrame([(value,)], "text string")
    return pipeline.analysed(df, positions=positions).first()["terms"]


def test_tokens_split_on_marks_and_underscores(spark):
    assert terms(spark, text.Pipeline(normalize=False), "Hello, wor_ld! x1 \u00e9 e\u0301") == ["Hello", "wor", "ld", "x1", "\u00e9", "e"]
    assert terms(spark, text.PLAIN, "") == []


def test_normalise_lowers_and_keeps_positions(spark):
    assert terms(spark, text.Pipeline(min_length=2), "A bc D ef") == [None, "bc", None, "ef"]
    assert terms(spark, text.PLAIN, "Привет WORLD") == ["привет", "world"]


def test_accents(spark):
    assert terms(spark, text.Pipeline(strip_accents=True), "café naïve résumé") == ["cafe", "naive", "resume"]
    assert text.without_accents("йё") == "ие"


def test_composition_is_that_of_the_standard(spark):
    pool = ["한", "각", "Å", "क़", "豈", "a", "ᄀ", "ᅡ", "ᆨ", "가"]
    rows = [(a + b + c,) for a in pool for b in pool for c in pool[-4:]]
    df = spark.createDataFrame(rows, "t string").select("t", text.composed(F.col("t")).alias("c"))
    assert [(r["t"], r["c"]) for r in df.collect() if r["c"] != unicodedata.normalize("NFC", r["t"])] == []


@pytest.mark.parametrize(
    ("value", "language"),
    [("Hello world", "english"), ("Привет мир", "russian"), ("Hello Привет мир", "mixed"), ("123", "unknown"), ("", "unknown"), ("abcdefghi я", "english")],
)
def test_language(spark, value, language):
    df = spark.createDataFrame([(value,)], "t string").select(text.text_language(F.col("t")))
    assert df.first()[0] == language


def test_token_language_goes_by_any_cyrillic_letter(spark):
    df = spark.createDataFrame([("abcя",), ("abc",)], "t string").select(text.token_language(F.col("t")))
    assert [r[0] for r in df.collect()] == ["russian", "english"]


def test_stop_words(spark):
    assert len(ENGLISH) == 125 and len(RUSSIAN) == 154
    assert text.is_stop_word("the", "english") and not text.is_stop_word("the", "russian") and not text.is_stop_word("the", "mixed")
    assert text.is_stop_word("foo", "english", {"english": ["foo"]})
    own = text.Pipeline(stop_words=text.stop_words({"english": ["fox", "DOG"]}))
    assert terms(spark, own, "The fox и dog") == [None, None, None, "dog"]


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("running", "run"), ("computers", "comput"), ("dogs", "dog"), ("lazy", "lazi"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"),
        ("agreed", "agre"), ("generously", "generous"), ("skies", "sky"), ("dying", "die"), ("proceed", "proceed"), ("ties", "tie"), ("cries", "cri"),
        ("gas", "gas"), ("kiwis", "kiwi"), ("consignment", "consign"), ("knightly", "knight"), ("sky", "sky"), ("by", "by"), ("say", "say"), ("controlling", "control"),
    ],
)
def test_english_stems(word, stem):
    assert stem_en.stem(word) == stem


@pytest.mark.parametrize(
    ("word", "stem"),
    [("документов", "документ"), ("быстрая", "быстр"), ("коричневая", "коричнев"), ("лиса", "лис"), ("прыгает", "прыга"), ("ленивой", "ленив"), ("собакой", "собак"), ("учёные", "учен"), ("м", "м")],
)
def test_russian_stems(word, stem):
    assert stem_ru.stem(word) == stem


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz'", min_size=1, max_size=14))
def test_english_stems_never_fail_or_grow(word):
    assert len(stem_en.stem(word)) <= len(word) + 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="абвгдежзийклмнопрстуфхцчшщъыьэюяё", min_size=1, max_size=14))
def test_russian_stems_never_fail_or_grow(word):
    assert len(stem_ru.stem(word)) <= len(word)


def test_full_pipeline(spark):
    df = spark.createDataFrame([(1, "The quick brown fox is running and runs"), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in text.process(df, text.FULL).collect()}
    assert rows[1]["lang"] == "english"
    assert rows[1]["terms"] == ["quick", "brown", "fox", "run"]
    assert [(t["position"], t["term"]) for t in rows[1]["tokens"]] == [(1, "quick"), (2, "brown"), (3, "fox"), (5, "run"), (7, "run")]
    assert rows[2]["terms"] == [] and rows[3]["terms"] in (None, [])


def test_driver_and_column_forms_agree(spark):
    value = "The quick-brown foxes; Быстрая лиса и собаки, café 42"
    for own in (text.PLAIN, text.FULL, text.Pipeline(strip_accents=True), text.Pipeline(normalize=False)):
        found = [t for t in terms(spark, own, value) if t]
        assert list(dict.fromkeys(found)) == own.terms_of(value)


def test_forced_language_is_a_label_only(spark):
    own = text.Pipeline(forced="russian", stem_with=text.stem_any)
    df = spark.createDataFrame([(1, "running dogs")], "doc_id long, text string")
    row = text.process(df, own).first()
    assert row["lang"] == "russian" and row["terms"] == ["run", "dog"]


def test_changing_letters_are_found_in_few_steps():
    # nested ranges: no class lists more than a few, so that a character isn't held against all of them
    import re

    found = text.composing()
    assert max(len(re.findall(r"\\x\{[0-9a-f]+\}-", part)) for part in re.split(r"&&\[|\]", found)) <= 5
    assert all(re.search(rf"\\x\{{{c:x}\}}-|-\\x\{{{c:x}\}}", found) for c in (0x374, 0x2f800))


def test_tokens_of_many_rows_are_mapped_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(text, "TOKENS", 3)
    monkeypatch.setattr(text, "REMEMBERED", 2)
    rows = [["Café", "THE", "ran"], None, [], ["running", "é", "of", "книги", "Café"], ["x"]]
    own = text.Pipeline(strip_accents=True, stop_words=text.stop_words(), stem_with=text.stem_any)
    want = [None if r is None else [own.term(t) for t in r] for r in rows]
    array = pa.array(rows, pa.list_(pa.string()))
    assert text._mapped(array, own).to_pylist() == want and text._mapped(array.slice(2), own).to_pylist() == want[2:]
    assert text._mapped(array.slice(1, 1), own).to_pylist() == [None]
    assert not text.is_cyrillic("abc") and text.is_cyrillic("aж")
