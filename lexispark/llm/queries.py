"""The registered queries of this subpackage: each applies an operator to its whole table.

SQL can express two of them, and the base columns of three more, which are entries of their
own (``*_base``) beside the whole queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, licenses, nearest, neardup, packing, pieces, pii, quality, secrets, urls
from .common import read
from .tokens import vocabulary


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, percent=80)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segment(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs))
    return found.withColumn("held_out", language.held_out(found, "doc_id"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def secret_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def quality_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.BASE), "base_sha256")


_TEXTS = "texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_WORD = r"[^\x20\x09-\x0D]+"


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


def _spans(kinds: list[tuple[str, str, int, str]]) -> str:
    """CTEs that place the matches of (kind, pattern, a group, condition on the match ``m`` and that group ``g``): ``spans(doc_id, k, kind, a, b)``.

    Matches and the pieces between them alternate, so the lengths before a match say where it starts.
    """
    found = []
    for k, (kind, pattern, group, keep) in enumerate(kinds):
        found.append(
            f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, a, a + length(m) AS b FROM (
    SELECT doc_id, ms[i] AS m, gs[i] AS g, coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a
    FROM (SELECT doc_id, ms, gs, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs, regexp_split_to_array(t, '{pattern}') AS ps FROM texts))) WHERE {keep}"""
        )
    return "spans AS (" + " UNION ALL ".join(found) + ")"


def _span_counts(kinds: list[tuple[str, str, int, str]], order: str) -> str:
    counts = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in kinds)
    sums = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in kinds)
    return f"""WITH {_TEXTS}, {_spans(kinds)},
sums AS (SELECT doc_id, {sums}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY {order}) AS joined FROM spans GROUP BY doc_id)
SELECT doc_id, {counts}, sha256(coalesce(joined, '')) AS base_sha256 FROM texts LEFT JOIN sums USING (doc_id)"""


def _secrets_sql() -> str:
    assign = f"""({_either_case("password|passwd|secret|token")}|{_either_case("api")}_?{_either_case("key")})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    return _span_counts([("assign", assign, 2, "length(g) >= 6"), ("access", "AKIA[A-Z0-9]+", 0, "length(m) >= 20"), ("hex", "[0-9a-f]+", 0, "length(m) >= 24")], "a, k")


def _pii_sql() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    worth = f"""list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({digits})[i] AS INTEGER)
      WHEN CAST(reverse({digits})[i] AS INTEGER) > 4 THEN 2 * CAST(reverse({digits})[i] AS INTEGER) - 9 ELSE 2 * CAST(reverse({digits})[i] AS INTEGER) END))"""
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0"),
        ("card", r"[0-9]([\x20-]?[0-9])+", 0, f"length({digits}) BETWEEN 16 AND 19 AND {worth} % 10 = 0"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"length({digits}) BETWEEN 8 AND 15"),
    ]
    return _span_counts(kinds, "k, a")


_QUALITY_SQL = f"""WITH {_TEXTS},
worded AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS l FROM texts),
placed AS (SELECT doc_id, unnest(range(len(l))) AS p, unnest(l) AS w FROM worded),
runs AS (SELECT doc_id, p, [w, lead(w, 1) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d, lead(w, 4) OVER d] AS run FROM placed WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
twice AS (SELECT doc_id, p FROM runs WHERE run[5] IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
covered AS (SELECT doc_id, count(DISTINCT p + i) AS n_repeat_words FROM twice, (SELECT unnest(range(5)) AS i) GROUP BY doc_id),
lines AS (SELECT doc_id, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))) AS n, len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))) AS own FROM texts)
SELECT doc_id, len(l) AS n_words, CAST(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(n - own AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(l) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(l) AS base_failed
FROM worded JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)"""

_NEAR_SQL = f"""WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS l FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(l) >= 4 THEN list_distinct(list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' '))) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END AS s FROM worded),
members AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM members x JOIN members y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sets p ON a = p.doc_id JOIN sets q ON b = q.doc_id WHERE 100 * c >= 80 * (len(p.s) + len(q.s) - c)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS root FROM sets UNION SELECT b, root FROM reached JOIN steps ON doc_id = a)
SELECT sets.doc_id, len(s) AS n_shingles, min(root) AS component_id, sets.doc_id = min(root) AS kept FROM sets JOIN reached ON sets.doc_id = reached.doc_id GROUP BY sets.doc_id, s"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_secret_scan, op2_url_filter, op3_minhash_dedup, op4_packing, op5_nearest_neighbours, op6_sentencepiece, op7_quality_rules, op8_pii, op9_language_id, op10_license_scan,
        secret_scan_base, quality_rules_base, pii_base,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": urls.oracle(), "op3_minhash_dedup": _NEAR_SQL, "secret_scan_base": _secrets_sql(), "quality_rules_base": _QUALITY_SQL, "pii_base": _pii_sql()}
