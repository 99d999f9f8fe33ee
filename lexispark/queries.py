"""The registered queries of the engine over the driver's tables, and their DuckDB SQL.

``documents`` has no dates; both sides derive them from the id. A plain pipeline (no stop
words, no stems) is used where the answer is compared with SQL. The search queries read a
stored index, which the first of them in an application builds. Stems, stop words and
languages are checked on sentences that both sides put together from a word list, whose
stems the SQL holds as a table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, PipelineConfig, StorageConfig
from .engine import Engine
from .functions import dates, kgrams, text
from .functions.stopwords import ENGLISH
from .operators import index, kv
from .operators.numbering import dense
from .plans.parser import QueryError, parse, tokenize
from .sources import documents as sources
from .storage import delete, located, shared_dir

#: name -> (query, oracle SQL or None)
_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _register(sql: str | None = None):
    def keep(f):
        _FOUND[f.__name__] = (f, sql)
        return f

    return keep


def _plain() -> Config:
    stages = PipelineConfig(stemming=False)
    return Config(index=stages, query=stages)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with derived dates: some open-ended, some without a start."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int"))
    start = F.when(F.col("doc_id") % 11 != 0, F.date_sub(day, 14))
    end = F.when(F.col("doc_id") % 4 != 0, F.date_add(day, (F.col("doc_id") % 90).cast("int")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("filename"), "text", day.alias("date"), start.alias("start_date"), end.alias("end_date"))


#: Stored indexes of this application, by data folder.
_OPEN: dict[tuple[str, str], Config] = {}


def _folder(spark: SparkSession, name: str, sf_dir: str) -> str:
    """A folder of this application for one data folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{zlib.crc32(sf_dir.encode()):08x}"
    where, files = located(spark, path)
    files.deleteOnExit(where)
    return path


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The stored index over the documents, built if this application hasn't yet, and opened anew each time."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        config = replace(_plain(), storage=StorageConfig(backend="lsm", data_dir=_folder(spark, "search", sf_dir)))
        found = Engine(spark, config)
        if not found.count:
            found.add_documents(documents(spark, sf_dir))
        _OPEN[key] = config
    return Engine(spark, _OPEN[key])


def build_index(spark: SparkSession, sf_dir: str) -> None:
    """Builds the stored index now, where the first search query would."""
    _engine(spark, sf_dir)


def _query(spark: SparkSession, sf_dir: str, text_: str) -> DataFrame:
    return _engine(spark, sf_dir).query(text_).ids


_TOKENS = r"""tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> '') AS l FROM documents),
post AS (SELECT DISTINCT unnest(l) AS term, doc_id FROM tok)"""
_DATES = """dated AS (SELECT doc_id, d AS date, CASE WHEN doc_id % 11 <> 0 THEN d - 14 END AS start_date,
  CASE WHEN doc_id % 4 <> 0 THEN d + CAST(doc_id % 90 AS INTEGER) END AS end_date
  FROM (SELECT doc_id, DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER) AS d FROM documents))"""
_PLACED = f"WITH {_TOKENS}, placed AS (SELECT doc_id, unnest(range(len(l))) AS position, unnest(l) AS term FROM tok)"
_IDS = f"WITH {_TOKENS}, {_DATES} "


def _has(where: str) -> str:
    return f"SELECT doc_id FROM post WHERE {where}"


# -- text pipeline


@_register(f"{_PLACED} SELECT doc_id, position, term FROM placed")
def tokenize_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.tokens(documents(spark, sf_dir), text.PLAIN).withColumn("position", F.col("position").cast("long"))


@_register(f"WITH {_TOKENS} SELECT doc_id, term FROM post")
def distinct_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(documents(spark, sf_dir), text.PLAIN).select("doc_id", "term")


@_register(f"{_PLACED} SELECT doc_id, position, term FROM placed WHERE length(term) >= 4")
def normalize_min_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.tokens(documents(spark, sf_dir), text.Pipeline(min_length=4)).withColumn("position", F.col("position").cast("long"))


@_register(f"WITH {_TOKENS} SELECT DISTINCT strip_accents(term) AS term, doc_id FROM post")
def strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(documents(spark, sf_dir), text.Pipeline(strip_accents=True))


_STOP = ", ".join(f"'{w}'" for w in sorted(ENGLISH))


@_register(f"{_PLACED} SELECT doc_id, position, term FROM placed WHERE term NOT IN ({_STOP})")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.tokens(documents(spark, sf_dir), text.Pipeline(stop_words=text.stop_words())).withColumn("position", F.col("position").cast("long"))


@_register(f"WITH {_TOKENS} SELECT term, doc_id FROM post WHERE term NOT IN ({_STOP}, 'thth', 'le')")
def custom_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.stop_words({"english": ["thth", "le", "Upper"]})
    return index.postings(documents(spark, sf_dir), text.Pipeline(stop_words=words))


@_register(
    r"""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '\p{Cyrillic}')) AS c, len(regexp_extract_all(text, '\p{Latin}')) AS l FROM documents)
SELECT doc_id, CASE WHEN c + l = 0 THEN 'unknown' WHEN c / (c + l) > 0.2 AND l / (c + l) > 0.2 THEN 'mixed'
  WHEN c / (c + l) > 0.5 THEN 'russian' ELSE 'english' END AS language FROM n"""
)
def doc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.text_language(F.col("text")).alias("language"))


@_register()
def stem_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the full pipeline; SQL has no stemmer here."""
    return index.postings(documents(spark, sf_dir), text.FULL)


@_register()
def process_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, distinct terms and placed tokens of each document; nested, so not compared with SQL."""
    return text.process(documents(spark, sf_dir), text.FULL)


# -- leaves and boolean algebra


def _simple(name: str, query: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _query(spark, sf_dir, query)

    run.__name__ = name
    run.__doc__ = query
    _FOUND[name] = (run, _IDS + sql)


def _prefix(p: str) -> str:
    return f"SELECT DISTINCT doc_id FROM post WHERE starts_with(term, '{p}')"


_simple("term_search", "the", _has("term = 'the'"))
_simple("bool_and", "the AND of", f"{_has("term = 'the'")} INTERSECT {_has("term = 'of'")}")
_simple("bool_or", "der OR les", f"{_has("term = 'der'")} UNION {_has("term = 'les'")}")
_simple("bool_and_not", "the AND NOT is", f"{_has("term = 'the'")} EXCEPT {_has("term = 'is'")}")
_simple("bool_nested", "(the OR de) AND NOT (is OR est)", f"SELECT doc_id FROM ({_has("term IN ('the', 'de')")} EXCEPT {_has("term IN ('is', 'est')")}) GROUP BY doc_id")
_simple("bool_precedence", "der OR the AND of", f"{_has("term = 'der'")} UNION ({_has("term = 'the'")} INTERSECT {_has("term = 'of'")})")
_simple("bool_unknown_side_empty", "the AND qqqqzzzz", f"{_has("term = 'the'")} INTERSECT {_has("term = 'qqqqzzzz'")}")
_simple("multi_term_leaf", "the-of", f"{_has("term = 'the'")} INTERSECT {_has("term = 'of'")}")
_simple("prefix_search", "thre*", _prefix("thre"))
_simple("prefix_all", "*", "SELECT DISTINCT doc_id FROM post")
_simple("wildcard_middle", "th*ing", "SELECT DISTINCT doc_id FROM post WHERE term LIKE 'th%ing'")
_simple("wildcard_leading", "*tion", "SELECT DISTINCT doc_id FROM post WHERE term LIKE '%tion'")
_simple("wildcard_multi", "t*h*e", "SELECT DISTINCT doc_id FROM post WHERE term LIKE 't%h%e'")
# A pattern finds terms by its grams: those of its parts, the first and last with an edge mark; with no grams nothing is found.
_GRAMLESS = """SELECT DISTINCT doc_id FROM post WHERE contains(term, 'a') AND EXISTS (
  SELECT 1 FROM (SELECT unnest(['$', 'a', '$']) AS part) WHERE length(part) >= 2)"""
_simple("wildcard_no_gram_empty", "*a*", _GRAMLESS)
_simple("wildcard_or_term", "(*tion OR thre*) AND NOT the", f"(SELECT doc_id FROM post WHERE term LIKE '%tion' UNION {_prefix('thre')}) EXCEPT {_has("term = 'the'")}")
_simple("date_range", "DATE:[2024-02-01,2024-03-15]", "SELECT doc_id FROM dated WHERE date BETWEEN DATE '2024-02-01' AND DATE '2024-03-15'")
_VALID = "SELECT doc_id FROM dated WHERE start_date <= DATE '{1}' AND (end_date >= DATE '{0}' OR end_date IS NULL)"
_simple("valid_in_range", "VALID:[2024-03-01,2024-03-31]", _VALID.format("2024-03-01", "2024-03-31"))
_simple("valid_inverted_range", "VALID:[2024-06-30,2024-06-01]", _VALID.format("2024-06-30", "2024-06-01"))
_simple("appeared_in_range", "APPEARED:[2024-05-01,2024-05-31]", "SELECT doc_id FROM dated WHERE start_date BETWEEN DATE '2024-05-01' AND DATE '2024-05-31'")
_simple(
    "text_and_date",
    "(de OR thre*) AND NOT is AND VALID:[2024-03-01,2024-03-31]",
    f"(({_has("term = 'de'")} UNION {_prefix('thre')}) EXCEPT {_has("term = 'is'")}) INTERSECT {_VALID.format('2024-03-01', '2024-03-31')}",
)


@_register(f"WITH {_TOKENS} SELECT doc_id FROM post WHERE term IN ('the', 'of', 'and') GROUP BY doc_id HAVING count(*) = 3")
def multi_term_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).search("the of", "and").ids


@_register(f"WITH {_TOKENS} {_has("term = 'the'")} INTERSECT {_has("term = 'of'")}")
def unknown_term_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).search("the", "qqqqzzzz", "of").ids


@_register(f"WITH {_TOKENS} {_has("term = 'the'")} INTERSECT {_has("term = 'of'")}")
def result_chain_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).search("the").and_("of", "qqqqzzzz").ids


@_register(f"WITH {_TOKENS} {_has("term = 'der'")} UNION {_has("term = 'les'")}")
def result_chain_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).search("der").or_("les", "qqqqzzzz").ids


@_register(f"WITH {_TOKENS} ({_has("term = 'the'")} EXCEPT {_has("term = 'is'")}) EXCEPT {_has("term = 'was'")}")
def result_chain_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).search("the").not_("is", "was", "qqqqzzzz").ids


@_register(f"WITH {_TOKENS} SELECT count(DISTINCT doc_id) AS documents FROM post WHERE term = 'the'")
def result_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).search("the").ids.agg(F.count("*").alias("documents"))


@_register(f"{_IDS} SELECT d.doc_id, 'doc' || d.doc_id || '.txt' AS filename, CAST(d.date AS VARCHAR) AS date FROM dated d JOIN post p USING (doc_id) WHERE p.term = 'der'")
def result_documents_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _engine(spark, sf_dir).search("der").documents()
    return found.select("doc_id", "filename", F.col("date").cast("string").alias("date"))


@_register(f"WITH {_DATES} SELECT doc_id, 'doc' || doc_id || '.txt' AS filename, CAST(start_date AS VARCHAR) AS start_date FROM dated WHERE doc_id = 17")
def doc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).document(17).select("doc_id", "filename", F.col("start_date").cast("string").alias("start_date"))


# -- index tables


@_register(f"WITH {_TOKENS} SELECT term, count(*) AS documents, sum(doc_id)::BIGINT AS ids FROM post GROUP BY term")
def inverted_index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).postings.groupBy("term").agg(F.count("*").alias("documents"), F.sum("doc_id").alias("ids"))


@_register(f"WITH {_TOKENS} SELECT term, count(*) AS documents FROM post GROUP BY term")
def posting_bitmap_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _engine(spark, sf_dir)
    packed = index.bitmaps(found.postings, found.parts())
    return packed.groupBy("term").agg(F.sum(F.bitmap_count("bitmap")).alias("documents"))


@_register(f"WITH {_TOKENS} SELECT count(*) AS documents FROM (SELECT doc_id FROM post WHERE term IN ('the', 'of', 'and') GROUP BY doc_id HAVING count(*) = 3)")
def posting_bitmap_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _engine(spark, sf_dir)
    packed = index.bitmaps(found.postings, found.parts())
    return index.and_bitmaps(packed, ["the", "of", "and"]).agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"))


@_register(f"WITH {_TOKENS} SELECT term, CAST(doc_id // 1024 AS BIGINT) AS block, count(*) AS documents FROM post GROUP BY ALL")
def blocked_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _engine(spark, sf_dir)
    return index.blocks(found.postings, n=found.parts())


@_register(
    f"{_PLACED}, firsts AS (SELECT term, min(doc_id * 10000000 + position) AS f FROM placed GROUP BY term) SELECT row_number() OVER (ORDER BY f) - 1 AS feature_id, term FROM firsts"
)
def dictionary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).dictionary()


@_register(f"WITH {_TOKENS} SELECT DISTINCT term FROM post WHERE starts_with(term, 'an')")
def dictionary_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.prefixed(_engine(spark, sf_dir).vocabulary, "an")


@_register(
    f"""WITH {_TOKENS}, padded AS (SELECT term, '$' || term || '$' AS p FROM (SELECT DISTINCT term FROM post)),
cut AS (SELECT term, p, unnest(range(1, length(p))) AS i FROM padded) SELECT DISTINCT substring(p, i, 2) AS gram, term FROM cut"""
)
def kgram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.gram_index(_engine(spark, sf_dir).vocabulary)


@_register(f"WITH {_TOKENS} SELECT DISTINCT term FROM post WHERE term LIKE 'th%t%n'")
def kgram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.gram_search(index.gram_index(_engine(spark, sf_dir).vocabulary), "th*t*n")


@_register(f"WITH {_TOKENS}, t AS (SELECT count(DISTINCT term) AS n FROM post) SELECT (SELECT count(*) FROM documents) AS docs, n AS terms, n AS features FROM t")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _engine(spark, sf_dir)
    return index.stats(found.docs, found.vocabulary)


# -- key-value, on events: a user's key, the event's id as sequence, one type of event as deletion


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(kv.keyed(F.col("user_id")).alias("key"), F.col("value"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("deleted"))


_KV = """WITH log AS (SELECT lpad(CAST(user_id AS VARCHAR), 19, '0') AS key, value, event_id AS seq, event_type = 'purchase' AS deleted FROM events),
newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) """


@_register(_KV + "SELECT key, value FROM newest WHERE NOT deleted")
def kv_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.latest(kv_log(spark, sf_dir))


@_register(_KV + "SELECT key, value FROM newest WHERE NOT deleted AND key = '0000000000000000012'")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.get(kv_log(spark, sf_dir), "0000000000000000012")


@_register(_KV + "SELECT key FROM newest WHERE deleted")
def kv_delete_hides_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = kv_log(spark, sf_dir)
    return log.select("key").distinct().join(kv.latest(log), "key", "left_anti")


@_register(_KV + "SELECT key, value FROM newest WHERE NOT deleted AND key >= '0000000000000000010' AND key < '0000000000000000050'")
def kv_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan(kv_log(spark, sf_dir), "0000000000000000010", "0000000000000000050")


@_register(_KV + "SELECT key, value, seq, deleted FROM newest")
def kv_compact_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = kv_log(spark, sf_dir)
    halves = kv.compact(log.where("seq % 2 = 0")).unionByName(kv.compact(log.where("seq % 2 = 1")))
    return kv.compact(halves)


@_register(_KV + ", gone AS (SELECT key, max(seq) AS g FROM log WHERE deleted GROUP BY key) SELECT DISTINCT key, event_type AS member FROM (SELECT lpad(CAST(user_id AS VARCHAR), 19, '0') AS key, event_id AS seq, event_type FROM events WHERE event_type <> 'purchase') e LEFT JOIN gone USING (key) WHERE g IS NULL OR seq > g")
def kv_compact_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = kv_log(spark, sf_dir).drop("value").join(events.select(F.col("event_id").alias("seq"), F.array("event_type").alias("value")), "seq")
    return kv.union(log).select("key", F.explode("value").alias("member"))


@_register(f"WITH {_TOKENS} SELECT term, count(*) AS documents FROM post WHERE contains(term, 'a') AND EXISTS (SELECT 1 FROM (SELECT unnest(['$', 'a', '$']) AS part) WHERE length(part) >= 2) GROUP BY term")
def kgram_pattern_without_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern without grams finds no terms."""
    found = _engine(spark, sf_dir)
    return index.gram_search(index.gram_index(found.vocabulary), "*a*").join(found.terms, "term").select("term", "documents")


@_register(f"WITH {_TOKENS} SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS place, doc_id FROM post WHERE term = 'der'")
def result_ids_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of an answer's documents in ascending order of their ids."""
    return dense(_engine(spark, sf_dir).search("der").ids, "doc_id", number="place").select("place", "doc_id")


@_register(f"WITH {_TOKENS} SELECT w AS word, NOT EXISTS (SELECT 1 FROM post WHERE term = w) AS is_empty FROM (VALUES ('the'), ('der'), ('qqqqzzzz')) AS v(w)")
def result_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _engine(spark, sf_dir)
    return spark.createDataFrame([(w, found.search(w).is_empty()) for w in ("the", "der", "qqqqzzzz")], "word string, is_empty boolean")


_DICTIONARY = f"{_PLACED}, firsts AS (SELECT term, min(doc_id * 10000000 + position) AS f FROM placed GROUP BY term), ids AS (SELECT row_number() OVER (ORDER BY f) - 1 AS feature_id, term FROM firsts)"


@_register(f"{_DICTIONARY} SELECT term, feature_id FROM ids WHERE term IN ('the', 'der', 'qqqqzzzz', 'of')")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of terms, one of them unknown."""
    return index.lookup(_engine(spark, sf_dir).dictionary(), ["the", "der", "qqqqzzzz", "of"])


@_register(f"WITH {_TOKENS} SELECT term, count(*) AS documents FROM post WHERE starts_with(term, 'th') GROUP BY term")
def union_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed postings of two halves of the documents, which overlap, as one."""
    own = _engine(spark, sf_dir).postings.where("startswith(term, 'th')")
    n = index.parts(spark, own.count(), index.PACKED)
    halves = index.bitmaps(own.where("doc_id % 3 <> 0"), n).unionByName(index.bitmaps(own.where("doc_id % 3 <> 1"), n))
    return index.union_bitmaps(halves, n).groupBy("term").agg(F.sum(F.bitmap_count("bitmap")).alias("documents"))


# -- dates


@_register(
    f"""WITH {_DATES} SELECT 'at most' AS rule, doc_id FROM dated WHERE date <= DATE '2024-02-10'
UNION ALL SELECT 'at least', doc_id FROM dated WHERE date >= DATE '2024-11-20'
UNION ALL SELECT 'range', doc_id FROM dated WHERE date BETWEEN DATE '2024-02-10' AND DATE '2024-02-12'
UNION ALL SELECT 'length', count(date) FROM dated"""
)
def date_index_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _engine(spark, sf_dir).docs
    day = F.col("date")
    rows = [("at most", dates.at_most(day, "2024-02-10")), ("at least", dates.at_least(day, "2024-11-20")), ("range", dates.in_range("DATE", "2024-02-10", "2024-02-12"))]
    found = docs.select(F.lit("length").alias("rule"), "date").groupBy("rule").agg(F.count("date").alias("doc_id"))
    for name, rule in rows:
        found = found.unionByName(docs.where(rule).select(F.lit(name).alias("rule"), "doc_id"))
    return found


@_register(f"WITH {_DATES} SELECT doc_id, date_diff('day', DATE '1970-01-01', date) AS day, date_diff('day', DATE '1970-01-01', start_date) AS start_day FROM dated")
def date_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since 1970 of dates and of their texts."""
    docs = _engine(spark, sf_dir).docs
    return docs.select("doc_id", dates.day(F.col("date")).alias("day"), dates.day(dates.parsed(F.col("start_date").cast("string"))).alias("start_day"))


#: Queries, and what is told of those that can't be parsed.
_BROKEN = ("", "AND owl", "owl AND", "(owl", "owl)", "()", "owl newt", "DATE:[]", "DATE:[2024-01-01]", "DATE:[2024-13-01,2024-12-31]", "VALID:[2024-01-01,2024-1-2]", "owl AND NOT (newt OR toad)", "DATE:[2024-01-01,2024-12-31]")


@_register("SELECT query, query NOT IN ('owl AND NOT (newt OR toad)', 'DATE:[2024-01-01,2024-12-31]') AS refused FROM (VALUES " + ", ".join(f"('{q}')" for q in _BROKEN) + ") AS v(query)")
def query_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def refused(query: str) -> bool:
        try:
            parse(query)
        except QueryError:
            return True
        return False

    return spark.createDataFrame([(q, refused(q)) for q in _BROKEN], "query string, refused boolean")


_LINE = "(owl* OR n*t) and NOT(toad\tOr DATE:[2024-01-01,2024-02-01])"


@_register(
    f"""WITH found AS (SELECT regexp_extract_all('{_LINE}', '[()]|[^\\s()]+') AS l)
SELECT unnest(range(len(l))) AS place, unnest(l) AS token FROM found"""
)
def lexer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(tokenize(_LINE))), "place long, token string")


# -- Russian and English: sentences from a word list

#: Words, whether their language's stop list has them, and the stem that the published Snowball algorithms give.
_WORDS = (
    ("the", True, ""), ("running", False, "run"), ("computers", False, "comput"), ("happily", False, "happili"), ("and", True, ""), ("national", False, "nation"),
    ("generously", False, "generous"), ("skies", False, "sky"), ("hopping", False, "hop"), ("relational", False, "relat"), ("от", True, ""), ("документов", False, "документ"),
    ("быстрая", False, "быстр"), ("книги", False, "книг"), ("и", True, ""), ("красивый", False, "красив"), ("городами", False, "город"), ("читали", False, "чита"),
    ("важность", False, "важност"), ("что", True, ""), ("новое", False, "нов"), ("2024", False, "2024"), ("7", False, "7"),
)
_TABLE = "words AS (SELECT row_number() OVER () - 1 AS w, * FROM (VALUES " + ", ".join(f"('{w}', {str(stop).lower()}, '{stem}')" for w, stop, stem in _WORDS) + ") AS v(word, stop, stem))"
_SENTENCES = f"""{_TABLE}, placed AS (
  SELECT d.doc_id, p.position, word, stop, stem FROM documents d, (SELECT unnest(range(8)) AS position) p
  JOIN words ON w = (d.doc_id * 5 + p.position * p.position * (1 + d.doc_id % 3) + p.position * (d.doc_id % 7)) % {len(_WORDS)})"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: eight words of the list for each document, by its id."""
    words = F.array(*(F.lit(w) for w, _, _ in _WORDS))
    i = F.col("doc_id")
    picked = [F.get(words, ((i * 5 + p * p * (1 + i % 3) + p * (i % 7)) % len(_WORDS)).cast("int")) for p in range(8)]
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.initcap(F.concat_ws(", ", *picked)).alias("text"))


@_register(f"WITH {_SENTENCES} SELECT DISTINCT stem AS term, doc_id FROM placed WHERE NOT stop")
def stem_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full pipeline in both languages: stop words dropped, stems by each token's script."""
    return index.postings(sentences(spark, sf_dir), text.FULL)


@_register(f"WITH {_SENTENCES} SELECT doc_id, position, word AS term FROM placed WHERE NOT stop")
def stopword_filter_russian(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.tokens(sentences(spark, sf_dir), text.Pipeline(stop_words=text.stop_words()))
    return found.withColumn("position", F.col("position").cast("long"))


@_register(f"WITH {_SENTENCES} SELECT DISTINCT word AS term, doc_id FROM placed WHERE NOT stop AND word <> 'книги' AND word <> 'skies'")
def custom_stopwords_russian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(sentences(spark, sf_dir), text.Pipeline(stop_words=text.stop_words({"russian": ["книги"], "english": ["skies"]})))


@_register(f"WITH {_SENTENCES} SELECT DISTINCT word AS term, CASE WHEN regexp_matches(word, '\\p{{Cyrillic}}') THEN 'russian' ELSE 'english' END AS language, stop FROM placed")
def token_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each token, and whether that language's list has it."""
    term = F.col("term")
    stop = F.lit(False)
    for language in ("english", "russian"):
        own = [w for w, _, _ in _WORDS if text.is_stop_word(w, language)]
        stop = stop | ((text.token_language(term) == language) & term.isin(*own))
    found = index.postings(sentences(spark, sf_dir), text.PLAIN).select("term").distinct()
    return found.select("term", text.token_language(term).alias("language"), stop.alias("stop"))


_LANGUAGE = r"""CASE WHEN c + l = 0 THEN 'unknown' WHEN c / (c + l) > 0.2 AND l / (c + l) > 0.2 THEN 'mixed' WHEN c / (c + l) > 0.5 THEN 'russian' ELSE 'english' END"""
_LETTERS = r"""letters AS (SELECT doc_id, sum(len(regexp_extract_all(word, '\p{Cyrillic}'))) AS c, sum(len(regexp_extract_all(word, '\p{Latin}'))) AS l FROM placed GROUP BY doc_id)"""


@_register(f"WITH {_SENTENCES}, {_LETTERS} SELECT doc_id, {_LANGUAGE} AS language FROM letters")
def doc_language_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select("doc_id", text.text_language(F.col("text")).alias("language"))


def _flat(found: DataFrame) -> DataFrame:
    """Processed documents with one row for each kept token and how many distinct terms there are."""
    return found.select("doc_id", "lang", F.size("terms").cast("long").alias("n_terms"), F.inline("tokens")).withColumn("position", F.col("position").cast("long"))


_PROCESSED = f"""WITH {_SENTENCES}, {_LETTERS}, counts AS (SELECT doc_id, count(DISTINCT stem) AS n_terms FROM placed WHERE NOT stop GROUP BY doc_id)
SELECT doc_id, <lang> AS lang, n_terms, position, stem AS term FROM placed JOIN letters USING (doc_id) JOIN counts USING (doc_id) WHERE NOT stop"""


@_register(_PROCESSED.replace("<lang>", f"CASE {_LANGUAGE} WHEN 'unknown' THEN 'english' ELSE {_LANGUAGE} END"))
def process_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(text.process(sentences(spark, sf_dir), text.FULL))


@_register(_PROCESSED.replace("<lang>", "'russian'"))
def process_tokens_of_given_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given language is a label only: tokens go by their own script."""
    return _flat(text.process(sentences(spark, sf_dir), replace(text.FULL, forced="russian")))


@_register(f"WITH {_SENTENCES} SELECT doc_id, position, word AS term FROM placed WHERE length(word) >= 5")
def configured_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline by configuration: no stems, no stop words, at least five characters."""
    made = text.pipeline(Config(), PipelineConfig(stemming=False, min_term_length=5))
    return index.tokens(sentences(spark, sf_dir), made).withColumn("position", F.col("position").cast("long"))


# -- sources: the nations as files, with another extension and dates among them


def _files(spark: SparkSession, sf_dir: str, encoding: str = "utf-8") -> str:
    """A folder with a file for each nation (25 rows whatever the scale) and a metadata file."""
    folder = _folder(spark, f"files-{encoding}", sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect()
    delete(spark, folder)
    texts = {f"n{r[0]:02d}.{'md' if r[0] % 5 == 0 else 'TXT' if r[0] % 5 == 1 else 'txt'}": f"nation {r[1]} é número {r[0]}" for r in rows}
    dated = "".join(f"{name}: {{date: '2024-01-{i + 1:02d}', start_date: '{'2024-1-1' if i % 4 == 0 else '2023-12-01'}', end_date: ''}}\n" for i, name in enumerate(sorted(texts)))
    for name, content in [(n, t.encode(encoding)) for n, t in texts.items()] + [("metadata.yaml", dated.encode())]:
        where, files = located(spark, f"{folder}/{name}")
        out = files.create(where, True)
        out.write(content)
        out.close()
    return folder


_NATIONS = """WITH named AS (SELECT n_nationkey AS k, 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || CASE n_nationkey % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' ELSE '.txt' END AS filename,
  'nation ' || n_name || ' é número ' || n_nationkey AS text FROM nation),
dated AS (SELECT *, row_number() OVER (ORDER BY filename) - 1 AS i FROM named),
docs AS (SELECT CAST(row_number() OVER (ORDER BY filename) - 1 AS BIGINT) AS doc_id, filename, text, CAST(DATE '2024-01-01' + CAST(i AS INTEGER) AS VARCHAR) AS date,
  CASE WHEN i % 4 <> 0 THEN '2023-12-01' END AS start_date FROM dated WHERE k % 5 <> 0) """


@_register(_NATIONS + "SELECT filename, text FROM docs")
def source_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the default extension, in any case; the .md files stay out."""
    return sources.directory(spark, _files(spark, sf_dir))


@_register(_NATIONS + "SELECT filename, text FROM named WHERE k % 5 = 0")
def source_extensions_and_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.directory(spark, _files(spark, sf_dir, "latin-1"), [".md"], "ISO-8859-1")


@_register(_NATIONS + "SELECT filename, date, CASE WHEN i % 4 <> 0 THEN '2023-12-01' END AS start_date FROM (SELECT *, CAST(DATE '2024-01-01' + CAST(i AS INTEGER) AS VARCHAR) AS date FROM dated)")
def source_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of the metadata file; one that isn't strict is null."""
    found = sources.metadata(spark, _files(spark, sf_dir))
    return found.select("filename", F.col("date").cast("string").alias("date"), F.col("start_date").cast("string").alias("start_date"))


@_register(_NATIONS + "SELECT doc_id, filename, date, start_date FROM docs UNION ALL SELECT 20, 'n00.md', '2024-05-05', NULL")
def source_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configured folder, then one file more with a date of its own, as an index; found by a word that all have."""
    config = _plain()
    config.source.dir = _files(spark, sf_dir)
    found = Engine(spark, config)
    found.index_source()
    found.index_file(f"{config.source.dir}/n00.md", date="2024-05-05")
    return found.search("nation").documents().select("doc_id", "filename", F.col("date").cast("string").alias("date"), F.col("start_date").cast("string").alias("start_date"))


# -- the life of a key-value table: batches, flushes, compactions, opened again


def _table(spark: SparkSession, sf_dir: str, name: str, policy: kv.Policy = kv.LATEST) -> kv.Table:
    """Events as a table: twelve batches, three tables to a level, then closed and opened again."""
    path = _folder(spark, name, sf_dir)
    options = kv.Options(tables_per_level=3, levels=4, policy=policy)
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    deleted = F.col("event_type") == "purchase"
    # an event's bitmap has one bit: it is put down as it is, not packed into 4 KB for each event
    value = F.col("event_type").cast("binary") if policy is kv.LATEST else kv.bit(F.bitmap_bit_position(F.crc32("event_type") % 1000 + 1))
    rows = log.select(kv.keyed(F.col("user_id")).alias("key"), "event_id", deleted.alias("deleted"), value.alias("value"))
    delete(spark, path)
    table = kv.Table(spark, path, options)
    bounds = log.agg(F.min("event_id"), F.max("event_id")).first()
    step = (bounds[1] - bounds[0]) // 12 + 1
    for i in range(12):
        low = bounds[0] + i * step
        part = rows.where((F.col("event_id") >= low) & (F.col("event_id") < low + step))
        table.write_all(part.withColumn("seq", F.col("event_id") - low).withColumn("value", F.when(~F.col("deleted"), F.col("value"))).select("key", "value", "seq", "deleted"))
    table.put("~put", b"1")
    table.put("~put", b"2")
    table.put("~gone", b"3")
    table.delete("~gone")
    if policy is kv.UNION:
        table.delete("~put")
    table.close()
    return kv.Table(spark, path, options)


_LIFE = _KV.replace("value,", "event_type AS value,", 1)


@_register(_LIFE + "SELECT key, value FROM newest WHERE NOT deleted UNION ALL SELECT '~put', '2'")
def kv_table_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "kv-reopened").scan("", "\U0010ffff")
    return found.select("key", F.col("value").cast("string").alias("value"))


@_register(_LIFE + "SELECT key, value FROM newest WHERE NOT deleted AND key >= '0000000000000000005' AND key < '0000000000000000031'")
def kv_table_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "kv-range").scan("0000000000000000005", "0000000000000000031")
    return found.select("key", F.col("value").cast("string").alias("value"))


@_register(_LIFE + ", asked AS (SELECT unnest(['0000000000000000003', '0000000000000000012', '~put', '~gone', 'none']) AS key), have AS (SELECT key, value FROM newest WHERE NOT deleted UNION ALL SELECT '~put', '2') SELECT key, value FROM asked LEFT JOIN have USING (key)")
def kv_table_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "kv-points")
    asked = ("0000000000000000003", "0000000000000000012", "~put", "~gone", "none")
    return spark.createDataFrame([(k, None if (v := table.get(k)) is None else v.decode()) for k in asked], "key string, value string")


# Thirteen flushes with three tables to a level: four merges of level 0 (one flush is left), and one merge of level 1 (one table is left).
@_register("SELECT CAST(l AS BIGINT) AS level, CAST(CASE l WHEN 0 THEN 13 % 3 WHEN 1 THEN (13 // 3) % 3 WHEN 2 THEN 13 // 9 ELSE 0 END AS BIGINT) AS tables FROM (SELECT unnest(range(4)) AS l)")
def kv_table_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_table(spark, sf_dir, "kv-levels").tables_per_level())), "level long, tables long")


@_register(
    _KV + """, gone AS (SELECT key, max(seq) AS g FROM log WHERE deleted GROUP BY key)
SELECT key, count(DISTINCT event_type) AS members FROM (SELECT lpad(CAST(user_id AS VARCHAR), 19, '0') AS key, event_id AS seq, event_type FROM events WHERE event_type <> 'purchase') e LEFT JOIN gone USING (key)
WHERE g IS NULL OR seq > g GROUP BY key"""
)
def kv_table_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge policy of bitmaps, through flushes and compactions."""
    return _table(spark, sf_dir, "kv-union", kv.UNION).scan("", "\U0010ffff").select("key", F.bitmap_count("value").alias("members"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a boolean query, materialised."""
    return _engine(spark, sf_dir).query("(the OR of) AND NOT is").documents()
