"""Personal data: weak supervision over spans, with DataFrame functions only.

Regular expressions give candidate spans: the four strict kinds, which are always kept, and
looser ones. Four labelers vote on each candidate: its form (checksums, number ranges),
gazetteers (top-level domains, calling codes, card issuers, bank countries, reserved
blocks), words around it, and the characters at its edges. Votes are counted by pattern;
expectation-maximisation on these counts (their number has a bound, whatever the table's
size) estimates how reliable each labeler is and how likely each pattern. A logistic
classifier is then trained on counts of votes, shapes and the word before, hashed, with those
likelihoods as soft labels, and its weights, as one expression, decide on the looser
candidates: so a word that keeps company with likely spans speaks for others.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Characters of context on each side of a candidate.
CONTEXT = 40
THRESHOLD = 0.5
BASE = ("email", "ip", "card", "phone")
#: Looser kinds, in the order of their spans after the base ones.
MORE = ("email_words", "phone_local", "ssn", "iban", "mac")
KINDS = BASE + MORE

# Possessive quantifiers and look-behinds change no match; they keep long runs linear and off the stack.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_LOOSE = {
    "email_words": r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z]{2,}+)++",
    "phone_local": r"(?<![0-9+(.-])(?<!\+[0-9]{1,3}[\x20-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "mac": r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])",
}
#: Words near a candidate that speak for its kind, and words that speak against any.
_FOR = {
    "email": "mail|e-?mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|address|host|server|client|login|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta|iban|konto",
    "phone": "phone|tel|call|mobile|cell|fax|telefon|appel|llamar",
    "email_words": "mail|e-?mail|contact|write|kontakt|correo|courriel",
    "phone_local": "phone|tel|call|mobile|cell|fax|telefon|appel|llamar",
    "ssn": "ssn|social|security|taxpayer|tax",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "mac": "mac|ethernet|device|hardware|wlan|wifi",
}
_AGAINST = "version|release|isbn|issn|doi|sku|serial|part|model|figure|table|order"


#: Parts of a text whose lengths are added up in one go, and buckets of the word before a candidate.
_RUN, WORDS = 256, 32
#: Generic top-level domains (any two letters are a country's), calling codes and the starts of three-digit ones, lengths of account numbers by country.
_DOMAINS = "com org net edu gov mil int info biz name pro app dev io ai cloud online site shop store tech blog news media email xyz eu museum travel jobs mobi tel asia cat post".split()
_CALLING = "1|7|20|27|3[0123469]|4[013456789]|5[12345678]|6[0123456]|8[1246]|9[0123458]|2[123456]|29|3[578]|42|50|59|6[789]|80|85|87|88|96|97|99"
_ISSUERS = "4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|35(?:2[89]|[3-8])|30[0-5]|3[689]|6011|64[4-9]|65|62"
_ACCOUNTS = {
    15: "NO", 16: "BE", 18: "DK FI NL", 19: "MK SI", 20: "AT BA EE KZ LT LU", 21: "CH HR LI LV", 22: "BG DE GB GE IE ME RS", 23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN",
    25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL CY HU LB PL", 29: "BR", 31: "MT",
}


def _found(docs: DataFrame, patterns: dict[str, str], when: dict[str, Column]) -> DataFrame:
    """``docs`` (``id, text``) with the leftmost non-overlapping matches of each kind, as structs of start, end (code points), match and context.

    One pass marks the matches; between marks lie in turn the pieces of the text and the
    matches, whose lengths are added up in runs, and then the sums of runs, so that the time
    is in proportion to the matches. Each step is a column of its own, evaluated once.
    """
    plain = F.translate("text", "\0", "\ufffe")  # neither is in any pattern
    none = F.array().cast("array<string>")
    docs = docs.select("id", *(F.when(when[k], F.split(F.regexp_replace(plain, F.lit(p), F.lit("\0$0\0")), "\0", -1)).otherwise(none).alias(f"{k}_parts") for k, p in patterns.items()))
    zero = F.array(F.lit(0).cast("bigint"))
    append = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    own = lambda name: [F.col(f"{k}_{name}") for k in patterns]
    names = ["parts"]
    for name, made in (
        ("sizes", lambda k: F.transform(f"{k}_parts", lambda x: F.length(x).cast("bigint"))),
        ("runs", lambda k: F.transform(F.sequence(F.lit(0), ((F.size(f"{k}_sizes") - 1) / _RUN).cast("int")), lambda c: F.aggregate(F.slice(f"{k}_sizes", c * _RUN + 1, _RUN), zero, append))),
        ("bases", lambda k: F.aggregate(f"{k}_runs", zero, lambda acc, x: append(acc, F.element_at(x, -1)))),
        ("starts", lambda k: F.flatten(F.zip_with(f"{k}_runs", F.slice(f"{k}_bases", 1, F.size(f"{k}_runs")), lambda x, b: F.transform(x, lambda v: v + b)))),
    ):
        few = F.lit(2)
        columns = [F.when(F.size(f"{k}_parts") > few, made(k)).alias(f"{k}_{name}") for k in patterns]
        docs = docs.select("id", *(c for n in names for c in own(n)), *columns)
        names.append(name)

    def spans(k: str) -> Column:
        # a run holds its own end too, so a part's start lies one place further for each run before it
        def one(i: Column) -> Column:
            at = F.get(f"{k}_starts", (2 * i - 1 + F.floor((2 * i - 1) / _RUN)).cast("int"))
            match = F.get(f"{k}_parts", 2 * i - 1)
            before, after = F.right(F.get(f"{k}_parts", 2 * i - 2), F.lit(CONTEXT)), F.left(F.get(f"{k}_parts", 2 * i), F.lit(CONTEXT))
            return F.struct(at.alias("start"), (at + F.length(match)).alias("end"), match.alias("match"), before.alias("before"), after.alias("after"))

        count = ((F.size(f"{k}_parts") - 1) / 2).cast("int")
        empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>")
        return F.when(F.size(f"{k}_parts") > 2, F.transform(F.sequence(F.lit(1), count), one)).otherwise(empty)

    return docs.select("id", *(spans(k).alias(k) for k in patterns))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether the digits of ``x`` pass Luhn's sum."""
    digits = F.reverse(_digits(x))

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _mod97(x: Column) -> Column:
    """Whether an IBAN's check digits hold."""
    plain = F.regexp_replace(x, "\\x20", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        value = F.ascii(c)
        return F.when(value < 58, (acc * 10 + value - 48) % 97).otherwise((acc * 100 + value - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(add(a, c))) == 1


def _valid(kind: str, x: Column) -> Column:
    """The rule that a match of a base kind must meet."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(x, "\\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(x)).between(16, 19) & _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def _form(kind: str, x: Column) -> Column:
    """First labeler, by form: 1 for, -1 against, 0 no opinion."""
    digits = _digits(x)
    against, sure = {
        "email": (F.lit(False), x.rlike(r"\.[A-Za-z]{2,}$")),
        "ip": (x.rlike(r"^(?:0|127|255)\."), F.lit(True)),
        "card": (digits.rlike(r"^0{6}"), digits.rlike("^[3-6]")),
        "phone": (digits.rlike("^0{4}"), F.length(digits).between(10, 13)),
        "email_words": (F.lit(False), x.rlike(r"(?i)dot[\])]\x20?[A-Za-z]{2,}$")),
        "phone_local": (digits.rlike("^[01]|^...[01]11"), digits.rlike("^[2-9]..[2-9]")),
        "ssn": (digits.rlike("^(?:000|666|9)|^...00|0000$"), F.lit(False)),
        "iban": (~_mod97(x), _mod97(x)),
        "mac": (x.rlike("(?i)^(?:00:){5}|^(?:ff:){5}"), F.lit(True)),
    }[kind]
    return F.when(against, -1).when(sure, 1).otherwise(0)


def _gazetteer(kind: str, x: Column) -> Column:
    """Second labeler, by lists of what there is: 1 if the candidate is listed, -1 if it should be and isn't, 0 where no list helps."""
    digits = _digits(x)
    if kind in ("email", "email_words"):
        top = F.lower(F.regexp_extract(x, "([A-Za-z0-9-]+)$", 1))
        return F.when(top.rlike("^[a-z]{2}$") | top.isin(*_DOMAINS), 1).otherwise(-1)
    if kind == "phone":
        return F.when(digits.rlike(f"^(?:{_CALLING})"), 1).otherwise(-1)
    if kind == "card":
        return F.when(digits.rlike(f"^(?:{_ISSUERS})"), 1).otherwise(-1)
    if kind == "ip":
        return F.when(x.rlike(r"^0*(?:10|127|192\.0*168|169\.0*254|172\.0*(?:1[6-9]|2[0-9]|3[01])|0|22[4-9]|2[3-5][0-9])\."), -1).otherwise(1)
    if kind == "iban":
        plain = F.regexp_replace(x, "\\x20", "")
        fits = [(F.length(plain) == n) & F.substring(plain, 1, 2).isin(*codes.split()) for n, codes in _ACCOUNTS.items()]
        listed = F.lit(False)
        for f in fits:
            listed = listed | f
        return F.when(listed, 1).otherwise(-1)
    if kind == "phone_local":
        return F.when(digits.rlike("^(?:555|[2-9]00|[2-9]9[0-9])"), -1).when(digits.rlike("^8(?:00|33|44|55|66|77|88)"), -1).otherwise(0)
    if kind == "ssn":
        return F.when(digits.isin("078051120", "219099999", "123456789"), -1).otherwise(0)
    return F.lit(0)


def _context(kind: str, before: Column, after: Column) -> Column:
    """Third labeler, by words near."""
    near = F.concat_ws(" ", before, after)
    return F.when(near.rlike(rf"(?i)\b(?:{_FOR[kind]})\b"), 1).when(near.rlike(rf"(?i)\b(?:{_AGAINST})\b"), -1).otherwise(0)


def _edges(before: Column, after: Column) -> Column:
    """Fourth labeler, by the characters next to the candidate."""
    glued = before.rlike(r"[\p{L}\p{N}_/=]$") | after.rlike(r"^[\p{L}\p{N}_/=]")
    loose = (before.rlike(r"[\s(:,;<\"'.]$") | (before == "")) & (after.rlike(r"^[\s).,;:>\"'!?]") | (after == ""))
    return F.when(glued, -1).when(loose, 1).otherwise(0)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, c``: the candidates of each row, by kind and start, with the four votes, a shape and the word before; written to the shared folder."""
    own = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"))
    has = lambda s: F.contains(F.col("text"), F.lit(s))
    digit = F.col("text").rlike("[0-9]")
    when = {"email": has("@"), "ip": digit & has("."), "card": F.col("text").rlike("[0-9][0-9\\x20-]{14}"), "phone": has("+")}
    loose = {
        "email_words": F.col("text").rlike(r"(?i)[\[(]at[\])]"),
        "phone_local": F.col("text").rlike(r"[0-9]{3}[.-][0-9]{4}"),
        "ssn": F.col("text").rlike("[0-9]-[0-9]{2}-[0-9]{4}"),
        "iban": F.col("text").rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
        "mac": F.col("text").rlike("(?i):[0-9a-f]{2}:[0-9a-f]{2}:"),
    }
    patterns = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE} | _LOOSE

    def voted(kind: str) -> Column:
        found = F.filter(kind, lambda s: _valid(kind, s["match"]))
        word = lambda s: F.lower(F.regexp_extract(s["before"], r"(\p{L}+)[^\p{L}]*$", 1))
        return F.transform(
            found,
            lambda s: F.struct(
                F.lit(KINDS.index(kind)).cast("tinyint").alias("kind"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                _form(kind, s["match"]).cast("tinyint").alias("v1"),
                _gazetteer(kind, s["match"]).cast("tinyint").alias("v2"),
                _context(kind, s["before"], s["after"]).cast("tinyint").alias("v3"),
                _edges(s["before"], s["after"]).cast("tinyint").alias("v4"),
                F.least(F.length(s["match"]) / 8, F.lit(4)).cast("tinyint").alias("shape"),
                F.when(word(s) == "", 0).otherwise(1 + F.pmod(F.xxhash64(word(s)), F.lit(WORDS))).cast("tinyint").alias("word"),
            ),
        )

    found = _found(own, patterns, when | loose)
    return cut(found.select("id", F.concat(*(voted(k) for k in KINDS)).alias("c")), "candidates")


def reliabilities(counts: Iterable[tuple[tuple[int, ...], float]], labelers: int = 4, rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]], dict]:
    """Expectation-maximisation on counts of vote patterns.

    Returns the share of true candidates, each labeler's chance of a vote for true and for
    false ones, and the likelihood of each pattern. A majority vote starts it.
    """
    counts = [(v, n) for v, n in counts]
    belief = {v: 0.5 + 0.45 * max(-1, min(1, sum(v))) for v, _ in counts}
    share, chances = 0.5, []
    for _ in range(rounds):
        true = sum(n * belief[v] for v, n in counts)
        false = sum(n * (1 - belief[v]) for v, n in counts)
        share = min(0.99, max(0.01, (true + 1) / (true + false + 2)))
        chances = []
        for k in range(labelers):
            chances.append(
                {
                    x: (
                        (sum(n * belief[v] for v, n in counts if v[k] == x) + 1 + (x == 1)) / (true + 4),
                        (sum(n * (1 - belief[v]) for v, n in counts if v[k] == x) + 1 + (x == -1)) / (false + 4),
                    )
                    for x in (-1, 0, 1)
                }
            )
        for v, _ in counts:
            log = math.log(share / (1 - share)) + sum(math.log(chances[k][x][0] / chances[k][x][1]) for k, x in enumerate(v))
            belief[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
    return share, chances, belief


def classifier(rows: list[tuple[list[float], float, float]], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Weights (the last is the constant) of a logistic model fitted to ``(features, soft label, count)`` rows."""
    if not rows:
        return []
    x = np.array([[*f, 1.0] for f, _, _ in rows])
    label, share = np.array([y for _, y, _ in rows]), np.array([n for _, _, n in rows], float)
    share /= share.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        off = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - label) * share
        slope = x.T @ off
        slope[:-1] += ridge * w[:-1]
        w -= rate * slope
    return w.tolist()


VOTES = ("v1", "v2", "v3", "v4")


def _features(kind: int, votes: tuple[int, ...], shape: int, word: int) -> list[float]:
    return [float(kind == k) for k in range(len(KINDS))] + [float(word == k) for k in range(WORDS + 1)] + [float(v) for v in votes] + [shape / 4]


def learned(found: DataFrame) -> list[float]:
    """Classifier weights from all candidates; the driver gets counts by kind, votes, shape and word bucket only (at most 9 * 81 * 5 * 33 rows, for any table)."""
    counts = found.select(F.explode("c").alias("c")).groupBy("c.kind", *(f"c.{v}" for v in VOTES), "c.shape", "c.word").agg(F.count("*").alias("n")).collect()
    by_kind: dict[int, dict] = {}
    for r in counts:
        votes, own = by_kind.setdefault(r["kind"], {}), tuple(r[v] for v in VOTES)
        votes[own] = votes.get(own, 0) + r["n"]
    beliefs = {k: reliabilities(sorted(v.items()))[2] for k, v in by_kind.items()}
    rows = [(_features(r["kind"], votes := tuple(r[v] for v in VOTES), r["shape"], r["word"]), beliefs[r["kind"]][votes], r["n"]) for r in counts]
    return classifier(sorted(rows))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans array<struct<kind,start,end,base>>`` of each row, by kind and start.

    Null and empty texts have none; repeated rows and null ids are each scanned; other
    columns are ignored; an empty table gives no rows. A long text is scanned whole, in time
    in proportion to its length and its matches.
    """
    found = candidates(docs, id_col, text_col)
    w = learned(found)

    def kept(c: Column) -> Column:
        if not w:
            return c["kind"] < len(BASE)
        pick = lambda own, name: F.element_at(F.array(*map(F.lit, own)), c[name].cast("int") + 1)
        z = pick(w[: len(KINDS)], "kind") + pick(w[len(KINDS) : len(KINDS) + WORDS + 1], "word") + w[-2] * c["shape"] / 4 + w[-1]
        for v, weight in zip(VOTES, w[-2 - len(VOTES) : -2]):
            z = z + weight * c[v]
        return (c["kind"] < len(BASE)) | (1 / (1 + F.exp(-z)) >= THRESHOLD)

    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(
        F.filter("c", kept),
        lambda c: F.struct(F.element_at(names, c["kind"].cast("int") + 1).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), (c["kind"] < len(BASE)).alias("base")),
    )
    return found.select(F.col("id").alias(id_col), spans.alias("spans"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans of each row."""
    joined = lambda s: F.array_join(F.transform(s, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda c: c["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("spans", lambda c: c["base"])
    return find(docs, id_col, text_col).select(id_col, *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
