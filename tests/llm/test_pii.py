import hashlib
import re

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import pii


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return out


def check(rows, found):
    order = lambda key: (key is not None, key or 0)
    for (key, text), r in zip(sorted(rows, key=lambda x: order(x[0])), sorted(found, key=lambda r: order(r["doc_id"])), strict=True):
        expected = base(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in expected)
        assert r["doc_id"] == key and r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (text[:200], r["spans"])
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in expected) for k in pii.BASE]
        assert r["spans"].startswith(joined)


def test_odd_rows(docs_of):
    texts = [
        "", "a@b.com_x@d.ef a@@b.c x@y x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 00000000000000000000000000001.1.1.1", "é" * 5 + "x@é.com 😀 a.b@c-d.e",
        "4111 1111 1111 1111 4111-1111-1111-1111-1 4111111111111111", "+1 (702) 555-0742, ++12 34 +1234567-", "1" * 50_000, "1 " * 30_000, "a." * 20_000 + "@b.c" + ".d" * 9000, "+1" * 20_000, "+1-" * 3000 + "x",
        "9.9.9.9" * 3, "a@b.c@d.e", "+12345678 4111111111111111@x.y",
    ]
    rows = [*enumerate(texts), (50, None), (None, "a@b.com"), (1, texts[1])]
    check(rows, pii.digest(docs_of(rows)).collect())
    assert pii.digest(docs_of([])).collect() == []


_PARTS = ["a", "@", ".", "b-c", "1", "25", "256", "4111111111111111", " ", "-", "+", "(", ")", "é", "_", "0", "+1", "x@y.z", "1.2.3.4", "\n"]


def test_random_texts(spark, docs_of):
    rows = []

    @settings(max_examples=400, deadline=None, database=None)
    @given(st.lists(st.sampled_from(_PARTS), max_size=16))
    def gather(parts):
        rows.append((len(rows), "".join(parts)))

    gather()
    check(rows, pii.digest(docs_of(rows)).collect())


def test_added_spans(docs_of):
    rows = [(1, "call (702) 555-0742 now"), (2, "bank iban DE89 3704 0044 0532 0130 00."), (3, "part 702-555-0742x"), (4, "my ssn is 536-22-1234, social security"), (5, "write to joe [at] mail [dot] org today"), (6, "+1 (702) 555-0742")]
    rows = rows + [(10 + i, t) for i, (_, t) in enumerate(rows * 5)]
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(docs_of(rows)).collect()}
    assert spans[1] == "phone_local:5:19" and spans[2].startswith("iban:10:") and spans[3] == "" and spans[6] == "phone:0:17"
    assert spans[4].startswith("ssn:10:21") and spans[5].startswith("email_words:9:")


def test_long_addresses_and_many_matches(docs_of):
    user, host = "u" * 90, "h" * 70
    rows = [(1, f"write to {user} [at] {host} [dot] {'d' * 30} [dot] com [dot] co [dot] org today, mail"), (2, "mail a@b.com now " * 700), (3, "x" + "\0" + "a@b.com\0\0c@d.org")]
    rows += [(10 + i, "write to joe [at] mail [dot] org today") for i in range(8)]
    found = {r["doc_id"]: r for r in pii.digest(docs_of(rows)).collect()}
    assert found[1]["spans"] == f"email_words:9:{len(rows[0][1]) - 12}"
    check(rows[1:3], [found[2], found[3]])


def test_time_grows_with_the_matches(docs_of):
    import time

    seconds = []
    for n in (4_000, 4_000, 64_000):
        start = time.time()
        row = pii.digest(docs_of([(1, "write joe.smith@mail.org " * n)])).first()
        seconds.append(time.time() - start)
        assert row["n_email"] == n
    assert seconds[2] < 16 * seconds[1]


def added(text):
    """Candidates of the looser kinds by plain searches."""
    spans = []
    for kind in pii.MORE:
        spans += [(kind, *m.span()) for m in regex.finditer(pii._LOOSE[kind], text)]
    return spans


def test_candidates_against_plain_searches(docs_of):
    texts = [
        "call (702) 555-0742, 702.555.0742 or 1-702-555-0742", "DE89 3704 0044 0532 0130 00 and GB29NWBK60161331926819 xDE893704", "00:1a:2B:3c:4d:5e 00:1a:2B:3c:4d:5e:6f",
        "536-22-1234 536-22-12345 x536-22-1234", "joe [at] mail [dot] org, a.b(at)c.de ab[at]c-d (dot) ef.gh", "nothing here",
    ]
    rows = list(enumerate(texts))
    for r in pii.candidates(docs_of(rows)).collect():
        got = sorted((pii.KINDS[c["kind"]], c["start"], c["end"]) for c in r["c"] if c["kind"] >= len(pii.BASE))
        assert got == sorted(added(texts[r["id"]])), texts[r["id"]]


def test_reliabilities_find_the_good_labeler():
    # labeler 0 is right, 1 is a coin, 2 abstains
    counts = [((1, 1, 0), 45), ((1, -1, 0), 45), ((-1, 1, 0), 5), ((-1, -1, 0), 60), ((1, 1, 1), 30), ((-1, -1, -1), 30)]
    share, chances, belief = pii.reliabilities(counts, labelers=3)
    assert 0 < share < 1 and belief[(1, 1, 1)] > 0.9 > 0.1 > belief[(-1, -1, -1)]
    assert chances[0][1][0] > chances[0][1][1] and pii.reliabilities([])[2] == {}


def test_plan_has_no_python(docs_of):
    plan = pii.digest(docs_of([(1, "a@b.com")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
