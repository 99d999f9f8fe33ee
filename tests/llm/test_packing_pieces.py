import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")
from lexispark.llm import packing, pieces, tokens  # noqa: E402

WORDS = tokens.vocabulary("word_bpe_49k.json")
PIECES = tokens.vocabulary("piece_bpe_32k.model")
TEXTS = [
    "Hello, it's 2024! don't  stop\nÜber Ñandú façade", "", "  ", "日本語 テスト 😀 مرحبا", "a\x0bb\x0cc\x1cd\xa0e\u2003f", "x" * 5000, "İstanbul ΟΔΟΣ É é ﬁ ① ½ ²",
    "<|endoftext|> plain <|startoftext|>", "foo-bar_baz#$% 'tis 'twas we'll", "word " * 3000, "\x00\x7f \x85",
]


def encode(text):
    return tokens.fast_tokenizer(WORDS).encode(text, add_special_tokens=False).ids


def words_of(texts):
    table = tokens.FastWords(WORDS)
    words, per_text = tokens.split_words(pa.array(texts, pa.string()))
    ids, counts = table.lookup(words)
    return [x.tolist() for x in np.split(ids, np.cumsum(tokens.by_text(counts, per_text))[:-1])]


def test_word_ids_equal_the_tokenizer():
    more = ["ab" * 31 + " " + "abc" * 22, "\xb5\xaa\xb2\xb3\xb9\xba \xd7\xf7 \xdf\xff", "a'sb't'LL've", "x" * 63 + " " + "x" * 64 + " " + "x" * 65]
    assert words_of(TEXTS + more + [None]) == [encode(t) for t in TEXTS + more] + [[]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x17F) | st.sampled_from("aeinrst'1 ")), max_size=5))
def test_word_ids_of_any_texts(texts):
    assert words_of([*texts, "end"]) == [encode(t) for t in [*texts, "end"]]


def test_long_text_is_tokenised_in_stretches(docs_of, monkeypatch):
    text = "\n".join(f"paragraph {i} of a long text, " * 20 for i in range(12_000))
    assert len(text) > 3 * tokens.TOKEN_SLICE
    own = encode(text) + [1]
    found = packing.pack(docs_of([(1, "before"), (2, text), (3, "after")]), WORDS).where("doc_id = 2").orderBy("start").collect()
    assert {r["doc_tokens"] for r in found} == {len(own)} and sum(r["length"] for r in found) == len(own)
    for r in found[:3] + found[-3:]:
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_packing_round_trip(docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, None), (None, "null id"), (1, "")]
    docs = docs_of(rows).repartition(3)
    found = packing.pack(docs, WORDS, length=64).collect()
    expected = sorted((str(k), len(encode(t or "")) + 1) for k, t in rows)
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in found if r["start"] == 0) == expected
    # each sequence is gapless and full but the last
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for s, own in by.items():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == 64 or s == max(by)
    texts = {k: encode(t or "") + [1] for k, t in rows if k not in (1, 3)}
    for r in found:
        if r["doc_id"] in texts:
            own = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
    assert packing.pack(docs_of([]), WORDS).collect() == []


def test_sequences_hold_the_whole_stream(docs_of):
    rows = [(i, f"document {i} " * (i % 7 + 1)) for i in range(40)]
    docs = docs_of(rows).repartition(5)
    made = packing.sequences(docs, WORDS, length=32, pad=0).orderBy("sequence_id").collect()
    stream = [i for r in made for i in r["ids"][: r["n_tokens"]]]
    assert all(len(r["ids"]) == 32 for r in made) and all(r["n_tokens"] == 32 for r in made[:-1])
    parts, own = [], []
    for i in stream:
        own.append(i)
        if i == 1:
            parts.append(tuple(own))
            own = []
    assert own == [] and sorted(parts) == sorted(tuple(encode(t) + [1]) for _, t in rows)


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(PIECES)


def every(lattice, text):
    """All segmentations of a short text with their scores."""
    if not text:
        return [(0.0, ())]
    out = []
    for k in range(1, len(text) + 1):
        i = lattice.ids.get(text[:k])
        if i is None and k > 1:
            continue
        score = lattice.unknown_score if i is None else lattice.score[i]
        out += [(score + s, (lattice.unknown if i is None else i, *x)) for s, x in every(lattice, text[k:])]
    return out


def sizes_from_the_end(lattice, ids):
    return [-int(lattice.sizes[i]) for i in reversed(ids)]


@pytest.mark.parametrize("chunk", ["▁the", "▁nation", "thereof", "▁▁a", "▁xé", "日本", "aaaaaaaa", "▁", "q", "abababab", "bbbabbba"])
def test_nbest_against_all_segmentations(lattice, chunk):
    expected = sorted(every(lattice, chunk), key=lambda x: (-x[0], sizes_from_the_end(lattice, x[1])))
    for n in (1, 2, 5, 40):
        assert [(float(s), x) for s, x in expected[:n]] == lattice.nbest(chunk, n)
    ids, counts, best, loss = lattice.solve([chunk, chunk])
    assert best[0] == best[1] == expected[0][0] and ids[: counts[0]].tolist() == list(expected[0][1])
    assert loss[0] == (expected[0][0] - expected[1][0] if len(expected) > 1 else np.inf)


class Flat(pieces.Lattice):
    """A lattice where every piece has the same score, so that nearly all paths tie."""

    def __init__(self, path):
        super().__init__(path)
        self.score = np.where(self.score < 0, -1.0, self.score)


def test_ties_beyond_any_bound_and_long_words_follow_one_rule():
    lattice = Flat(PIECES)
    chunk = "aaaaabaab"
    expected = sorted(every(lattice, chunk), key=lambda x: (-x[0], sizes_from_the_end(lattice, x[1])))
    assert max(Counter(s for s, _ in expected).values()) > 20  # past four times the default n
    assert [(float(s), x) for s, x in expected] == lattice.nbest(chunk, len(expected))
    draw = np.random.default_rng(5)
    for size in (33, 63, 64, 65, 66, 90):
        words = ["".join(draw.choice(list("ab"), size)) for _ in range(20)]
        for own in (lattice, pieces.Lattice(PIECES)):
            ids, counts, best, loss = own.solve(words)
            for word, x, b, lost in zip(words, np.split(ids, np.cumsum(counts)[:-1]), best, loss):
                first, second = own.nbest(word, 2)
                assert first == (b, tuple(x.tolist())) and first[0] - second[0] == lost


def test_a_long_text_without_spaces_takes_little_memory(docs_of):
    import tracemalloc

    text = "".join(np.random.default_rng(3).choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000))
    lattice = pieces.Lattice(PIECES)
    tracemalloc.start()
    found = lattice.nbest(text, 3)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    assert len(found) == 3 and found[0][0] >= found[1][0] >= found[2][0]
    row = pieces.segment(docs_of([(1, text[:30_000])]), PIECES).first()
    assert row["round_trip"] and len(set(row["nbest_crc32"])) == 5


def test_blocks_of_a_long_text_change_nothing(monkeypatch):
    text = " ".join(f"word{i % 97} the nation " for i in range(400))
    expected = pieces.encode_nbest(text, PIECES, 4)
    monkeypatch.setattr(pieces, "TOKEN_SLICE", 1000)
    monkeypatch.setattr(pieces, "_CHUNKS", 50)
    assert pieces.encode_nbest(text, PIECES, 4) == expected


def test_nbest_of_texts_against_all(lattice):
    for text in ("the cat", "a b a", "no\nway", "the the the"):
        chunks = lattice.chunks(text)
        assert "".join(chunks) == "▁" + text.replace(" ", "▁")
        expected = sorted((s for s, _ in every(lattice, "".join(chunks))), reverse=True)[:5]
        found = pieces.encode_nbest(text, PIECES, 5)
        assert [s for s, _ in found] == expected and len({tuple(x) for _, x in found}) == len(found)
        assert all(lattice.decode(x) == text for _, x in found)


def test_segments_and_round_trip(docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (None, "null id"), (0, TEXTS[0]), (51, "mark ▁ here"), (52, "  lead and trail  \n")]
    found = pieces.segment(docs_of(rows), PIECES, ids=True).collect()
    assert len(found) == len(rows)
    for (key, text), r in zip(rows, found):
        assert r["doc_id"] == key and r["round_trip"] == (key != 51)
        best = pieces.encode_nbest(text or "", PIECES, 5)
        assert r["nbest_scores"] == [s for s, _ in best] and r["score"] == best[0][0] and r["nbest_ids"] == [x for _, x in best]
        assert r["nbest_crc32"] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in r["nbest_ids"]] and r["n_pieces"] == len(best[0][1])
        if not text:
            assert (r["n_pieces"], r["score"], r["nbest_scores"]) == (0, 0.0, [0.0])
    assert pieces.segment(docs_of([]), PIECES).collect() == []
