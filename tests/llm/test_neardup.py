import random
import re

import numpy as np
import pytest

from lexispark.llm import hashing, neardup


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent=80):
    """Component and set size by row, by all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            linked = neardup.shingle_similarity(sets[i], sets[j], percent) or rows[i][0] == rows[j][0]
            if rows[i][0] is not None and rows[j][0] is not None and linked:
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return sorted((str(key), len(s), str(least.get(top(i)))) for i, ((key, _), s) in enumerate(zip(rows, sets)))


def run(docs, **options):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in neardup.near_duplicates(docs, **options).collect())


def test_sets_are_those_of_words():
    texts = ["A b  c\td e", "a B", "", " \n", "x x x x x x", "é Ü a\xa0b c d", "a b c d e"]
    values, offsets = hashing.shingle_sets(texts, 4)
    assert np.diff(offsets).tolist() == [len(shingles(t, 4)) for t in texts]
    parts = [set(values[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
    assert parts[0] == parts[6] and parts[1] and not parts[1] & parts[0]


def test_signature_is_that_of_the_sequential_algorithm():
    m, rng = 16, random.Random(1)
    sets = [np.array(sorted({rng.getrandbits(64) for _ in range(n)}), np.uint64) for n in (1, 2, 7, 40, 300)]
    got = neardup.superminhash(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), m)
    golden, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    for values, signature in zip(sets, got):
        slots = [None] * m
        for v in values:
            seed, p = int(hashing.mix(np.array([v ^ np.uint64(0x5851F42D4C957F2D)]))[0]), list(range(m))
            for j in range(m):
                draw = int(hashing.mix(np.array([(seed + (j * golden & mask)) & mask], np.uint64))[0])
                k = j + (draw >> 40) % (m - j)
                p[j], p[k] = p[k], p[j]
                rank = j << 40 | draw & (1 << 40) - 1
                slots[p[j]] = rank if slots[p[j]] is None else min(slots[p[j]], rank)
        assert signature.tolist() == slots


def test_signature_estimates_similarity():
    rng = random.Random(2)
    common, a, b = ([rng.getrandbits(64) for _ in range(n)] for n in (400, 50, 50))
    x, y = (np.array(sorted(common + z), np.uint64) for z in (a, b))
    s = neardup.superminhash(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 200)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.09


def corpus(seed, groups=6, copies=12, changes=(0, 1, 2, 3, 5, 9)):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 90))]
        for _ in range(copies):
            own = list(text)
            for _ in range(rng.choice(changes)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(docs_of, seed):
    rows = corpus(seed)
    assert run(docs_of(rows), shingle=4) == brute(rows, 4)


def test_odd_rows(docs_of):
    same = "one two three four five six seven eight nine ten"
    rows = [(5, same), (3, same.upper()), (9, same), (9, same), (4, None), (6, ""), (7, " \n"), (8, "a b"), (2, "A  b"), (None, same), (None, None), (20, same + " " * 50_000), (11, "x y z q r s"), (11, same), (12, "x y z q r s")]
    assert run(docs_of(rows)) == brute(rows, 5)
    assert run(docs_of([])) == []
    kept = [r["doc_id"] for r in neardup.near_duplicates(docs_of(rows)).where("kept").collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [3, 4, 6, 7, 2, None, None]))


def test_divided_groups_are_joined_in_small_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = corpus(5, groups=2, copies=30, changes=(2, 3, 4, 5))
    assert run(docs_of(rows), shingle=4) == brute(rows, 4)


def test_divided_groups_of_many_sizes(docs_of, monkeypatch):
    """Chains of ever shorter copies, so that links lead across classes of size."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 2000)
    rng, rows = random.Random(8), []
    for _ in range(3):
        text = [f"v{rng.randrange(900)}" for _ in range(400)]
        for size in rng.sample(range(40, 400), 22):
            own = text[:size]
            for _ in range(rng.choice((0, 0, 1, 2))):
                own[rng.randrange(size)] = f"z{rng.randrange(9)}"
            rows.append((len(rows) * 7 % 66, " ".join(own)))
    assert run(docs_of(rows), shingle=4) == brute(rows, 4)


def test_roots_after_more_links(spark):
    rng = random.Random(4)
    first, more = ([(rng.randrange(60), rng.randrange(60)) for _ in range(25)] for _ in range(2))
    table = lambda links: spark.createDataFrame(links, "a long, b long")
    found = dict(neardup.extended(neardup.components(table(first)), table(more)).collect())
    whole = dict(neardup.components(table(first + more)).collect())
    assert {k: v for k, v in found.items() if k != v} == whole


def test_components_of_a_path_and_a_star(spark):
    links = [(i + 1, i) for i in range(20)] + [(100 + i, 99) for i in range(30)] + [(99, 98), (7, 7)]
    rng = random.Random(3)
    rng.shuffle(links)
    found = dict(neardup.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {k: v for k, v in found.items() if k != v} == {i: 0 for i in range(1, 21)} | {i: 98 for i in [99, *range(100, 130)]}
