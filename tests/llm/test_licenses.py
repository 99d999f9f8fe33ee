import difflib
import random
from itertools import combinations

import pytest

from lexispark.llm import licenses


def longest(a, b):
    """Length of the longest common subsequence, by trying every subsequence of the shorter list."""
    a, b = sorted((a, b), key=len)
    for size in range(len(a), 0, -1):
        for own in combinations(a, size):
            rest = iter(b)
            if all(w in rest for w in own):
                return size
    return 0


def plain(a, b):
    """Patience alignment by its definition: equal ends, then the largest set of words unique on both sides that keeps its order, then the gaps."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    once = [w for w in a if a.count(w) == 1 == b.count(w)]
    for size in range(len(once), 0, -1):
        kept = [own for own in combinations(once, size) if [b.index(w) for w in own] == sorted(b.index(w) for w in own)]
        if kept:
            return {head + tail + size + gaps for own in kept for gaps in between(a, b, own)}
    return {head + tail}


def between(a, b, own):
    """Possible sizes of the alignments of the gaps between anchors."""
    sizes = {0}
    ends = [(-1, -1), *((a.index(w), b.index(w)) for w in own), (len(a), len(b))]
    for (x, y), (x2, y2) in zip(ends, ends[1:]):
        gap = plain(a[x + 1 : x2], b[y + 1 : y2]) if x + 1 < x2 and y + 1 < y2 else {0}
        sizes = {s + g for s in sizes for g in gap}
    return sizes


def test_alignment_of_short_lists_by_its_definition():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(10))] for _ in "ab")
        pairs = licenses.align(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) in plain(a, b) and len(pairs) <= longest(a, b)
    same = [str(i) for i in range(50)]
    assert licenses.align(same, same) == [(i, i) for i in range(50)]
    assert licenses.align([], same) == []


def test_alignment_of_words_that_occur_once_is_the_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        a, b = (rng.sample("abcdefghijkl", rng.randrange(9)) for _ in "ab")
        assert len(licenses.align(a, b)) == longest(a, b)


def test_scan_against_every_window():
    """Best coverage of a few templates in short texts, by aligning them with every window of the text."""
    rng = random.Random(9)
    templates = [t for t in licenses.TEMPLATES if t.name in ("MPL-2.0", "CC0-1.0", "Apache-2.0", "BSD-3-Clause") and len(t.text) < 250]
    for k in range(24):
        template = templates[k % len(templates)]
        own = [w if rng.random() > 0.07 else "zz" for w in template.text.split()]
        text = " ".join(["pre", "of"] * rng.randrange(6) + own + ["the", "post"] * rng.randrange(6))
        plain_words = [w for w, _, _ in licenses.words(text)]
        best: dict[str, float] = {}
        for t in templates:
            target = [w for w, _, _ in licenses.words(t.text)]
            for a in range(len(plain_words)):
                for b in range(a + 1, min(len(plain_words), a + 2 * len(target)) + 1):
                    pairs = licenses.align(plain_words[a:b], target)
                    if set(t.telling) <= {target[y] for _, y in pairs}:
                        best[t.name] = max(best.get(t.name, 0), len(pairs) / len(target))
        wanted = max((c, n) for n, c in best.items()) if best else (0, None)
        found = licenses.find(text)
        if wanted[0] >= licenses.COVERAGE:
            assert [f[0] for f in found] == [wanted[1]] and found[0][3] >= 0.95 * wanted[0], text
        else:
            assert not [f for f in found if f[0] in best]


def test_longest_increasing():
    rng = random.Random(2)
    for _ in range(200):
        v = rng.sample(range(20), rng.randrange(12))
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = max([best[j] + 1 for j in range(i) if v[j] < v[i]] + [1])
        got = [v[i] for i in licenses.increasing(v)]
        assert got == sorted(got) and len(got) == max(best, default=0)


def test_coverage_is_close_to_that_of_a_full_comparison():
    rng = random.Random(3)
    template = [w for w, _, _ in licenses.words(licenses.TEMPLATES[0].text)]
    for _ in range(10):
        own = [w for w in template if rng.random() > 0.08]
        full = sum(m.size for m in difflib.SequenceMatcher(None, own, template, autojunk=False).get_matching_blocks())
        assert len(licenses.align(own, template)) >= 0.95 * full


@pytest.mark.parametrize("template", licenses.TEMPLATES, ids=lambda t: f"{t.name}-{len(t.text)}")
def test_each_template_is_found_in_place(template):
    text = "Some prose before it.\n" + template.text + "\nand some words after it"
    found = licenses.find(text)
    assert [f[0] for f in found] == [template.name] and found[0][3] == 1.0
    assert text[found[0][1] : found[0][2]].split()[0].strip('("') == template.text.split()[0].strip('("')


def test_near_misses():
    assert licenses.find("We discussed the license of the driver and the GNU in the zoo.") == []
    assert licenses.find("a license that is not released") == []
    twice = "Released under the MIT License. Released under the MIT License."
    assert [f[:3] for f in licenses.find(twice)] == [("MIT", 0, 30), ("MIT", 32, 62)]
    broken = "released under\nthe MIT\nlicense"
    assert [f[0] for f in licenses.find(broken)] == ["MIT"]


def test_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (3, "İ " * 10 + "Released under the MIT License."), (None, "Licensed under CC BY 4.0."), (3, "x"), (4, "pad " * 50_000 + "Released under the MIT License.")]
    found = licenses.scan(docs_of(rows)).collect()
    assert [(r["doc_id"], r["n_licenses"]) for r in found] == [(1, 0), (2, 0), (3, 1), (None, 1), (3, 0), (4, 1)]
    assert found[2]["licenses"] == "MIT:20:50" and found[0]["coverage"] == 0.0
    assert licenses.scan(docs_of([])).collect() == []


MPL_HEADER = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"


@pytest.mark.parametrize("template", licenses.TEMPLATES, ids=lambda t: f"{t.name}-{len(t.text)}")
@pytest.mark.parametrize("between", ["  ", "\r\n", "\n# ", "\n// ", "\n * ", "\t"])
def test_marks_and_white_space_between_words(template, between):
    text = between.join(template.text.split())
    assert [(f[0], f[3]) for f in licenses.find(text)] == [(template.name, 1.0)]


def test_usual_headers_and_damaged_keys():
    assert [(n, c) for n, _, _, c in licenses.find(MPL_HEADER)] == [("MPL-2.0", 1.0)]
    notice = next(t.text for t in licenses.TEMPLATES if t.name == "GPL-3.0" and "This program" in t.text)
    damaged = notice.replace("GNU General", "GNV Genera", 1)
    for text in (damaged, "GNU is a name. " * 3 + damaged):
        found = licenses.find(text)
        assert [f[0] for f in found] == ["GPL-3.0"] and found[0][3] > 0.95 and found[0][2] == len(text) - 1


def test_many_key_words_stay_fast():
    assert licenses.find("gnu " * 200_000 + "binary license " * 100_000) == []
