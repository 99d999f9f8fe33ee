"""License scans: patience alignment of texts with license templates.

A template counts only if its telling words are all matched, so the places of the first of
them in a text and in the template say where it could stand; case, white space and marks
between words play no part. An automaton over these words passes most texts by. The
window is aligned with the template: words that occur exactly once on both sides
anchor it, the longest increasing subsequence of anchors is kept, and the gaps between them
are aligned the same way. The share of the template's words that are matched is its
coverage; a template counts from ``COVERAGE`` on.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts, typed

COVERAGE = 0.8
_WORD = re.compile("[a-z0-9]+(?:[.-][a-z0-9]+)*")

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{} THE SOFTWARE IS "
    "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
    "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
    "covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare "
    "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The "
    "copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following "
    "disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies "
    "or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS "
    "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
    "FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE "
    "FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
    "USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
    "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
    "or implied. See the License for the specific language governing permissions and limitations under the License."
)
_GPL = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software "
    "Foundation, either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} "
    "for more details."
)
_GENERAL, _LESSER, _AFFERO = "General Public License", "Lesser General Public License", "Affero General Public License"
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
    "file, You can obtain one at http://mozilla.org/MPL/2.0/."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In "
    "jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to "
    "the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
    "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE "
    "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)


@dataclass(frozen=True)
class Template:
    """All ``telling`` words (lower case) must be matched; the first, the rarest in running text, says where the text could stand."""

    name: str
    text: str
    telling: tuple[str, ...]


TEMPLATES = (
    Template("MIT", _MIT_GRANT, ("sublicense",)),
    Template("BSD-3-Clause", _BSD_START + _BSD_NAME + _BSD_END, ("endorse", "binary")),
    Template("BSD-2-Clause", _BSD_START + _BSD_END, ("binary",)),
    Template("ISC", _ISC.format(_ISC_NOTICE), ("fee", "appear")),
    Template("0BSD", _ISC.format("."), ("fee",)),
    Template("Zlib", _ZLIB, ("misrepresented",)),
    Template("BSL-1.0", _BOOST, ("machine-executable",)),
    Template("Apache-2.0", _APACHE, ("apache", "2.0")),
    Template("GPL-3.0", _GPL.format("program", _GENERAL, "3"), ("gnu", "3")),
    Template("GPL-2.0", _GPL.format("program", _GENERAL, "2"), ("gnu", "2")),
    Template("LGPL-3.0", _GPL.format("library", _LESSER, "3"), ("lesser", "3")),
    Template("LGPL-2.1", _GPL.format("library", _LESSER, "2.1"), ("lesser", "2.1")),
    Template("AGPL-3.0", _GPL.format("program", _AFFERO, "3"), ("affero", "3")),
    Template("MPL-2.0", _MPL, ("mozilla", "2.0")),
    Template("Unlicense", _UNLICENSE, ("unencumbered",)),
    Template("MIT", "Released under the MIT License.", ("license", "mit")),
    Template("MIT", "Licensed under the MIT License.", ("licensed", "mit")),
    Template("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", ("bsd", "3-clause")),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "3")),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu", "2")),
    Template("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ("lesser", "3")),
    *(
        Template(f"CC-{x}-4.0", f"Licensed under CC {x} 4.0.", ("4.0", "cc", x.lower()))
        for x in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
    ),
    Template("CC0-1.0", "Released into the public domain under CC0 1.0.", ("cc0", "1.0")),
)


def words(text: str) -> list[tuple[str, int, int]]:
    """Lower-case words with their places in code points."""
    return [(m[0], m.start(), m.end()) for m in _WORD.finditer(_lower(text))]


def _lower(text: str) -> str:
    """Lower case with as many code points."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of two word lists, increasing on both sides."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        one_a, one_b = _once(a, a0, a1), _once(b, b0, b1)
        anchors = sorted((i, one_b[w]) for w, i in one_a.items() if w in one_b)
        anchors = [anchors[i] for i in increasing([y for _, y in anchors])]
        if not anchors:
            continue
        found += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:]) if x + 1 < x2 and y + 1 < y2]
    return sorted(found)


def _once(words_: list[str], start: int, end: int) -> dict[str, int]:
    seen: dict[str, int] = {}
    for i in range(start, end):
        seen[words_[i]] = -1 if words_[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


@lru_cache(maxsize=1)
def _prepared():
    """An automaton over all first telling words, the templates that each belongs to, and each template's words, their counts and that word's places."""
    import ahocorasick

    automaton, owners, made = ahocorasick.Automaton(), {}, []
    for i, t in enumerate(TEMPLATES):
        own = [w for w, _, _ in words(t.text)]
        made.append((own, Counter(own), [k for k, w in enumerate(own) if w == t.telling[0]]))
        owners.setdefault(t.telling[0], []).append(i)
    for word in owners:
        automaton.add_word(word, len(word))
    automaton.make_automaton()
    return automaton, owners, made


_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _mentions(low: str, automaton) -> bool:
    """Whether one of the automaton's words could be a word of the text."""
    return any(low[end + 1 : end + 2] not in _INSIDE and (end < size or low[end - size] not in _INSIDE) for end, size in automaton.iter(low))


def find(text: str) -> list[tuple[str, int, int, float]]:
    """``(license, start, end, coverage)`` of a text by start; overlapping finds leave the one with most matched words."""
    automaton, owners, prepared = _prepared()
    if not _mentions(_lower(text), automaton):
        return []
    plain, starts, ends, same = [], array("q"), array("q"), {}
    for m in _WORD.finditer(_lower(text)):  # equal words are one object, places are plain numbers: a long text stays small
        plain.append(same.setdefault(m[0], m[0]))
        starts.append(m.start())
        ends.append(m.end())
    places: dict[str, list[int]] = {}
    for at, w in enumerate(plain):
        if w in owners:
            places.setdefault(w, []).append(at)
    made = set()
    for i in sorted(i for w in places for i in owners[w]):
        template = TEMPLATES[i]
        for pairs, size in _aligned(plain, places[template.telling[0]], template, *prepared[i]):
            made.add((len(pairs), starts[pairs[0][0]], ends[pairs[-1][0]], template.name, len(pairs) / size))
    out: list[tuple[int, int, str, float]] = []
    for _, s, e, name, share in sorted(made, key=lambda m: (-m[0], -m[4], m[2] - m[1], m[1:4])):
        k = bisect_left(out, (s,))
        if (k == 0 or out[k - 1][1] <= s) and (k == len(out) or out[k][0] >= e):
            insort(out, (s, e, name, share))
    return [(name, s, e, share) for s, e, name, share in out]


def _aligned(plain: list[str], at: list[int], template: Template, own: list[str], counts: Counter, places: list[int]):
    """Matches of a template (and its size) in the words of a text, which has the first telling word ``at`` some places.

    Each place of the word in the text is tried with each one in the template. A window that
    shares too few words, in any order, with the template is left, and so are those so near
    to it that they can't share enough: one step changes the number by one at most.
    """
    size, slack, least = len(own), 4 + len(own) // 4, ceil(COVERAGE * len(own))
    clear = -size
    whole = 0
    for begin, key in sorted({(k - p, k) for k in at for p in places}):
        if begin < clear or key < whole:
            continue
        window = Counter(plain[max(0, begin - slack) : begin + size + slack])
        missing = least - sum(min(n, window[w]) for w, n in counts.items())
        if missing > 0:
            clear = begin + missing
            continue
        for a, b in ((begin, begin + size), (begin - slack, begin + size + slack)):
            a = max(0, a)
            pairs = [(x + a, y) for x, y in _dense(align(plain[a:b], own), size)]
            if len(pairs) >= least and {own[y] for _, y in pairs}.issuperset(template.telling):
                yield pairs, size
                if len(pairs) == size == pairs[-1][0] + 1 - pairs[0][0]:  # nothing else there can be better
                    whole = pairs[-1][0] + 1
                    break


def _dense(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Matches without stray words far before or after the template's place."""
    if not pairs:
        return pairs
    shift = sorted(x - y for x, y in pairs)[len(pairs) // 2]
    return [(x, y) for x, y in pairs if abs(x - y - shift) <= max(3, size // 4)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_licenses, licenses, coverage`` of each row.

    ``licenses`` joins ``name:start:end`` (code points, end exclusive) by commas, by start;
    ``coverage`` is the highest, 0 without any. Null and empty texts have none; repeated
    rows are each scanned; other columns are ignored; an empty table gives no rows; a text of
    any length is scanned whole.
    """
    schema = T.StructType(
        [T.StructField(id_col, typed(docs, id_col)), T.StructField("n_licenses", T.LongType()), T.StructField("licenses", T.StringType()), T.StructField("coverage", T.DoubleType())]
    )

    def kernel(ids: list, texts: list[str]) -> dict[str, list]:
        found = [find(t) for t in texts]
        return {
            id_col: ids,
            "n_licenses": [len(f) for f in found],
            "licenses": [",".join(f"{n}:{a}:{b}" for n, a, b, _ in f) for f in found],
            "coverage": [max((c for *_, c in f), default=0.0) for f in found],
        }

    return map_texts(docs, id_col, text_col, schema, kernel)
