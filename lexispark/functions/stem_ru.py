"""Russian stemmer: the published Snowball Russian algorithm, on lower-case words."""

from __future__ import annotations

import re
from functools import lru_cache

_V = "аеиоуыэюя"


def _ends(*plain: str, after_a: str = "") -> re.Pattern:
    """Longest ending first; those in ``after_a`` count only behind а or я."""
    both = [(x, x) for x in " ".join(plain).split()] + [(x, f"(?<=[ая]){x}") for x in after_a.split()]
    return re.compile("(?:" + "|".join(p for _, p in sorted(both, key=lambda b: -len(b[0]))) + ")$")


_GERUND = _ends("ив ивши ившись ыв ывши ывшись", after_a="в вши вшись")
_ADJECTIVE = _ends("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
_PARTICIPLE = _ends("ивш ывш ующ", after_a="ем нн вш ющ щ")
_REFLEXIVE = _ends("ся сь")
_VERB = _ends(
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю",
    after_a="ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно",
)
_NOUN = _ends("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")
_DERIVED = _ends("ост ость")
_SUPERLATIVE = _ends("ейш ейше")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of a lower-case word; ё counts as е."""
    w = word.replace("ё", "е")
    m = re.search(f"[{_V}]", w)
    if not m:
        return w
    head, rv = w[: m.end()], w[m.end() :]
    pair = re.compile(f"[{_V}][^{_V}]")
    r1 = pair.search(w)
    r2 = pair.search(w, r1.end()) if r1 else None
    second = max(0, r2.end() - len(head)) if r2 else len(rv)
    cut = _cut(_GERUND, rv)
    if cut is None:
        plain = _cut(_REFLEXIVE, rv)
        rv = rv if plain is None else plain
        found = _cut(_ADJECTIVE, rv)
        if found is not None:
            part = _cut(_PARTICIPLE, found)
            rv = found if part is None else part
        else:
            found = _cut(_VERB, rv)
            found = _cut(_NOUN, rv) if found is None else found
            rv = rv if found is None else found
    else:
        rv = cut
    rv = rv.removesuffix("и")
    m = _DERIVED.search(rv)
    if m and m.start() >= second:
        rv = rv[: m.start()]
    if rv.endswith("нн"):
        rv = rv[:-1]
    elif (m := _SUPERLATIVE.search(rv)) is not None:
        rv = rv[: m.start()]
        rv = rv[:-1] if rv.endswith("нн") else rv
    else:
        rv = rv.removesuffix("ь")
    return head + rv


def _cut(pattern: re.Pattern, text: str) -> str | None:
    m = pattern.search(text)
    return text[: m.start()] if m else None
