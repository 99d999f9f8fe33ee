"""English stemmer: the published Porter2 (Snowball English) algorithm, on lower-case words."""

from __future__ import annotations

import re
from functools import lru_cache

_V = "aeiouy"
_EXACT = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _after_vowel_consonant(w: str, start: int) -> int:
    m = re.compile(f"[{_V}][^{_V}]").search(w, start)
    return m.end() if m else len(w)


def _regions(w: str) -> tuple[int, int]:
    for prefix in ("gener", "commun", "arsen"):
        if w.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        r1 = _after_vowel_consonant(w, 0)
    return r1, _after_vowel_consonant(w, r1)


def _short_end(w: str) -> bool:
    return bool(re.search(f"(?:[^{_V}][{_V}][^{_V}wxY]|^[{_V}][^{_V}])$", w))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = word.replace("’", "'").replace("‘", "'").replace("‛", "'").removeprefix("'")
    if w in _EXACT:
        return _EXACT[w]
    w = re.sub(f"^y|(?<=[{_V}])y", "Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_PLURAL:
        return w.lower()
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end in sorted(_STEP2, key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "ogi" or w[:-3].endswith("l")) and (end != "li" or w[:-2][-1:] in tuple("cdeghkmnrt")):
                w = w[: -len(end)] + _STEP2[end]
            break
    for end in sorted(_STEP3, key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "ative" or len(w) - 5 >= r2):
                w = w[: -len(end)] + _STEP3[end]
            break
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[:-3][-1:] in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _past(w: str, r1: int) -> str:
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not w.endswith(end):
            continue
        rest = w[: -len(end)]
        if end.startswith("eed"):
            return rest + "ee" if len(rest) >= r1 else w
        if not re.search(f"[{_V}]", rest):
            return w
        if rest.endswith(("at", "bl", "iz")):
            return rest + "e"
        if rest.endswith(_DOUBLES):
            return rest[:-1]
        return rest + "e" if r1 >= len(rest) and _short_end(rest) else rest
    return w
