"""Porter's stemming algorithm, after the paper of 1980."""

from __future__ import annotations

import re
from functools import lru_cache


def _shape(stem: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


# The paper's suffix rules of steps 2 to 4.
STEP_2 = dict(pair.split(":") for pair in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
STEP_3 = dict(pair.split(":") for pair in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w.removesuffix(suffix) + new
            break
    if w.endswith("eed"):
        if _measure(w[:-3]):
            w = w[:-1]
    elif (s := next((x for x in ("ed", "ing") if w.endswith(x)), None)) and "v" in _shape(w.removesuffix(s)):
        w = w.removesuffix(s)
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        if (s := _longest(w, rules)) and _measure(w.removesuffix(s)) > 0:
            w = w.removesuffix(s) + rules[s]
    if (s := _longest(w, STEP_4)) and _measure(rest := w.removesuffix(s)) > 1 and (s != "ion" or rest.endswith(("s", "t"))):
        w = rest
    if w.endswith("e"):
        rest = w[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _cvc(rest)):
            w = rest
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w
