"""Porter's suffix stripper (M. F. Porter, "An algorithm for suffix stripping", 1980), table driven.

Three departures from the paper, kept because indexes and queries must agree on them: words of one or two
letters stay as they are, ``bli`` becomes ``ble`` (the paper has ``abli``), and ``logi`` becomes ``log``.
Digits count as consonants.
"""

from __future__ import annotations

import re
from functools import lru_cache

# The published suffix tables, in the paper's order with the departures above.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
)

_MEASURE = re.compile("v+c+")


def pattern(word: str) -> str:
    """``c`` or ``v`` for each letter; y is a vowel exactly after a consonant."""
    out: list[str] = []
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and bool(out) and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _measure(cv: str) -> int:
    return len(_MEASURE.findall(cv))


def _doubled(word: str, cv: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and cv[-1] == "c"


def _short(word: str, cv: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return cv[-3:] == "cvc" and word[-1] not in "wxy"


def _plural(word: str) -> str:
    if not word.endswith("s") or word.endswith("ss"):
        return word
    return word[:-2] if word.endswith(("sses", "ies")) else word[:-1]


def _past(word: str) -> str:
    cv = pattern(word)
    if word.endswith("eed"):
        return word[:-1] if _measure(cv[:-3]) > 0 else word
    cut = next((len(s) for s in ("ed", "ing") if word.endswith(s)), 0)
    if not cut or "v" not in cv[:-cut]:
        return word
    stem, cv = word[:-cut], cv[:-cut]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _doubled(stem, cv):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(cv) == 1 and _short(stem, cv) else stem


def _swap(word: str, rules) -> str:
    table = dict(rules)
    suffix = _longest(word, table)
    if suffix is None:
        return word
    stem = word[: len(word) - len(suffix)]
    return stem + table[suffix] if _measure(pattern(stem)) > 0 else word


def _drop(word: str) -> str:
    suffix = _longest(word, STEP4)
    if suffix is None:
        return word
    stem = word[: len(word) - len(suffix)]
    if suffix == "ion" and not stem.endswith(("s", "t")):
        return word
    return stem if _measure(pattern(stem)) > 1 else word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        cv = pattern(stem)
        m = _measure(cv)
        if m > 1 or (m == 1 and not _short(stem, cv)):
            word = stem
    cv = pattern(word)
    return word[:-1] if word.endswith("ll") and _measure(cv) > 1 else word


@lru_cache(maxsize=1 << 15)
def stem(word: str) -> str:
    """Stem of one lower-case word."""
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in pattern(word[:-1]):
        word = word[:-1] + "i"
    return _tidy(_drop(_swap(_swap(word, STEP2), STEP3)))
