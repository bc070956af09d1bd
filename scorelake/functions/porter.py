"""Porter's stemmer, after the published algorithm (M. F. Porter, 1980), for lower-case words."""

from __future__ import annotations

import re
from functools import lru_cache

_C, _V = "[^aeiou](?:[^aeiouy]*)", "[aeiouy][aeiou]*"
_MEASURE = re.compile(f"^(?:{_C})?((?:{_V}{_C})*)(?:{_V})?$")
_VOWEL = re.compile(f"^(?:{_C})?{_V}")
_DOUBLE = re.compile(r"([^aeiouylsz])\1$")
_SHORT = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")
# The algorithm's suffixes and what replaces them.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _measure(stem: str) -> int:
    found = _MEASURE.match(stem)
    return len(re.findall(f"{_V}{_C}", found[1])) if found else 0


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(100_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (end := _longest(word, ("ed", "ing"))) and _VOWEL.match(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _DOUBLE.search(word):
            word = word[:-1]
        elif _measure(word) == 1 and _SHORT.match(word):
            word += "e"
    if word.endswith("y") and _VOWEL.match(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        if (end := _longest(word, table)) and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    if end := _longest(word, STEP_4):
        own = word[: -len(end)] + (end[0] if end in ("sion", "tion") else "")
        if _measure(own) > 1:
            word = own
    if word.endswith("e"):
        own = word[:-1]
        if _measure(own) > 1 or _measure(own) == 1 and not _SHORT.match(own):
            word = own
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
