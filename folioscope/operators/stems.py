"""English words: a list of stop words, and stems by Porter's algorithm (1980).

A word's letters are vowels (a, e, i, o, u, and y after a consonant) or consonants; its measure is the number of times that
vowels are followed by consonants. Each step looks for the longest ending that it knows and replaces it if what stands
before it has measure enough.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Words that a query drops unless nothing is left. Fixed values.
STOP_WORDS = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both but
    by can could did do does doing down during each few for from further had has have having he her here hers herself him
    himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other
    our ours ourselves out over own same she should so some such than that the their theirs them themselves then there
    these they this those through to too under until up very was we were what when where which while who whom why will
    with would you your yours yourself yourselves""".split()
)

#: Endings of the second to fourth step with what they become. Fixed values of the algorithm.
_STEP_2 = dict(
    pair.split(":")
    for pair in "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate "
    "ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split()
)
_STEP_3 = dict(pair.split(":") for pair in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")


def _form(word: str) -> str:
    """v for each vowel and c for each consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or letter == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _form(stem)


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c"


def _short(word: str) -> bool:
    return _form(word).endswith("cvc") and word[-1] not in "wxy"


def _ending(word: str, rules: dict[str, str], least: int) -> str:
    for size in range(min(7, len(word)), 0, -1):
        if (new := rules.get(word[-size:])) is not None:
            stem = word[:-size]
            fits = _measure(stem) >= least and (rules is not _STEP_4 or word[-size:] != "ion" or stem[-1:] in ("s", "t"))
            return stem + new if fits else word
    return word


def _plurals_and_participles(word: str) -> str:
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    cut = next((e for e in ("ed", "ing") if word.endswith(e) and _has_vowel(word[: -len(e)])), None)
    if not cut:
        return word
    word = word[: -len(cut)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if _doubled(word) and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if _measure(word) == 1 and _short(word) else word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters, or with other signs than a to z, are their own."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    word = _plurals_and_participles(word)
    if word[-1:] == "y" and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _ending(_ending(_ending(word, _STEP_2, 1), _STEP_3, 1), _STEP_4, 2)
    if word[-1:] == "e" and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word[-2:] == "ll" and _measure(word[:-1]) > 1 else word
