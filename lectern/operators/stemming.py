"""Spanish stems by suffix removal.

The published Snowball algorithm for Spanish: regions R1, R2 and RV of a
word, then attached pronouns, standard suffixes, verb suffixes and residual
suffixes are removed step by step, and acute accents last.

:func:`stem_arrays` stems arrays of words.  Each Arrow batch's distinct words
are stemmed once, and a worker remembers a bounded number of stems.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import (
    STEM_GERUNDS,
    STEM_PRONOUNS,
    STEM_RESIDUAL,
    STEM_STANDARD,
    STEM_VERB_OTHER,
    STEM_VERB_Y,
)

VOWELS = frozenset("aeiouáéíóúü")
_ACUTE = str.maketrans("áéíóú", "aeiou")
#: Stems a worker remembers.
REMEMBERED = 200_000


def _after_vowel_and_consonant(word: str, start: int) -> int:
    """Where the region behind the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def regions(word: str) -> tuple[int, int, int]:
    """Where R1, R2 and RV of a word begin."""
    r1 = _after_vowel_and_consonant(word, 0)
    r2 = _after_vowel_and_consonant(word, r1)
    rv = len(word)
    if len(word) > 2:
        if word[1] not in VOWELS:
            rv = next((i + 1 for i in range(2, len(word)) if word[i] in VOWELS), len(word))
        elif word[0] in VOWELS:
            rv = next((i + 1 for i in range(2, len(word)) if word[i] not in VOWELS), len(word))
        else:
            rv = 3
    return r1, r2, rv


def _longest(word: str, start: int, suffixes) -> str:
    """The longest of ``suffixes`` that ends the part of ``word`` from ``start``."""
    for n in range(min(len(word) - start, 8), 0, -1):
        if word[-n:] in suffixes:
            return word[-n:]
    return ""


def _without_pronoun(word: str, rv: int) -> str:
    pronoun = _longest(word, rv, STEM_PRONOUNS)
    if not pronoun:
        return word
    head = word[: -len(pronoun)]
    gerund = _longest(head, rv, STEM_GERUNDS)
    if not gerund:
        return word
    if gerund == "yendo" and head[-6:-5] != "u":
        return word
    return head[: -len(gerund)] + gerund.translate(_ACUTE)


def _without_standard(word: str, r1: int, r2: int) -> str:
    suffix = _longest(word, 0, STEM_STANDARD)
    rule = STEM_STANDARD.get(suffix)
    if rule is None:
        return word
    region, replacement, before = rule
    at = len(word) - len(suffix)
    if at < (r1 if region == "R1" else r2):
        return word
    word = word[:at] + replacement
    endings = before
    while endings:  # a further ending in R2 goes too, and one before it
        found = _longest(word, r2, endings)
        if not found:
            break
        word, endings = word[: -len(found)], before.get(found, ())
    return word


def _without_verb(word: str, rv: int) -> str:
    suffix = _longest(word, rv, STEM_VERB_Y)
    if suffix and word[-len(suffix) - 1 : -len(suffix)] == "u":
        return word[: -len(suffix)]
    suffix = _longest(word, rv, STEM_VERB_OTHER)
    if not suffix:
        return word
    word = word[: -len(suffix)]
    if suffix in ("en", "es", "éis", "emos") and word.endswith("gu"):
        word = word[:-1]
    return word


def _without_residual(word: str, rv: int) -> str:
    suffix = _longest(word, rv, STEM_RESIDUAL)
    if not suffix:
        return word
    word = word[: -len(suffix)]
    if suffix in ("e", "é") and word.endswith("gu") and len(word) - 1 >= rv:
        word = word[:-1]
    return word


def stem(word: str) -> str:
    """The stem of a lower-cased Spanish word."""
    r1, r2, rv = regions(word)
    word = _without_pronoun(word, rv)
    shorter = _without_standard(word, r1, r2)
    if shorter == word:
        shorter = _without_verb(word, rv)
    return _without_residual(shorter, rv).translate(_ACUTE)


_STEMS: dict[str, str] = {}


def _stems_of(words) -> list[str]:
    if len(_STEMS) > REMEMBERED:
        _STEMS.clear()
    out = []
    for w in words:
        s = _STEMS.get(w)
        if s is None:
            s = _STEMS[w] = stem(w)
        out.append(s)
    return out


def _stem_lists(lists: pd.Series) -> pd.Series:
    distinct = {w for row in lists if row is not None for words in row if words is not None for w in words}
    named = dict(zip(distinct, _stems_of(distinct), strict=True))
    return lists.map(lambda row: None if row is None else [None if words is None else [named[w] for w in words] for words in row])


def stem_arrays(words: Column) -> Column:
    """Arrays of arrays of words, each word as its stem."""
    return F.pandas_udf(_stem_lists, "array<array<string>>")(words)
