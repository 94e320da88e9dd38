"""Folding and stemming of search terms, applied to distinct words only.

``fold`` lower-cases and drops diacritics; ``stem`` is Porter's algorithm (M. F. Porter, An algorithm
for suffix stripping, Program 14(3), 1980) for words of ASCII letters; other words stay as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The suffixes of steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def _shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[i - 1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y."""
    return len(stem) > 2 and _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _replaced(word: str, table: dict[str, str], least: int) -> str:
    """The longest suffix of the table decides; it is replaced where the stem measures more than ``least``."""
    for n in range(min(len(word) - 1, 7), 0, -1):
        if (end := word[-n:]) in table:
            return word[:-n] + table[end] if _measure(word[:-n]) > least else word
    return word


def stem(word: str) -> str:
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif _double(cut) and cut[-1] not in "lsz":
            w = cut[:-1]
        else:
            w = cut + "e" if _measure(cut) == 1 and _short_end(cut) else cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP2, 0), STEP3, 0)
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            rest = w[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def _normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for words in batches:
        yield words.map(lambda w: None if w is None else stem(fold(w)))


def normalised(word: Column) -> Column:
    """Folded and stemmed; meant for tables of distinct words.

    Spark must not move it below what makes words distinct, for a filter on its result, so it is not declared deterministic.
    """
    return _normal.asNondeterministic()(word)
