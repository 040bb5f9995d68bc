"""Porter's stemmer (1980) as a function of a word; it is applied to a vocabulary, once a term, and not to running text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..sources.store import ship

# The suffix rules of the published steps.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _form(stem: str) -> str:
    """Consonants and vowels as c and v: y is a vowel behind a consonant."""
    out = ""
    for i, letter in enumerate(stem):
        out += "v" if letter in "aeiou" or letter == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _ends_cvc(stem: str) -> bool:
    return _form(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    for suffix, by in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + by
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif (suffix := _longest(word, ("ed", "ing"))) and "v" in _form(word[: -len(suffix)]):
        word = word[: -len(suffix)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _ends_cvc(word):
            word += "e"
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        if (suffix := _longest(word, rules)) and _measure(word[: -len(suffix)]):
            word = word[: -len(suffix)] + rules[suffix]
    if (suffix := _longest(word, STEP_4)) and _measure(stem := word[: -len(suffix)]) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
        word = stem
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _ends_cvc(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stemmed(vocabulary: DataFrame, column: str = "term") -> DataFrame:
    """Distinct terms with their ``stem``."""

    ship(vocabulary.sparkSession)

    @F.pandas_udf("string")
    def of(terms: pd.Series) -> pd.Series:
        return terms.map(porter)

    return vocabulary.select(column).distinct().withColumn("stem", of(column))
