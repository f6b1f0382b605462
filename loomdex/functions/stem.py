"""Porter's stemmer (M. F. Porter, 1980), applied to distinct words of an Arrow batch."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def _kinds(w: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(w):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return _kinds(w).replace("cv", "c v").count("vc") if w else 0


def _cvc(w: str) -> bool:
    return len(w) > 2 and _kinds(w)[-3:] == "cvc" and w[-1] not in "wxy"


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if "v" in _kinds(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in _STEP4:
        if w.endswith(end):
            root = w[: -len(end)]
            if _measure(root) > 1 and (end != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def stems(words: Column) -> Column:
    """The stems of an array of lower-case words."""
    return _stems(words)
