"""Arrow functions for what has no built-in counterpart: Jaro-Winkler, Porter stems, full compatibility folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def jaro_winkler_of(a: str, b: str) -> float:
    """Similarity of two strings: common characters in reach, transpositions, and a bonus for up to four equal first ones."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, t in zip(b, taken) if t]
    swapped = sum(x != y for x, y in zip(mine, theirs)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(StringType())
def compatibility_fold(text: pd.Series) -> pd.Series:
    """NFKD without combining marks, for scripts that plain_latin doesn't know."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def porter_of(word: str) -> str:
    """The stem of an English word by Porter's algorithm of 1980."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word

    def vowel(w: str, i: int) -> bool:
        return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not vowel(w, i - 1))

    def measure(w: str) -> int:
        kinds = "".join("v" if vowel(w, i) else "c" for i in range(len(w)))
        return sum(kinds[i : i + 2] == "vc" for i in range(len(kinds)))

    has_vowel = lambda w: any(vowel(w, i) for i in range(len(w)))
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and not vowel(w, len(w) - 1)
    cvc = lambda w: len(w) > 2 and not vowel(w, len(w) - 3) and vowel(w, len(w) - 2) and not vowel(w, len(w) - 1) and w[-1] not in "wxy"
    w = word
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    second = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
    third = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
    for rules in (tuple(zip(second[::2], second[1::2])), third):
        for end, to in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(end):
                w = w[: -len(end)] + to if measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


@F.pandas_udf(StringType())
def porter(word: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return word.map(lambda x: None if x is None else known[x] if x in known else known.setdefault(x, porter_of(x)))


def register(spark: SparkSession) -> None:
    """The functions under SQL names."""
    for f, name in ((jaro_winkler, "jaro_winkler"), (compatibility_fold, "compatibility_fold"), (porter, "porter")):
        spark.udf.register(name, f)
