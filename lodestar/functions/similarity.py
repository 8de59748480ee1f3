"""String similarities that Spark lacks, as pandas UDFs over pairs that are already few."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler(a: str, b: str, weight: float = 0.1, boost: float = 0.7) -> float:
    """Jaro similarity, raised for up to four equal first characters where it is above boost."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken, strict=True) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= boost:
        return jaro
    same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + same * weight * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def sequence_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks, as the standard library defines it."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype="float64")
