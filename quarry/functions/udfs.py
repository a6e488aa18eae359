"""The few functions that Spark lacks, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth of the rest for each of up to four equal first characters above .7."""
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    swapped = sum(x != y for x, y in zip(hits, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    memo: dict[tuple[str, str], float] = {}

    def one(x, y):
        if x is None or y is None:
            return None
        if (x, y) not in memo:
            memo[x, y] = jaro_winkler_of(x, y)
        return memo[x, y]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _nfc(a: pd.Series) -> pd.Series:
    return a.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def jaro_winkler(a: Column, b: Column) -> Column:
    return pandas_udf(_jaro_winkler, DoubleType())(a, b)


def nfc(a: Column) -> Column:
    """Canonical composition of identifiers."""
    return pandas_udf(_nfc, StringType())(a)
