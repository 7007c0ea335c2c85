"""Longest common subsequence length as an Arrow (pandas) UDF.

Bit-parallel LCS (Allison-Dix / Hyyro): one big-int add per token of the first sequence, so a
pair of lengths n, m costs O(n * m / 64) word operations instead of the O(n * m) DP table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a, b) -> int:
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    masks: dict[str, int] = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for tok in a:
        m = masks.get(tok)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


@F.pandas_udf(T.IntegerType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b)], dtype="int32")
