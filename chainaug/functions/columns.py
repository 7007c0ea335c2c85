"""Portable column expressions: the same value in Spark and in the DuckDB oracle.

* ``phash(*parts)`` = first 32 bits of md5(concat(parts)) as a non-negative BIGINT.
* ``round6(c)`` = floor(c * 1e6 + 0.5) / 1e6, identical IEEE steps in both engines
  (``round(x, 6)`` differs on half-way values between the two).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _s(c) -> Column:
    if isinstance(c, Column):
        return c.cast("string")
    if isinstance(c, str):
        return F.lit(c)
    return F.lit(str(c))


def phash(*parts) -> Column:
    """Portable 32-bit hash of the concatenated parts (Column parts are cast to string;
    plain Python strings are literals)."""
    text = F.concat(*[_s(p) for p in parts]) if len(parts) > 1 else _s(parts[0])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def round6(c: Column) -> Column:
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)



def f_measure(p: Column, r: Column) -> Column:
    """2PR/(P+R), 0 when P+R = 0."""
    return F.when((p + r) > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def micro(c: Column) -> Column:
    """x in integer millionths (floor(x*1e6 + 0.5)); sums of these are exact in both engines."""
    return F.floor(c * F.lit(1e6) + F.lit(0.5))


def mean6(c: Column) -> Column:
    """Order-independent mean of a 6-digit quantity: integer sum of millionths, one division."""
    return round6(F.sum(micro(c)).cast("double") / (F.count(c) * F.lit(1e6)))
