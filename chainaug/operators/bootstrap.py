"""M4: bootstrap intervals by replicate vectors.

Replicate b weighs a pair by a Poisson(1) draw from a hash of (seed, b, pair), so a replicate is reproducible and no sample is
drawn.  A task keeps, per group, one vector of B weighted sums for each statistic and adds its pairs to them; what leaves it
is B rows per group, whatever the number of pairs.  The statistics are sufficient: scores that are no mean of pairs
(corpus BLEU) are worked out from the replicate's sums."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import round6

WORDS = 4  # 32-bit words in an MD5, a draw each
_HELD = 10_000  # groups whose vectors a task holds before it hands them on


def poisson_bounds(kmax: int = 12) -> list[int]:
    """Inverse-CDF bounds of Poisson(1) on a 32-bit uniform: draw k when hash < bounds[k]."""
    bounds, cdf, term = [], 0.0, exp(-1.0)
    for k in range(kmax):
        cdf += term
        bounds.append(int(cdf * 4294967296))
        term /= k + 1
    return bounds


def weights(names: list[str], replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) draws, a row per pair name and a column per replicate: word j of MD5("seed:block:name") is the draw of
    replicate 4 * block + j + 1."""
    blocks = range(-(-replicates // WORDS))
    raw = b"".join(md5(f"{seed}:{k}:{name}".encode()).digest() for name in names for k in blocks)
    draws = np.frombuffer(raw, dtype=">u4").reshape(len(names), -1)[:, :replicates].astype(np.int64)
    return np.searchsorted(np.array(poisson_bounds(), dtype=np.int64), draws, side="right")


def _sum(keys: list, stats: list, replicates: int, seed: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            groups, sums = list(held), list(held.values())
            columns = [[g[k] for g in groups for _ in range(replicates)] for k in range(len(keys))]
            table = np.concatenate(sums) if sums else np.zeros((0, len(stats) + 1), dtype=np.int64)
            columns += [list(range(1, replicates + 1)) * len(groups), *table.T.tolist()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            w = weights(batch["_pair"].to_pylist(), replicates, seed)
            x = np.stack([np.ones(len(batch), dtype=np.int64), *(batch[s].to_numpy(zero_copy_only=False).astype(np.int64) for s in stats)], axis=1)
            groups = list(zip(*(batch[k].to_pylist() for k in keys))) if keys else [()] * len(batch)
            number = {g: i for i, g in enumerate(dict.fromkeys(groups))}
            group = np.fromiter((number[g] for g in groups), dtype=np.int64, count=len(groups))
            for g, i in number.items():
                at = group == i
                part = w[at].T @ x[at]
                held[g] = held[g] + part if g in held else part
            if len(held) > _HELD:
                yield rows()
        yield rows()

    return run


def replicate_sums(pairs: DataFrame, keys: list, stats: list, replicates: int = 100, seed: int = 42) -> DataFrame:
    """Per group and replicate: ``keys, b, weight`` and the weighted sum of every column of ``stats`` (whole numbers).
    A pair is named by its keys and ``idx``, joined by colons."""
    name = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("idx").cast("string"))
    rows = pairs.select(*keys, name.alias("_pair"), *[F.col(s).cast("long").alias(s) for s in stats])
    fields = [T.StructField(k, rows.schema[k].dataType) for k in keys] + [T.StructField(c, T.LongType()) for c in ("b", "weight", *stats)]
    schema = T.StructType(fields)
    sums = rows.mapInArrow(_sum(keys, stats, replicates, seed, to_arrow_schema(schema)), schema)
    return sums.groupBy(*keys, "b").agg(*[F.sum(c).alias(c) for c in ("weight", *stats)])


def intervals(replicates: DataFrame, keys: list, values: dict[str, Column], quantiles=(0.025, 0.5, 0.975)) -> DataFrame:
    """A row per group and metric: percentiles of the metric's ``values`` over the replicates, in six digits."""
    names = [f"q{int(q * 1000):03d}" for q in quantiles]
    found = replicates.select(*keys, *[v.alias(f"_{m}") for m, v in values.items()]).groupBy(*keys).agg(*[
        F.struct(F.lit(m).alias("metric"), *[round6(F.percentile(F.col(f"_{m}"), q)).alias(n) for q, n in zip(quantiles, names)]).alias(f"_{m}")
        for m in values])
    return found.select(*keys, F.explode(F.array(*[f"_{m}" for m in values])).alias("_x")).select(*keys, "_x.*")
