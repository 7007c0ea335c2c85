"""What the two classifiers share: held-out rows, bounded samples of rows and small numpy models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def sample_ids(ids: DataFrame, most: int, seed: str) -> DataFrame:
    """The ``most`` ids with the smallest seeded hashes: the same rows whatever the partitions, and
    few enough to broadcast."""
    return ids.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(most)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)
