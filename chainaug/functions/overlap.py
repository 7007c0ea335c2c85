"""Multiset overlap of the tokens of two texts as an Arrow UDF.

The tokens of a batch are coded once; each side becomes runs of (pair, token) with their lengths by one
sort, and the overlap of a pair is the sum of the shorter of two equal runs.  The work is that of sorting the
tokens, whatever the length of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: bytes of text coded at once (a longer pair is worked on alone)
CHUNK_BYTES = 8 << 20


def coded_tokens(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Tokens between single spaces (empty ones count) of two string columns: number per row and codes of all, for
    either side, and the number of codes.  A null has none."""
    sides = [pc.split_pattern(side.cast(pa.large_string()), " ") for side in (left, right)]
    counts = [np.diff(s.offsets.to_numpy()) for s in sides]
    flat = [s.flatten() for s in sides]
    codes = pa.concat_arrays(flat).dictionary_encode()
    number = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return counts[0], number[: len(flat[0])], counts[1], number[len(flat[0]) :], max(len(codes.dictionary), 1)


def runs(counts: np.ndarray, codes: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys row * n_codes + code, and how often each occurs."""
    row = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    return np.unique(row * n_codes + codes, return_counts=True)


def overlap(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: tokens that both sides hold (each as often as both do), tokens of the left and of the right."""
    n_left, a, n_right, b, n_codes = coded_tokens(left, right)
    (key_a, times_a), (key_b, times_b) = runs(n_left, a, n_codes), runs(n_right, b, n_codes)
    both, at_a, at_b = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
    common = np.zeros(len(n_left), dtype=np.int64)
    np.add.at(common, both // n_codes, np.minimum(times_a[at_a], times_b[at_b]))
    return common, n_left, n_right


def chunks(left: pa.Array, right: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` bytes of text, one row at least."""
    size = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (left, right))
    begin, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(size):
        yield begin, len(size)


@F.arrow_udf(DoubleType())
def _f1(left: pa.Array, right: pa.Array) -> pa.Array:
    out = np.zeros(len(left))
    for lo, hi in chunks(left, right):
        common, n_left, n_right = overlap(left.slice(lo, hi - lo), right.slice(lo, hi - lo))
        total = np.maximum(n_left + n_right, 1)
        out[lo:hi] = np.floor((2 * common).astype(np.float64) / total.astype(np.float64) * 1e6 + 0.5) / 1e6
    missing = pc.or_(pc.is_null(left), pc.is_null(right)).to_numpy(zero_copy_only=False)
    return pa.array(out, pa.float64(), mask=missing)


def token_f1(left: Column, right: Column) -> Column:
    """2 |overlap| / (|left| + |right|), a token counting as often as both texts hold it, in six digits; null for a null."""
    return _f1(left, right)
