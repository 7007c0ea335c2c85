"""Clipped n-gram overlap and longest common subsequence of two texts, an Arrow batch at a time.

Tokens are coded once per row; a gram of n tokens is coded from the gram of n - 1 that begins where it does and the token that ends it, so
no gram is ever written out as text.  The work is that of hashing the tokens once per order; nothing is held beyond a chunk of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .lcs import lcs_length
from .overlap import chunks


def _coded(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Tokens between single spaces: how many per row (an empty text has none), and all of them."""
    split = pc.split_pattern(texts.cast(pa.large_string()), " ")
    counts, flat = np.diff(split.offsets.to_numpy()), split.flatten()
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False).astype(bool)
    if empty.any():
        flat = flat.filter(pa.array(np.repeat(~empty, counts)))
        counts = np.where(empty, 0, counts)
    return counts, flat


def overlaps(left: pa.Array, right: pa.Array, orders: tuple, lcs: bool = False) -> list[np.ndarray]:
    """Per row of two columns of token strings (tokens joined by single spaces, no nulls): tokens of the left and of the right, for each
    of ``orders`` the grams that both hold (each as often as both do), and with ``lcs`` the longest common subsequence."""
    (n_left, a), (n_right, b) = _coded(left), _coded(right)
    rows = len(n_left)
    token = pa.concat_arrays([a, b]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.concatenate((n_left, n_right))
    text = np.repeat(np.arange(2 * rows), counts)  # the left texts, then the right ones
    row = text % max(rows, 1)
    most = int(token.max()) + 1 if len(token) else 1
    first, _ = pd.factorize(row * most + token)  # a code is of one row, so equal codes are equal grams of one row
    out, gram, at = [n_left, n_right], first, np.arange(len(first))
    size = int(first.max()) + 1 if len(first) else 1
    for n in range(1, max(orders) + 1):
        if n > 1:
            inside = at + n - 1 < len(first)
            at, gram = at[inside], gram[inside]
            inside = text[at + n - 1] == text[at]
            at, gram = at[inside], gram[inside]
            gram, _ = pd.factorize(gram * size + first[at + n - 1])
        if n in orders:
            codes = int(gram.max()) + 1 if len(gram) else 0
            is_left = text[at] < rows
            both = np.minimum(np.bincount(gram[is_left], minlength=codes), np.bincount(gram[~is_left], minlength=codes))
            of = np.zeros(codes, dtype=np.int64)
            of[gram] = row[at]
            found = np.zeros(rows, dtype=np.int64)
            np.add.at(found, of, both)
            out.append(found)
    if lcs:
        ends, codes = np.cumsum(counts), first.tolist()
        out.append(np.array([lcs_length(codes[ends[i] - n_left[i]: ends[i]], codes[ends[rows + i] - n_right[i]: ends[rows + i]])
                             for i in range(rows)], dtype=np.int64))
    return out


def overlap_rows(carried: list, orders: tuple, lcs: bool):
    """Batches of ``carried`` columns and the token strings ``_pt`` and ``_rt`` -> ``carried, lp, lr, o<n>... (, lcs)``,
    without the rows that lack a text."""
    names = [*carried, "lp", "lr", *(f"o{n}" for n in orders), *(["lcs"] if lcs else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch["_pt"]), pc.is_valid(batch["_rt"])))
            for lo, hi in chunks(batch["_pt"], batch["_rt"]):
                some = batch.slice(lo, hi - lo)
                found = overlaps(some["_pt"], some["_rt"], orders, lcs)
                yield pa.RecordBatch.from_arrays([*(some[c] for c in carried), *(pa.array(x, pa.int64()) for x in found)], names)

    return run
