"""Greedy max-cosine matching of token vectors (embedding F1, BERTScore-style), an Arrow batch at a time.

Per pair: S = cosine matrix of prediction x reference token vectors; P = mean over prediction
tokens of the row max, R = mean over reference tokens of the column max, F = 2PR/(P+R).

A pair is two lists of distinct token ids with their multiplicities.  A token that both sides hold matches
itself with cosine 1 in six digits, which no other vector exceeds, so only tokens of one side are multiplied, against the
distinct tokens of the other.  A matrix product of unit vectors finds the largest cosines; where one lies so near the middle between two
millionths that the order of additions could matter, its dot products are accumulated dimension by dimension (the order a
plain loop uses), and means are taken over values rounded to 1e-6, so the result is that of the plain loop and reproducible
in the SQL oracle."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: cells of a cosine matrix held at once per pair: long texts are matched in row blocks
BLOCK_CELLS = 1 << 22
_TINY = 1e-100  # least norm of a vector that is scaled to a unit vector
_NEAR = 1e-3  # part of a millionth; a matrix product is exact to far less
_FEW_CELLS = 1024  # up to so many cells a running sum over the products is quicker than one pass per dimension


def _round6(x):
    return np.floor(x * 1e6 + 0.5) / 1e6


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products accumulated dimension by dimension, left to right, bit-identical to the SQL oracle."""
    if len(a) * len(b) <= _FEW_CELLS:
        return np.cumsum(a[:, None, :] * b[None, :, :], axis=2)[:, :, -1]
    out = np.multiply.outer(a[:, 0], b[:, 0])
    product = np.empty_like(out)
    for k in range(1, a.shape[1]):
        out += np.multiply.outer(a[:, k], b[:, k], out=product)
    return out


class Vectors(NamedTuple):
    """Tokens (an Arrow array without repeats) with the rows of their vectors, the vectors' norms, the rows as unit vectors, and
    which are ``plain``: of a norm that a division bears."""

    tokens: pa.Array
    rows: np.ndarray
    norms: np.ndarray
    units: np.ndarray
    plain: np.ndarray


def vectors(tokens: pa.Array, rows: np.ndarray) -> Vectors:
    rows = rows.astype(np.float64, copy=False)
    norms = np.sqrt(np.cumsum(rows * rows, axis=1)[:, -1]) if rows.size else np.zeros(len(rows))
    plain = np.isfinite(norms) & (norms > _TINY) & (norms < 1 / _TINY)
    units = rows / np.where(plain, norms, 1.0)[:, None] if rows.size else rows
    return Vectors(tokens, rows, norms, units, plain)


def _exact(ids: np.ndarray, others: np.ndarray, table: Vectors) -> np.ndarray:
    """Largest cosine of each id with any of ``others``."""
    own, b, norms = table.rows, table.rows[others], table.norms[others]
    best = np.empty(len(ids))
    step = max(1, BLOCK_CELLS // len(others))
    for begin in range(0, len(ids), step):
        part = ids[begin : begin + step]
        best[begin : begin + step] = (_dots(own[part], b) / np.multiply.outer(table.norms[part], norms)).max(axis=1)
    return best


def _best(ids: np.ndarray, others: np.ndarray, table: Vectors, plain: bool) -> np.ndarray:
    """Largest cosine of each id with any of ``others``, in integer millionths."""
    if not plain:
        return np.floor(_exact(ids, others, table) * 1e6 + 0.5)
    b, best = table.units[others].T, np.empty(len(ids))
    step = max(1, BLOCK_CELLS // len(others))
    for begin in range(0, len(ids), step):
        best[begin : begin + step] = (table.units[ids[begin : begin + step]] @ b).max(axis=1)
    scaled = best * 1e6 + 0.5
    unsure = np.abs(scaled - np.rint(scaled)) < _NEAR
    if unsure.any():
        scaled[unsure] = _exact(ids[unsure], others, table) * 1e6 + 0.5
    return np.floor(scaled)


def _runs(texts: pa.Array, table: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys row * tokens + id of the distinct known tokens of each text (single-space split), and how often each occurs."""
    split = pc.split_pattern(texts.cast(pa.large_string()), " ")
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(split.offsets.to_numpy()))
    ids = pc.fill_null(pc.index_in(split.flatten(), value_set=table.tokens), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = ids >= 0
    return np.unique(row[known] * max(len(table.tokens), 1) + ids[known], return_counts=True)


def _side(keys: np.ndarray, times: np.ndarray, other_keys: np.ndarray, table: Vectors, plain: np.ndarray) -> np.ndarray:
    """Per text the mean of the largest cosines over the tokens of one side; 0 where a side has none."""
    size, rows = max(len(table.tokens), 1), len(plain)
    row, ids, others = keys // size, keys % size, other_keys % size
    own_from, from_ = np.searchsorted(row, np.arange(rows + 1)), np.searchsorted(other_keys // size, np.arange(rows + 1))
    both = (np.diff(own_from) > 0) & (np.diff(from_) > 0)
    best = np.full(len(keys), 1e6)
    lone = np.flatnonzero(both[row] & ~(plain[row] & np.isin(keys, other_keys, assume_unique=True)))
    begins = np.flatnonzero(np.diff(row[lone], prepend=-1))
    for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(lone)]):
        at = lone[begin:end]
        i = row[at[0]]
        best[at] = _best(ids[at], others[from_[i] : from_[i + 1]], table, plain[i])
    out = np.zeros(rows)
    total, weight = np.bincount(row, best * times, rows), np.bincount(row, times, rows)
    out[both] = _round6(total[both] / (weight[both] * 1e6))
    return out


def score(predictions: pa.Array, references: pa.Array, table: Vectors) -> np.ndarray:
    """(P, R, F) for each row of two text columns (n x 3).  Tokens without a vector, and empty ones, are ignored."""
    (a, times_a), (b, times_b) = _runs(predictions, table), _runs(references, table)
    size, rows = max(len(table.tokens), 1), len(predictions)
    odd = np.zeros(rows, dtype=bool)  # texts with a vector whose cosines may be NaN, which is the largest
    for keys in (a, b):
        odd[(keys // size)[~table.plain[keys % size]]] = True
    p, r = _side(a, times_a, b, table, ~odd), _side(b, times_b, a, table, ~odd)
    f = np.zeros(rows)
    some = p + r > 0
    f[some] = _round6(2.0 * p[some] * r[some] / (p[some] + r[some]))
    return np.stack((p, r, f), axis=1)
