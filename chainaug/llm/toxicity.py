"""Operator 8: toxicity by a linear classifier over character n-grams scaled by naive Bayes
log-count ratios (NB-SVM: Wang and Manning, 2012).

A text's features are the n-grams of ``SHORTEST`` to ``LONGEST`` characters present in it (lower case, any white
space one blank), hashed into buckets.  A bucket's weight is its log-count ratio

    r = log( (a + texts of class 1 with it) / sum  /  (a + texts of class 0 with it) / sum )

times a coefficient that logistic regression fits on the scaled features; buckets whose ratio is
indistinct (by its z-value) are left out."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import held_out, sample_ids, sigmoid
from .tables import Stage

TOXIC = 2500  # labelled rows of class 1 that the fit reads at most
CLEAN = 5000  # and of class 0
FEATURES = 20_000  # buckets with a weight at most
SHORTEST, LONGEST = 4, 6
BUCKET_BITS = 21
_CHUNK = 1 << 18  # characters hashed at once
_MUL, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grams(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of the n-grams of a text (int32); only those marked in ``wanted``, if given."""
    chars = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found = []
    for begin in range(0, len(chars), _CHUNK):
        part = chars[begin : begin + _CHUNK + LONGEST - 1].astype(np.uint64)
        h = np.zeros(len(part), dtype=np.uint64)
        for n in range(1, min(LONGEST, len(part)) + 1):  # the hash of n characters extends that of n - 1
            h = h[: len(part) - n + 1] * _MUL + part[n - 1 :]
            if n >= SHORTEST:
                bucket = ((h[:_CHUNK] * _SPREAD) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
                found.append(bucket if wanted is None else bucket[wanted[bucket]])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


class Model(NamedTuple):
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        wanted, weight = np.zeros(1 << BUCKET_BITS, dtype=bool), np.zeros(1 << BUCKET_BITS, dtype=np.float32)
        wanted[self.buckets], weight[self.buckets] = True, self.weights
        return wanted, weight


def log_count_ratios(toxic: np.ndarray, clean: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = toxic + alpha, clean + alpha
    return np.log(p / p.sum()) - np.log(q / q.sum())


def logistic(index: np.ndarray, begin: np.ndarray, scale: np.ndarray, y: np.ndarray, weight: np.ndarray,
             penalty: float = 3e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """(coefficients, bias) of weighted logistic regression with an L2 penalty, by Adam over the whole
    sample.  Row i holds the features index[begin[i]:begin[i+1]], feature f with value scale[f]."""
    coef, bias = np.zeros(len(scale)), 0.0
    counts = np.diff(begin)
    row = np.repeat(np.arange(len(y)), counts)
    m, v, mb, vb = np.zeros_like(coef), np.zeros_like(coef), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=(coef * scale)[index], minlength=len(y)) + bias
        err = (sigmoid(z) - y) * weight
        g = np.bincount(index, weights=err[row], minlength=len(scale)) * scale + penalty * coef
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 * 0.5 * (1 + np.cos(np.pi * t / steps)) + 1e-4
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        coef -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        bias -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return coef, float(bias)


def choose(bucket: np.ndarray, toxic: np.ndarray, clean: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted buckets, their ratios): the ``most`` whose ratio is surest, of those in three texts or more."""
    r = log_count_ratios(toxic, clean)
    z = np.abs(r) / np.sqrt(1 / (toxic + 1) + 1 / (clean + 1))
    z[toxic + clean < 3] = 0
    order = np.lexsort((bucket, -z))[:most]
    order = np.sort(order[z[order] > 3])
    order = order[np.argsort(bucket[order])]
    return bucket[order], r[order]


def fit_rows(buckets: np.ndarray, ratios: np.ndarray, rows: list[tuple[int, np.ndarray]], prior: float) -> Model:
    """A class weighs as the root of its share of all labelled rows, between equal classes and their
    true shares; with one class or none, or no telling n-gram, the score is the prior."""
    y = np.array([label for label, _ in rows], dtype=float)
    if not len(buckets) or not 0 < y.sum() < len(y):
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.empty(0, np.int32), np.empty(0), float(np.log(prior / (1 - prior))))
    begin = np.concatenate(([0], np.cumsum([len(b) for _, b in rows])))
    index = np.searchsorted(buckets, np.concatenate([b for _, b in rows]))
    weight = np.sqrt(prior) / (np.sqrt(prior) + np.sqrt(1 - prior))
    share = np.where(y == 1, weight / y.sum(), (1 - weight) / (len(y) - y.sum()))
    coef, bias = logistic(index, begin, ratios, y, share)
    return Model(buckets, coef * ratios, bias)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> how many texts of each class have a bucket."""
    total = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
    for batch in batches:
        for label, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist()):
            total[label][grams(text or "")] += 1
    at = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int64()), pa.array(total[1][at]), pa.array(total[0][at])], ["bucket", "n_toxic", "n_clean"])


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Model:
    """Fit on ``labels(doc_id, toxic)`` outside the held-out fold: at most ``toxic`` and ``clean`` rows of the
    classes, chosen by hash of the id (a bound on the fit, not on what is scored)."""
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0]
    ids = sample_ids(known.where("toxic = 1").distinct(), toxic, "toxic").union(sample_ids(known.where("toxic = 0").distinct(), clean, "clean"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stage = Stage(docs.sparkSession)
    # one row of a chosen id, however many share it
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("toxic", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = stage.write(rows.select("toxic", "text"), "sample")
    counts = sample.mapInArrow(_count, "bucket long, n_toxic long, n_clean long").groupBy("bucket").agg(
        F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean")).where("n_toxic + n_clean >= 3")
    counts = counts.toArrow()  # a row per bucket at most
    buckets, ratios = choose(*(counts[c].to_numpy() for c in ("bucket", "n_toxic", "n_clean")), FEATURES)
    chosen = docs.sparkSession.sparkContext.broadcast(buckets.astype(np.int32))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BUCKET_BITS, dtype=bool)
        wanted[chosen.value] = True
        for batch in batches:
            found = [grams(t or "", wanted).astype("<i4").tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(found, pa.binary())], ["toxic", "buckets"])

    rows = sorted((r["toxic"], bytes(r["buckets"])) for r in sample.mapInArrow(reduce, "toxic int, buckets binary").collect())
    stage.drop(sample)
    return fit_rows(buckets.astype(np.int32), ratios, [(y, np.frombuffer(b, "<i4")) for y, b in rows], 0.5 if prior is None else float(prior))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, score``, one row per row: the probability of class 1, from
    the whole text.  Null and empty texts have the score of a text without n-grams; extra columns are ignored."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = shared.value.table()
        for batch in batches:
            z = np.array([weight[grams(t or "", wanted)].sum(dtype=np.float64) for t in batch["text"].to_pylist()])
            score = sigmoid(z + shared.value.bias)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
