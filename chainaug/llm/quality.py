"""Operator 7: quality classifier by positive-unlabelled learning (nnPU: Kiryo et al., 2017).

Trusted positives are labelled rows of quality 1; the unlabelled are ordinary documents, good and bad.
With class prior p and loss l the risk of a scorer g over positives P and unlabelled U is

    p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]),

whose second part, the risk on negatives, is estimated without any negative and kept from going below
zero, where it would reward over-fitting.  The prior is estimated from the labelled rows outside
the held-out fold.  Features are proportions of a whole text: character classes, repeats and shapes of words
and lines."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SPACE_WORDS, Words, chunks, utf8
from .learning import held_out, sample_ids, sigmoid, softplus

POSITIVES = 6000  # labelled rows of quality 1 that the fit reads at most
UNLABELLED = 9000  # documents that the fit reads at most

_LINES = np.ones(256, dtype=bool)
_LINES[[0x0A, 0x0D]] = False


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_CLASSES = np.stack([
    _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789"), _class(".,;:"), _class("!?"),
    _class("|/\\<>[]{}()_=+-~^`'\""), _class("#$%&*@"), _class(" \t"), _class("\n\r"), np.arange(256) >= 0x80,
]).astype(np.float64)


def _distinct(hashes: np.ndarray) -> float:
    return len(np.unique(hashes)) / len(hashes)


def features(texts: list[bytes]) -> np.ndarray:
    """One row of proportions per text (zeros for a text without words)."""
    rows = []
    for lo, hi in chunks(texts):
        part = texts[lo:hi]
        words, lines = Words(part, SPACE_WORDS), Words(part, _LINES, b"\n")
        size = words.end - words.start
        last = words.buf[np.maximum(words.end - 1, 0)] if len(size) else np.empty(0, np.uint8)
        begin = words.buf[words.start] if len(size) else np.empty(0, np.uint8)
        upper = (begin >= 0x41) & (begin <= 0x5A)
        odd = ~((last >= 0x80) | (last >= 0x30) & (last <= 0x39) | (last >= 0x41) & (last <= 0x5A) | (last >= 0x61) & (last <= 0x7A))
        for i, text in enumerate(part):
            a, b = words.first[i], words.first[i + 1]
            n = b - a
            if not n:
                rows.append(np.zeros(_N))
                continue
            counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            shares = _CLASSES @ counts / len(text)
            h, k = words.hash[a:b], lines.hash[lines.first[i] : lines.first[i + 1]]
            span = (lines.end - lines.start)[lines.first[i] : lines.first[i + 1]]
            _, where, times = np.unique(k, return_index=True, return_counts=True)
            letters = shares[0] + shares[1] + shares[9]
            rows.append(np.array([
                *shares, shares[0] / letters if letters else 0, (h[1:] == h[:-1]).mean() if n > 1 else 0,
                (h[2:] == h[:-2]).mean() if n > 2 else 0, _distinct(h), _distinct(h[-100:]), np.minimum(size[a:b], 40).mean() / 10,
                (size[a:b] == 1).mean(), (size[a:b] > 25).mean(), odd[a:b].mean(), upper[a:b].mean(),
                1 - span[where].sum() / max(1, span.sum()), (times > 1).mean() if len(times) else 0, np.log1p(n) / 10,
                np.log1p(n / max(1, len(k))) / 10]))
    return np.array(rows).reshape(-1, _N)


_N = len(_CLASSES) + 14


def _expand(x: np.ndarray) -> np.ndarray:
    """Proportions, and their square roots: small shares of odd characters tell most."""
    return np.concatenate((x, np.sqrt(np.abs(x))), axis=1)


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality 1."""
        if not self.layers:
            return np.full(len(x), self.prior)
        return sigmoid(_forward(self.layers, (_expand(x) - self.mean) / self.scale)[-1][:, 0])


def _forward(layers: list, x: np.ndarray) -> list[np.ndarray]:
    out = [np.clip(x, -8, 8)]
    for k, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(np.tanh(z) if k < len(layers) - 1 else z)
    return out


def _gradient(layers: list, acts: list[np.ndarray], top: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    grads, d = [], top
    for k in range(len(layers) - 1, -1, -1):
        grads.append((acts[k].T @ d, d.sum(axis=0)))
        if k:
            d = (d @ layers[k][0].T) * (1 - acts[k] ** 2)
    return grads[::-1]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, epochs: int = 60, seed: int = 7) -> Model:
    """Minimise the non-negative risk with Adam over batches; ``prior`` alone where a side is empty."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(0), np.ones(0), [], prior)
    rng = np.random.default_rng(seed)
    p, u = _expand(positive), _expand(unlabelled)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-6
    p, u = (p - mean) / scale, (u - mean) / scale
    sizes = [p.shape[1], hidden, 1]
    layers = [(rng.standard_normal((a, b)) / np.sqrt(a), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
    moments = [[np.zeros_like(x), np.zeros_like(x)] for layer in layers for x in layer]
    steps, t = max(1, len(u) // 512), 0
    for epoch in range(epochs):
        rate = 0.005 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-5
        pi, ui = rng.permutation(len(p)), rng.permutation(len(u))
        for s in range(steps):
            xp, xu = p[pi[s::steps]], u[ui[s::steps]]
            if not len(xp):
                xp = p
            ap, au = _forward(layers, xp), _forward(layers, xu)
            gp, gu = ap[-1], au[-1]
            negative = softplus(gu).mean() - prior * softplus(gp).mean()
            up_p, up_u = prior * sigmoid(gp) / len(xp), sigmoid(gu) / len(xu)  # slopes of l(-g)
            if negative >= 0:
                top_p, top_u = -prior * sigmoid(-gp) / len(xp) - up_p, up_u
            else:  # the estimate has passed zero: only the risk on positives counts
                top_p, top_u = -prior * sigmoid(-gp) / len(xp), 0 * up_u
            grads = [a + b for x, y in zip(_gradient(layers, ap, top_p), _gradient(layers, au, top_u)) for a, b in zip(x, y)]
            t += 1
            new = []
            for (m, v), g, x in zip(moments, grads, [x for layer in layers for x in layer]):
                g = g + 1e-4 * x
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                new.append(x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
            layers = list(zip(new[0::2], new[1::2]))
    return Model(mean, scale, layers, prior)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on ``labels(doc_id, quality)`` outside the held-out fold: at most ``positives`` rows of quality 1 and
    ``unlabelled`` documents of any kind, both chosen by hash of the id (bounds on the fit, not on
    what is scored).  Without any labelled row the model is the prior 0.5."""
    known = labels.where(~held_out() & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    prior = known.agg(F.avg("quality")).first()[0]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    trusted = sample_ids(known.where("quality = 1").select("doc_id").distinct(), positives, "trusted").withColumn("side", F.lit("P"))
    general = sample_ids(texts.select("doc_id").where(~held_out()).distinct(), unlabelled, "general").withColumn("side", F.lit("U"))
    chosen = texts.join(F.broadcast(trusted.union(general)), "doc_id").select("side", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(utf8(batch["text"]))
            x = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["side"], batch["doc_id"], x], ["side", "doc_id", "x"])

    # one row of a chosen id, however many share it: the collect is as small as the sample
    found = chosen.mapInArrow(run, "side string, doc_id long, x binary").groupBy("side", "doc_id").agg(F.min("x").alias("x"))
    rows = sorted((r["side"], bytes(r["x"])) for r in found.collect())

    def side(name: str) -> np.ndarray:
        return np.frombuffer(b"".join(x for s, x in rows if s == name)).reshape(-1, _N)

    return fit(side("P"), side("U"), 0.5 if prior is None else float(prior))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, score``, one row per row: the probability of quality 1.
    Null and empty texts have the score of a text without words; extra columns are ignored."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(features(utf8(batch["text"])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_quality(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, whole, whose score is at least ``threshold``."""
    at, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(features(utf8(batch.column(at)))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
