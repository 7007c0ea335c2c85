"""Operator 9: embedding near-dedup by randomised-rotation binary codes (RaBitQ: Gao and Long, 2024).

Each unit vector o is rotated by one random orthogonal matrix; its code is the signs of the rotated
vector, that is the nearest vector c of {-1, 1}^d / sqrt(d), and its stored correction factor is f = <c, o>.
<c, q> / f estimates <o, q> without bias, and as q = <o,q> o + sqrt(1 - <o,q>^2) e with e orthogonal to o,

    <c, q> = f <o, q> + sqrt(1 - <o,q>^2) sqrt(1 - f^2) <u, e>,   u, e unit vectors in d-1 dimensions,

so for <o,q> >= t the estimate is at least t - w sqrt(1 - t^2) sqrt(1 - f^2) / f unless -<u, e> > w.
Over the random rotation <u, e> has deviation 1 / sqrt(d-1); w = ``confidence`` deviations, at most 1,
and w = 1 always holds.  Pairs whose estimate passes get their cosine exactly, in double precision.

Only vectors of one label meet.  Equal vectors are one row with a count; a label's rows are dealt
into blocks, and each pair of blocks is a task that returns counts and a spanning forest, never the pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import Stage

BLOCK = 2048  # rows of a label in a block


def rotation(dim: int, seed: int = 20240521) -> np.ndarray:
    """A random orthogonal matrix: QR of a Gaussian one, signs fixed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sign bits packed to bytes, correction factors <c, o>) of unit vectors."""
    turned = unit @ turn
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def least_estimate(factor: np.ndarray, threshold: float, dim: int, confidence: float | None) -> np.ndarray:
    """The smallest estimate that a pair at or above ``threshold`` can have (``None``: with certainty)."""
    width = 1.0 if confidence is None or dim < 2 else min(1.0, confidence / math.sqrt(dim - 1))
    spread = math.sqrt(max(0.0, 1 - threshold**2)) * np.sqrt(np.maximum(0, 1 - factor**2)) / factor
    return threshold - width * spread - 1e-9


def link_pairs(left: np.ndarray, right: np.ndarray, bits: np.ndarray, factor: np.ndarray, turn: np.ndarray,
               threshold: float, confidence: float | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(i, j) of ``left`` (with codes) and ``right`` whose cosine reaches the threshold, and how many
    cosines were computed exactly.  Both hold unit vectors."""
    dim = left.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    estimate = signs @ (right @ turn).T.astype(np.float32) / (math.sqrt(dim) * factor[:, None])
    i, j = np.nonzero(estimate >= least_estimate(factor, threshold, dim, confidence)[:, None] - 1e-4)  # float32 rounding
    keep = np.empty(len(i), dtype=bool)
    for a in range(0, len(i), 65536):
        s = slice(a, a + 65536)
        keep[s] = np.einsum("nd,nd->n", left[i[s]], right[j[s]]) >= threshold
    return i[keep], j[keep], len(i)


def _encode(batches):
    """Rows with their unit vector, code and factor; these are null where a vector is not usable."""
    for batch in batches:
        units = [_usable(v) for v in batch["embedding"].to_pylist()]
        bits, factors = [None] * len(units), [None] * len(units)
        for dim in {len(u) for u in units if u is not None}:
            rows = [k for k, u in enumerate(units) if u is not None and len(u) == dim]
            packed, factor = codes(np.stack([units[k] for k in rows]), rotation(dim))
            for k, b, f in zip(rows, packed, factor.tolist()):
                bits[k], factors[k] = b.tobytes(), f
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"], batch["label"], pa.array([u if u is None else len(u) for u in units], pa.int32()),
             pa.array([u if u is None else u.tobytes() for u in units], pa.binary()),
             pa.array(bits, pa.binary()), pa.array(factors, pa.float64())],
            ["vec_id", "label", "dim", "unit", "bits", "factor"])


def _usable(vector: list | None) -> np.ndarray | None:
    """The unit vector, or None for a null, empty or zero vector and one with null or non-finite parts."""
    if not vector or None in vector:
        return None
    v = np.array(vector, dtype=np.float64)
    if not np.isfinite(v).all():
        return None
    scale = np.abs(v).max()  # against overflow of the squares
    if scale == 0:
        return None
    v = v / scale
    return v / math.sqrt(v @ v)


def _block_links(threshold: float, confidence: float | None):
    schema = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        turn = rotation(dim)
        second = table["second"].to_numpy()
        unit = np.frombuffer(b"".join(table["unit"].to_pylist()), dtype=np.float64).reshape(-1, dim)
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), dtype=np.uint8).reshape(len(unit), -1)
        factor, ids, copies = table["factor"].to_numpy(), table["rep"].to_numpy(), table["copies"].to_numpy()
        same = table["block_i"][0].as_py() == table["block_j"][0].as_py()
        x = np.flatnonzero(second == 0)
        y = x if same else np.flatnonzero(second == 1)
        counts, parent, edges = np.zeros(len(unit), dtype=np.int64), np.arange(len(unit)), []

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for a in range(0, len(x), 512):  # a strip of the block at a time
            rows = x[a : a + 512]
            i, j, _ = link_pairs(unit[rows], unit[y], bits[rows], factor[rows], turn, threshold, confidence)
            i, j = rows[i], y[j]
            if same:
                i, j = i[i < j], j[i < j]
            np.add.at(counts, i, copies[j])
            np.add.at(counts, j, copies[i])
            for p, q in zip(i.tolist(), j.tolist()):
                p, q = root(p), root(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    edges.append((p, q))
        linked = np.flatnonzero(counts)
        return pa.table([
            pa.array(["count"] * len(linked) + ["edge"] * len(edges), pa.string()),
            pa.array([*ids[linked].tolist(), *(int(ids[p]) for p, _ in edges)], pa.int64()),
            pa.array([*counts[linked].tolist(), *(int(ids[q]) for _, q in edges)], pa.int64())], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, confidence: float | None = None) -> DataFrame:
    """``vectors(vec_id, embedding, label, ...)`` -> ``vec_id, n_links, component_id, kept``, one row per row.

    Rows link when their labels are equal and not null, their vectors have as many components, and the
    cosine (double precision) is at least ``threshold``; ``n_links`` counts the rows linked directly, ``component_id`` is the smallest
    vec_id reachable, ``kept`` marks it.  Null, empty and zero vectors and those with null or non-finite components link with
    nothing, as do rows without a vec_id.  Repeated rows are rows each.  ``confidence`` is the bound's
    width in deviations; ``None`` takes the bound that always holds, so no link is missed."""
    spark = vectors.sparkSession
    stage = Stage(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    encoded = rows.mapInArrow(_encode, "vec_id long, label string, dim int, unit binary, bits binary, factor double")
    encoded = stage.write(encoded, "encoded")
    key = F.when(F.col("vec_id").isNotNull(), F.sha2("unit", 256))
    classes = encoded.where("vec_id is not null and label is not null and unit is not null").groupBy("label", "dim", key.alias("key")).agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
        F.first("unit").alias("unit"), F.first("bits").alias("bits"), F.first("factor").alias("factor"))
    classes = stage.write(classes, "classes")

    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")))
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "label", "dim", "rep", "copies", "unit", "bits", "factor",
        F.least("block", "other").alias("block_i"), F.greatest("block", "other").alias("block_j"),
        (F.col("block") > F.col("other")).cast("int").alias("second"))
    found = meets.groupBy("label", "dim", "block_i", "block_j").applyInArrow(
        _block_links(threshold, confidence), "kind string, a long, b long")
    found = stage.write(found, "found")

    counts = found.where("kind = 'count'").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    parts = connected_components(spark, found.where("kind = 'edge'").select("a", "b")).withColumnRenamed("id", "rep")
    per_class = classes.select("label", "dim", "key", "rep", "copies").join(counts, "rep", "left").join(parts, "rep", "left").select(
        "label", "dim", "key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    # a row without a class has a null key, label or dim and finds none
    named = encoded.select("vec_id", "label", "dim", key.alias("key")).join(per_class, ["label", "dim", "key"], "left")
    return named.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
