"""Operator 4: packing by non-negative least squares.

1. Each document is tokenised once; full windows are cut off its front, and the rest (shorter
   than a window) gets a bin of its length.  The written table holds a few numbers per document.
2. The driver gets the histogram over bins (``BINS`` numbers, whatever the data), enumerates
   shallow combinations of bins that fill a window, solves ``min |A x - h|, x >= 0`` (Lawson-Hanson)
   and rounds down to repeat counts that the histogram can serve.
3. The k-th document of a bin (two-pass numbering, no global sort) goes to the combination
   whose share of the bin holds k.
4. Documents that no combination takes are packed greedily end to end; one that crosses the end of
   a window is cut there, so only the last of these windows is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Stage
from .tokens import broadcast_tokenizer, encoder

BINS = 256  # lengths up to a window, rounded up to a 256th of it
BROADCAST_ROWS = 1_000_000  # offsets (a row per task and bin) sent to the documents; beyond it a shuffle

ROWS = "part int, row long, doc_id {doc_id}, doc_tokens long, n_full long, full_crc binary, full_rank long, " \
       "rest int, rest_crc long, rest_ids binary, bin int, bin_rank long"


def _tokenise(tokenizer, window: int, end_id: int, doc_type: pa.DataType):
    types = [pa.int32(), pa.int64(), doc_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(),
             pa.binary(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, full_rank = TaskContext.get().partitionId(), 0, 0
        in_bin = np.zeros(BINS + 1, dtype=np.int64)
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"], encoder(tokenizer).encode(batch["text"].to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                n_full, rest = divmod(len(ids), window)
                crcs = [zlib.crc32(ids[k * window : (k + 1) * window].tobytes()) for k in range(n_full)]
                tail = ids[n_full * window :].tobytes()
                b = -(-rest * BINS // window)
                out.append((part, row, doc_id, len(ids), n_full, np.array(crcs, dtype="<u4").tobytes(), full_rank, rest,
                            zlib.crc32(tail), tail, b, int(in_bin[b])))
                row, full_rank = row + 1, full_rank + n_full
                in_bin[b] += 1
            columns = zip(*out) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in c] if n == "doc_id" else c, t)
                                              for c, t, n in zip(columns, types, names)], names)

    return run


def combinations(bins: int) -> list[tuple[tuple[int, int], ...]]:
    """Ways to fill ``bins`` exactly: up to three parts, or one part repeated and one more.

    Each is a tuple of (bin, how often)."""
    found = set()
    for a in range(1, bins + 1):
        for b in range(0, min(a, bins - a) + 1):
            c = bins - a - b
            if c <= b or c == 0 or b == 0 and c <= a:
                found.add(tuple(sorted(x for x in (a, b, c) if x)))
        for often in range(2, bins // a + 1):
            left = bins - a * often
            found.add((a,) * often + ((left,) if left else ()))
    count = {tuple((x, parts.count(x)) for x in sorted(set(parts))) for parts in found if sum(parts) == bins}
    return sorted(count)


def nnls(columns: list[tuple[tuple[int, int], ...]], target: np.ndarray, rounds: int = 4000) -> np.ndarray:
    """Lawson-Hanson: x >= 0 that minimises |A x - target|, where column k of A holds columns[k]."""
    matrix = np.zeros((len(target), len(columns)))
    for k, parts in enumerate(columns):
        for b, often in parts:
            matrix[b, k] = often
    gram_scale = max(1.0, float(np.abs(target).max()))
    x, passive = np.zeros(len(columns)), []
    for _ in range(rounds):
        gain = matrix.T @ (target - matrix @ x)
        gain[passive] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-7 * gram_scale:
            break
        passive.append(best)
        while True:
            sub = matrix[:, passive]
            z = np.linalg.solve(sub.T @ sub + 1e-9 * np.eye(len(passive)), sub.T @ target)
            if (z > 1e-12).all():
                x[:] = 0
                x[passive] = z
                break
            now = x[passive]
            falling = z <= 1e-12
            step = np.min(now[falling] / np.maximum(now[falling] - z[falling], 1e-300))
            now = now + step * (z - now)
            x[:] = 0
            x[passive] = np.maximum(now, 0)
            kept = [k for k, v in zip(passive, now) if v > 1e-12]
            if len(kept) == len(passive):
                kept.remove(passive[int(np.argmin(now))])
            x[[k for k in passive if k not in kept]] = 0
            passive = kept
            if not passive:
                break
    return x


def solve(histogram: dict[int, int], bins: int = BINS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(combination, repeat count) so that every bin serves the counts: least squares, rounded
    down, then whatever the left-over documents can still fill."""
    free = np.zeros(bins + 1, dtype=np.int64)
    for b, n in histogram.items():
        free[b] = n
    usable = [c for c in combinations(bins) if all(free[b] >= often for b, often in c)]
    if not usable:
        return []
    x = nnls(usable, free.astype(float))
    order = np.argsort(-x, kind="stable")
    counts = dict.fromkeys(usable, 0)
    for rounded in (True, False):
        for k in order:
            most = min(int(free[b]) // often for b, often in usable[k])
            take = min(int(x[k] + 1e-9), most) if rounded else most
            if take > 0:
                counts[usable[k]] += take
                for b, often in usable[k]:
                    free[b] -= take * often
    return [(c, n) for c, n in counts.items() if n]


def _cut_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """crc32 of ids[skip : skip + length] of each row's rest."""
    for batch in batches:
        crc = [zlib.crc32(ids[4 * s : 4 * (s + n)])
               for ids, s, n in zip(batch["rest_ids"].to_pylist(), batch["skip"].to_pylist(), batch["length"].to_pylist())]
        keep = [c for c in batch.schema.names if c not in ("rest_ids", "skip")]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(crc, pa.int64())], [*keep, "ids_crc32"])


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per piece: ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset``; sequences of at most ``window`` ids.

    A document's ids are its text's (null: none) and ``end_id``, so an empty text is one piece of one id.
    Pieces of a document lie end to end, those of a sequence too (``offset`` from 0).  Rows that share a doc_id, or have
    none, are packed each.  Extra columns are ignored; an empty table gives no pieces."""
    spark = docs.sparkSession
    stage = Stage(spark)
    tokenizer = broadcast_tokenizer(spark, tokenizer_path)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    rows = stage.write(
        texts.mapInArrow(_tokenise(tokenizer, window, end_id, arrow), ROWS.format(doc_id=kind.simpleString())), "rows")

    # how many of a bin (and of full windows) the tasks before hold
    counts = rows.groupBy("part", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stage.write(counts.withColumn("bin_start", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    fulls = rows.groupBy("part").agg(F.sum("n_full").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    fulls = fulls.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("full_start"))

    histogram = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    total_full = rows.agg(F.sum("n_full")).first()[0] or 0
    plan, taken, next_id = [], {}, total_full
    for parts, count in solve({b: n for b, n in histogram.items() if b}):
        for b, often in parts:
            low = taken.get(b, 0)
            taken[b] = low + often * count
            plan.append((b, low, taken[b], next_id, count))
        next_id += count
    slots = F.broadcast(spark.createDataFrame(plan, "bin int, low long, high long, base long, count long"))  # <= 4 rows a combination

    offsets = counts.select("part", "bin", "bin_start")
    if counts.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    rank = F.col("bin_start") + F.col("bin_rank")
    placed = (
        rows.where("rest > 0").join(offsets, ["part", "bin"]).withColumn("rank", rank)
        .join(slots.withColumnRenamed("bin", "slot_bin"), (F.col("bin") == F.col("slot_bin")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
    )
    rest_start = (F.col("n_full") * window).alias("start")

    full = rows.where("n_full > 0").join(fulls, "part").select(
        "doc_id", "doc_tokens", "full_crc", (F.col("full_start") + F.col("full_rank")).alias("first"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_full") - 1)).alias("k"))
    # four little-endian bytes of the checksum list
    code = F.hex(F.expr("substring(full_crc, cast(k * 4 + 1 as int), 4)"))
    crc = F.conv(F.concat(*[F.substring(code, 2 * i + 1, 2) for i in (3, 2, 1, 0)]), 16, 10).cast("long")
    full = full.select(
        "doc_id", (F.col("k") * window).alias("start"), F.lit(window).cast("long").alias("length"), crc.alias("ids_crc32"),
        "doc_tokens", (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    solved = placed.where("low is not null").select(
        "doc_id", rest_start, F.col("rest").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens",
        (F.col("base") + F.pmod(F.col("rank") - F.col("low"), F.col("count"))).alias("sequence_id"), "part", "row")
    inside = Window.partitionBy("sequence_id").orderBy("part", "row").rowsBetween(Window.unboundedPreceding, -1)
    solved = solved.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))

    # the others, end to end: where a document begins is the sum of those before it
    left = stage.write(placed.where("low is null").select("part", "row", "doc_id", "doc_tokens", "n_full", "rest", "rest_ids"), "left")
    sums = left.groupBy("part").agg(F.sum("rest").alias("n"))
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    begin = left.select("part", "row", F.coalesce(F.sum("rest").over(within), F.lit(0)).alias("in_part")).join(sums, "part")
    begin = begin.select("part", "row", (F.col("part_start") + F.col("in_part")).alias("at"))
    at, end = F.col("at"), F.col("at") + F.col("rest")
    cut = left.join(begin, ["part", "row"]).withColumn(
        "w", F.explode(F.sequence(F.floor(at / window), F.floor((end - 1) / window))))
    low, high = F.greatest(at, F.col("w") * window), F.least(end, (F.col("w") + 1) * window)
    cut = cut.select(
        "doc_id", (F.col("n_full") * window + low - at).alias("start"), (high - low).alias("length"), "doc_tokens",
        (F.col("w") + next_id).alias("sequence_id"), (low - F.col("w") * window).alias("offset"), "rest_ids", (low - at).alias("skip"))
    fields = f"doc_id {kind.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return full.select(columns).union(solved.select(columns)).union(cut.mapInArrow(_cut_crcs, fields).select(columns))
