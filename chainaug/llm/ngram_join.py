"""Operator 2: n-gram Jaccard join, exact, without pairs of whole groups.

1. Every text becomes the sorted array of its distinct word-shingle hashes; equal sets are one
   class from there on, so copies cost nothing more.
2. *Size-banded tiles.*  Linked sets have sizes within the ratio ``threshold``; tile j takes the
   sizes of band j (ratio ``BAND``) and those just below it that can still link into it.  In a tile
   at most k shingles can differ between linked sets, so of k+1+e ranges of the hash space at least
   1+e hold the same shingles in both (pigeonhole).  Each set emits one key per range that is not empty;
   a set with more than e empty ranges also emits the tile's key for sparse sets.  So no link is lost.
   This holds for any part of the shingles, so those that a sample of documents finds popular (passages and
   phrases that many share) are left out of the keys, and only of the keys.
3. Sets of a tile that share a key are one family (connected components over one edge per set
   and key).  Families are split into blocks ordered by size; only block pairs whose sizes can link meet.
4. Inside a block pair *hashed bitmap signatures* bound the overlap from above: a bit set in one
   signature only is at least one shingle the other lacks.  Pairs that pass and are not connected yet
   get the exact *sorted-array intersection*.  Only the edges of a spanning forest leave the task.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import with_running_start
from .components import connected_components
from .kernels import SPACE_WORDS, Words, chunks, mix64, utf8
from .tables import Stage, semi_join_texts

BAND = 1.5  # size ratio of a tile's band
BLOCK_SHINGLES = 1 << 20  # shingles in one block of a family ...
LEAST_WEIGHT = 512  # ... where a set counts as this many at least, so a block holds 2,048 sets at most
SAMPLE_ONE_IN = 12  # of the documents, those in which popular shingles are looked for
POPULAR_BITS = 26  # popular shingles are broadcast as a bitmap of 2 ** 26 bits (8 MB), whatever the data
POPULAR_MOST = 1 << 22  # of which at most this many are set, the most frequent ones
_SEEN = 1 << 20  # sets that a task remembers so that copies emit their keys once
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], words_per_shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased, words split at white space.

    A text of fewer words than a shingle has its whole sequence as one; without words: empty."""
    for lo, hi in chunks(texts):
        words = Words([t.lower() for t in texts[lo:hi]], SPACE_WORDS)
        hashes = words.windows(words_per_shingle)
        for a, b in zip(words.first[:-1], words.first[1:]):
            if b - a >= words_per_shingle:
                yield np.unique(hashes[a : b - words_per_shingle + 1])
            elif b > a:
                whole = np.array([b - a], dtype=np.uint64)
                for h in words.hash[a:b]:
                    whole = whole * _ODD + h
                yield mix64(whole)
            else:
                yield np.empty(0, dtype=np.uint64)


def set_hash(hashes: np.ndarray) -> int:
    """64-bit name of a set of shingles (order-free sum of scrambled members, and their number)."""
    total = mix64(hashes ^ _ODD).sum(dtype=np.uint64, keepdims=True) + np.full(1, len(hashes), dtype=np.uint64) * _ODD
    return int(mix64(total).view(np.int64)[0])


def band_of(n: int) -> int:
    """Band j holds the sizes band_start(j) .. band_start(j+1)-1."""
    j = max(0, int(math.log(n) / math.log(BAND)) - 1)
    while band_start(j + 1) <= n:
        j += 1
    return j


def band_start(j: int) -> int:
    return math.ceil(BAND**j)


@functools.cache
def tile_ranges(tile: int, threshold: Fraction) -> tuple[int, int]:
    """(number of hash ranges, e) of a tile.

    Sizes in the tile are below ``top``, so |x| + |y| <= 2 (top-1), and a link needs
    |x ^ y| <= (1-t)/(1+t) (|x|+|y|).  e is a bound that the number of empty ranges of a set seldom passes."""
    top = band_start(tile + 1) - 1
    least = math.ceil(threshold * band_start(tile))
    differ = int((1 - threshold) / (1 + threshold) * 2 * top)
    spare = 0
    for _ in range(8):
        ranges = differ + 1 + spare
        empty = ranges * (1 - 1 / ranges) ** least
        spare = math.ceil(empty + 4 * math.sqrt(empty)) if empty > 1e-4 else 0
    return differ + 1 + spare, spare


def tile_keys(hashes: np.ndarray, tile: int, threshold: Fraction) -> np.ndarray:
    """Keys of a set in a tile: one per non-empty range of the hash space, or one more for a sparse set."""
    ranges, spare = tile_ranges(tile, threshold)
    if not len(hashes):
        return np.array([tile], dtype=np.int64)
    at = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    total = np.add.reduceat(mix64(hashes), begin)
    keys = mix64((total * _ODD + at[begin]) * _ODD + np.uint64(tile)).view(np.int64)
    return keys if ranges - len(begin) <= spare else np.append(keys, np.int64(tile))


def keys_of(hashes: np.ndarray, threshold: Fraction, popular: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(tile, keys) of a set for the tiles it belongs to; shingles whose bit is set in ``popular`` are left out."""
    n = len(hashes)
    if not n:
        return []
    own = band_of(n)
    tiles = [own] + [own + 1] * (n >= threshold * band_start(own + 1))
    at = hashes & np.uint64((1 << POPULAR_BITS) - 1)
    hashes = hashes[(popular[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 0]
    return [(j, tile_keys(hashes, j, threshold)) for j in tiles]


def _popular(stage: Stage, texts: DataFrame, words_per_shingle: int) -> np.ndarray:
    """Bitmap of the shingles that two or more different sets of a sample hold: one document in
    ``SAMPLE_ONE_IN``, by hash of the id.

    It decides how much work is spared, never what is found, so a bit that stands for other shingles too does
    no harm, and its size needs no relation to the data's."""
    sample = texts.where(F.pmod(F.xxhash64(F.lit("popular"), "doc_id"), F.lit(SAMPLE_ONE_IN)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [h for h in shingle_sets(utf8(batch["text"]), words_per_shingle) if len(h)]
            for part in range(0, len(sets), 100):
                some = sets[part : part + 100]
                node = np.repeat(np.array([set_hash(h) for h in some], dtype=np.int64), [len(h) for h in some])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some).view(np.int64)), pa.array(node)], ["shingle", "node"])

    # a set that is in the sample more than once (copies) is no sign of popularity
    many = sample.select("text").mapInArrow(run, "shingle long, node long").groupBy("shingle").agg(
        F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("shingle", "n")
    many = stage.write(many, "popular")
    total = many.count()
    if total > POPULAR_MOST:
        least = many.agg(F.percentile_approx("n", 1 - POPULAR_MOST / total)).first()[0]
        many = many.where(F.col("n") > least)
    at = F.col("shingle").bitwiseAND(F.lit((1 << POPULAR_BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(shingle & 63 as int))")
    rows = many.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(1 << (POPULAR_BITS - 6), dtype=np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return words.view(np.uint64)


SETS = "doc_id long, n_shingles long, node long, tiles array<int>, counts array<int>, keys binary"


def _sets(words_per_shingle: int, threshold: Fraction, popular):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for doc_id, hashes in zip(batch["doc_id"].to_pylist(), shingle_sets(utf8(batch["text"]), words_per_shingle)):
                node = set_hash(hashes) if len(hashes) else None
                keyed = []
                if node is not None and doc_id is not None and node not in seen:
                    keyed = keys_of(hashes, threshold, popular.value)
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(node)
                out.append((doc_id, len(hashes), node, [j for j, _ in keyed], [len(k) for _, k in keyed],
                            b"".join(k.tobytes() for _, k in keyed)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), _SET_TYPES)] if out else [pa.array([], t) for t in _SET_TYPES]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "node", "tiles", "counts", "keys"])

    return run


_SET_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, tiles, counts, keys) -> one row (key, node, tile) per key."""
    for batch in batches:
        keys = np.frombuffer(b"".join(batch["keys"].to_pylist()), dtype=np.int64)
        nodes, tiles, counts = [], [], []
        for node, t, c in zip(batch["node"].to_pylist(), batch["tiles"].to_pylist(), batch["counts"].to_pylist()):
            nodes += [node] * len(t)
            tiles += t
            counts += c
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(np.repeat(np.array(nodes, dtype=np.int64), counts)),
             pa.array(np.repeat(np.array(tiles, dtype=np.int32), counts))], ["key", "node", "tile"])


def _first_of_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, node) -> an edge from each node to the first node with its key.

    Only the last key and its first node are held from one batch to the next, so a key of any
    number of rows is read as a stream."""
    last_key = last_node = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node, tile = (batch[c].to_numpy() for c in ("key", "node", "tile"))
        new = np.concatenate(([last_key is None or key[0] != last_key], key[1:] != key[:-1]))
        run = np.cumsum(new)
        heads = np.concatenate(([0 if last_node is None else last_node], node[new]))
        head = heads[run]
        last_key, last_node = key[-1], head[-1]
        edge = head != node
        if not edge.any():
            continue
        rows = np.unique(np.stack([tile[edge], head[edge], node[edge]]), axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0].astype(np.int32)), pa.array(rows[1]), pa.array(rows[2])], ["tile", "a", "b"])


def _arrays(words_per_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [h for h in shingle_sets(utf8(batch["text"]), words_per_shingle)]
            keep = [h for h in sets if len(h)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_hash(h) for h in keep], pa.int64()), pa.array([len(h) for h in keep], pa.int64()),
                 pa.array([h.tobytes() for h in keep], pa.binary())], ["node", "n", "hashes"])

    return run


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Hashed bitmaps, one row of 64-bit words per set; four to eight bits per shingle of the largest."""
    bits = max(64, 1 << (4 * max(map(len, sets)) - 1).bit_length())
    out = np.zeros((len(sets), bits // 64), dtype=np.uint64)
    for i, hashes in enumerate(sets):
        at = hashes & np.uint64(bits - 1)
        np.bitwise_or.at(out[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


class Forest:
    """Components of the sets of a task; ``label`` is kept flat so whole arrays can be compared."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, i: int, j: int) -> None:
        self.label[self.label == self.label[j]] = self.label[i]


def spanning_links(sets: list[np.ndarray], threshold: Fraction, split: int | None = None) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of all links among ``sets``, which are ordered by size.

    With ``split`` only pairs of one set before it and one from it on are compared."""
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    bitmaps, forest, edges = signatures(sets), Forest(len(sets)), []
    p, q = threshold.numerator, threshold.denominator
    for i in range(1 if split is None else split, len(sets)):
        top = i if split is None else split
        lo = int(np.searchsorted(size[:top], -(-p * size[i] // q)))  # the smallest size that can link to i
        hi = top if split is None else int(np.searchsorted(size[:top], size[i] * q // p, side="right"))
        if lo >= hi:
            continue
        other = bitmaps[lo:hi]
        here = size[i] - np.bitwise_count(bitmaps[i] & ~other).sum(axis=1, dtype=np.int64)
        there = size[lo:hi] - np.bitwise_count(other & ~bitmaps[i]).sum(axis=1, dtype=np.int64)
        bound = np.minimum(here, there)
        # overlap / (total - overlap) >= p / q   <=>   (p + q) overlap >= p total
        total = size[i] + size[lo:hi]
        can = np.flatnonzero(((p + q) * bound >= p * total) & (forest.label[lo:hi] != forest.label[i]))
        for j in can[np.argsort(-bound[can], kind="stable")] + lo:
            if forest.label[j] == forest.label[i]:
                continue
            merged = np.concatenate((sets[i], sets[j]))
            merged.sort(kind="stable")  # two sorted runs: one merge
            overlap = int((merged[1:] == merged[:-1]).sum())
            if (p + q) * overlap >= p * int(size[i] + size[j]):
                forest.union(i, int(j))
                edges.append((i, int(j)))
    return edges


def _links(threshold: Fraction):
    def run(table: pa.Table) -> pa.Table:
        families = table["family"].to_numpy()
        node, second = table["node"].to_numpy(), table["second"].to_numpy()
        sets = [np.frombuffer(h, dtype=np.uint64) for h in table["hashes"].to_pylist()]
        size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        order = np.lexsort((node, size, second, families))
        cut = np.flatnonzero(np.concatenate(([True], families[order][1:] != families[order][:-1])))
        a, b = [], []
        for rows in np.split(order, cut[1:]):
            split = int(np.searchsorted(second[rows], 1)) if table["block_i"][0].as_py() != table["block_j"][0].as_py() else None
            for i, j in spanning_links([sets[r] for r in rows], threshold, split):
                a.append(node[rows[i]])
                b.append(node[rows[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def jaccard_components(docs: DataFrame, words_per_shingle: int = 3, threshold: float = 0.9) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_shingles, component_id)``, one row per input row.

    Two texts link when the Jaccard similarity of their shingle sets is at least ``threshold``.
    ``component_id`` is the smallest doc_id reachable by links, the own one included.
    Null, empty and blank texts have no shingles and link with nothing; a null doc_id links with
    nothing and stays null; rows that share a doc_id are separate documents.  Extra columns are ignored."""
    spark = docs.sparkSession
    exact = Fraction(threshold).limit_denominator(1000)
    stage = Stage(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    popular = spark.sparkContext.broadcast(_popular(stage, texts, words_per_shingle))
    full = stage.write(texts.mapInArrow(_sets(words_per_shingle, exact, popular), SETS), "sets")

    sets = stage.write(full.select("doc_id", "n_shingles", "node"), "nodes")
    classes = sets.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    # copies of a set emit keys once in a task; those of other tasks meet as equal rows, which give no edge
    keys = full.where("size(tiles) > 0").select("node", "tiles", "counts", "keys").mapInArrow(_key_rows, "key long, node long, tile int")
    shared = (
        keys.repartition("key").sortWithinPartitions("key", "node")
        .mapInArrow(_first_of_key, "tile int, a long, b long").distinct()
    )
    vertex = lambda c: F.xxhash64("tile", c)  # noqa: E731 - a set is another vertex in each of its tiles
    shared = stage.write(shared, "shared")
    stage.drop(full)
    families = connected_components(spark, shared.select(vertex("a").alias("a"), vertex("b").alias("b")))
    members = (
        shared.select("tile", F.col("a").alias("node")).union(shared.select("tile", "b")).distinct()
        .withColumn("id", vertex("node")).join(families, "id")
        .select("node", F.col("component").alias("family"))
    )
    members = stage.write(members.join(classes, "node"), "members")

    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    n_wanted = wanted.count()
    found = semi_join_texts(texts, wanted, "doc_id", n_wanted)
    arrays = stage.write(found.mapInArrow(_arrays(words_per_shingle), "node long, n long, hashes binary"), "arrays")
    if arrays.count() > n_wanted:  # rows that share a doc_id
        arrays = stage.write(arrays.dropDuplicates(["node"]), "arrays")

    # blocks of a family: running weight by size, over the sizes of all families at once, so that a large family lies in
    # several tasks; one number per set is sorted, never its shingles
    sized = members.join(arrays.select("node", "n"), "node").withColumn("weight", F.greatest("n", F.lit(LEAST_WEIGHT)).cast("long"))
    running = stage.write(with_running_start(sized, ["family", "n", "node"], "weight", "running"), "running")
    begins = stage.write(running.groupBy("family").agg(F.min("running").alias("begin")), "begins")
    block = F.floor((F.col("running") - F.col("begin")) / BLOCK_SHINGLES).cast("int")
    blocks = stage.write(running.join(begins, "family").select(*sized.columns, block.alias("block")), "blocks")
    spans = blocks.groupBy("family", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.sum("weight").alias("weight"))
    spans = stage.write(spans, "spans")
    first, second = spans.alias("i"), spans.alias("j")
    near = F.lit(exact.numerator) * F.col("j.low") <= F.lit(exact.denominator) * F.col("i.high")
    meets = first.join(second, (F.col("i.family") == F.col("j.family")) & (F.col("i.block") <= F.col("j.block")) & near).select(
        F.col("i.family").alias("family"), F.col("i.block").alias("block_i"), F.col("j.block").alias("block_j"))
    # families of one block share tasks of about a block's weight; a split family has one for each block pair
    last = spans.groupBy("family").agg(F.max("block").alias("last"))
    bundles = (spans.agg(F.sum("weight")).first()[0] or 0) // BLOCK_SHINGLES + 1
    bundle = F.when(F.col("last") == 0, F.pmod(F.xxhash64("family"), F.lit(bundles))).otherwise(F.xxhash64("family"))
    meets = meets.join(last, "family").withColumn("bundle", bundle)
    left = meets.select("family", F.col("block_i").alias("block"), "block_i", "block_j", "bundle", F.lit(0).alias("second"))
    right = meets.where("block_i <> block_j").select("family", F.col("block_j").alias("block"), "block_i", "block_j", "bundle", F.lit(1).alias("second"))
    tasks = (
        blocks.join(left.union(right), ["family", "block"]).select("node", "family", "block_i", "block_j", "bundle", "second")
        .join(arrays.select("node", "hashes"), "node")
    )
    links = tasks.groupBy("bundle", "block_i", "block_j").applyInArrow(_links(exact), "a long, b long")

    found = connected_components(spark, links).withColumnRenamed("id", "node")
    grouped = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = grouped.join(smallest, "component").select("node", "component_id")
    return sets.select("doc_id", "n_shingles", "node").join(named, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
