"""Operator 12: a Merkle manifest of a table, one tree per group and one over the groups' roots.

Leaf coordinates come from bitmaps, not from a sort.  Each group's doc_ids are 64-bit words of a bitmap, kept
only where a bit is set, built per task and merged by OR.  A popcount directory (documents before each bucket of 512
words, and before each word in its bucket) turns a doc_id into its rank with one join and one popcount.

Levels are reduced by keyed slot arrays: node i goes to slot i mod 4096 of array i div 4096, and one task
hashes four levels of that array, so each shuffle carries a 4096th of the nodes of the one before.  Proofs come back
the same way: the siblings above an array are one row that meets the array's slots in their task."""

from __future__ import annotations

import string
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import with_group_position, with_position, with_running_start
from .tables import Stage

ARITY = 8
LEVELS = 4  # levels hashed in one task: an array has ARITY**LEVELS slots
_NO_ID = -(1 << 62)  # the bucket of rows without a doc_id: below all others
NODES = "tree string, n long, pos long, hash binary"
PATHS = "tree string, pos long, upper string, ends string"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def encoded(value: Column) -> Column:
    """A value as ``bytes:value``, or ``-`` where it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    """SHA-256 (binary) over the encoded values of a row."""
    return F.unhex(F.sha2(F.concat(*map(encoded, columns)).cast("binary"), 256))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _coordinates(leaves: DataFrame, stage: Stage) -> tuple[DataFrame, int]:
    """``leaves(tree, doc_id, leaf, ...)`` with ``n`` (leaves of the tree) and ``pos`` (place in it, by doc_id, null
    first, then leaf), and the largest ``n``."""
    keyed = leaves.select(
        "*", F.coalesce(F.shiftright("doc_id", 15), F.lit(_NO_ID)).alias("bucket"),
        F.coalesce(F.shiftright("doc_id", 6).bitwiseAND(511), F.lit(0)).cast("int").alias("word"),
        F.coalesce(F.expr("shiftleft(1L, cast(doc_id & 63 as int))"), F.lit(0)).alias("bit"))
    words = stage.write(
        keyed.groupBy("tree", "bucket", "word").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n_word")), "words")
    # the directory: documents before each bucket of a tree, and before each word of a bucket
    buckets = with_running_start(words.groupBy("tree", "bucket").agg(F.sum("n_word").alias("n_bucket")), ["tree", "bucket"], "n_bucket", "begin")
    trees = buckets.groupBy("tree").agg(F.sum("n_bucket").alias("n"), F.min("begin").alias("first"))
    inside = Window.partitionBy("tree", "bucket").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.join(trees, "tree").select("tree", "bucket", "n", (F.col("begin") - F.col("first")).alias("begin"))
    directory = words.withColumn("inside", F.coalesce(F.sum("n_word").over(inside), F.lit(0))).join(buckets, ["tree", "bucket"])
    directory = stage.write(directory.select(
        "tree", "bucket", "word", "bits", "n", (F.col("begin") + F.col("inside")).alias("begin"),
        (F.col("n_word") > F.bit_count("bits")).alias("repeats")), "directory")
    placed = keyed.join(directory, ["tree", "bucket", "word"])
    columns = [*leaves.columns, "n"]
    ranked = placed.where("not repeats").select(
        *columns, (F.col("begin") + F.expr("bit_count(bits & ~shiftleft(-1L, cast(doc_id & 63 as int)))")).alias("pos"))
    most = directory.agg(F.max("n"), F.max("repeats")).first()
    if most[1]:
        # words with a repeated doc_id or none: numbered within the word; the last key spreads equal rows
        again = placed.where("repeats").withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
        again = with_group_position(again, ["tree", "bucket", "word"], ["doc_id", "leaf", "spread"], "place")
        ranked = ranked.union(again.select(*columns, (F.col("begin") + F.col("place")).alias("pos")))
    return ranked, most[0] or 0


def levels_of(n: int) -> int:
    """Levels above n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _floors(hashes: list[str], levels: int) -> list[list[str]]:
    """The nodes of an array at each of its levels, from the lowest to the one that is left."""
    floors = [hashes]
    for _ in range(levels):
        below = floors[-1]
        floors.append([sha256("".join(below[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(below), ARITY)])
    return floors


def _siblings(floor: list[str], i: int) -> str:
    """The other members of node i's run, with a star in its own place."""
    begin = i - i % ARITY
    return "".join(floor[begin:i]) + "*" + "".join(floor[i + 1 : begin + ARITY])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one array at a time (the rows arrive sorted by tree, block and pos)."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            here = (row["tree"], row["block"])
            if here != key and held:
                yield held
                held = []
            key = here
            held.append(row)
    if held:
        yield held


def _reduce(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _runs(batches):
            n = rows[0]["n"]
            top = _floors([r["hash"].hex() for r in rows], min(levels, levels_of(n)))[-1]
            out.append((rows[0]["tree"], -(-n // ARITY**levels), rows[0]["block"], bytes.fromhex(top[0])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.binary()))],
            ["tree", "n", "pos", "hash"])

    return run


def _arrays(rows: DataFrame) -> DataFrame:
    """The rows of an array together and in order of their slots."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _block(levels: int) -> Column:
    return F.floor(F.col("pos") / ARITY**levels).cast("long").alias("block")


def climb(stage: Stage, nodes: DataFrame, most: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The floors of the trees of ``nodes(tree, n, pos, hash)`` (``n`` nodes in a tree, at most ``most``; a floor for as many
    levels each), and ``(tree, hash)`` of their roots."""
    floors, roots = [nodes], nodes.where("n = 1").select("tree", "hash")
    while most > 1:
        arrays = _arrays(floors[-1].where("n > 1").select("tree", "n", "pos", "hash", _block(levels)))
        floors.append(stage.write(arrays.mapInArrow(_reduce(levels), NODES), "floor"))
        roots = roots.union(floors[-1].where("n = 1").select("tree", "hash"))
        most = -(-most // ARITY**levels)
    return floors, roots


def _meet(floor: DataFrame, uppers: DataFrame | None, above: DataFrame, levels: int) -> DataFrame:
    """Each array of a floor with one row (pos -1) that holds the siblings above it: from the floor above, or
    from ``above`` where the tree has one node here."""
    tops = floor.where("n = 1").select("tree").join(above, "tree").select("tree", F.lit(0).cast("long").alias("block"), "upper", "ends")
    if uppers is not None:
        tops = tops.union(uppers.select("tree", F.col("pos").alias("block"), "upper", "ends"))
    rows = floor.withColumn("block", _block(levels)).unionByName(tops.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    return _arrays(rows)


def _paths(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *rows in _runs(batches):
            floors = _floors([r["hash"].hex() for r in rows], min(levels, levels_of(rows[0]["n"])))
            upper = [head["upper"]] if head["upper"] else []
            paths = ["|".join([*(_siblings(f, i // ARITY**k) for k, f in enumerate(floors[:-1])), *upper]) for i in range(len(rows))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["tree"] for r in rows], pa.string()), pa.array([r["pos"] for r in rows], pa.int64()),
                 pa.array(paths, pa.string()), pa.array([head["ends"]] * len(rows), pa.string())], ["tree", "pos", "upper", "ends"])

    return run


def descend(stage: Stage, floors: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The lowest floor's arrays, each led by the siblings above it; ``above(tree, upper, ends)`` holds those above the trees."""
    uppers = None
    for floor in floors[:0:-1]:
        uppers = stage.write(_meet(floor, uppers, above, levels).mapInArrow(_paths(levels), PATHS), "paths")
    return _meet(floors[0], uppers, above, levels)


def fold(leaf: str, path: list[str]) -> str:
    """The root above ``leaf`` with the siblings of ``path``, from the lowest level up."""
    for level in path:
        leaf = sha256(level.replace("*", leaf).encode()).hexdigest()
    return leaf


def _prove(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *rows in _runs(batches):
            leaves = [r["hash"].hex() for r in rows]
            floors = _floors(leaves, min(levels, levels_of(rows[0]["n"])))[:-1]
            between = [[_siblings(f, i) for i in range(len(f))] for f in floors]
            upper = head["upper"].split("|") if head["upper"] else []
            subroot, root = head["ends"][:64], head["ends"][64:]
            proofs, folded = [], []
            for i, row in enumerate(rows):
                path = [b[i // ARITY**k] for k, b in enumerate(between)] + upper
                proofs.append(sha256("".join(path).replace("*", "").encode()).hexdigest())
                folded.append(fold(row["claimed"].hex() if row["claimed"] is not None else leaves[i], path))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array(leaves, pa.string()),
                 pa.array([subroot] * len(rows), pa.string()), pa.array([root] * len(rows), pa.string()),
                 pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_())],
                [c.split()[0] for c in PROOFS.split(", ")])

    return run


def manifest(docs: DataFrame, group: str, leaf: Column, claimed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Per row of ``docs(doc_id, ...)``: ``doc_id, leaf, subroot`` (of its ``group``), ``root, proof_sha256`` (SHA-256 over
    the siblings, from the leaf's to the root's), ``folded_root`` (from ``claimed``, a leaf hash held against the manifest,
    or from the leaf itself where that is null) and ``verified`` (whether that is the root).

    Rows without a group are a group, the first; rows without a doc_id come first in theirs.  Repeated
    doc_ids are leaves each, in order of their hashes; a group of one row is its own root.  An empty table gives
    no rows.  Further columns, whatever their names, are ignored unless ``leaf`` names them."""
    spark = docs.sparkSession
    stage = Stage(spark)
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = stage.write(docs.select(
        tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"),
        (F.lit(None).cast("binary") if claimed is None else claimed).alias("claimed")), "leaves")
    ranked, most = _coordinates(leaves, stage)
    if not most:
        return spark.createDataFrame([], PROOFS)
    placed = stage.write(ranked.withColumnRenamed("leaf", "hash"), "placed")
    stage.drop(leaves)
    floors, subroots = climb(stage, placed.select("tree", "n", "pos", "hash"), most, levels)
    subroots = stage.write(with_position(subroots, ["tree"]).withColumnsRenamed({"tree": "name"}), "subroots")
    n = subroots.count()
    groups = subroots.select(F.lit("").alias("tree"), F.lit(n).cast("long").alias("n"), "pos", "hash")
    higher, top = climb(stage, groups, n, levels)
    top = top.select("tree", F.lit("").alias("upper"), F.lower(F.hex("hash")).alias("ends"))
    over = descend(stage, higher, top, levels).mapInArrow(_paths(levels), PATHS).join(subroots, "pos")
    above = stage.write(over.select(
        F.col("name").alias("tree"), "upper", F.concat(F.lower(F.hex("hash")), F.col("ends")).alias("ends")), "above")
    return descend(stage, [placed, *floors[1:]], above, levels).mapInArrow(_prove(levels), PROOFS)


def document_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``documents`` by lang, held against a copy in which the text of every third document (by
    the checksum of its id) is in ASCII lower case."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, "lang", leaf_hash(columns), F.when(changed, leaf_hash([*columns[:-1], lower_ascii(columns[-1])])), levels)
