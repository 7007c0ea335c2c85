"""Operator 11: the prefix trie of conversations, by a skeleton of splitter paths.

A conversation is a path of turn digests.  Paths are sorted into shards between splitter paths (a bounded
sample).  A node whose members lie in more than one shard holds a splitter between two of them, so it is a prefix of
a splitter: the trie of the splitters, the skeleton, holds all such nodes.  Each shard walks its
sorted paths with one stack and finishes every node that is not of the skeleton; for a skeleton node it gives a
partial aggregate, and these are reduced by node.  Copies of a path are told apart by conv_id, so many copies spread
over shards.

Paths are cut into segments of ``segment`` turns, so no row grows with a conversation: a later
segment hangs below the hash of all turns before it, in a trie of its own, and the totals of
those tries are added to the nodes above them by pointer jumping."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import with_position, with_running_start
from .tables import Stage

TURN = 16  # bytes of a turn's digest in a path; a path begins with as many that name its trie
FIRST = b"\0" * TURN  # the trie of first segments
SHARD_PATHS = 2_000  # paths a shard is meant to hold, as long as there are
MOST_SHARDS = 20_000  # no more splitters than this (less one) go to the driver and the tasks
_SAMPLED = 16  # paths sampled for a shard
_CHUNK = 1 << 16  # bytes of ids of members in one row on their way to the hash of a skeleton node
EMPTY_HASH = sha256(b"").hexdigest()

NODE, PART, ENDS, LINK, TRIE = range(5)  # kinds of rows that a shard gives
FOUND = ("kind int, uid long, conv_id long, depth long, parent long, parent_part long, parent_trie binary, "
         "n_convs long, n_children long, n_leaves long, saved long, ends string, place long, trie binary, below binary")
_FOUND = [(name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[kind])
          for name, kind in (c.split() for c in FOUND.split(", "))]
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _head(conv_id: Column | str) -> Column:
    """How many first turns a conversation takes from the one it was branched off."""
    return F.crc32(F.col(conv_id).cast("string").cast("binary")) % 9


def _trunk(conv_id: str) -> Column:
    return F.col(conv_id) - F.col(conv_id) % 5


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn``, a digest of role and text, and the bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.octet_length(text).alias("size"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"))


def rebuild(turns: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns ``conv_id, depth`` (from 0), ``digest, size, length`` (turns of the conversation), and every
    conversation with its ``length``.

    Turns are numbered by a range sort of all, so a long conversation lies in several tasks; equal turn
    numbers are ordered by digest."""
    numbered = with_position(turns, ["conv_id", "turn", "digest"], "at")
    convs = numbered.groupBy("conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    trunks = convs.where(F.col("conv_id") == _trunk("conv_id")).select(F.col("conv_id").alias("trunk"), F.col("n").alias("n_trunk"))
    own = F.col("conv_id") == F.col("trunk")
    convs = convs.withColumn("trunk", _trunk("conv_id")).join(trunks, "trunk", "left").select(
        "conv_id", "first", own.alias("own"), F.when(own, 0).otherwise(_head("conv_id")).alias("head"),
        F.when(own, 0).otherwise(F.least(_head("conv_id"), F.coalesce("n_trunk", F.lit(0)))).alias("taken"), "n")
    convs = stage.write(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))), "conversations")
    places = numbered.join(convs, "conv_id").withColumn("depth", F.col("at") - F.col("first"))
    kept = places.where("depth >= head").withColumn("depth", F.col("depth") - F.col("head") + F.col("taken"))
    given = places.where("own and depth < 8").select(
        F.col("conv_id").alias("trunk"), F.explode(F.sequence(F.lit(-4), F.lit(4))).alias("step"), "depth", "digest", "size")
    given = given.withColumn("conv_id", F.col("trunk") + F.col("step")).where(
        (F.col("step") != 0) & (_trunk("conv_id") == F.col("trunk")) & (F.col("depth") < _head("conv_id")))
    given = given.join(convs.select("conv_id", "length"), "conv_id")
    columns = ["conv_id", "depth", "digest", "size", "length"]
    return kept.select(columns).union(given.select(columns)), convs.select("conv_id", "length")


def paths_of(turns: DataFrame, convs: DataFrame, segment: int, stage: Stage) -> tuple[DataFrame, bool]:
    """A row per conversation and segment: ``conv_id, part`` (the segment), ``path`` (the trie's name and the turns'
    digests), ``sizes`` and ``below`` (the trie in which the conversation goes on, null where it ends); and
    whether any goes on.  A conversation without turns has a path of none."""
    part = F.floor(F.col("depth") / segment).cast("long")
    joined = turns.groupBy("conv_id", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "digest", "size"))).alias("turns"), F.max("length").alias("length"))
    rows = joined.select(
        "conv_id", "part", F.unhex(F.array_join("turns.digest", "")).alias("turns"), F.col("turns.size").alias("sizes"), "length")
    none = convs.where("length = 0").select(
        "conv_id", F.lit(0).cast("long").alias("part"), F.lit(b"").alias("turns"), F.array().cast("array<int>").alias("sizes"), "length")
    rows = stage.write(rows.union(none), "segments")
    lead, nothing = F.lit(FIRST), F.lit(None).cast("binary")
    short = rows.where(F.col("length") <= segment).select("conv_id", "part", F.concat(lead, "turns").alias("path"), "sizes", nothing.alias("below"))
    if convs.where(F.col("length") > segment).isEmpty():
        return short, False
    # the hash of all turns before a segment: sums of the segments' hashes over a conversation, as running sums over all
    long = rows.where(F.col("length") > segment)
    digest = F.md5(F.concat(F.col("part").cast("string").cast("binary"), F.lit(b":"), F.col("turns")))
    sums = long.select("conv_id", "part", *(
        F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)").alias(name) for at, name in ((1, "high"), (16, "low"))))
    for name in ("high", "low"):
        sums = with_running_start(sums, ["conv_id", "part"], name, f"{name}_before")
    sums = stage.write(sums, "sums")
    start = sums.where("part = 0").select("conv_id", F.col("high_before").alias("high_first"), F.col("low_before").alias("low_first"))

    def name_of(number: Column, high: Column, low: Column) -> Column:
        return F.unhex(F.md5(F.concat_ws(":", number.cast("string"), high.cast("string"), low.cast("string")).cast("binary")))

    high, low = F.col("high_before") - F.col("high_first"), F.col("low_before") - F.col("low_first")
    names = sums.join(start, "conv_id").select(
        "conv_id", "part", F.when(F.col("part") == 0, lead).otherwise(name_of(F.col("part"), high, low)).alias("trie"),
        name_of(F.col("part") + 1, high + F.col("high"), low + F.col("low")).alias("below"))
    long = long.join(names, ["conv_id", "part"]).select(
        "conv_id", "part", F.concat("trie", "turns").alias("path"), "sizes",
        F.when(F.col("length") > (F.col("part") + 1) * segment, F.col("below")).alias("below"))
    return short.union(long), True


def _common(a: bytes, b: bytes) -> int:
    """Digests that two paths have in common from the start."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // TURN
    at = 0
    while a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


class Skeleton:
    """The trie of the splitters ``(path, conv_id, sizes, part)`` (sorted): ``ids[s][k]`` is the node of the first k+1
    digests of splitter s; ``parent``, ``size`` (bytes of the last text), ``depth`` and ``trie`` by node."""

    def __init__(self, splitters: list[tuple], segment: int):
        self.keys = [(path, conv) for path, conv, *_ in splitters]
        self.ids: list[list[int]] = []
        self.parent, self.size, self.depth, self.trie = [], [], [], []
        before, ids = b"", []
        for path, _, sizes, part in splitters:
            ids = ids[: _common(before, path)]
            for k in range(len(ids), len(path) // TURN):
                self.parent.append(ids[-1] if k else -1)
                self.size.append(sizes[k - 1] if k else 0)
                self.depth.append(part * segment + k)
                self.trie.append(path[:TURN])
                ids.append(len(self.parent) - 1)
            self.ids.append(list(ids))
            before = path

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.keys, (path, conv_id))


class _Node:
    """An open node of a shard's walk: ``part`` is its number in the skeleton, None outside of it."""

    __slots__ = ("part", "size", "depth", "n", "least", "children", "leaves", "saved", "hash", "ids", "waiting", "below", "links", "chunks")

    def __init__(self, part: int | None, size: int, depth: int):
        self.part, self.size, self.depth = part, size, depth
        self.n = self.children = self.leaves = self.saved = self.chunks = 0
        self.least = self.hash = self.below = None
        self.ids, self.waiting, self.links = [], [], []


class _Walk:
    """One shard: sorted paths in, rows of FOUND out.  It holds the open nodes, one per turn of the path at hand, and
    finished children whose parent is still open."""

    def __init__(self, skeleton: Skeleton, segment: int, shard: int):
        self.skeleton, self.segment, self.shard = skeleton, segment, shard
        self.lower = (skeleton.keys[shard - 1][0], skeleton.ids[shard - 1]) if shard else (b"", [])
        self.upper = (skeleton.keys[shard][0], skeleton.ids[shard]) if shard < len(skeleton.keys) else (b"", [])
        self.path, self.stack, self.out, self.named = b"", [], [], 0

    def _give(self, kind: int, **values) -> None:
        self.out.append((kind, values))

    def add(self, conv_id: int, part: int, path: bytes, sizes: list[int], below: bytes | None) -> None:
        if path != self.path or not self.stack:
            self._close(_common(self.path, path) if self.stack else 0)
            low, high = _common(path, self.lower[0]), _common(path, self.upper[0])
            for k in range(len(self.stack), len(path) // TURN):
                number = self.lower[1][k] if k < low else self.upper[1][k] if k < high else None
                self.stack.append(_Node(number, sizes[k - 1] if k else 0, part * self.segment + k))
            self.path = path
        node = self.stack[-1]
        node.n += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        if below is not None:
            if node.below is None:
                node.below = below
                node.links.append(below)
        elif node.part is None:
            if node.hash is None:
                node.hash = sha256(b"%d" % conv_id)
            else:
                node.hash.update(b",%d" % conv_id)
        else:
            node.ids.append(str(conv_id))
            if len(node.ids) * 8 > _CHUNK:
                self._give_ids(node)

    def _give_ids(self, node: _Node) -> None:
        if node.ids:
            self._give(ENDS, uid=node.part, ends=",".join(node.ids), place=self.shard << 32 | node.chunks)
            node.ids, node.chunks = [], node.chunks + 1

    def _close(self, kept: int) -> None:
        trie = self.path[:TURN]
        while len(self.stack) > kept:
            node = self.stack.pop()
            over = self.stack[-1] if self.stack else None
            if over is not None:
                over.n += node.n
                over.least = node.least if over.least is None else min(over.least, node.least)
                over.links += node.links
            uid = None
            if node.links:
                self.named += 1
                uid = -1 - (self.shard << 32 | self.named) if node.part is None else node.part
                for link in node.links:
                    self._give(LINK, uid=uid, trie=trie, below=link, place=int(link == node.below))
            if node.part is not None:
                self._give_ids(node)
                self._give(PART, uid=node.part, conv_id=node.least, n_convs=node.n, n_children=node.children,
                           n_leaves=node.leaves, saved=node.saved, below=node.below)
                continue
            for child in node.waiting:
                self._give(NODE, parent=node.least, **child)
            leaves = node.leaves if node.children or node.below is not None else 1
            row = dict(uid=uid, conv_id=node.least, depth=node.depth, n_convs=node.n, n_children=node.children, n_leaves=leaves,
                       saved=node.saved + (node.n - 1) * node.size, ends=node.hash.hexdigest() if node.hash else EMPTY_HASH, below=node.below)
            if over is None:
                self._give(NODE if trie == FIRST else TRIE, trie=trie, **row)
                continue
            over.children += 1
            over.leaves += leaves
            over.saved += row["saved"]
            if len(self.stack) == 1 and trie != FIRST:
                self._give(NODE, parent_trie=trie, **row)
            elif over.part is not None:
                self._give(NODE, parent_part=over.part, **row)
            else:
                over.waiting.append(row)

    def finish(self) -> None:
        self._close(0)

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = [pa.array([k for k, _ in rows], pa.int32())]
        columns += [pa.array([v.get(name) for _, v in rows], kind) for name, kind in _FOUND[1:]]
        return pa.RecordBatch.from_arrays(columns, [name for name, _ in _FOUND])


def _assign(skeleton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = list(map(skeleton.value.shard, batch["path"].to_pylist(), batch["conv_id"].to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), *batch.columns], ["shard", *batch.schema.names])

    return run


def _walk(skeleton, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            for shard, *row in zip(*(batch[c].to_pylist() for c in ("shard", "conv_id", "part", "path", "sizes", "below"))):
                if walk is None or walk.shard != shard:
                    if walk is not None:
                        walk.finish()
                        yield walk.batch()
                    walk = _Walk(skeleton.value, segment, shard)
                walk.add(*row)
                if len(walk.out) >= 10_000:
                    yield walk.batch()
        if walk is not None:
            walk.finish()
            yield walk.batch()

    return run


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of ids in order of node and place -> the hash of each node's ids, read as one stream."""
    node, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["uid", "hash"])

    for batch in batches:
        for uid, ids in zip(batch["uid"].to_pylist(), batch["ends"].to_pylist()):
            if uid == node:
                state.update(b",")
            else:
                if state is not None:
                    yield done()
                node, state = uid, sha256()
            state.update(ids.encode())
    if state is not None:
        yield done()


def _splitters(paths: DataFrame, rows: int, shard_paths: int) -> list[tuple]:
    """At most MOST_SHARDS - 1 rows between shards of about equal size, from a sample by hash."""
    shards = min(MOST_SHARDS, -(-rows // shard_paths))
    every = max(1, rows // (_SAMPLED * shards))
    sample = paths.where(F.pmod(F.xxhash64("conv_id", "part"), F.lit(every)) == 0) if shards > 1 else paths.limit(0)
    found = sorted((bytes(r["path"]), r["conv_id"], r["sizes"], r["part"]) for r in sample.collect())
    return [found[i * len(found) // shards] for i in range(1, shards)] if len(found) >= shards else []


def _reduced(spark: SparkSession, found: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The skeleton's nodes from their partial aggregates: ``uid`` and the columns of FOUND.  Sums per node come from
    Spark; adding children to parents is one pass over the skeleton, which the number of splitters bounds."""
    parts = found.where(F.col("kind") == PART).groupBy("uid").agg(
        F.sum("n_convs").alias("n"), F.min("conv_id").alias("least"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("below").alias("below"))
    at = {r["uid"]: r for r in parts.collect()}
    n = len(skeleton.parent)
    children, leaves, saved = ([at[i][c] for i in range(n)] for c in ("children", "leaves", "saved"))
    for i in reversed(range(n)):  # a node's number is above its parent's
        if not children[i] and at[i]["below"] is None:
            leaves[i] = 1
        saved[i] += (at[i]["n"] - 1) * skeleton.size[i]
        over = skeleton.parent[i]
        if over >= 0:
            children[over] += 1
            leaves[over] += leaves[i]
            saved[over] += saved[i]
    rows = []
    for i in range(n):
        over, first = skeleton.parent[i], skeleton.trie[i] == FIRST
        under_trie = over >= 0 and skeleton.parent[over] < 0 and not first
        rows.append((NODE if over >= 0 or first else TRIE, i, at[i]["least"], skeleton.depth[i],
                     at[over]["least"] if over >= 0 and not under_trie else None, skeleton.trie[i] if under_trie else None,
                     at[i]["n"], children[i], leaves[i], saved[i], skeleton.trie[i], at[i]["below"]))
    schema = ("kind int, uid long, conv_id long, depth long, parent long, parent_trie binary, n_convs long, n_children long, "
              "n_leaves long, saved long, trie binary, below binary")
    return spark.createDataFrame(rows, schema)


def _totals(tries: DataFrame, edges: DataFrame, stage: Stage) -> DataFrame:
    """``tries(trie, n_leaves, saved)`` of their own and ``edges(trie, below)`` -> the sums over a trie and all below it,
    by pointer jumping: after k rounds a trie has summed 2**k generations."""
    current = stage.write(tries.join(edges.select(F.col("below").alias("trie"), F.col("trie").alias("over")), "trie", "left"), "totals")
    while not current.where("over is not null").isEmpty():
        more = current.where("over is not null").groupBy("over").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = current.select(F.col("trie").alias("over"), F.col("over").alias("next"))
        following = current.join(more.withColumnRenamed("over", "trie"), "trie", "left").join(jump, "over", "left").select(
            "trie", "n_children", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.col("next").alias("over"))
        following = stage.write(following, "totals")
        stage.drop(current)
        current = following
    return current.drop("over")


def prefix_trie(conversations: DataFrame, segment: int = 256, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """The nodes of the trie of rebuilt ``conversations(conv_id, turn, role, text, ...)``: columns NODES.

    Null roles and texts are empty; a null turn comes first, equal turns in order of their digests.  Rows without a
    conv_id belong to no conversation and are left out.  A conversation rebuilt without turns ends at the root.
    An empty table gives no nodes.  Further columns, whatever their names, are ignored."""
    spark = conversations.sparkSession
    stage = Stage(spark)
    turns, convs = rebuild(turns_of(conversations), stage)
    paths, deep = paths_of(turns, convs, segment, stage)
    paths = stage.write(paths, "paths")
    rows = paths.count()
    skeleton = Skeleton(_splitters(paths, rows, shard_paths) if rows else [], segment)
    shared = spark.sparkContext.broadcast(skeleton)
    placed = paths.mapInArrow(_assign(shared), "shard int, conv_id long, part long, path binary, sizes array<int>, below binary")
    placed = placed.repartitionById(len(skeleton.keys) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    found = stage.write(placed.mapInArrow(_walk(shared, segment), FOUND), "found")

    inner = stage.write(_reduced(spark, found, skeleton), "skeleton")
    chunks = found.where(F.col("kind") == ENDS).select("uid", "place", "ends")
    hashes = chunks.repartition("uid").sortWithinPartitions("uid", "place").mapInArrow(_hash_ids, "uid long, hash string")
    inner = inner.join(hashes, "uid", "left").withColumn("ends", F.coalesce("hash", F.lit(EMPTY_HASH)))
    outer = found.where(F.col("kind").isin(NODE, TRIE))
    parents = inner.select(F.col("uid").alias("parent_part"), F.col("conv_id").alias("part_parent"))
    outer = outer.join(F.broadcast(parents), "parent_part", "left").withColumn("parent", F.coalesce("parent", "part_parent"))
    columns = ["kind", "uid", "conv_id", "depth", "parent", "parent_trie", "n_convs", "n_children", "n_leaves", "saved", "ends", "trie", "below"]
    nodes = outer.select(columns).union(inner.select(columns))
    if deep:
        nodes = _with_tries_below(stage.write(nodes, "nodes"), found, stage)
    return nodes.where(F.col("kind") == NODE).select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def _with_tries_below(nodes: DataFrame, found: DataFrame, stage: Stage) -> DataFrame:
    """Nodes with what lies in the tries of later segments below them, and the parents of those tries' first nodes."""
    links = found.where(F.col("kind") == LINK).groupBy("uid", "trie", "below").agg(F.max("place").alias("own"))
    links = stage.write(links, "links")
    tries = nodes.where(F.col("kind") == TRIE).select("trie", "n_children", "n_leaves", "saved")
    edges = links.where(F.col("trie") != F.lit(FIRST)).select("trie", "below").distinct()
    totals = _totals(tries, edges, stage)
    more = links.select("uid", "own", F.col("below").alias("trie")).join(totals, "trie").groupBy("uid").agg(
        F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.sum(F.col("n_children") * F.col("own")).alias("more_children"))
    ends = nodes.where((F.col("kind") == NODE) & F.col("below").isNotNull()).select(
        F.col("below").alias("parent_trie"), F.col("conv_id").alias("trie_parent"))
    linked = nodes.where("uid is not null").join(more, "uid", "left").withColumns({
        "n_children": F.col("n_children") + F.coalesce("more_children", F.lit(0)),
        "n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)),
        "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))}).select(nodes.columns)
    whole = linked.union(nodes.where("uid is null"))
    return whole.join(ends, "parent_trie", "left").withColumn("parent", F.coalesce("parent", "trie_parent"))
