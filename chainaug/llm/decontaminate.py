"""Operator 1: benchmark decontamination.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased.  Every
window of ``n`` benchmark words (a shorter item is one window) goes into a sorted hash index that
is broadcast; documents are scanned where they lie, a table lookup drops nearly all windows, and
the rest are verified word by word.  A benchmark whose text is over ``INDEX_BYTES`` is scanned for
in parts of that size, one pass over the documents each; both ways give the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM_WORDS, Words, chunks, utf8

INDEX_BYTES = 16 << 20  # benchmark text in one broadcast index (about 40 bytes of index a word)
_FILTER_BITS = 20


class Index(NamedTuple):
    """Distinct windows of benchmark items, by hash; window k is the phrase text[begin[k]:end[k]] of the items sets[which[k]]."""

    text: bytes  # the words of all items, one blank between
    items: list[str]
    sets: list[tuple[int, ...]]  # places in ``items`` of the items that share a window
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def build_index(rows: list[tuple[str | None, str | None]], n: int) -> Index:
    """Index of ``(item_id, text)`` rows.  Items without words have no window; the windows of an
    item whose id is null are hits all the same, but name no item."""
    texts = [(t or "").encode().lower() for _, t in rows]
    words = Words(texts, ALNUM_WORDS)
    normal, begin, end = bytearray(), [], []
    for s, e in zip(words.start.tolist(), words.end.tolist()):
        begin.append(len(normal))
        normal += words.buf[s:e].tobytes() + b" "
        end.append(len(normal) - 1)
    count = np.diff(words.first)
    ids = sorted({i for i, _ in rows if i is not None})
    place = {i: k for k, i in enumerate(ids)}
    item = np.repeat([place.get(i, -1) for i, _ in rows], count)
    begin, end = np.array(begin, dtype=np.int64), np.array(end, dtype=np.int64)
    length = np.repeat(np.minimum(count, n), count)
    sets = [(i,) for i in range(len(ids))] + [()]  # place -1: an item without an id
    known = {s: i for i, s in enumerate(sets)}
    by_length = {}
    for k in sorted(set(length.tolist())):
        at = np.flatnonzero((length == k) & words.inside(k))
        hashes = words.windows(k)[at]
        order = np.argsort(hashes, kind="stable")
        at, hashes = at[order], hashes[order]
        quick = np.zeros(1 << _FILTER_BITS, dtype=bool)
        quick[hashes >> np.uint64(64 - _FILTER_BITS)] = True
        first, last, owner = begin[at], end[at + k - 1], item[at]
        cut = np.flatnonzero(np.concatenate((np.ones(min(len(hashes), 1), dtype=bool), hashes[1:] != hashes[:-1])))
        keep, which = np.ones(len(hashes), dtype=bool), np.where(owner < 0, len(ids), owner)
        stop = np.append(cut[1:], len(hashes))
        shared = stop - cut > 1
        for a, b in zip(cut[shared].tolist(), stop[shared].tolist()):
            phrases: dict[bytes, list[int]] = {}  # of a hash: one phrase, or hardly ever more
            for w in range(a, b):
                phrases.setdefault(bytes(normal[first[w] : last[w]]), []).append(w)
            keep[a:b] = False
            for same in phrases.values():
                owners = tuple(sorted({int(owner[w]) for w in same} - {-1}))
                if owners not in known:
                    known[owners] = len(sets)
                    sets.append(owners)
                keep[same[0]], which[same[0]] = True, known[owners]
        by_length[k] = (quick, hashes[keep], first[keep], last[keep], which[keep])
    return Index(bytes(normal), ids, sets, by_length)


class Hits(NamedTuple):
    n_words: int
    items: list[str]
    runs: list[tuple[int, int]]  # runs of hit words, as word numbers
    cuts: list[tuple[int, int]]  # the same runs, as byte ranges of the text


def scan(texts: list[bytes], index: Index) -> Iterator[Hits]:
    """Verified hits of each text."""
    for lo, hi in chunks(texts):
        lowered = [t.lower() for t in texts[lo:hi]]
        words = Words(lowered, ALNUM_WORDS)
        depth = np.zeros(len(words.hash) + 1, dtype=np.int64)
        found: dict[int, set[int]] = {}
        for k, (quick, hashes, begin, end, which) in index.by_length.items():
            if len(words.hash) < k:
                continue
            window = words.windows(k)
            maybe = np.flatnonzero(quick[window >> np.uint64(64 - _FILTER_BITS)] & words.inside(k))
            left = np.searchsorted(hashes, window[maybe], side="left")
            right = np.searchsorted(hashes, window[maybe], side="right")
            for at, a, b in zip(maybe[left < right].tolist(), left[left < right].tolist(), right[left < right].tolist()):
                phrase = b" ".join(words.buf[s:e].tobytes() for s, e in zip(words.start[at : at + k], words.end[at : at + k]))
                same = next((w for w in range(a, b) if index.text[begin[w] : end[w]] == phrase), None)
                if same is not None:
                    depth[at] += 1
                    depth[at + k] -= 1
                    text = int(np.searchsorted(words.first, at, side="right")) - 1
                    found.setdefault(text, set()).add(int(which[same]))
        hit = np.cumsum(depth[:-1]) > 0
        for i in range(hi - lo):
            a, b = int(words.first[i]), int(words.first[i + 1])
            if i not in found:
                yield Hits(b - a, [], [], [])
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([False], hit[a:b], [False])).view(np.int8)))
            runs = list(zip(edge[0::2].tolist(), edge[1::2].tolist()))
            base = int(words.offset[i])
            cuts = [(int(words.start[a + s]) - base, int(words.end[a + e - 1]) - base) for s, e in runs]
            yield Hits(b - a, sorted(index.items[k] for k in set().union(*(index.sets[j] for j in found[i]))), runs, cuts)


def _parts(benchmark: DataFrame, n: int) -> list:
    """Broadcast indexes over the benchmark's distinct items: one, or as many as their text needs."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = size // INDEX_BYTES + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(build_index([tuple(r) for r in rows.where(part == k).collect()], n)) for k in range(count)]


RUNS = "array<struct<start:int,end:int>>"
HITS = f"n_words long, items array<string>, runs {RUNS}, cuts {RUNS}"
_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_HITS = [pa.int64(), pa.list_(pa.string()), _RUNS, _RUNS]


def _scanner(index, hits_only: bool, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = list(scan(utf8(batch["text"]), index.value))
            keep = [i for i, h in enumerate(hits) if h.runs or not hits_only]
            columns = [batch[k].take(pa.array(keep, pa.int64())) for k in keys]
            for j, kind in enumerate(_HITS):
                values = [hits[i][j] for i in keep]
                if j > 1:
                    values = [[{"start": s, "end": e} for s, e in v] for v in values]
                columns.append(pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(columns, [*keys, *Hits._fields])

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``(doc_id, n_words, items, runs, cuts)`` of each row of ``docs(doc_id, text, ...)``.

    ``items`` are the benchmark ids (as strings, sorted) with a window of ``n`` words in the text; ``runs``
    the runs of words inside any such window (word numbers, end exclusive) and ``cuts`` the same as bytes of the UTF-8 text.
    A null or empty text has no words; repeated rows are reported each; extra columns are ignored; an empty
    benchmark hits nothing; repeated benchmark items count once, and an item with a null id hits without being named."""
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {HITS}"
    parts = _parts(benchmark, n)
    if len(parts) == 1:
        return texts.mapInArrow(_scanner(parts[0], False, ["doc_id"]), schema)
    # the result depends on the text alone, so parts meet by the text's digest
    texts = texts.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = None
    for part in parts:
        one = texts.select("digest", "text").mapInArrow(_scanner(part, True, ["digest"]), f"digest string, {HITS}")
        found = one if found is None else found.union(one)
    merged = found.dropDuplicates().groupBy("digest").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        _merge(F.flatten(F.collect_list("runs"))).alias("runs"),
        _merge(F.flatten(F.collect_list("cuts"))).alias("cuts"),
    )
    none = _scanner(texts.sparkSession.sparkContext.broadcast(build_index([], n)), False, ["doc_id", "digest"])
    counted = texts.mapInArrow(none, f"{schema}, digest string".replace(HITS, f"digest string, {HITS}").removesuffix(", digest string"))
    empty = F.array().cast(RUNS)
    return counted.select("doc_id", "digest", "n_words").join(merged, "digest", "left").select(
        "doc_id", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("runs", empty).alias("runs"), F.coalesce("cuts", empty).alias("cuts"),
    )


def _merge(runs: Column) -> Column:
    """Union of runs: sorted, touching runs joined."""
    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))
        return F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= run["start"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)),
        ).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(F.array_sort(runs), F.array().cast(RUNS), add)


def n_hit(runs: str = "runs") -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + (r["end"] - r["start"]))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, action: str = "document") -> DataFrame:
    """``docs`` without contaminated documents (``action='document'``), or with the hit spans cut
    out of their texts (``action='span'``).  All columns are kept; in a cut text each span becomes
    one blank.  Rows with a null or empty text stay as they are."""
    if action not in ("document", "span"):
        raise ValueError(f"action must be 'document' or 'span', not {action!r}")
    parts, names = _parts(benchmark, n), docs.columns
    at = names.index("text")

    def cleaner(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = utf8(batch.column(at))
                hits = list(scan(texts, index.value))
                if action == "document":
                    yield batch.filter(pa.array([not h.runs for h in hits], pa.bool_()))
                    continue
                clean = batch.column(at).to_pylist()
                for i, h in enumerate(hits):
                    if h.cuts:
                        edges = [0, *(x for cut in h.cuts for x in cut), len(texts[i])]
                        clean[i] = b" ".join(texts[i][a:b] for a, b in zip(edges[0::2], edges[1::2])).decode()
                columns = list(batch.columns)
                columns[at] = pa.array(clean, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return run

    for part in parts:  # documents left by one part of the benchmark are scanned for the next
        docs = docs.mapInArrow(cleaner(part), docs.schema)
    return docs
