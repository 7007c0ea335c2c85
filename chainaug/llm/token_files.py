"""Operator 6: token files with frequency-ranked ids in byte-aligned variable-length coding.

The most frequent id of the corpus is rank 0, and so on; ranks are written in one to four bytes.  A
file holds one run of documents in ascending order: a header, the documents' ids and
lengths, the control bytes (four two-bit byte counts each) and, apart from them, the data bytes.
A control byte looks up its four byte counts in a 256-row table, so numpy decodes a file at once.

Files are written by tasks into the shared folder under names of their own; a table of those that
committed tasks wrote (the manifest) says which count, so a repeated task does no harm."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import with_running_start
from .tables import Stage, scratch_path
from .tokens import broadcast_tokenizer, encoder

MAGIC = b"RANKVB01"
READ_TASKS = 10_000  # tasks that read files back, at most (each then reads several)
FILE_TOKENS = 2_000_000  # a file is closed beyond this many ids (a longer document stays whole)
_HEADER = struct.Struct("<8sQQQ")  # magic, documents, ids, data bytes
_BLOCK = 1 << 16  # values coded at once (a multiple of four)
_BYTES = np.arange(4, dtype=np.uint8)
#: byte counts of the four values of each control byte
COUNTS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.int32)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of uint32 values, a block at a time so that the work stays in cache."""
    control, data = [], []
    for begin in range(0, len(values), _BLOCK):
        part = values[begin : begin + _BLOCK].astype("<u4")
        code = (part > 0xFF).astype(np.uint8) + (part > 0xFFFF) + (part > 0xFFFFFF)
        padded = np.concatenate((code, np.zeros(-len(code) % 4, dtype=np.uint8))).reshape(-1, 4)
        control.append((padded[:, 0] | padded[:, 1] << 2 | padded[:, 2] << 4 | padded[:, 3] << 6).astype(np.uint8).tobytes())
        data.append(part.view(np.uint8).reshape(-1, 4)[_BYTES <= code[:, None]].tobytes())
    return b"".join(control), b"".join(data)


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n uint32 values behind ``control`` and ``data``."""
    codes, raw = np.frombuffer(control, dtype=np.uint8), np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out, at = np.empty(n, dtype=np.uint32), 0
    for begin in range(0, n, _BLOCK):
        counts = COUNTS[codes[begin // 4 : (begin + _BLOCK) // 4]].reshape(-1)[: n - begin]
        end = np.cumsum(counts, dtype=np.int32)
        size = int(end[-1])
        here, start = raw[at : at + size + 3], end - counts
        part = here[start].astype(np.uint32)
        for byte in (1, 2, 3):
            more = np.flatnonzero(counts > byte)
            if len(more):
                part[more] |= here[start[more] + byte].astype(np.uint32) << np.uint32(8 * byte)
        out[begin : begin + _BLOCK] = part
        at += size
    return out


def pack_file(doc_ids: list[int | None], lengths: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_values(ranks)
    named = np.array([i is not None for i in doc_ids], dtype=np.uint8)
    return b"".join((
        _HEADER.pack(MAGIC, len(doc_ids), len(ranks), len(data)), named.tobytes(),
        np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes(), np.array(lengths, dtype="<i8").tobytes(), control, data))


def unpack_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, ranks of all documents) of a file."""
    magic, n_docs, n_ids, n_data = _HEADER.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file of this format")
    at = _HEADER.size
    named = np.frombuffer(content, np.uint8, n_docs, at)
    ids = np.frombuffer(content, "<i8", n_docs, at + n_docs)
    lengths = np.frombuffer(content, "<i8", n_docs, at + 9 * n_docs)
    at += 17 * n_docs
    n_control = -(-n_ids // 4)
    ranks = decode_values(content[at : at + n_control], content[at + n_control : at + n_control + n_data], n_ids)
    return [int(i) if k else None for i, k in zip(ids, named)], lengths, ranks


def _tokenise(tokenizer, end_id: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = encoder(tokenizer).encode(batch["text"].to_pylist())
            ids = [np.append(i, np.uint32(end_id)).astype(width).tobytes() for i in found]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _count(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch["ids"].to_pylist()), dtype=width))
            if len(n) > len(total):
                total, n = n, total
            total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return run


MANIFEST = "file string, part int, number int, n_docs long, n_ids long"


def _write(folder: str, rank_of, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, base = FileSystem.from_uri(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        number, names, lengths, parts, held = 0, [], [], [], 0  # held: ids of the documents at hand

        def close() -> pa.RecordBatch:
            nonlocal number, names, lengths, parts, held
            ranks = rank_of.value[np.concatenate(parts)]
            file = f"{part:07d}-{number:05d}-{attempt}.tokens"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{file}") as out:
                out.write(pack_file(names, lengths, ranks))
            row = [file, part, number, len(names), len(ranks)]
            number, names, lengths, parts, held = number + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _MANIFEST)], [c.split()[0] for c in MANIFEST.split(", ")])

        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist()):
                ids = np.frombuffer(raw, dtype=width)
                if names and held + len(ids) > FILE_TOKENS:
                    yield close()
                names.append(doc_id)
                lengths.append(len(ids))
                held += len(ids)
                parts.append(ids)
        if names:
            yield close()

    return run


_MANIFEST = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2) -> tuple[DataFrame, DataFrame]:
    """Write ``docs(doc_id, text, ...)`` as token files into ``folder``, ascending by doc_id (null first; rows
    of one doc_id lie in order of a hash of their tokens, and spread over as many tasks as they need).  Returns the manifest (file, part, number, n_docs, n_ids; files in order of part and number) and
    the code book (id, rank); both are kept beside the files as Parquet."""
    spark = docs.sparkSession
    stage = Stage(spark)
    tokenizer = broadcast_tokenizer(spark, tokenizer_path)
    vocabulary = _vocabulary(tokenizer.value, end_id)
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stage.write(texts.mapInArrow(_tokenise(tokenizer, end_id, width), "doc_id long, ids binary"), "ids")

    counts = rows.select("ids").mapInArrow(_count(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(((-r["n"], r["id"]) for r in counts.collect()))  # at most a row per id of the vocabulary
    rank_of = np.zeros(vocabulary, dtype=np.uint32)
    for rank, (_, i) in enumerate(ranked):
        rank_of[i] = rank
    book = spark.createDataFrame([(i, rank) for rank, (_, i) in enumerate(ranked)], "id long, rank long")
    book.write.parquet(f"{folder}/book")

    order = ["doc_id", "hash", "spread"]  # the last tells equal rows apart, so that a repeated one spreads over tasks
    keyed = rows.select("doc_id", "ids", F.xxhash64("ids").alias("hash"), F.xxhash64(F.monotonically_increasing_id()).alias("spread"))
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    manifest = ordered.mapInArrow(_write(f"{folder}/files", spark.sparkContext.broadcast(rank_of), width), MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    stage.drop(rows)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"), spark.read.parquet(f"{folder}/book")


def _vocabulary(content: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_str(content).get_vocab_size(with_added_tokens=True), end_id + 1)


def _read(folder: str, id_of, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, base = FileSystem.from_uri(folder)
        for batch in batches:
            for file, begin in zip(batch["file"].to_pylist(), batch["begin"].to_pylist()):
                with store.open_input_stream(f"{base}/{file}") as content:
                    names, lengths, ranks = unpack_file(content.read())
                ids = id_of.value[ranks]
                end = np.cumsum(lengths)
                raw = [ids[e - n : e].tobytes() for e, n in zip(end.tolist(), lengths.tolist())]
                columns = [pa.array(names, pa.int64()), pa.array(begin + end - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                           pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids,
                                                 ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    return run


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of the token files in ``folder``: ``doc_id, start, n_tokens, ids_crc32`` and, with
    ``with_ids``, ``ids`` (little-endian uint32).  ``start`` counts the ids of all documents before it.

    Only names and places move: a task opens the files of the manifest that fall to it."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    n_files = manifest.count()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    if not n_files:
        return spark.createDataFrame([], schema)
    begins = with_running_start(manifest.select("file", "part", "number", "n_ids"), ["part", "number"], "n_ids", "begin")
    book = spark.read.parquet(f"{folder}/book").collect()  # at most a row per id of the vocabulary
    id_of = np.zeros(len(book), dtype="<u4")
    for r in book:
        id_of[r["rank"]] = r["id"]
    files = begins.select("file", "begin").repartition(min(n_files, READ_TASKS))
    return files.mapInArrow(_read(f"{folder}/files", spark.sparkContext.broadcast(id_of), with_ids), schema)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files into a fresh shared folder and read them back.

    A null or empty text is a document of ``end_id`` alone; repeated rows are documents each; an empty
    table gives no rows; extra columns are ignored."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer_path, folder, end_id)
    return read_token_files(docs.sparkSession, folder)
