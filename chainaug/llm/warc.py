"""Operator 5: WARC derivative builder (ISO 28500).

A record is a row ``(headers map<string,string>, block binary)``.  Each ``response`` record gives a
``metadata`` record (application/warc-fields: the HTTP status and headers of the source, its digests and whether they
hold) and a ``conversion`` record (the page's plain text).  Both name the source by WARC-Refers-To,
WARC-Refers-To-Target-URI and WARC-Refers-To-Date, and carry digests of their own blocks.  Record ids are derived
from the source's id and the kind, so a repeated task makes the same records."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_extract import INLINE, parse
from .tables import scratch_path

RECORD = "headers map<string,string>, block binary"
FILE_BYTES = 64 << 20  # record bytes after which a file is closed
GZIP_LEVEL = 1  # of a record: a longer search costs twice the time and saves 5 % of the bytes
READ_TASKS = 10_000  # tasks that read files, at most
_PIECE = 1 << 20  # bytes fetched or unpacked at once
_FED = 1 << 16  # bytes of a file given to gzip at once: a member's end copies what is left of them
_MOST_HEADER, _MOST_BLOCK = 1 << 20, 1 << 30  # a longer header or block makes a record unreadable
_GZIP = b"\x1f\x8b\x08"
_HEX = re.compile(rb"[0-9A-Fa-f]{1,15}")
_END = object()

_TYPE = pa.map_(pa.string(), pa.string())
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_HIDDEN = frozenset("head script style noscript template iframe object svg textarea title xmp".split())


def digest(data: bytes, like: str | None = None) -> str:
    """Labelled digest: sha1 in base 32, or the algorithm that ``like`` names where hashlib knows it."""
    name = (like or "sha1").split(":")[0].lower().replace("-", "")
    if name == "sha1" or name not in hashlib.algorithms_guaranteed or name.startswith("shake"):
        return f"sha1:{base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()}"
    return f"{name}:{hashlib.new(name, data).hexdigest()}"


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def serialise(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def inflated(blocks: Iterable[bytes]) -> Iterator[bytes | None]:
    """The data of a file that comes in blocks, in pieces of bounded size: gzip members one after another, or the blocks as they
    are where the first is not gzip.  None marks a damaged or cut-off member; reading goes on at the next one."""
    blocks = iter(blocks)
    held = next(blocks, b"")
    while len(held) < 2 and (block := next(blocks, None)) is not None:
        held += block
    if held[:2] != _GZIP[:2]:
        yield held
        yield from blocks
        return
    member, full = None, False
    while True:
        if member is None:
            at = held.find(_GZIP)
            if at < 0:
                block = next(blocks, None)
                if block is None:
                    return
                held = held[-2:] + block
                continue
            held, member, full = held[at:], zlib.decompressobj(31), False
        if not held and not full:
            held = next(blocks, None)
            if held is None:
                yield None
                return
        try:
            out = member.decompress(held, _PIECE)
        except zlib.error:
            yield None
            held, member = held[1:], None
            continue
        full = len(out) == _PIECE  # there may be more without further input
        if out:
            yield out
        if member.eof:
            held, member = member.unused_data, None
        else:
            held = member.unconsumed_tail


class _Stream:
    """Bytes of a stream that has been read so far; a gap (None) or the end stops the reading."""

    def __init__(self, pieces: Iterable[bytes | None]):
        self.pieces, self.data, self.open, self.gap = iter(pieces), bytearray(), True, False

    def more(self) -> bool:
        if self.gap or not self.open:
            return False
        piece = next(self.pieces, _END)
        if piece is _END:
            self.open = False
        elif piece is None:
            self.gap = True
        else:
            self.data += piece
            return True
        return False

    def skip(self, n: int) -> Iterator[tuple[dict[str, str], bytes]]:
        """Drop n bytes that belong to no record; but for white space they come out as records."""
        for begin in range(0, n, _PIECE):
            lost = bytes(self.data[begin : min(begin + _PIECE, n)])
            if lost.strip():
                yield {"WARC-Type": "unreadable", "Content-Length": str(len(lost))}, lost
        del self.data[:n]

    def record(self) -> tuple[dict[str, str], bytes] | None:
        """The record that begins here, None if there is none that can be read."""
        while (end := self.data.find(b"\r\n\r\n")) < 0 and len(self.data) < _MOST_HEADER and self.more():
            pass
        if end < 0:
            return None
        headers = _fields(self.data[:end].decode("utf-8", "replace").split("\r\n")[1:])
        length = next((v for k, v in headers.items() if k.lower() == "content-length"), "")
        if not (length.isascii() and length.isdigit()) or int(length) > _MOST_BLOCK:
            return None
        stop = end + 4 + int(length)
        while len(self.data) < stop + 9 and self.more():
            pass
        after = bytes(self.data[stop : stop + 9])
        closed = after.startswith(b"\r\n\r\n") or b"WARC/".startswith(after.lstrip()[:5])
        if len(self.data) < stop or not closed:
            return None
        block = bytes(self.data[end + 4 : stop])
        del self.data[:stop]
        return headers, block


def parse_records(pieces: Iterable[bytes | None]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an uncompressed stream in pieces (None: a gap).  What is no record (a bad or missing length, one that is cut off,
    other bytes in between) comes out as records of type ``unreadable``, and reading goes on at the next ``WARC/``.
    No more than a record and a piece are held."""
    stream = _Stream(pieces)
    while True:
        at = stream.data.find(b"WARC/")
        if at < 0:
            yield from stream.skip(max(len(stream.data) - 4, 0))
            if not stream.more():
                yield from stream.skip(len(stream.data))
                if not stream.open:
                    return
                stream.gap = False
            continue
        yield from stream.skip(at)
        record = stream.record()
        if record is not None:
            yield record
        else:
            following = stream.data.find(b"WARC/", 5)
            yield from stream.skip(following if following >= 0 else min(len(stream.data), max(5, len(stream.data) - 4)))


def _fields(lines: list[str]) -> dict[str, str]:
    """Named fields; a line that begins with white space goes on the one before, a repeated name keeps all its values."""
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip(), value.strip()
            out[name] = f"{out[name]}, {value}" if name in out else value
            last = name
    return out


def http_parts(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """(status line, header fields, payload) of an HTTP response; one without a header is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", {}, block
    m = re.search(rb"\r?\n\r?\n", block)
    head, payload = (block[: m.start()], block[m.end() :]) if m else (block, b"")
    lines = head.decode("latin-1").splitlines()
    return lines[0], _fields(lines[1:]), payload


def dechunked(payload: bytes) -> bytes | None:
    """The body of a chunked payload, as far as its chunks can be read; None where it doesn't begin with a chunk."""
    out, at = [], 0
    while True:
        line = payload.find(b"\n", at, at + 1024)
        size = payload[at:line].split(b";")[0].strip() if line >= 0 else b""
        if not _HEX.fullmatch(size):
            return b"".join(out) if out else None
        n = int(size, 16)
        out.append(payload[line + 1 : line + 1 + n])
        at = line + 1 + n
        if not n or at >= len(payload):
            return b"".join(out)
        at += 2 if payload[at : at + 2] == b"\r\n" else 1 if payload[at : at + 1] == b"\n" else 0


def decoded(http: dict[str, str], payload: bytes) -> tuple[bytes, list[str]]:
    """The body behind a payload's transfer and content codings, and the codings that could not be undone (the body is then empty).
    Archives often keep the header of a coding that they have undone: a payload that does not look coded is taken as it is."""
    if "chunked" in (_get(http, "Transfer-Encoding") or "").lower():
        body = dechunked(payload)
        payload = payload if body is None else body
    codings = [c.strip().lower() for c in (_get(http, "Content-Encoding") or "").split(",")]
    for k, coding in reversed(list(enumerate(codings))):
        if coding in ("gzip", "x-gzip"):
            if payload.startswith(_GZIP):
                payload = b"".join(p for p in inflated([payload]) if p)
        elif coding == "deflate":
            for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
                try:
                    payload = zlib.decompressobj(bits).decompress(payload)
                    break
                except zlib.error:
                    pass
        elif coding not in ("", "identity", "none"):
            return b"", [c for c in codings[: k + 1] if c]
    return payload, []


def plain_text(html: str) -> str:
    """All visible text of a page: a line per block, white space inside it as one blank."""
    tree = parse(html)
    tags, pieces = tree.tag, tree.pieces
    lines, line = [], []

    def end() -> None:
        words = "".join(line).split()
        if words:
            lines.append(" ".join(words))
        line.clear()

    todo = [(iter(pieces[0]), True)]
    while todo:
        rest, block = todo[-1]
        for piece in rest:
            if piece.__class__ is str:
                line.append(piece)
                continue
            tag = tags[piece]
            if tag == "br":
                end()
            elif tag not in _HIDDEN:
                inner = tag not in INLINE
                if inner and line:
                    end()
                todo.append((iter(pieces[piece]), inner))
                break
        else:
            todo.pop()
            if block and line:
                end()
    return "\n".join(lines)


def _get(headers: dict[str, str], name: str) -> str | None:
    return next((v for k, v in headers.items() if k.lower() == name.lower()), None)


def _by_name(headers: dict[str, str]) -> dict[str, str]:
    """Values by lower-case name, the first one of each."""
    out: dict[str, str] = {}
    for name, value in headers.items():
        out.setdefault(name.lower(), value)
    return out


def derive(headers: dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and conversion records of a response record (none of any other)."""
    named = _by_name(headers)
    if (named.get("warc-type") or "").lower() != "response":
        return []
    status, http, payload = http_parts(block)
    source = named.get("warc-record-id") or record_id("unnamed", digest(block))
    link = {"WARC-Refers-To": source}
    for name, of in (("WARC-Refers-To-Target-URI", "WARC-Target-URI"), ("WARC-Refers-To-Date", "WARC-Date"), ("WARC-Target-URI",) * 2, ("WARC-Date",) * 2):
        if named.get(of.lower()):
            link[name] = named[of.lower()]
    fields = [("http-status", status)] if status else []
    fields += [(f"http-header-{k.lower()}", v) for k, v in http.items()]
    for name, data in (("Payload", payload), ("Block", block)):
        stated = named.get(f"warc-{name.lower()}-digest")
        own = digest(data, stated)
        fields += [(f"source-{name.lower()}-digest", stated or own)]
        if stated:
            fields.append((f"source-{name.lower()}-digest-holds", str(stated.lower() == own.lower()).lower()))
    fields += [(f"source-{k.lower()}", v) for k, v in headers.items()
               if k.lower() in ("content-type", "content-length", "warc-ip-address", "warc-warcinfo-id", "warc-truncated")]
    raw, left = decoded(http, payload)
    if left:
        fields.append(("payload-not-decoded", ", ".join(left)))
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    kind = _get(http, "Content-Type") or ""
    charset = _CHARSET.search(kind)
    try:
        page = raw.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = raw.decode("utf-8", "replace")
    text = (page if kind.lower().startswith("text/plain") else plain_text(page)).encode("utf-8", "replace")
    out = []
    for name, content_type, body in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
        labelled = digest(body)
        own = {"WARC-Type": name, "WARC-Record-ID": record_id(name, source), **link, "Content-Type": content_type,
               "WARC-Block-Digest": labelled, "WARC-Payload-Digest": labelled, "Content-Length": str(len(body))}
        out.append((own, body))
    return out


def _batch(rows: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
    ends = pa.array([0, *accumulate(len(h) for h, _ in rows)], pa.int32())
    names = pa.array([k for h, _ in rows for k in h], pa.string())
    values = pa.array([v for h, _ in rows for v in h.values()], pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.MapArray.from_arrays(ends, names, values, _TYPE), pa.array([b for _, b in rows], pa.binary())], ["headers", "block"])


def _records(batch: pa.RecordBatch) -> Iterator[tuple[dict[str, str | None], bytes]]:
    """The rows of a batch; null headers are none, a null block is empty."""
    maps = batch["headers"]
    names, values = maps.keys.to_pylist(), maps.items.to_pylist()
    ends, null = maps.offsets.to_pylist(), maps.is_null().to_pylist()
    for k, block in enumerate(batch["block"].to_pylist()):
        some = slice(0, 0) if null[k] else slice(ends[k], ends[k + 1])
        yield dict(zip(names[some], values[some])), block or b""


def derivatives(records: DataFrame) -> DataFrame:
    """``records(headers, block, ...)`` -> the derived records, as rows of the same two columns.

    Only responses give any; a null block is empty, null headers make no response.  Repeated rows
    give repeated records (with the same ids); extra columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([
                record for headers, block in _records(batch) for record in derive({k: v or "" for k, v in headers.items()}, block)])

    return records.select("headers", "block").mapInArrow(run, RECORD)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``pages(page_id, url, html, ...)`` as response records; the record id is made of page_id and url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html"))):
                payload = (html or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                block = head.encode() + payload
                rows.append(({
                    "WARC-Type": "response", "WARC-Record-ID": record_id("response", str(page_id), url or ""), "WARC-Target-URI": url or "",
                    "WARC-Date": date, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(payload),
                    "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}, block))
            yield _batch(rows)

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, RECORD)


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write records as .warc.gz files (a gzip member per record) into ``folder``/files; returns the table of
    files that committed tasks wrote, also kept at ``folder``/manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, base = FileSystem.from_uri(f"{folder}/files")
        store.create_dir(base, recursive=True)
        part, attempt, number, size, count, out, file = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, 0, 0, None, ""

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([count], pa.int64())], ["file", "n_records"])

        for batch in batches:
            for headers, block in _records(batch):
                if out is None:
                    file = f"{part:07d}-{number:05d}-{attempt}.warc.gz"
                    out, size, count, number = store.open_output_stream(f"{base}/{file}", compression=None), 0, 0, number + 1
                member = zlib.compress(serialise(headers, block), GZIP_LEVEL, wbits=31)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    records.select("headers", "block").mapInArrow(run, "file string, n_records long").write.parquet(f"{folder}/manifest")
    return records.sparkSession.read.parquet(f"{folder}/manifest")


def _blocks(stream) -> Iterator[bytes]:
    while block := stream.read(_FED):
        yield block


def _rows(records: Iterator[tuple[dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
    """Records in batches of some hundred rows and some megabytes."""
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record[1])
        if len(held) == 500 or size > 8 << 20:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the .warc and .warc.gz files under ``path`` (a folder, file or pattern), damaged stretches as records of
    type ``unreadable``.

    A task streams its files, member by member; it holds one record and a block, not the file.  Only names come
    from the listing.  (A gzip member's mark may also stand inside another's data, so a file is not split by guess.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for file in batch["path"].to_pylist():
                store, inner = FileSystem.from_uri(re.sub("^file:/+", "file:///", file))
                with store.open_input_stream(inner, compression=None, buffer_size=_PIECE) as stream:
                    yield from _rows(parse_records(inflated(_blocks(stream))))

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(max(1, min(files.count(), READ_TASKS))).mapInArrow(run, RECORD)


def written_and_read(records: DataFrame) -> DataFrame:
    """``records`` after a way through .warc.gz files in a fresh shared folder."""
    folder = scratch_path(records.sparkSession, "warc")
    if not write_warc(records, folder).agg(F.sum("n_records")).first()[0]:
        return records.sparkSession.createDataFrame([], RECORD)
    return read_warc(records.sparkSession, f"{folder}/files")
