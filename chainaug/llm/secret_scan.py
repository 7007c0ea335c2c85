"""Operator 10: secret scans with multipart credential linking.

Strong patterns stand alone (``assign``, ``access``, ``hex``).  Weak candidates are parts of a credential
that mean little by themselves: an identifier (account, user or key id), a secret-looking word of
mixed characters, an endpoint (URL or host with a port).  They are reported only when complementary parts
lie in one scope (a paragraph): a secret with an identifier or an endpoint within ``REACH``
characters.  Each part is an interval; the join sweeps the parts of a scope in order and looks up
the nearest complements by position, so a text with many parts costs no pairs."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 300  # characters between the ends of two parts that can belong together
LEAST_BITS = 3.2  # bits of entropy a character for a weak secret

# The base patterns, with the least length of the part named.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

_IDENTIFIER = re.compile(
    r"""(?<![A-Za-z0-9])(?:access_?key(?:_?id)?|client_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""",
    re.I | re.A)
_URL = re.compile(
    r"""(?<![A-Za-z0-9])(?:https?|ftp|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+""", re.A)
#: a whole run of the characters of host names before a port: begun nowhere else, so a ruled line is read once
_HOST_RUN = re.compile(r"(?<![A-Za-z0-9.-])([A-Za-z0-9.-]++)(?=:([0-9]{2,5})(?![0-9]))", re.A)
_WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", re.A)
_SCOPE = re.compile(r"\n[^\S\n]*\n")


class Span(NamedTuple):
    start: int
    kind: int  # place in KINDS
    end: int


def base_spans(text: str) -> list[Span]:
    found = [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def endpoint_spans(text: str) -> list[Span]:
    """URLs, and hosts of two labels or more with a port; of a run with empty labels the labels after the last."""
    if ":" not in text:
        return []
    urls = [Span(m.start(), 5, m.end()) for m in _URL.finditer(text)]
    starts, ends = [u.start for u in urls], [u.end for u in urls]
    hosts, done = [], 0
    for m in _HOST_RUN.finditer(text):
        run, begin = m[1], max(done - m.start(), 0)  # the port before may reach into the run
        begin = max(begin, run.rfind("..") + 1)
        while begin < len(run) and (run[begin] == "." or begin and run[begin - 1] not in ".-"):
            begin += 1
        span = Span(m.start() + begin, 5, m.end() + 1 + len(m[2]))
        if "." in run[begin:] and run[-1] != "." and not _overlaps(span, ends, starts):
            hosts.append(span)
            done = span.end
    return sorted(urls + hosts)


def _looks_secret(word: str) -> bool:
    """Digits, lower and upper case together, and characters spread evenly."""
    if not (any(c.isdigit() for c in word) and any(c.islower() for c in word) and any(c.isupper() for c in word)):
        return False
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values()) >= LEAST_BITS


def _overlaps(span: Span, ends: list[int], starts: list[int]) -> bool:
    """Whether a span meets one of the non-overlapping intervals given by sorted ends and starts."""
    k = bisect.bisect_right(ends, span.start)
    return k < len(starts) and starts[k] < span.end


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts that a complement in the same scope confirms.

    Identifiers and endpoints pair with secrets: weak ones, and the base ``assign`` and ``hex`` spans;
    a weak secret pairs with identifiers (``access`` spans too) and endpoints."""
    identifiers = [Span(m.start(), 3, m.end()) for m in _IDENTIFIER.finditer(text)]
    endpoints = endpoint_spans(text)
    taken = sorted([*base, *identifiers, *endpoints])
    joined: list[list[int]] = []  # their union, for weak secrets to lie outside of
    for s in taken:
        if joined and s.start < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], s.end)
        else:
            joined.append([s.start, s.end])
    starts, ends = [a for a, _ in joined], [b for _, b in joined]
    names = [s for s in base if s.kind == 1] + identifiers + endpoints
    if not names:
        return []
    weak = [Span(m.start(), 4, m.end()) for m in _WORD.finditer(text) if _looks_secret(m[0])]
    weak = [s for s in weak if not _overlaps(s, ends, starts)]
    secrets = sorted(weak + [s for s in base if s.kind in (0, 2)])
    if not secrets:
        return []
    breaks = [m.start() for m in _SCOPE.finditer(text)]
    confirmed = set()
    for own, others in ((identifiers + endpoints, secrets), (weak, sorted(names))):
        others_start = [o.start for o in others]
        furthest, last = [], 0  # running maximum of the ends: the nearest complement before a position
        for o in others:
            last = max(last, o.end)
            furthest.append(last)
        for s in own:
            scope = bisect.bisect_left(breaks, s.start)
            low = breaks[scope - 1] if scope else 0
            high = breaks[scope] if scope < len(breaks) else len(text)
            k = bisect.bisect_left(others_start, s.end)  # the next part after it ...
            after = k < len(others) and others_start[k] - s.end <= reach and others_start[k] < high
            j = bisect.bisect_left(others_start, s.start)  # ... and those that begin before its end
            before = j and s.start - furthest[j - 1] <= reach and furthest[j - 1] > low
            if after or before or j < k:
                confirmed.add(s)
    return sorted(confirmed)


def digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``, one row per row.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind, joined by commas;
    ``base_sha256`` covers those of the base patterns.  A null or empty text has none; repeated rows are
    kept; extra columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                base = base_spans(text or "")
                kinds = Counter(s.kind for s in base)
                every = sorted({*base, *linked_spans(text or "", base)})
                out.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(digest(base).encode()).hexdigest(), digest(every)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, [pa.int64()] * 3 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *(c.split()[0] for c in FOUND.split(", "))])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def redact(text: str) -> str:
    """``text`` with each secret replaced by its kind; identifiers and endpoints stay."""
    base = base_spans(text)
    out, at = [], 0
    for s in sorted({*base, *(s for s in linked_spans(text, base) if s.kind == 4)}):
        if s.start >= at:
            out += [text[at : s.start], f"[{KINDS[s.kind]}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind in brackets; ``n_chars``, where there is
    one, follows a changed text.  All rows and columns stay; null texts stay null."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(names.index("text")).to_pylist()
            after = [t and redact(t) for t in before]
            columns = list(batch.columns)

            def put(name: str, values: list) -> None:
                columns[names.index(name)] = pa.array(values, batch.schema.field(names.index(name)).type)

            put("text", after)
            if "n_chars" in names:
                counts = batch.column(names.index("n_chars")).to_pylist()
                put("n_chars", [n if a == b else len(a) for n, a, b in zip(counts, after, before)])
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)
