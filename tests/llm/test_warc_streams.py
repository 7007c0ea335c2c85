"""WARC codings, damaged files and streaming against the standard library and plain loops."""

import gzip
import hashlib
import http.client
import io
import random
import zlib
from html.parser import HTMLParser

import pytest

from chainaug.llm import warc
from chainaug.llm.queries import QUERIES
from chainaug.llm.tables import scratch_path

SF = "/root/testdata/sf0.001"


def chunked(data, sizes, extension=b""):
    out, at = b"", 0
    for n in sizes:
        if data[at : at + n]:
            out += b"%x%s\r\n%s\r\n" % (len(data[at : at + n]), extension, data[at : at + n])
        at += n
    rest = data[at:]
    return out + (b"%X\r\n%s\r\n" % (len(rest), rest) if rest else b"") + b"0\r\n\r\n"


def by_http_client(head, payload):
    """The body as the standard library reads it from a connection, with its gzip members undone."""

    class Socket:
        def makefile(self, mode):
            return io.BytesIO(b"HTTP/1.1 200 OK\r\n" + head + b"\r\n" + payload)

    response = http.client.HTTPResponse(Socket())
    response.begin()
    body = response.read()
    return gzip.decompress(body) if response.getheader("Content-Encoding") == "gzip" else body


TEXT = "<p>Hello chunked wörld</p>".encode() * 50


@pytest.mark.parametrize("head, payload", [
    (b"Transfer-Encoding: chunked\r\n", chunked(TEXT, [26, 1, 700])),
    (b"Transfer-Encoding: chunked\r\n", chunked(TEXT, [5], b";name=value")),
    (b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n", chunked(gzip.compress(TEXT), [10, 3])),
    (b"Content-Encoding: gzip\r\n", gzip.compress(TEXT[:100]) + gzip.compress(TEXT[100:]) + gzip.compress(b"")),
    (b"Content-Encoding: gzip\r\n", b"".join(gzip.compress(TEXT[i : i + 7]) for i in range(0, len(TEXT), 7))),
    (b"X-None: 1\r\n", TEXT)])
def test_bodies_equal_the_standard_library(head, payload):
    _, fields, _ = warc.http_parts(b"HTTP/1.1 200 OK\r\n" + head + b"\r\n" + payload)
    assert warc.decoded(fields, payload) == (by_http_client(head, payload), []) == (TEXT, [])


def test_other_codings():
    raw = zlib.compressobj(wbits=-15)
    assert warc.decoded({"Content-Encoding": "deflate"}, raw.compress(TEXT) + raw.flush()) == (TEXT, [])
    assert warc.decoded({"content-encoding": "Deflate"}, zlib.compress(TEXT)) == (TEXT, [])
    assert warc.decoded({"Content-Encoding": "gzip, gzip"}, gzip.compress(gzip.compress(TEXT))) == (TEXT, [])
    assert warc.decoded({"Content-Encoding": "br"}, b"\x8b\x02\x80abc\x03") == (b"", ["br"])
    assert warc.decoded({"Content-Encoding": "zstd, gzip"}, gzip.compress(b"(\xb5/\xfd")) == (b"", ["zstd"])
    # the header of a coding that the archive has undone
    for fields in ({"Content-Encoding": "gzip"}, {"Content-Encoding": "deflate"}, {"Transfer-Encoding": "chunked"}, {"Content-Encoding": "identity"}, {}):
        assert warc.decoded(fields, TEXT) == (TEXT, [])
    cut = gzip.compress(random.Random(1).randbytes(5000) + TEXT)
    assert warc.decoded({"Content-Encoding": "gzip"}, cut[: len(cut) // 2])[0]  # what there is of a cut-off body
    assert warc.decoded({"Transfer-Encoding": "chunked"}, b"5\r\nhello\r\nff\r\nonly so")[0] == b"helloonly so"


def test_a_payload_that_can_not_be_decoded_is_named():
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: br\r\n\r\n\x8b\x02\x80abc"
    (_, meta), (_, text) = warc.derive({"WARC-Type": "response", "WARC-Record-ID": "<a>"}, block)
    assert b"payload-not-decoded: br\r\n" in meta and text == b""


def record(n, body, length=None):
    head = {"WARC-Type": "resource", "WARC-Record-ID": f"<{n}>"}
    return warc.serialise(head | ({} if length == "" else {"Content-Length": str(len(body) if length is None else length)}), body)


def read(data, piece=1 << 20):
    return list(warc.parse_records(warc.inflated(data[i : i + piece] for i in range(0, len(data), piece))))


def named(records):
    return [(h.get("WARC-Record-ID"), b) for h, b in records if h["WARC-Type"] != "unreadable"]


@pytest.mark.parametrize("piece", [1, 3, 50, 1 << 20])
@pytest.mark.parametrize("bad", [
    record(9, b"no length", ""), record(9, b"word", "ten"), record(9, b"too long", 10_000_000), record(9, b"x" * 60, 20),
    b"junk between records\r\n\r\n", b"WARC/1.1\r\nno end of a header", record(9, b"", 10**15)])
def test_reading_goes_on_after_a_bad_record(bad, piece):
    bodies = [b"first", b"", b"third WARC/1.1\r\n\r\n inside", b"x" * 500]
    good = [record(i, b) for i, b in enumerate(bodies)]
    data = good[0] + bad + b"".join(good[1:])
    got = read(data, piece)
    assert [g for g in named(got) if g[0] != "<9>"] == [(f"<{i}>", b) for i, b in enumerate(bodies)]
    if bad.endswith(b"header"):  # such a header goes on into the next record's
        return
    assert any(h["WARC-Type"] == "unreadable" for h, _ in got)
    # nothing is lost: the bytes of bad stretches come out
    assert sum(len(b) for h, b in got if h["WARC-Type"] == "unreadable") >= len(bad.strip()) - 60


@pytest.mark.parametrize("piece", [1, 100, 1 << 20])
def test_gzip_members_and_damaged_ones(piece):
    rng = random.Random(3)
    bodies = [rng.randbytes(3000) if i % 2 else b"text " * 1000 for i in range(6)]
    bodies.append(gzip.compress(record(77, b"a file in a file")))  # a member's mark inside another's data
    members = [gzip.compress(record(i, b), mtime=0) for i, b in enumerate(bodies)]
    assert named(read(b"".join(members), piece)) == [(f"<{i}>", b) for i, b in enumerate(bodies)]
    hurt = bytearray(members[1])
    hurt[len(hurt) // 2 : len(hurt) // 2 + 40] = b"\0" * 40
    got = named(read(members[0] + bytes(hurt) + b"".join(members[2:]), piece))
    assert [n for n, _ in got if n != "<1>"] == [f"<{i}>" for i in range(7) if i != 1]
    assert [n for n, _ in named(read(b"".join(members)[:-5], piece))][:6] == [f"<{i}>" for i in range(6)]
    assert read(b"") == [] == read(gzip.compress(b"\r\n\r\n"))


def test_a_file_is_streamed(monkeypatch):
    """Of a long stream no more than a record and some pieces are held."""
    most = 0

    def pieces():
        for i in range(2000):
            yield record(i, b"y" * 20_000)

    real = warc._Stream.more

    def more(self):
        nonlocal most
        most = max(most, len(self.data))
        return real(self)

    monkeypatch.setattr(warc._Stream, "more", more)
    assert sum(1 for _ in warc.parse_records(pieces())) == 2000 and most < 200_000


def test_files_of_foreign_writers_are_read(spark, tmp_path):
    bodies = {f"<{i}>": f"body {i}".encode() for i in range(30)}
    parts = [record(i, f"body {i}".encode()) for i in range(30)]
    (tmp_path / "a.warc").write_bytes(b"".join(parts[:10]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts[10:20])))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(parts[20:])))  # one member for all
    (tmp_path / "d.warc.gz").write_bytes(b"")
    got = {r["headers"]["WARC-Record-ID"]: bytes(r["block"]) for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert got == bodies


class VisibleText(HTMLParser):
    """All visible text by the standard library's events: a line per block."""

    def __init__(self):
        super().__init__()
        self.lines, self.line, self.hidden = [], "", 0

    def end(self):
        if self.line.split():
            self.lines.append(" ".join(self.line.split()))
        self.line = ""

    def handle_starttag(self, tag, attrs):
        if tag in warc._HIDDEN:
            self.hidden += 1
        if tag not in warc.INLINE or tag == "br":
            self.end()

    def handle_endtag(self, tag):
        if tag in warc._HIDDEN and self.hidden:
            self.hidden -= 1
        if tag not in warc.INLINE:
            self.end()

    def handle_data(self, data):
        if not self.hidden:
            self.line += data


def test_the_query_equals_a_plain_derivation(spark):
    """Every record that comes back from the files, against records made a page at a time by other means."""
    got = {(r["record_type"], r["refers_to"]): r for r in QUERIES["op5_warc_derivatives"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == 2 * len(pages)
    for page in pages:
        html = page["html"] or ""
        source = warc.record_id("response", str(page["page_id"]), page["url"] or "")
        parser = VisibleText()
        parser.feed(html)
        parser.close()
        parser.end()
        text = "\n".join(parser.lines).encode()
        r = got["conversion", source]
        assert (r["block_sha256"], r["content_length"], r["refers_to_target_uri"]) == (hashlib.sha256(text).hexdigest(), len(text), page["url"])
        payload = html.encode()
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        meta = (f"http-status: HTTP/1.1 200 OK\r\nhttp-header-content-type: text/html; charset=utf-8\r\nhttp-header-content-length: {len(payload)}\r\n"
                f"source-payload-digest: {warc.digest(payload)}\r\nsource-payload-digest-holds: true\r\n"
                f"source-block-digest: {warc.digest(block)}\r\nsource-block-digest-holds: true\r\n"
                f"source-content-type: application/http; msgtype=response\r\nsource-content-length: {len(block)}\r\n").encode()
        r = got["metadata", source]
        assert (r["block_sha256"], r["content_type"]) == (hashlib.sha256(meta).hexdigest(), "application/warc-fields")


def test_no_records_are_written_and_read(spark, no_docs):
    none = spark.createDataFrame([], warc.RECORD)
    assert warc.written_and_read(none).collect() == [] and scratch_path(spark, "x").endswith("/x")


def test_a_record_costs_one_digest_per_block_and_a_quick_gzip(spark, monkeypatch):
    calls = []
    plain = warc.digest
    monkeypatch.setattr(warc, "digest", lambda data, like=None: calls.append(len(data)) or plain(data, like))
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>one <b>two</b><br>three<ul><li>x<li>y</ul><script>z</script>"
    out = warc.derive({"warc-type": "response", "WARC-Record-ID": "<a>"}, page)
    assert [b for _, b in out][1] == b"one two\nthree\nx\ny" and len(calls) == 4
    assert all(h["WARC-Block-Digest"] == h["WARC-Payload-Digest"] == plain(b) for h, b in out)
    rows = [({"n": str(i)}, b"abc" * i) for i in range(30)] + [(None, None), ({}, b"")]
    folder = scratch_path(spark, "warc")
    written = warc.write_warc(spark.createDataFrame(rows, warc.RECORD).coalesce(1), folder)
    files = [f"{folder}/files/{r['file']}".removeprefix("file:") for r in written.collect()]
    members = [f.read() for f in (open(name, "rb") for name in files)]
    assert all(m[8] == 4 for m in members)  # the mark of gzip's quickest method (2: its slowest)
    assert b"".join(map(gzip.decompress, members)) == b"".join(warc.serialise(h or {}, b or b"") for h, b in rows)
