"""Packing, token files, WARC, embeddings, classifiers and the pipeline."""

import math
import tempfile
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import TOKENIZER, edge_rows, groups_of, jaccard_links

import __spark_entry__ as entry
import corpus_pipeline
from chainaug.llm import embedding_dedup, learning, packing, quality, token_files, tokens, toxicity, warc
from chainaug.llm.queries import ORACLE, QUERIES
from chainaug.llm.tables import scratch_path

SF = "/root/testdata/sf0.01"


def ids_of(encode, text, end):
    return np.array([*encode(text), end], dtype="<u4")


def test_words_encoded_apart_equal_whole_texts():
    import random

    rng, encoder = random.Random(3), tokens.Encoder(open(TOKENIZER, encoding="utf-8").read())
    assert encoder.by_word
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "1", ".", "!!", "日", "\x1c", "<|endoftext|>", "\r\n", "_", "á", "²", "x'll", " ", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(20_000)]
    whole = encoder._whole(texts)
    assert [i.tobytes() for i in encoder.encode(texts)] == whole
    assert [i.tobytes() for i in encoder.encode(texts)] == whole  # from memory
    tokens._REMEMBERED, before = 50, tokens._REMEMBERED
    try:
        assert [i.tobytes() for i in encoder.encode(texts[:2000])] == whole[:2000]  # memory too small for a chunk
    finally:
        tokens._REMEMBERED = before


def test_added_tokens_in_a_text_are_matched_as_the_library_does():
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(TOKENIZER), tokens.Encoder(open(TOKENIZER, encoding="utf-8").read())
    texts = ["hello <|endoftext|> there", "<|endoftext|>", "a<|endoftext|>b c", "one two <|endoftext|><|endoftext|>", "<|endof text|> x", "hello there"]
    got = [i.tolist() for i in encoder.encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [31373, 220, 50256, 612]


def check_pieces(pieces, rows, encode, window=2048):
    """Each document's pieces tile it, each sequence's pieces tile its beginning; returns the share of padding."""
    docs = {}
    for r in pieces:
        docs.setdefault(r["doc_id"], []).append(r)
    assert set(docs) == {i for i, *_ in rows}
    for i, text, *_ in rows:
        ids = ids_of(encode, text, 1)
        copies = sum(r[0] == i for r in rows)
        at = 0
        for r in sorted(docs[i], key=lambda r: (r["start"], r["length"]))[::copies]:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = {}
    for r in pieces:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += window - at
    return padding / (window * len(sequences))


def test_packing_of_edge_rows(edge_docs, no_docs, encode):
    pieces = packing.pack(edge_docs, TOKENIZER).collect()
    check_pieces(pieces, edge_rows(), encode)
    assert packing.pack(no_docs, TOKENIZER).count() == 0


def test_packing_of_the_table_pads_little(spark, encode):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert check_pieces(QUERIES["op4_pack"](spark, SF).collect(), rows, encode) < 0.01


def test_packing_cuts_when_one_length_rules(spark, encode):
    """No combination of lengths fills a window: the greedy part cuts, and pads one window only."""
    text = " ".join(["word"] * 1500)
    rows = [(i, text) for i in range(40)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect()
    assert check_pieces(pieces, rows, encode) * len({r["sequence_id"] for r in pieces}) < 1


def test_nnls_against_its_conditions():
    rng = np.random.default_rng(0)
    columns = packing.combinations(24)
    assert all(sum(b * n for b, n in c) == 24 for c in columns) and len(set(columns)) == len(columns)
    assert ((8, 3),) in columns and ((5, 1), (7, 1), (12, 1)) in columns and ((1, 24),) in columns
    target = np.concatenate(([0], rng.integers(0, 500, 24))).astype(float)
    x = packing.nnls(columns, target)
    matrix = np.zeros((25, len(columns)))
    for k, c in enumerate(columns):
        for b, n in c:
            matrix[b, k] = n
    gain = matrix.T @ (target - matrix @ x)
    assert (x >= 0).all() and gain.max() < 1e-3 and np.abs(gain[x > 1e-9]).max() < 1e-3
    used = np.zeros(25)
    for c, count in packing.solve({b: int(n) for b, n in enumerate(target) if n}, 24):
        for b, n in c:
            used[b] += n * count
    assert (used <= target).all() and used.sum() > 0.6 * target.sum()


def test_variable_length_coding_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        values = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_files.encode_values(values)
        assert len(control) == -(-n // 4)
        assert len(data) == sum(max(1, (int(v).bit_length() + 7) // 8) for v in values)
        assert (token_files.decode_values(control, data, n) == values).all()
    ranks = np.array([5, 70_000, 3], dtype=np.uint32)
    names, lengths, back = token_files.unpack_file(token_files.pack_file([None, 7], [1, 2], ranks))
    assert names == [None, 7] and lengths.tolist() == [1, 2] and back.tolist() == ranks.tolist()
    with pytest.raises(ValueError):
        token_files.unpack_file(b"x" * 100)


def test_token_files_of_edge_rows(spark, edge_docs, no_docs, encode, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TOKENS", 50)
    folder = scratch_path(spark, "tokens")
    manifest, book = token_files.write_token_files(edge_docs, TOKENIZER, folder)
    assert manifest.agg({"n_docs": "sum"}).first()[0] == len(edge_rows())
    got = token_files.read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in edge_rows()), key=lambda i: -1 if i is None else i)
    at, total = 0, np.zeros(60_000, dtype=int)
    want = sorted((str(i), ids_of(encode, t, 2).tobytes()) for i, t, *_ in edge_rows())
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got) == want
    for r in got:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
        total += np.bincount(np.frombuffer(r["ids"], "<u4"), minlength=60_000)
    ranked = [r["id"] for r in book.orderBy("rank").collect()]
    assert ranked == sorted(np.flatnonzero(total).tolist(), key=lambda i: (-total[i], i))
    assert token_files.round_trip(no_docs, TOKENIZER).count() == 0


def test_many_empty_documents_fill_a_file_in_seconds():
    n = 200_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([b"\2\0"] * n, pa.binary())], ["doc_id", "ids"])

    class Ranks:
        value = np.zeros(10, dtype=np.uint32)

    began, folder = time.perf_counter(), tempfile.mkdtemp(dir="/tmp")
    token_files.TaskContext, before = type("Task", (), {"get": staticmethod(lambda: None), "partitionId": lambda self: 0}), token_files.TaskContext
    try:
        token_files.TaskContext.get = staticmethod(token_files.TaskContext)
        files = [r.to_pylist()[0] for r in token_files._write(f"file://{folder}", Ranks, "<u2")(iter([batch]))]
    finally:
        token_files.TaskContext = before
    assert [f["n_docs"] for f in files] == [n] and time.perf_counter() - began < 5


def test_one_doc_id_in_most_rows_spreads_over_files(spark, encode):
    """A repeated id and rows without one are split by a hash of their tokens, and equal rows by their place."""
    rows = [(7, "same words")] * 3000 + [(None, f"text {i % 50}") for i in range(2000)] + [(i, "") for i in range(8, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    folder = scratch_path(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows are one partition
    try:
        manifest, _ = token_files.write_token_files(docs, TOKENIZER, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["n_docs"] for r in manifest.collect()) < len(rows) / 3
    got = sorted(token_files.read_token_files(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    want = sorted((str(i), ids_of(encode, t, 2).tobytes()) for i, t in rows)
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_token_files_of_the_table(spark, encode):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    at, want = 0, {}
    for r in rows:
        ids = ids_of(encode, r["text"], 2)
        want[r["doc_id"]] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = QUERIES["op6_token_files"](spark, SF).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want and len(got) == len(rows)


def test_derived_records_keep_links_headers_and_digests(spark):
    html = "<head><title>x</title></head><body><nav>Menu</nav><p>One &amp; <b>two</b><br>three</p><script>no</script></body>".encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nX-A: 1\r\nX-A: 2\r\n\r\n" + html + "é".encode("latin-1")
    source = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:a>", "WARC-Target-URI": "http://e.org/", "WARC-Date": "2024-02-03T04:05:06Z",
              "WARC-Block-Digest": warc.digest(block), "WARC-Payload-Digest": "sha256:00", "Content-Type": "application/http; msgtype=response"}
    rows = [(source, block, "x"), (source, block, "x"), ({**source, "WARC-Type": "request"}, block, "x"), (None, block, "x"),
            ({"WARC-Type": "response"}, None, "x"), ({"warc-type": "Response", "WARC-Record-ID": None}, b"HTTP/1.1 404 Gone", "x")]
    df = spark.createDataFrame(rows, "headers map<string,string>, block binary, extra string")
    got = [(r["headers"], bytes(r["block"])) for r in warc.derivatives(df).collect()]
    assert len(got) == 2 * 4
    meta, text = ((h, b) for h, b in got[:2])
    for h, b in (meta, text):
        assert h["WARC-Refers-To"] == "<urn:uuid:a>" and h["WARC-Refers-To-Target-URI"] == "http://e.org/"
        assert h["WARC-Refers-To-Date"] == h["WARC-Date"] == source["WARC-Date"]
        assert h["WARC-Block-Digest"] == warc.digest(b) and int(h["Content-Length"]) == len(b)
    assert text[0]["WARC-Type"] == "conversion" and text[1].decode() == "Menu\nOne & two\nthree\né"
    fields = meta[1].decode()
    assert "http-header-x-a: 1, 2\r\n" in fields and "source-block-digest-holds: true\r\n" in fields
    assert "source-payload-digest: sha256:00\r\nsource-payload-digest-holds: false\r\n" in fields
    assert got[0] == got[2] and len({h["WARC-Record-ID"] for h, _ in got}) == 6
    assert warc.derivatives(df.limit(0)).count() == 0


def test_warc_files_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages = pages.union(spark.createDataFrame([(None, None, None), (10**6, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 5)], pages.schema))
    records = warc.responses(pages)
    records = records.union(warc.derivatives(records))
    folder = scratch_path(spark, "warc")
    if not folder.startswith("file:"):
        folder = "file://" + folder
    files = warc.write_warc(records, folder)
    key = lambda r: (sorted(r["headers"].items()), bytes(r["block"]))
    assert files.agg({"n_records": "sum"}).first()[0] == records.count() == 3 * pages.count()
    assert sorted(map(key, warc.read_warc(spark, folder + "/files").collect())) == sorted(map(key, records.collect()))


def test_every_page_gives_two_records(spark):
    rows = QUERIES["op5_warc_derivatives"](spark, SF).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in rows} == {"metadata": 250, "conversion": 250}


def cosine_links(rows, threshold):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        return [x / math.sqrt(sum(y * y for y in v)) for x in v]

    units = [(i, unit(v), label) for i, (_, v, label) in enumerate(rows)]
    return [(a, b) for n, (a, u, p) in enumerate(units) for b, v, q in units[:n]
            if u and v and p is not None and p == q and len(u) == len(v) and sum(x * y for x, y in zip(u, v)) >= threshold]


def test_embedding_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)  # labels of several blocks
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 24))
    rows = [(k, (centres[k % 6] + 0.28 * rng.standard_normal(24)).tolist(), k % 2) for k in range(150)]
    same = rows[3][1]
    rows += [(200, same, 1), (201, same, 1), (202, [2 * x for x in same], 1), (203, same, None), (204, None, 1), (205, [], 1), (206, [0.0] * 24, 1),
             (207, [float("nan")] * 24, 1), (208, [float("inf")] + [1.0] * 23, 1), (209, [None] + [1.0] * 23, 1), (210, [1.0], 1), (211, [1.0], 1), (212, [-1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS rep", "1 AS block", "2 AS copies")
    links = cosine_links(rows, 0.93)
    roots = groups_of(links, list(range(len(rows))))
    degree = np.bincount([x for p in links for x in p], minlength=len(rows))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {rows[i][0]: (degree[i], rows[r][0], i == r) for i, r in roots.items()}
    assert len(links) > 100 and embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    repeated = df.where("vec_id in (200, 204)")
    got = embedding_dedup.near_duplicates(repeated.union(repeated)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(200, 1, 200)] * 2 + [(204, 0, 204)] * 2


def test_code_estimates_are_unbiased_and_bounded():
    rng, dim = np.random.default_rng(9), 64
    x = rng.standard_normal(dim)
    x /= np.linalg.norm(x)
    y = x + 0.35 * rng.standard_normal(dim) / 8 * 2
    y /= np.linalg.norm(y)
    true, found = float(x @ y), []
    for seed in range(400):
        turn = embedding_dedup.rotation(dim, seed)
        assert np.allclose(turn @ turn.T, np.eye(dim))
        bits, factor = embedding_dedup.codes(x[None], turn)
        signs = np.unpackbits(bits, axis=1, count=dim)[0] * 2.0 - 1
        estimate = signs @ (y @ turn) / (8 * factor[0])
        assert estimate >= embedding_dedup.least_estimate(factor, true, dim, None)[0] - 1e-9
        found.append(estimate)
    assert abs(np.mean(found) - true) < 4 * np.std(found) / 20
    wide, narrow = (embedding_dedup.least_estimate(np.array([0.8]), 0.93, dim, c)[0] for c in (None, 2.0))
    assert wide < narrow < 0.93
    assert np.mean([e >= true - (0.93 - narrow) * 1.5 for e in found]) > 0.9


def test_codes_spare_most_exact_cosines():
    rng, turn = np.random.default_rng(2), embedding_dedup.rotation(64)
    unit = rng.standard_normal((1500, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    bits, factor = embedding_dedup.codes(unit, turn)
    i, j, exact = embedding_dedup.link_pairs(unit, unit, bits, factor, turn, 0.93, None)
    assert (i == j).all() and len(i) == 1500 and exact < 0.001 * 1500**2 + 1500


def test_held_out_rows(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id").withColumn("h", learning.held_out())
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in df.collect())


@pytest.mark.parametrize("name,label", [("op7_quality_classifier", "quality"), ("op8_toxicity_classifier", "toxic")])
def test_held_out_accuracy(spark, name, label):
    rows = QUERIES[name](spark, "/root/testdata/sf0.1")
    assert rows.count() == 10_000 and rows.where("score < 0 or score > 1 or score is null").isEmpty()
    known = rows.where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    for value in (0, 1):
        of = known[known[label] == value]
        assert len(of) > 20 and (of.predicted == value).mean() >= 0.9


@pytest.mark.parametrize("train,score,label", [(quality.train, quality.score_quality, "quality"), (toxicity.train, toxicity.score_toxicity, "toxic")])
def test_classifiers_on_edge_rows(spark, edge_docs, no_docs, train, score, label):
    both = spark.createDataFrame([(i, i % 2) for i in range(12)] * 2 + [(None, 1), (3, None), (99, 1), (5, 7)], f"doc_id long, {label} int")
    one, none = both.where(f"{label} = 1"), both.limit(0)
    for labels in (both, one, none):
        model = train(edge_docs, labels)
        got = score(edge_docs, model).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in edge_rows())
        assert all(0 <= r["score"] <= 1 for r in got)
    assert score(no_docs, train(no_docs, both)).count() == 0


@pytest.mark.parametrize("train,score,label", [(quality.train, quality.score_quality, "quality"), (toxicity.train, toxicity.score_toxicity, "toxic")])
def test_an_id_in_many_rows_counts_once_in_the_fit(spark, train, score, label):
    rows = [(i, f"{'good words here' if i % 2 else 'bad stuff !!'} number {i} and more {'text' * (i % 5)}") for i in range(60)]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = once.union(spark.createDataFrame([rows[7]] * 500 + [rows[8]] * 500, once.schema))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], f"doc_id long, {label} int")
    a, b = ({r["doc_id"]: r["score"] for r in score(once, train(docs, labels)).collect()} for docs in (once, often))
    assert a == b


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = [b"one line", b"two\nlines", b"", b"one line", b"\n", b"a\n\na", "é ü".encode(), b"last"]
    together, alone = quality.features(texts), np.concatenate([quality.features([t]) for t in texts])
    assert np.array_equal(together, alone) and np.array_equal(together[0], together[3])


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.selectExpr("doc_id", "if(crc32(cast(string(doc_id) as binary)) % 5 = 0, 1 - quality, quality) AS quality",
                              "if(crc32(cast(string(doc_id) as binary)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    for train, score in ((quality.train, quality.score_quality), (toxicity.train, toxicity.score_toxicity)):
        a, b = (sorted(map(tuple, score(docs, train(docs, x)).collect())) for x in (labels, other))
        assert a == b


def test_risk_is_kept_from_going_negative():
    """Positives and unlabelled alike: with a prior near 1 no document may be taken for a negative."""
    x = np.random.default_rng(0).random((6000, quality._N))
    assert (quality.fit(x[:3000], x[3000:], 0.95).score(x) > 0.5).mean() > 0.95


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert got.equals(want)


def test_thirteen_queries_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= names and set(ORACLE) <= set(entry.oracle_sql())
    assert len(corpus_pipeline.STAGES) == 5


def test_rows_without_an_id_stay_when_an_id_repeats(spark):
    rows = [(None, "the same text", "en", "a", 1)] * 3 + [(None, None, "en", "a", 0)] * 2 + [(1, "one", "en", "a", 3)] * 2 + [(2, "two", "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", *["None"] * 5]
    other = docs.union(spark.createDataFrame([(1, "one", "de", "a", 3), (1, "one", "en", "b", 3)], docs.schema))
    kept = corpus_pipeline.near_duplicates(spark, other, SF)  # rows that differ in any column are rows of their own
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "1", "2", *["None"] * 5]


def test_each_stage_does_its_whole_work(spark, encode):
    """Every stage against a brute-force form on the rows that it was given."""
    from test_documents import brute_base, brute_hits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    read = lambda df: {r["doc_id"]: r for r in df.collect()}
    frames = [docs]
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        path = scratch_path(spark, f"stage{k}")
        step(spark, frames[-1], SF).write.parquet(path)
        frames.append(spark.read.parquet(path))
    assert all(f.dtypes == docs.dtypes for f in frames[:5])
    start, good, single, clean, safe = map(read, frames[:5])
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [i for i in start if i in label]
    assert sum((i in good) == (label[i] == 1) for i in known) >= 0.98 * len(known) and good.items() <= start.items()
    sets, links = jaccard_links([(i, r["text"]) for i, r in good.items()], 5, 80)
    roots = groups_of(links, list(sets))
    assert single == {i: r for i, r in good.items() if roots[i] == i} and len(single) < len(good)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    grams = {}
    for item, text in items:
        w = brute_words(text)
        for j in range(max(1, len(w) - 9)):
            grams.setdefault(tuple(w[j : j + 10]), []).append((item, text))

    def dirty(text):
        w = brute_words(text)
        near = {x for j in range(len(w)) for x in grams.get(tuple(w[j : j + 10]), ())}
        return bool(near) and brute_hits(text, sorted(near))[1] > 0

    assert clean == {i: r for i, r in single.items() if not dirty(r["text"])} and len(clean) < len(single)
    assert safe.keys() == clean.keys()
    for i, r in safe.items():
        had = brute_base(clean[i]["text"])
        assert not brute_base(r["text"]) and (had or r == clean[i]) and r["n_chars"] == len(r["text"])
    assert any(brute_base(r["text"]) for r in clean.values())
    check_pieces(frames[5].collect(), [(i, r["text"]) for i, r in safe.items()], encode)


def brute_words(text):
    from test_documents import words_of

    return words_of(text)


def test_pipeline_on_edge_rows(spark, edge_docs, no_docs):
    columns = edge_docs.select("doc_id", "text", "lang", "source", "n_chars", "score", "node")
    for docs in (columns, no_docs):
        for name, step in corpus_pipeline.STAGES:
            path = scratch_path(spark, "edge")
            step(spark, docs, SF).write.parquet(path)
            following = spark.read.parquet(path)
            if name != "packing":
                assert following.columns == docs.columns
                docs = following
