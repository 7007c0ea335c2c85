"""The prefix trie, the Merkle manifest and the token count cache against SQL, the library and hand-made rows."""

import hashlib
import random
import zlib

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chainaug.llm import conversation_trie, merkle, token_cache
from chainaug.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
COUNTER = public_tokenizers.path("word_bpe_49k.json")
TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def by_sql(name, df, **tables):
    """Rows of a query's SQL over the given Arrow or Parquet tables, and those of ``df``, both sorted."""
    con = duckdb.connect()
    for table, rows in tables.items():
        if isinstance(rows, str):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{rows}')")
        else:
            con.register(table, rows)
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == sorted(df.columns)
    expected = sorted((tuple(r) for r in rel.fetchall()), key=str)
    return expected, sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_merkle_manifest"])
def test_query_equals_sql_on_the_whole_table(spark, name):
    table = "conversations" if "11" in name else "documents"
    expected, got = by_sql(name, QUERIES[name](spark, SF), **{table: f"{SF}/{table}.parquet"})
    assert got == expected and expected


def made_turns():
    """Null turns, roles, texts and ids, turns that repeat or tie, copies, long conversations, one turn shared by most,
    trunks that are absent or short, negative ids."""
    rng, rows = random.Random(5), []
    for c in [*range(60), -3, -7, 1000, 1001, 1002, 1003, 1004]:
        for t in range(rng.choice([0, 1, 2, 3, 9, 12, 20])):
            rows.append((c, rng.choice([None, t, t, t, 1]), rng.choice(["assistant", None]) if rng.random() < 0.3 else "u",
                         rng.choice(["a", "b", None, "é"]) if rng.random() < 0.5 else "same"))
        if rng.random() < 0.3 and rows:
            rows.append(rows[-1])
    for c in (2005, 2010, 2015, 2020):  # long copies of each other
        rows += [(c, t, "u", f"t{t % 3}") for t in range(40)]
    return [*rows, (None, 1, "u", "x"), (70, None, None, None), (72, 0, "", "")]


@pytest.fixture(scope="module")
def made(spark):
    rows = made_turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("depth", "path", "part", "at", "below", "shard", "digest"):
        df = df.withColumn(name, F.lit("extra"))
    table = pa.Table.from_pylist([dict(zip(TURNS.names, r)) for r in rows], TURNS)
    return df, table


@pytest.mark.parametrize("segment, shard_paths", [(256, 2000), (256, 4), (1, 5), (3, 4), (3, 10**9)])
def test_trie_is_the_same_whatever_the_shards_and_segments(made, segment, shard_paths):
    df, table = made
    expected, got = by_sql("op11_conversation_trie", conversation_trie.prefix_trie(df, segment, shard_paths), conversations=table)
    assert got == expected
    assert len(got) > 300


def test_trie_of_an_empty_table(spark, made):
    assert conversation_trie.prefix_trie(made[0].where("false")).collect() == []


def test_most_conversations_equal(spark):
    """A group of copies lies in many shards; its ids are hashed in order across them."""
    n = 3000
    ids = spark.range(n).select((F.col("id") * 5).alias("conv_id"))
    rows = ids.select("conv_id", F.lit(0).alias("turn"), F.lit("u").alias("role"), F.when(F.col("conv_id") % 3 > 0, "copy").otherwise(
        F.concat(F.lit("own "), "conv_id")).alias("text"))
    got = {(r["depth"], r["conv_id"]): r for r in conversation_trie.prefix_trie(rows, shard_paths=50).collect()}
    copies = [5 * i for i in range(n) if 5 * i % 3]
    node = got[1, copies[0]]
    assert node["n_convs"] == len(copies) and node["saved_tokens"] == 4 * (len(copies) - 1)
    assert node["ends_sha256"] == hashlib.sha256(",".join(map(str, copies)).encode()).hexdigest()
    root = got[0, 0]
    assert root["n_convs"] == n and root["n_children"] == root["n_leaves"] == n - len(copies) + 1 and root["parent_conv_id"] is None


# --- Merkle manifest --------------------------------------------------------------------------------------------------

DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def manifest_rows():
    """Groups of 1, 2, 8, 9, 64 and 600 leaves, one without a name, ids far apart, negative, repeated and absent."""
    rows = [(7, "ONLY", "solo", None, None), (-5, None, None, "s", 1), (None, "x", None, "s", 1), (None, "x", None, "s", 1), (3, "", None, None, 0)]
    rows += [(i, f"Text {i}", f"n{n}", "s", i) for n in (2, 8, 9, 64) for i in range(n)]
    rows += [((i - 300) ** 3 * 10**9, f"Wide {i}", "wide", "s", i) for i in range(600)]
    rows += [(12, f"TEXT {i % 7}", "hot", "é", 5) for i in range(200)] + [(None, f"None {i}", "hot", "s", 5) for i in range(30)]
    rows += [(i, None, f"lang {i}", "s", i) for i in range(70)]  # more groups than a run of the root's tree
    return rows


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_of_hard_rows_equals_sql(spark, levels):
    """Also with arrays of 8 and 64 slots, so that trees take several tasks and floors."""
    rows = manifest_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name in ("tree", "leaf", "pos", "n", "hash", "word", "bucket", "bits", "claimed"):
        df = df.withColumn(name, F.lit("extra"))
    table = pa.Table.from_pylist([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows], DOCUMENTS)
    expected, got = by_sql("op12_merkle_manifest", merkle.document_manifest(df, levels), documents=table)
    assert got == expected


def test_manifest_of_an_empty_table(no_docs):
    assert merkle.document_manifest(no_docs).collect() == []


def test_manifest_marks_exactly_the_changed_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    changed = {r["doc_id"] for r in docs.collect()
               if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] and any("A" <= c <= "Z" for c in r["text"])}
    got = merkle.document_manifest(docs).collect()
    assert {r["doc_id"] for r in got if not r["verified"]} == changed
    assert len({r["root"] for r in got}) == 1


# --- token counts -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def count():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(COUNTER)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False))


def test_token_counts_equal_the_library_on_the_whole_table(spark, count):
    got = {r["doc_id"]: r for r in QUERIES["op13_token_counts"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        n = count(r["text"])
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len((r["text"] or "").encode()), n, n > 2048)


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_token_counts_of_edge_rows(spark, edge_docs, count, monkeypatch, broadcast):
    monkeypatch.setattr(token_cache, "BROADCAST_MISSES", broadcast)
    got = token_cache.token_counts(edge_docs, COUNTER, token_cache.fresh_cache(spark))
    expected = [(r["doc_id"], len((r["text"] or "").encode()), count(r["text"])) for r in edge_docs.collect()]
    assert sorted(map(str, (tuple(r)[:3] for r in got.collect()))) == sorted(map(str, expected))


def test_normal_forms_keep_the_count(spark, count):
    rng = random.Random(1)
    parts = ["A", "b", " ", "  ", "\n", "\t", "'S", "é", "1", ".", "!!", "日", "\x1c", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>",
             "\r\n", "_", "́", "²", " ", "H̱", "K", "İ", " \n ", "Hello", "ΣΑΣ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_cache.token_counts(df, COUNTER, token_cache.fresh_cache(spark)).collect()}
    assert [got[i] for i in range(len(texts))] == [count(t) for t in texts]


def test_only_distinct_misses_are_encoded_and_kept(spark):
    cache = token_cache.fresh_cache(spark)
    docs = spark.createDataFrame([(1, "One two"), (2, "one  two"), (3, "three"), (3, "three"), (None, None)], "doc_id long, text string")
    first = sorted(map(str, token_cache.token_counts(docs, COUNTER, cache).collect()))
    stored = token_cache.CountCache(spark, cache, token_cache.TokenizerVersion(COUNTER))
    raw = spark.read.option("recursiveFileLookup", "true").parquet(stored.folder)
    assert raw.count() == stored.counts().count() == 3  # "one two", "three" and the empty text
    assert sorted(map(str, token_cache.token_counts(docs, COUNTER, cache).collect())) == first
    assert spark.read.option("recursiveFileLookup", "true").parquet(stored.folder).count() == 3  # all were known
    more = docs.union(spark.createDataFrame([(4, "four"), (5, "ONE TWO")], docs.schema))
    token_cache.token_counts(more, COUNTER, cache).collect()
    assert spark.read.option("recursiveFileLookup", "true").parquet(stored.folder).count() == 4


def test_stored_counts_are_used_and_versions_kept_apart(spark):
    cache = token_cache.fresh_cache(spark)
    docs = spark.createDataFrame([(1, "One two")], "doc_id long, text string")
    version = token_cache.TokenizerVersion(COUNTER)
    planted = docs.select(F.unhex(F.sha2(version.normalised(F.col("text")), 256)).alias("content"), F.lit(99).cast("long").alias("n_tokens"))
    token_cache.CountCache(spark, cache, version).append(planted)
    assert token_cache.token_counts(docs, COUNTER, cache).first()["n_tokens"] == 99
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert token_cache.token_counts(docs, other, cache).first()["n_tokens"] == 2


def test_sentencepiece_models_count_too(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["Hello there", "", "  two  spaces ", "日本 é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_cache.token_counts(df, path, token_cache.fresh_cache(spark)).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [got[i] for i in range(len(texts))] == [len(model.encode(t)) for t in texts]


def test_token_counts_of_an_empty_table(spark, no_docs):
    assert token_cache.token_counts(no_docs, COUNTER, token_cache.fresh_cache(spark)).collect() == []
