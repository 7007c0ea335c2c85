"""The registered queries: each reads its whole table and returns the digest of one operator's result."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, decontaminate, embedding_dedup, html_extract, learning, merkle, ngram_join, packing, quality, secret_scan, token_cache, token_files, toxicity, warc
from .tables import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: CRC-32 of the text x in SQL: the polynomial's eight steps after each byte
CRC32 = """(4294967295 - list_reduce(list_concat([4294967295], flatten(list_transform(string_split(x, ''),
  lambda c: list_concat([ascii(c)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""


def query(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


@query("op2_ngram_jaccard_join", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common_counts AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common_counts JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * common >= 90 * (p.n + q.n - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, w.b FROM reach r JOIN ways w ON r.seen = w.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(seen) AS component_id
FROM documents d JOIN reach r ON r.node = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
GROUP BY d.doc_id, n""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words_per_shingle=3, threshold=0.9)


@query("op1_decontaminate", r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, w, least(len(w), 10) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
doc_windows AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM docs CROSS JOIN (SELECT DISTINCT k FROM items) WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, d.k, item_id FROM doc_windows d JOIN item_windows b ON d.s = b.s AND d.k = b.k),
words AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words h ON h.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    covered = decontaminate.n_hit()
    return hits.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (covered > 0).alias("contaminated"))


@query("op4_pack")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query("op9_embedding_dedup", """
WITH RECURSIVE units AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM units x JOIN units y
    ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION SELECT r.node, w.b FROM reach r JOIN ways w ON r.seen = w.a),
degree AS (SELECT a, count(*) AS n FROM ways GROUP BY a)
SELECT r.node AS vec_id, coalesce(max(n), 0)::BIGINT AS n_links, min(seen) AS component_id, r.node = min(seen) AS kept
FROM reach r LEFT JOIN degree g ON g.a = r.node GROUP BY r.node""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op3_html_main_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def _predicted(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", F.coalesce(learning.held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _predicted(quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels"))), 0.3)


@query("op8_toxicity_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _predicted(toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))), 0.5)


@query("op5_warc_derivatives")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.written_and_read(warc.derivatives(warc.responses(table(spark, sf_dir, "pages"))))
    get = F.col("headers").getItem
    return records.select(
        get("WARC-Record-ID").alias("record_id"), get("WARC-Type").alias("record_type"), get("WARC-Refers-To").alias("refers_to"),
        get("WARC-Refers-To-Target-URI").alias("refers_to_target_uri"), get("WARC-Refers-To-Date").alias("refers_to_date"),
        get("Content-Type").alias("content_type"), get("WARC-Block-Digest").alias("block_digest"),
        get("Content-Length").cast("long").alias("content_length"), F.sha2("block", 256).alias("block_sha256"))


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), token_cache.fresh_cache(spark), limit=2048)


@query("op11_conversation_trie", r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
marks AS (SELECT conv_id, conv_id - conv_id % 5 AS trunk, _CRC_ % 9 AS head FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS x FROM turns)),
lists AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY origin, place) AS path
  FROM (SELECT m.conv_id, 0 AS origin, place, role, text FROM marks m JOIN turns t ON t.conv_id = m.trunk AND place <= head
        UNION ALL SELECT m.conv_id, 1, place, role, text FROM marks m JOIN turns t ON t.conv_id = m.conv_id AND place > head)
  GROUP BY conv_id),
paths AS (SELECT m.conv_id, coalesce(path, []) AS path FROM marks m LEFT JOIN lists l ON l.conv_id = m.conv_id),
members AS (SELECT conv_id, path[1:d] AS node, d, len(path) AS total FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM paths)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE total = d), '')) AS ends
  FROM members GROUP BY node, d),
families AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (
  SELECT x.*, coalesce(n_children, 0) AS n_children, CASE WHEN x.d > 0 THEN (x.n - 1) * strlen(x.node[x.d].text) ELSE 0 END AS saved
  FROM nodes x LEFT JOIN families f ON f.node = x.node),
sums AS (
  SELECT over_node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT node[1:e] AS over_node, n_children, saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM full_nodes)) GROUP BY over_node)
SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n::BIGINT AS n_convs, x.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM full_nodes x JOIN sums s ON s.over_node = x.node LEFT JOIN nodes p ON x.d > 0 AND p.node = x.node[1:x.d - 1]""".replace("_CRC_", CRC32))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_merkle_manifest", r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree,
    coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS inner_fields,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') AS id_field, text,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents),
marks AS (SELECT doc_id, x IS NOT NULL AND _CRC_ % 3 = 0 AS tampered FROM (SELECT DISTINCT doc_id, doc_id::VARCHAR AS x FROM documents)),
leaves AS (
  SELECT d.doc_id, tree, sha256(id_field || inner_fields || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(id_field || inner_fields || CASE WHEN tampered THEN coalesce(strlen(low) || ':' || low, '-')
      ELSE coalesce(strlen(text) || ':' || text, '-') END) AS claimed
  FROM docs d JOIN marks m ON d.doc_id IS NOT DISTINCT FROM m.doc_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 8, n),
subroots AS (SELECT tree, level AS height, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS m FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place AS i, m AS n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 8, n),
root AS (SELECT h AS root, level AS height FROM tops WHERE n = 1),
walk AS (
  SELECT row_number() OVER () AS r, p.doc_id, p.leaf, p.tree, s.h AS subroot, s.height, s.place, root, root.height + s.height AS total,
    0 AS level, p.i, claimed AS h, '' AS proof
  FROM placed p JOIN subroots s ON p.tree = s.tree CROSS JOIN root
  UNION ALL
  SELECT w.r, w.doc_id, w.leaf, w.tree, w.subroot, w.height, w.place, w.root, w.total, w.level + 1,
    CASE WHEN w.level + 1 = w.height THEN w.place ELSE w.j // 8 END,
    sha256(string_agg(CASE WHEN x.i = w.j THEN w.h ELSE x.h END, '' ORDER BY x.i)),
    w.proof || coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (WHERE x.i <> w.j), '')
  FROM (SELECT *, CASE WHEN level = 0 AND height = 0 THEN place ELSE i END AS j FROM walk WHERE level < total) w
  JOIN (SELECT tree, level, i, h FROM nodes UNION ALL SELECT NULL, level, i, h FROM tops) x
    ON CASE WHEN w.level < w.height THEN x.tree = w.tree AND x.level = w.level ELSE x.tree IS NULL AND x.level = w.level - w.height END
    AND x.i // 8 = w.j // 8
  GROUP BY w.r, w.doc_id, w.leaf, w.tree, w.subroot, w.height, w.place, w.root, w.total, w.level, w.j, w.proof)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM walk WHERE level = total""".replace("_CRC_", CRC32))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))
