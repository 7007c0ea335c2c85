"""Generation metrics as grouped Spark plans (M1-M7).

Input: a pairs table with group keys (e.g. ``run``), a pair key ``idx``, a prediction column and a
reference column.  All metrics are computed for every group in one job.

n-gram metrics (BLEU, ROUGE-1/2) and the LCS: a pair's tokens are coded and counted in one pass over the
texts (``functions/ngrams.py``), without a shuffle of texts or grams; only rows of numbers are grouped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import f_measure, mean6, micro, round6
from ..functions.embedding import Vectors, score, vectors
from ..functions.lcs import lcs_udf
from ..functions.ngrams import overlap_rows
from ..functions.overlap import chunks
from ..functions.text import rouge_normalized, rouge_tokens, ws_normalized
from ..session import hash_partitions, materialize
from . import bootstrap as BS


def ngram_overlap(pairs: DataFrame, keys: list, pred_norm: Column, ref_norm: Column, orders=(1, 2, 3, 4), lcs: bool = False) -> DataFrame:
    """Per (keys, idx): prediction and reference token counts ``lp`` and ``lr``, for each of ``orders`` the clipped n-gram overlap
    ``o<n>`` and, with ``lcs``, the longest common subsequence.

    ``pred_norm`` / ``ref_norm`` are token strings joined by single spaces; pairs without one of them are left out.  The texts are
    read once, where they lie; what leaves a task is a row of numbers per pair.  Copies of a pair (equal key and lengths)
    make one row and add up their overlaps."""
    by = [*keys, "idx"]
    base = pairs.select(*by, pred_norm.alias("_pt"), ref_norm.alias("_rt"))
    sums = [f"o{n}" for n in orders]
    fields = [*(base.schema[c] for c in by), *(T.StructField(c, T.LongType()) for c in ("lp", "lr", *sums, *(["lcs"] if lcs else [])))]
    found = base.mapInArrow(overlap_rows(by, tuple(orders), lcs), T.StructType(fields))
    return found.groupBy(*by, "lp", "lr", *(["lcs"] if lcs else [])).agg(*[F.sum(c).alias(c) for c in sums])


def corpus_bleu(pairs: DataFrame, keys: list, pred: str = "generation", ref: str = "label") -> DataFrame:
    """M1: corpus BLEU-4, one reference, no smoothing (Papineni et al. 2002): clipped n-gram sums
    over the whole corpus, geometric mean of the four precisions (0 if any is 0), brevity penalty
    exp(1 - 1/ratio) when ratio <= 1.  Whitespace tokens."""
    ov = ngram_overlap(pairs, keys, ws_normalized(F.col(pred)), ws_normalized(F.col(ref)))
    aggs = []
    for n in (1, 2, 3, 4):
        aggs.append(F.sum(f"o{n}").alias(f"m{n}"))
        aggs.append(F.sum(F.greatest(F.col("lp") - n + 1, F.lit(0))).alias(f"c{n}"))
    aggs += [F.sum("lp").alias("pred_len"), F.sum("lr").alias("ref_len")]
    s = ov.groupBy(*keys).agg(*aggs)
    return s.select(*keys, round6(bleu_of_sums()).alias("bleu"), F.col("pred_len").cast("long"), F.col("ref_len").cast("long"))


def bleu_of_sums() -> Column:
    """BLEU-4 from sums over a corpus: matches m1-m4, candidates c1-c4, and the lengths pred_len and ref_len."""
    prec = [F.when(F.col(f"c{n}") > 0, F.col(f"m{n}") / F.col(f"c{n}")).otherwise(F.lit(0.0)) for n in (1, 2, 3, 4)]
    positive = reduce(lambda a, b: a & b, [p > 0 for p in prec])
    log_sum = reduce(lambda a, b: a + b, [F.log(F.when(p > 0, p)) for p in prec])
    geo = F.when(positive, F.exp(log_sum / 4)).otherwise(F.lit(0.0))
    ratio = F.when(F.col("ref_len") > 0, F.col("pred_len") / F.col("ref_len"))
    bp = F.when(ratio.isNull() | (ratio > 1), F.lit(1.0)).when(ratio > 0, F.exp(F.lit(1.0) - F.lit(1.0) / ratio)).otherwise(F.lit(0.0))
    return F.when(F.col("pred_len") > 0, geo * bp).otherwise(F.lit(0.0))


def rouge_n(pairs: DataFrame, keys: list, pred: str = "generation", ref: str = "label") -> DataFrame:
    """M2: per pair ROUGE-1 and ROUGE-2 F (P = overlap / max(pred n-grams, 1), R likewise)."""
    per = ngram_overlap(pairs, keys, rouge_normalized(F.col(pred)), rouge_normalized(F.col(ref)), orders=(1, 2))
    return per.select(*keys, "idx", *_rouge_n_columns())


def _rouge_n_columns() -> list[Column]:
    cols = []
    for n in (1, 2):
        p = F.col(f"o{n}") / F.greatest(F.col("lp") - n + 1, F.lit(1))
        r = F.col(f"o{n}") / F.greatest(F.col("lr") - n + 1, F.lit(1))
        cols.append(round6(f_measure(p, r)).alias(f"rouge{n}"))
    return cols


def _rouge_l_column() -> Column:
    p = F.when(F.col("lp") > 0, F.col("lcs") / F.col("lp")).otherwise(F.lit(0.0))
    r = F.when(F.col("lr") > 0, F.col("lcs") / F.col("lr")).otherwise(F.lit(0.0))
    return round6(f_measure(p, r)).alias("rougeL")


def rouge_l(pairs: DataFrame, keys: list, pred: str = "generation", ref: str = "label", dedupe: bool = False,
            partitioned: bool = False) -> DataFrame:
    """M3: per pair ROUGE-L F from the LCS of ROUGE tokens (Arrow UDF, bit-parallel), a narrow
    pass over the pairs.  With ``dedupe`` the UDF runs once per distinct (prediction, reference)
    text pair, at the price of two text shuffles: worth it only when pairs repeat a lot.
    Unless ``partitioned`` (already hash-partitioned by (keys, idx)), the texts are spread by
    pair key first so the CPU-heavy UDF runs balanced over tasks."""
    src = pairs.select(*keys, "idx", F.col(pred).alias("_g"), F.col(ref).alias("_l"))
    if not (partitioned or dedupe):
        src = src.repartition(*keys, "idx")
    texts = src.select("_g", "_l").distinct() if dedupe else src
    pt, rt = rouge_tokens(F.col("_g")), rouge_tokens(F.col("_l"))
    scored = texts.select("*", lcs_udf(pt, rt).alias("lcs"), F.size(pt).alias("lp"), F.size(rt).alias("lr"))
    if dedupe:
        scored = src.join(scored, [src["_g"].eqNullSafe(scored["_g"]), src["_l"].eqNullSafe(scored["_l"])]).select(
            *[src[k] for k in keys], src["idx"], "lcs", "lp", "lr")
    return scored.select(*keys, "idx", F.col("lcs").cast("long").alias("lcs"), _rouge_l_column())


def rouge_scores(pairs: DataFrame, keys: list, pred: str = "generation", ref: str = "label") -> DataFrame:
    """Per pair ROUGE-1, -2, -L F (one row per pair), in one pass: n-grams and LCS come from the same coded tokens."""
    per = ngram_overlap(pairs, keys, rouge_normalized(F.col(pred)), rouge_normalized(F.col(ref)), orders=(1, 2), lcs=True)
    return per.select(*keys, "idx", *_rouge_n_columns(), _rouge_l_column())


def rouge_corpus(per_pair: DataFrame, keys: list) -> DataFrame:
    """M4 value: mean F over pairs (the centre the bootstrap estimates)."""
    return per_pair.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        mean6(F.col("rouge1")).alias("rouge1"), mean6(F.col("rouge2")).alias("rouge2"), mean6(F.col("rougeL")).alias("rougeL"))


def bootstrap(pairs: DataFrame, keys: list, pred: str = "generation", ref: str = "label", replicates: int = 100,
              seed: int = 42, partitioned: bool = False) -> DataFrame:
    """M4 intervals: per group and metric (rouge1, rouge2, rougeL, bleu) the percentiles of its corpus value over
    Poisson bootstrap replicates (``operators/bootstrap.py``)."""
    rouge = ["rouge1", "rouge2", "rougeL"]
    if not partitioned:  # both halves read the pairs
        pairs = materialize(pairs.select(*keys, "idx", pred, ref).repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "idx"))
    scores = rouge_scores(pairs, keys, pred, ref)
    millionths = scores.select(*keys, "idx", *[micro(F.col(m)).cast("long").alias(m) for m in rouge])
    mean = lambda m: F.when(F.col("weight") > 0, F.col(m).cast("double") / (F.col("weight") * F.lit(1e6)))
    out = BS.intervals(BS.replicate_sums(millionths, keys, rouge, replicates, seed), keys, {m: mean(m) for m in rouge})
    counts = _bleu_counts(pairs, keys, pred, ref)
    stats = [c for c in counts.columns if c not in (*keys, "idx")]
    return out.unionByName(BS.intervals(BS.replicate_sums(counts, keys, stats, replicates, seed), keys, {"bleu": bleu_of_sums()}))


def _bleu_counts(pairs: DataFrame, keys: list, pred: str, ref: str) -> DataFrame:
    """Per pair: matching n-grams m1-m4, candidates c1-c4, and the lengths pred_len and ref_len."""
    per = ngram_overlap(pairs, keys, ws_normalized(F.col(pred)), ws_normalized(F.col(ref)))
    return per.select(*keys, "idx", *[F.col(f"o{n}").alias(f"m{n}") for n in (1, 2, 3, 4)], *[F.greatest(F.col("lp") - (n - 1), F.lit(0)).alias(f"c{n}") for n in (1, 2, 3, 4)],
                      F.col("lp").alias("pred_len"), F.col("lr").alias("ref_len"))


def _score_buckets(columns: list):
    """Rows of a bucket, its dictionary (kind 0) before its pairs (kind 1) -> scored pairs."""
    names = [*columns, "p", "r", "f1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rows, table = [], [], None
        for batch in batches:
            first = int(pc.sum(pc.equal(batch["_kind"], 0)).as_py() or 0)  # the dictionary's rows come first
            if first:
                part = batch.slice(0, first)
                tokens.append(part["_token"].cast(pa.large_string()))
                rows.append(part["_vector"].flatten().to_numpy(zero_copy_only=False).reshape(first, -1))
            if first == len(batch):
                continue
            if table is None:
                held = pa.concat_arrays(tokens) if tokens else pa.array([], pa.large_string())
                table = vectors(held, np.concatenate(rows) if rows else np.zeros((0, 1)))
            pairs = batch.slice(first)
            for lo, hi in chunks(pairs["_pt"], pairs["_rt"]):
                some = pairs.slice(lo, hi - lo)
                found = score(some["_pt"], some["_rt"], table)
                yield pa.RecordBatch.from_arrays([*(some[c] for c in columns), *(pa.array(found[:, k]) for k in range(3))], names)

    return run


class CodedVectors(NamedTuple):
    """A vector table in two parts: ``words(token, code)``, a row per token, and ``vectors(code, embedding)``, a row per code."""

    words: DataFrame
    vectors: DataFrame


def _usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())


def _one_each(vector_table: DataFrame) -> DataFrame:
    """(_token, _vector): one vector per token, none with NULLs."""
    v = vector_table.where(F.col("token").isNotNull() & _usable("embedding"))
    return v.groupBy(F.col("token").alias("_token")).agg(F.min("embedding").alias("_vector"))


_VECTOR, _WORD, _PAIR = range(3)


def _distinct_words(key: str):
    """Rows of a partition -> its distinct tokens, each with a key that lies in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new, size, first = pa.array([], pa.large_string()), [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            first = batch[key].slice(0, 1) if first is None else first
            for c in ("_pt", "_rt"):
                new.append(pc.unique(pc.split_pattern(batch[c].cast(pa.large_string()), " ").flatten()))
                size += len(new[-1])
            if size > len(held):
                held, new, size = pc.unique(pa.chunked_array([held, *new])), [], 0
        held = pc.unique(pa.chunked_array([held, *new])).drop_null()
        held = held.filter(pc.not_equal(held, ""))
        for lo in range(0, len(held), 10_000):
            part = held.slice(lo, 10_000)
            yield pa.RecordBatch.from_arrays([first.take(pa.array(np.zeros(len(part), np.int64))), part.cast(pa.string())], [key, "token"])

    return run


def _table(words: list, codes: list, vector_codes: list, rows: list) -> Vectors:
    """The vectors of the words whose code has one."""
    if not words or not rows:
        return vectors(pa.array([], pa.large_string()), np.zeros((0, 1)))
    token, code, known = pa.concat_arrays(words), pa.concat_arrays(codes), pa.concat_arrays(vector_codes)
    at = pc.index_in(code, value_set=known)
    found = pc.is_valid(at)
    own = vectors(known, np.concatenate(rows))
    at = at.filter(found).to_numpy(zero_copy_only=False)
    return Vectors(token.filter(found), own.rows[at], own.norms[at], own.units[at], own.plain[at])


def _score_partition(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Rows of a partition, the vectors of its codes and its words before its pairs -> (p, r, f1) of the pairs."""
    words, codes, vector_codes, rows, table = [], [], [], [], None
    for _, kind, token, code, vector, pred, ref in batches:
        begins = np.searchsorted(kind.to_numpy(zero_copy_only=False), [_VECTOR, _WORD, _PAIR, _PAIR + 1])
        if begins[1] > begins[0]:
            part = vector.slice(0, begins[1])
            vector_codes.append(code.slice(0, begins[1]))
            rows.append(part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1))
        if begins[2] > begins[1]:
            words.append(token.slice(begins[1], begins[2] - begins[1]).cast(pa.large_string()))
            codes.append(code.slice(begins[1], begins[2] - begins[1]))
        out = np.zeros((len(kind), 3))
        if begins[3] > begins[2]:
            if table is None:
                table = _table(words, codes, vector_codes, rows)
                words, codes, vector_codes, rows = [], [], [], []
            pred, ref = pred.slice(begins[2]), ref.slice(begins[2])
            for lo, hi in chunks(pred, ref):
                out[begins[2] + lo : begins[2] + hi] = score(pred.slice(lo, hi - lo), ref.slice(lo, hi - lo), table)
        yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(out[:, k])) for k in range(3)], ["p", "r", "f1"])


def _embedding_f1_in_place(src: DataFrame, columns: list, vector_table: CodedVectors, parts: int) -> DataFrame | None:
    """``embedding_f1`` of ``src(columns, _pt, _rt)``, stored in ``parts`` partitions by a hash of idx, without moving a pair: a
    partition's words and the vectors of their codes are dealt like its idx, and a union of equal partitionings puts them before its
    pairs.  The result is partitioned as ``src`` is.  None where Spark does not plan the union so."""
    needed = src.select("idx", "_pt", "_rt").mapInArrow(_distinct_words("idx"), T.StructType([src.schema["idx"], T.StructField("token", T.StringType())]))
    words = materialize(needed.join(vector_table.words, "token").select("idx", "token", "code").repartition(parts, "idx"))
    own = vector_table.vectors.where(_usable("embedding")).select("code", F.col("embedding").alias("_vector"))
    own = words.select("idx", "code").distinct().join(own, "code").repartition(parts, "idx")
    rows = own.select("idx", F.lit(_VECTOR).alias("_kind"), F.col("code").alias("_code"), "_vector")
    rows = rows.unionByName(words.select("idx", F.lit(_WORD).alias("_kind"), F.col("token").alias("_token"), F.col("code").alias("_code")), allowMissingColumns=True)
    rows = rows.unionByName(src.withColumn("_kind", F.lit(_PAIR)), allowMissingColumns=True)
    if hash_partitions(rows, "idx") != parts:
        return None
    scored = F.arrow_udf(_score_partition, "p double, r double, f1 double").asNondeterministic()  # goes by the order of rows
    # idx goes along: a plan that did without it would not know the partitionings to be equal
    rows = rows.withColumn("_s", scored("idx", "_kind", "_token", "_code", "_vector", "_pt", "_rt"))
    return rows.where(F.col("_kind") == _PAIR).select(*columns, "_s.p", "_s.r", "_s.f1")


def embedding_f1(pairs: DataFrame, keys: list, vector_table: DataFrame | CodedVectors, pred: str = "generation", ref: str = "label",
                 stored: bool = False, carry: list | None = None, buckets: int | None = None) -> DataFrame:
    """M5: per pair (P, R, F) by greedy max-cosine over token vectors (tokens = single-space split,
    empties dropped; tokens without a vector are ignored).  A token with several vectors takes the least
    of them; vectors that are NULL or hold NULLs count as none.  ``carry`` columns go along with their pair.

    Pairs are dealt into ``buckets`` (one per shuffle partition unless given) by a hash of their key.  A bucket's
    dictionary, the vectors of the distinct tokens in it, comes from one join on token and is sent once
    to the task of the bucket, ahead of its pairs; the pairs carry texts only.  So the vector table may have any size, a
    frequent token moves one vector per bucket, and a task holds the dictionary of one bucket and a batch of pairs: more
    buckets make smaller dictionaries.  Pairs are read twice; unless they are ``stored`` they are written first.

    Pairs that are ``stored`` hash-partitioned by idx with ``CodedVectors`` stay where they lie: a bucket is a partition, its words move
    with their codes only, and a vector moves once per bucket and code.  The scores are then partitioned by idx too."""
    columns = [*keys, "idx", *(carry or [])]
    n = buckets or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((pred, "_pt"), (ref, "_rt"))]
    src = pairs.select(*columns, *texts)
    if isinstance(vector_table, CodedVectors):
        parts = hash_partitions(src, "idx") if stored and not buckets else None
        found = _embedding_f1_in_place(src, columns, vector_table, parts) if parts else None
        if found is not None:
            return found
        vector_table = vector_table.words.join(vector_table.vectors, "code").select("token", "embedding")
    src = (src if stored else materialize(src)).withColumn("_bucket", F.pmod(F.xxhash64(*keys, "idx"), F.lit(n)).cast("int"))
    v = _one_each(vector_table)
    tokens = F.array_distinct(F.concat(F.split("_pt", " "), F.split("_rt", " ")))
    needed = src.select("_bucket", F.explode(tokens).alias("_token")).where("_token <> ''").distinct()
    dictionary = needed.join(v, "_token").select("_bucket", F.lit(0).alias("_kind"), "_token", "_vector")
    rows = dictionary.unionByName(src.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    dealt = rows.repartitionById(n, F.col("_bucket")).sortWithinPartitions("_kind")
    schema = T.StructType([*(T.StructField(c, src.schema[c].dataType) for c in columns), *(T.StructField(c, T.DoubleType()) for c in ("p", "r", "f1"))])
    return dealt.mapInArrow(_score_buckets(columns), schema)


def embedding_f1_corpus(per_pair: DataFrame, keys: list) -> DataFrame:
    """M5 corpus value: mean P, R, F per group."""
    return per_pair.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), mean6(F.col("p")).alias("p"), mean6(F.col("r")).alias("r"),
        mean6(F.col("f1")).alias("f1"))


def score_grid(pairs: DataFrame, vector_table: DataFrame, key: str = "run") -> DataFrame:
    """M6: one leaderboard row per run: embedding F1, ROUGE-1/2/L and BLEU, all runs in one job.
    The pair table feeds four metric plans, so it is materialised once (shared checkpoint
    folder), hash-partitioned by the pair key the n-gram metrics group on."""
    keys = [key]
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = materialize(pairs.repartition(n, key, "idx"))
    emb = embedding_f1_corpus(embedding_f1(pairs, keys, vector_table, stored=True), keys).select(
        key, F.col("f1").alias("bert_score"))
    rc = rouge_corpus(rouge_scores(pairs, keys), keys).select(
        key, F.col("rouge1").alias("rouge_1"), F.col("rouge2").alias("rouge_2"), F.col("rougeL").alias("rouge_l"))
    bl = corpus_bleu(pairs, keys).select(key, "bleu")
    return emb.join(rc, key).join(bl, key).select(
        F.col(key).alias("model_name"), "bert_score", "rouge_1", "rouge_2", "rouge_l", "bleu")
