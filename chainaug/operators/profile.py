"""Dataset profiling: set sizes and gains (A5-A7), token lengths (A8), null counts (A9),
argmax row (A10), key checks (A11), split sizes (A12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import phash
from ..functions.text import ws_tokens


def set_sizes(sets: DataFrame, keys=("method", "until_round")) -> DataFrame:
    """A5: rows per training set and the gain over its originals (round 0 rows)."""
    return sets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.col("round") == 0, 1).otherwise(0)).cast("long").alias("n_original"),
    ).withColumn("gain", F.col("n_rows") - F.col("n_original"))


def avg_set_size(sizes: DataFrame) -> DataFrame:
    """Average set size over the grid (integer sum, one division)."""
    return sizes.agg(
        F.count(F.lit(1)).alias("n_sets"),
        (F.sum("n_rows").cast("double") / F.count(F.lit(1))).alias("avg_rows"),
    )


def token_sizes(rows: DataFrame, keys: list, cols: list) -> DataFrame:
    """``keys, text_col, n_tokens``: whitespace tokens of every text column (a null has none)."""
    size = lambda c: F.coalesce(F.size(ws_tokens(F.col(c))), F.lit(0)).cast("long")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("text_col"), size(c).alias("n_tokens")) for c in cols]))
    return rows.select(*keys, each.alias("_x")).select(*keys, "_x.*")


def length_histograms(rows: DataFrame, keys: list, cols: list) -> DataFrame:
    """``keys, text_col, n_tokens, n``: how many rows have a length.  Histograms of parts add up to that of
    their union, so sets that share parts (methods, cumulative rounds) are put together from them."""
    return token_sizes(rows, keys, cols).groupBy(*keys, "text_col", "n_tokens").agg(F.count(F.lit(1)).alias("n"))


def length_quantiles(histograms: DataFrame, keys: list, percents=(50, 95, 99)) -> DataFrame:
    """``keys, n_rows, p<percent>..., max_tokens``, exact: the least length that at least that share of rows do not exceed.
    The sums run over the distinct lengths of a group, not over its rows."""
    merged = histograms.groupBy(*keys, "n_tokens").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumn("_upto", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(Window.partitionBy(*keys)))
    return merged.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        *[F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * q, F.col("n_tokens"))).alias(f"p{q}") for q in percents],
        F.max("n_tokens").alias("max_tokens"))


def length_sketches(rows: DataFrame, keys: list, cols: list, k: int = 400) -> DataFrame:
    """A8 where lengths take too many values for histograms: ``keys, text_col, sketch, max_tokens``, a KLL sketch (Karnin, Lang,
    Liberty 2016) of bounded size per group; larger ``k`` is closer."""
    return token_sizes(rows, keys, cols).groupBy(*keys, "text_col").agg(
        F.kll_sketch_agg_bigint("n_tokens", F.lit(k)).alias("sketch"), F.max("n_tokens").alias("max_tokens"))


def sketch_quantiles(sketches: DataFrame, keys: list, percents=(50, 95, 99)) -> DataFrame:
    """Like ``length_quantiles``, from merged sketches (approximate but for ``n_rows`` and ``max_tokens``)."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch").alias("_s"), F.max("max_tokens").alias("max_tokens"))
    return merged.select(*keys, F.kll_sketch_get_n_bigint("_s").alias("n_rows"),
                         *[F.kll_sketch_get_quantile_bigint("_s", F.lit(q / 100)).alias(f"p{q}") for q in percents], "max_tokens")


def row_digests(rows: DataFrame, keys: list, cols: list) -> DataFrame:
    """``keys, digest, witness``: 128 bits over the columns that make a row equal to another (NULL equals NULL), and 64 bits of
    another hash over the same."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    text = F.concat(*[part(c) for c in cols])
    return rows.select(*keys, F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.xxhash64(text).alias("witness"))


def dedup_sizes(digests: DataFrame, keys: list, rounds: int) -> DataFrame:
    """``keys, until_round, n_dedup, n_original, gain_dedup`` of ``digests(keys, round, digest, witness)``: a row counts in the first
    round that holds it, and a cumulative set is a prefix sum over rounds, so no text is shuffled and no row goes into
    more than one prefix.  Rows of one digest that are not equal (other witness) are an error."""
    differs = F.raise_error(F.lit("two different rows have the same digest")).cast("long")
    first = digests.groupBy(*keys, "digest").agg(
        F.when(F.min("witness") == F.max("witness"), F.min("round")).otherwise(differs).cast("long").alias("round"))
    per_round = first.groupBy(*keys, "round").agg(F.count(F.lit(1)).alias("n"))
    spread = per_round.select(*keys, "round", "n", F.explode(F.sequence(F.greatest(F.col("round"), F.lit(1)), F.lit(rounds))).alias("until_round"))
    out = spread.groupBy(*keys, F.col("until_round").cast("int").alias("until_round")).agg(
        F.sum("n").alias("n_dedup"), F.sum(F.when(F.col("round") == 0, F.col("n")).otherwise(0)).alias("n_original"))
    return out.withColumn("gain_dedup", F.col("n_dedup") - F.col("n_original"))


def null_counts(df: DataFrame) -> DataFrame:
    """NULL count of every column, one row."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}") for c in df.columns],
    )


def top_row(df: DataFrame, keys: list, score: str, tie: str, cols: list) -> DataFrame:
    """A10: per key, the row with the highest score; first (smallest ``tie``) on ties."""
    s = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    best = F.max(F.struct(F.col(score).alias("_s"), (-F.col(tie)).alias("_t"), *[F.col(c) for c in cols]))
    return s.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, (-F.col("_b._t")).alias(tie), F.col("_b._s").alias(score), *[F.col(f"_b.{c}").alias(c) for c in cols]
    )


def key_check(df: DataFrame, reference: DataFrame, key: str = "idx") -> DataFrame:
    """Uniqueness and both-way coverage of a key against a reference key set."""
    keys = df.select(key)
    ref = reference.select(key)
    n_missing = ref.join(keys, key, "left_anti").select(F.count(F.lit(1))).scalar()
    n_extra = keys.join(ref, key, "left_anti").select(F.count(F.lit(1))).scalar()
    return keys.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_distinct")).select(
        "n_rows", "n_distinct", n_missing.alias("n_missing"), n_extra.alias("n_extra"),
        (F.col("n_rows") == F.col("n_distinct")).alias("is_unique"),
    )


def split_of(idx: str = "idx", test_mod: int = 10) -> F.Column:
    """Deterministic train/test split: H('split:'||idx) mod 10 = 0 is test."""
    return F.when(phash("split:", F.col(idx)) % test_mod == 0, F.lit("test")).otherwise(F.lit("train"))


def split_sizes(corpus: DataFrame) -> DataFrame:
    """Rows per split and relation, with rollup totals (NULL = all)."""
    return corpus.withColumn("split", split_of()).rollup("split", "relation").agg(F.count(F.lit(1)).alias("n_rows"))
