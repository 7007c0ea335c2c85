"""Merges of generated premises with the originals.

Every training-set row carries ``idx`` (source row), ``round`` (0 = original) and ``source``
('original', 'prem1', 'prem2', 'pair'), so all rounds and methods are one plan and a
cumulative set "until i" is simply ``round <= i``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_COLS = ["premise_1", "premise_2", "conclusion", "relation", "idx"]
SET_COLS = ["idx", "round", "source", "premise_1", "premise_2", "conclusion", "relation"]
METHODS = ("aug_pair", "ori_mix", "aug_mix")


def valid_only(df: DataFrame) -> DataFrame:
    """Keep relation = 'yes' (exact, case-sensitive)."""
    return df.where(F.col("relation") == "yes")


def band(c: Column, floor: float, ceil: float) -> Column:
    """Strict both ends, floor < c < ceil; NULL and NaN fail."""
    if floor >= ceil:
        raise ValueError("band floor must be below ceil")
    return c.isNotNull() & ~F.isnan(c) & (c > F.lit(floor)) & (c < F.lit(ceil))


def pair_band(c1: Column, c2: Column, floor: float, ceil: float) -> Column:
    """P5: both scores in band."""
    return band(c1, floor, ceil) & band(c2, floor, ceil)


def parse_filtering(flag) -> bool:
    """The filtering switch accepts 'true'/'false' (or a bool), nothing else."""
    if isinstance(flag, bool):
        return flag
    if flag in ("true", "false"):
        return flag == "true"
    raise ValueError(f"filtering must be 'true' or 'false', got {flag!r}")


def premise_tables(generation: DataFrame):
    """Raw augmented premise tables from the generation table:
    prem1 = (idx, round, premise_1, premise_1_f1), prem2 = (idx, round, premise_2, premise_2_f1)."""
    g = generation.select("idx", "round", "target", "generation", "f1")
    p1 = g.where(F.col("target") == "prem1").select(
        "idx", "round", F.col("generation").alias("premise_1"), F.col("f1").alias("premise_1_f1")
    )
    p2 = g.where(F.col("target") == "prem2").select(
        "idx", "round", F.col("generation").alias("premise_2"), F.col("f1").alias("premise_2_f1")
    )
    return p1, p2


def attach_conclusion(prem2: DataFrame, originals: DataFrame) -> DataFrame:
    """The conclusion travels by key, never by position."""
    return prem2.join(originals.select("idx", "conclusion"), "idx", "inner")


def join_prem1_original(prem1: DataFrame, originals: DataFrame) -> DataFrame:
    """Generated premise 1 + original (premise 2, conclusion)."""
    return prem1.join(originals.select("idx", "premise_2", "conclusion"), "idx", "inner").withColumn(
        "relation", F.lit("yes")
    )


def join_prem2_original(prem2_with_conclusion: DataFrame, originals: DataFrame) -> DataFrame:
    """Original premise 1 + generated premise 2 (conclusion from the generated side)."""
    return originals.select("idx", "premise_1").join(prem2_with_conclusion, "idx", "inner").withColumn(
        "relation", F.lit("yes")
    )



def generated_pairs(generation: DataFrame, originals: DataFrame) -> DataFrame:
    """J3 over one generation table: premise 1 and premise 2 generated for the same (idx, round),
    with the conclusion attached by key.

    (idx, round, target) is unique in a generation table, so the inner join of the two premise
    tables on (idx, round) equals a pivot grouped by (idx, round) keeping groups with both
    targets.  The aggregation reuses an idx partitioning of its input (an equi-join on
    (idx, round) would re-shuffle both sides under the default co-partitioning rule)."""
    g = generation.where(F.col("target").isin("prem1", "prem2")).groupBy("idx", "round").agg(
        F.max(F.when(F.col("target") == "prem1", F.struct(F.col("generation").alias("g"), F.col("f1").alias("f")))).alias("_a"),
        F.max(F.when(F.col("target") == "prem2", F.struct(F.col("generation").alias("g"), F.col("f1").alias("f")))).alias("_b"),
    ).where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    pairs = g.select("idx", "round", F.col("_a.g").alias("premise_1"), F.col("_a.f").alias("premise_1_f1"),
                     F.col("_b.g").alias("premise_2"), F.col("_b.f").alias("premise_2_f1"))
    return attach_conclusion(pairs, originals).withColumn("relation", F.lit("yes"))


def _as_set(df: DataFrame, source: str) -> DataFrame:
    return df.select("idx", "round", F.lit(source).alias("source"), "premise_1", "premise_2", "conclusion", "relation")


def originals_set(originals: DataFrame) -> DataFrame:
    return originals.select(
        "idx", F.lit(0).alias("round"), F.lit("original").alias("source"),
        "premise_1", "premise_2", "conclusion", "relation",
    )


def added_rows(method: str, originals: DataFrame, generation: DataFrame, filtering=True,
               floor: float = 0.95, ceil: float = 0.99) -> DataFrame:
    """Rows a method adds on top of the originals, for every round at once."""
    if method not in METHODS:
        raise ValueError(f"unknown augmentation method {method!r}")
    filtering = parse_filtering(filtering)
    # one join with the originals: every part takes its columns from it
    o = originals.select("idx", F.col("premise_1").alias("_o1"), F.col("premise_2").alias("_o2"), "conclusion")
    j = generation.where(F.col("target").isin("prem1", "prem2")).select("idx", "round", "target", "generation", "f1").join(o, "idx")
    first = F.col("target") == "prem1"
    parts = []
    if method in ("ori_mix", "aug_mix"):
        one = j.where(band(F.col("f1"), floor, ceil)) if filtering else j
        parts.append(one.select(
            "idx", "round", F.col("target").alias("source"), F.when(first, F.col("generation")).otherwise(F.col("_o1")).alias("premise_1"),
            F.when(first, F.col("_o2")).otherwise(F.col("generation")).alias("premise_2"), "conclusion", F.lit("yes").alias("relation")))
    if method in ("aug_pair", "aug_mix"):
        side = lambda t: F.max(F.when(F.col("target") == t, F.struct(F.col("generation").alias("g"), F.col("f1").alias("f"))))
        both = j.groupBy("idx", "round").agg(side("prem1").alias("_a"), side("prem2").alias("_b"), F.first("conclusion").alias("conclusion"))
        both = both.where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
        if filtering:
            both = both.where(pair_band(F.col("_a.f"), F.col("_b.f"), floor, ceil))
        pair = both.withColumns({"premise_1": F.col("_a.g"), "premise_2": F.col("_b.g"), "relation": F.lit("yes")})
        parts.append(_as_set(pair, "pair"))
    return reduce(DataFrame.unionByName, parts)


def training_set(method: str, originals: DataFrame, generation: DataFrame, filtering=True,
                 floor: float = 0.95, ceil: float = 0.99) -> DataFrame:
    """Originals (round 0) + added rows of all rounds, duplicates kept (UNION ALL, U2)."""
    return originals_set(originals).unionByName(
        added_rows(method, originals, generation, filtering, floor, ceil)
    )


def lookup(originals: DataFrame, generation: DataFrame, ids: list | DataFrame | None = None) -> DataFrame:
    """P10: original and generated premises of a row beside each other, for the rounds that have both: of the ``ids`` asked for
    (a list, or a frame with ``idx``), or of all rows.

    The ids restrict every table below the join, and the two premises of a round meet in one aggregation by
    (idx, round), so tables that are stored by idx are not shuffled."""
    if isinstance(ids, DataFrame):
        ids = ids.select("idx").distinct()
        originals, generation = (t.join(ids, "idx", "left_semi") for t in (originals, generation))
    elif ids is not None:
        originals, generation = (t.where(F.col("idx").isin(list(ids))) for t in (originals, generation))
    text = lambda t: F.max(F.when(F.col("target") == t, F.col("generation")))
    pairs = generation.groupBy("idx", "round").agg(text("prem1").alias("aug_premise_1"), text("prem2").alias("aug_premise_2"))
    pairs = pairs.where("aug_premise_1 is not null and aug_premise_2 is not null")
    rows = originals.select("idx", F.col("premise_1").alias("original_premise_1"), F.col("premise_2").alias("original_premise_2")).join(pairs, "idx")
    return rows.select("idx", "round", "original_premise_1", "aug_premise_1", "original_premise_2", "aug_premise_2")


def round_prefixes(training: DataFrame, max_round: int) -> DataFrame:
    """Every cumulative set "until i" (i = 1..max_round) in one job: a row of round r belongs
    to prefixes max(r,1)..max_round."""
    return training.select(
        F.explode(F.sequence(F.greatest(F.col("round"), F.lit(1)), F.lit(max_round))).alias("until_round"),
        *training.columns,
    )


def dedup_rows(training: DataFrame, cols=None) -> DataFrame:
    """U4: whole-row de-dup on the five training columns (NULL equals NULL)."""
    return training.dropDuplicates(cols or TRAIN_COLS)


def keep_first(df: DataFrame, key: str, order: list) -> DataFrame:
    """First row per key under an explicit order."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def recover_index(aug_without_idx: DataFrame, originals: DataFrame, order: list) -> DataFrame:
    """J7 + U5: recover ``idx`` through the conclusion text (NULL matches NULL, as a pandas merge
    does) and keep one row per recovered idx: the first under ``order`` among the rows sharing
    that conclusion.

    The first row is chosen per distinct conclusion *before* the join (a partially aggregated
    ``min(struct)``), so a conclusion shared by M augmented rows and K source rows yields K output
    rows instead of M x K joined pairs."""
    cols = [c for c in aug_without_idx.columns if c != "conclusion"]
    first = aug_without_idx.groupBy("conclusion").agg(
        F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in cols])).alias("_f"))
    first = first.select("conclusion", *[F.col(f"_f.{c}").alias(c) for c in cols])
    keys = originals.select(F.col("conclusion").alias("_c"), "idx").distinct()
    return first.join(keys, first["conclusion"].eqNullSafe(keys["_c"]), "inner").drop("_c")


def recover_index_candidates(aug_without_idx: DataFrame, originals: DataFrame) -> DataFrame:
    """J7 as the reference's merge: every (augmented row, source idx) pair with the same
    conclusion.  Many-to-many on repeated text; prefer ``recover_index`` at scale."""
    keys = originals.select(F.col("conclusion").alias("_c"), "idx").distinct()
    return aug_without_idx.join(keys, aug_without_idx["conclusion"].eqNullSafe(keys["_c"]), "inner").drop("_c")


def compare_generations(runs: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """J10 over ``runs(run, idx, generation)``: for each pair of runs the rows matched on idx and how many
    generations are equal (plain '=': NULL never equal).  One pass: a pivot by idx, then sums."""
    names = sorted({r for p in pairs for r in p})
    wide = runs.where(F.col("run").isin(names)).groupBy("idx").agg(
        *[F.max(F.when(F.col("run") == r, F.struct("generation"))).alias(f"_{i}") for i, r in enumerate(names)])
    sums = []
    for k, (a, b) in enumerate(pairs):
        x, y = f"_{names.index(a)}", f"_{names.index(b)}"
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        sums += [F.count(F.when(both, 1)).alias(f"n{k}"), F.count(F.when(both & (F.col(f"{x}.generation") == F.col(f"{y}.generation")), 1)).alias(f"e{k}")]
    rows = F.array(*[F.struct(F.lit(a).alias("run_a"), F.lit(b).alias("run_b"), F.col(f"n{k}").alias("n_rows"), F.col(f"e{k}").alias("n_equal"))
                     for k, (a, b) in enumerate(pairs)])
    return wide.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


# Which method sets each source belongs to (one scan builds all three methods).
_MEMBERSHIP = {
    "original": ("aug_pair", "ori_mix", "aug_mix"),
    "prem1": ("ori_mix", "aug_mix"),
    "prem2": ("ori_mix", "aug_mix"),
    "pair": ("aug_pair", "aug_mix"),
}


def all_methods(originals: DataFrame, generation: DataFrame, filtering=True,
                floor: float = 0.95, ceil: float = 0.99) -> DataFrame:
    """The three methods' training sets in one plan: each row is computed once and tagged with
    every method it belongs to (aug_mix = ori_mix added rows + aug_pair added rows + originals)."""
    rows = every_row(originals, generation, filtering, floor, ceil)
    return with_methods(rows).select("method", *SET_COLS)


def every_row(originals: DataFrame, generation: DataFrame, filtering=True, floor: float = 0.95, ceil: float = 0.99) -> DataFrame:
    """The rows of all three methods' sets, each once."""
    return originals_set(originals).unionByName(added_rows("aug_mix", originals, generation, filtering, floor, ceil))


def with_methods(rows: DataFrame) -> DataFrame:
    """``rows(source, ...)``, or counts of them, once for every method whose sets hold that source (``method`` comes first)."""
    member = F.col("source")
    m = F.when(member == "original", F.array(*[F.lit(x) for x in _MEMBERSHIP["original"]]))
    m = m.when(member == "pair", F.array(*[F.lit(x) for x in _MEMBERSHIP["pair"]]))
    m = m.otherwise(F.array(*[F.lit(x) for x in _MEMBERSHIP["prem1"]]))
    return rows.select(F.explode(m).alias("method"), *rows.columns)
