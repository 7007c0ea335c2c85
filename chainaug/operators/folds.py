"""K1-K4: seeded k-fold assignment over valid rows and the leakage-free splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import phash
from .numbering import fold_of_position, positions


def shuffle_key(idx_col: str = "idx", seed: int = 42):
    """Portable seeded order key: H(seed:idx); ties broken by idx."""
    return phash(str(seed) + ":", F.col(idx_col))


def assign_folds(df: DataFrame, k: int = 5, seed: int = 42, idx_col: str = "idx", mode: str = "exact",
                 keep_columns: bool = False) -> DataFrame:
    """(idx, fold) for every row of ``df`` (K1); with ``keep_columns`` all of ``df``'s columns
    ride along (the numbering pass materialises them once).

    mode='exact': fold sizes equal ntile(k) over the seeded order (two-pass numbering).
    mode='hash' : fold = H(seed:idx) mod k, one narrow pass, sizes only approximately equal.
    """
    src = df.withColumnRenamed(idx_col, "idx") if keep_columns else df.select(F.col(idx_col).alias("idx"))
    keyed = src.withColumn("_h", shuffle_key("idx", seed))
    out_cols = [c for c in src.columns] if keep_columns else ["idx"]
    if mode == "hash":
        return keyed.select(*out_cols, (F.col("_h") % k).cast("int").alias("fold"))
    if mode != "exact":
        raise ValueError("mode must be 'exact' or 'hash'")
    positioned, n = positions(keyed, ["_h", "idx"], "_pos")
    return positioned.select(*out_cols, fold_of_position(F.col("_pos"), n, k).alias("fold"))


def split_of_fold(fold: Column, f: Column) -> Column:
    return F.when(fold == f, "valid").otherwise("train")


def kfold_splits(folds: DataFrame, k: int = 5) -> DataFrame:
    """K2 for every fold run at once: (f, idx, part), keyed (no position mapping)."""
    x = folds.select("idx", "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("f"))
    return x.select("f", "idx", split_of_fold(F.col("fold"), F.col("f")).alias("part"))


def leakage_free_splits(training_rows: DataFrame, folds: DataFrame, k: int = 5) -> DataFrame:
    """K3 for every fold run at once: ``training_rows`` with f and part.  Augmented rows inherit the fold of
    their source idx; validation holds originals only (round 0)."""
    tagged = training_rows.join(folds.select("idx", "fold"), "idx").withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    kept = tagged.where((F.col("fold") != F.col("f")) | (F.col("round") == 0))
    return kept.withColumn("part", split_of_fold(F.col("fold"), F.col("f"))).drop("fold")


def fold_rows(df: DataFrame, members: DataFrame, idx_col: str = "idx", complement: bool = False) -> DataFrame:
    """Rows whose idx is in ``members`` (hash semi join), or its complement (anti join)."""
    return df.join(members.select(idx_col), idx_col, "left_anti" if complement else "left_semi")
