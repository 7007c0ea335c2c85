"""Epoch-log analytics: tails (P7, P8), fold means (A1), composites (A2), best epoch (A3, A4),
threshold report (P9) and the model-selection plan (C6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import mean6, round6

METRICS = ["val_bleu", "val_loss", "val_rouge1", "val_rouge2", "val_rougeL"]
CRITERIA = {"rouge12L": "score_rouge12l", "rougeL": "score_rougel"}


def latest_run(log: DataFrame, n: int = 21, keys=("run", "fold")) -> DataFrame:
    """Last n rows of each (run, fold) by seq, renumbered pos = 0..(rows kept - 1)."""
    w = Window.partitionBy(*keys).orderBy(F.col("seq").desc())
    # the limit right after the numbering lets Spark drop older rows before the shuffle; then the kept are counted
    t = log.withColumn("_rd", F.row_number().over(w)).where(F.col("_rd") <= n)
    t = t.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return t.withColumn("pos", (F.col("_c") - F.col("_rd")).cast("int")).drop("_rd", "_c")


def skip_head(log: DataFrame, fold: int, n: int, keys=("run", "fold")) -> DataFrame:
    """Drop the first n rows (by seq) of one fold, renumber pos from 0 in every (run, fold)."""
    w = Window.partitionBy(*keys).orderBy("seq")
    t = log.withColumn("_r", F.row_number().over(w))
    t = t.where(~((F.col("fold") == fold) & (F.col("_r") <= n)))
    return t.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).drop("_r")


def kfold_mean(tail: DataFrame, k: int = 5, keys=("run",)) -> DataFrame:
    """A1: per (keys, pos) mean of every metric over the folds; NULL unless all k folds are present
    (pandas adds by label and yields NaN when a fold lacks the position)."""
    full = F.countDistinct("fold") == k
    aggs = [F.when(full, mean6(F.col(m))).alias(m) for m in METRICS]
    aggs.append(F.when(full, mean6(F.col("epoch").cast("double"))).alias("epoch"))
    return tail.groupBy(*keys, "pos").agg(*aggs)


def composite(mean: DataFrame) -> DataFrame:
    """A2: BLEU+R1+R2+RL and BLEU+RL."""
    return mean.withColumn(
        "score_rouge12l", round6(F.col("val_bleu") + F.col("val_rouge1") + F.col("val_rouge2") + F.col("val_rougeL"))
    ).withColumn("score_rougel", round6(F.col("val_bleu") + F.col("val_rougeL")))


def best_epoch(scored: DataFrame, criterion: str = "rouge12L", keys=("run",)) -> DataFrame:
    """A3: position of the first maximum of the criterion, NULL/NaN dropped.  Position p means
    "train p epochs" (position 0 is the pre-training entry)."""
    col = CRITERIA[criterion]
    s = scored.where(F.col(col).isNotNull() & ~F.isnan(col))
    best = F.max(F.struct(F.col(col).alias("s"), (-F.col("pos")).alias("np")))
    return s.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, (-F.col("_b.np")).cast("int").alias("best_pos"), F.col("_b.s").alias("best_score")
    )


def best_epoch_grid(scored: DataFrame, keys=("run",)) -> DataFrame:
    """A4: best position for every run and both criteria in one aggregation (criteria unpivoted)."""
    long = scored.select(
        *keys, "pos",
        F.expr("stack(2, 'rouge12L', score_rouge12l, 'rougeL', score_rougel) as (criterion, score)"),
    )
    s = long.where(F.col("score").isNotNull() & ~F.isnan("score"))
    best = F.max(F.struct(F.col("score").alias("s"), (-F.col("pos")).alias("np")))
    return s.groupBy(*keys, "criterion").agg(best.alias("_b")).select(
        *keys, "criterion", (-F.col("_b.np")).cast("int").alias("best_pos"), F.col("_b.s").alias("best_score")
    )


def model_selection(log: DataFrame, n: int = 21, k: int = 5, criterion: str = "rouge12L", keys=("run",)) -> DataFrame:
    """Logs -> tail -> fold mean -> composites -> best position per grid entry (``keys``)."""
    return best_epoch(composite(kfold_mean(latest_run(log, n, (*keys, "fold")), k, keys)), criterion, keys)


def late_best_epochs(log: DataFrame, n: int = 30, k: int = 5, min_pos: int = 20, keys=("run",)) -> DataFrame:
    """Grid entries whose best position is >= min_pos; of a grid with a ``filtering`` key, the filtered ones."""
    if "filtering" in keys:
        log = log.where(F.col("filtering") == "true")
    grid = best_epoch_grid(composite(kfold_mean(latest_run(log, n, (*keys, "fold")), k, keys)), keys)
    return grid.where(F.col("best_pos") >= min_pos)


def batch_mean_loss(rows: DataFrame, keys: list, batch_col: str, loss_col: str) -> DataFrame:
    """Validation loss = sum of batch means / number of batches, per key (a mean of batch
    means, not of rows; the last batch may be short).

    Order-independent in integers: losses are summed in millionths per batch, a batch's mean is
    rounded to a millionth, and the means are summed, so no batch size or row count overflows."""
    total = F.sum(F.floor(F.col(loss_col) * F.lit(1e6) + F.lit(0.5))).cast("long")
    per_batch = rows.groupBy(*keys, batch_col).agg(total.alias("_s"), F.count(F.lit(1)).alias("_n"))
    mean = per_batch.withColumn("_m", F.expr("(2 * _s + _n) div (2 * _n)"))
    return mean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_batches"),
        round6(F.sum("_m").cast("double") / (F.count(F.lit(1)) * F.lit(1e6))).alias("mean_batch_loss"),
    )
