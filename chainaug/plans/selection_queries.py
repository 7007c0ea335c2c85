"""Queries over the epoch log: P7-P9, A1-A4, A13, C6, S8."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import selection as S
from ..session import checkpoint_dir
from ..sources import fixtures as X
from ..sources import sinks
from .oracle_views import R6, with_ctes
from .registry import query

LOG_COLS = "run, fold, seq, epoch, val_bleu, val_rouge1, val_rouge2, val_rougeL, val_loss, data_length"


def M6(x: str) -> str:
    return R6(f"sum(floor(({x}) * 1e6 + 0.5))::DOUBLE / (count({x}) * 1e6)")


def tail_cte(n: int, name: str = "tail", src: str = "epoch_log", keys: str = "run", cols: str = LOG_COLS) -> tuple[str, str]:
    return (name, f"""SELECT {cols}, (least(c, {n}) - rd)::INTEGER AS pos FROM (
        SELECT *, row_number() OVER (PARTITION BY {keys}, fold ORDER BY seq DESC) AS rd,
                  count(*) OVER (PARTITION BY {keys}, fold) AS c FROM {src}) WHERE rd <= {n}""")


def mean_cte(src: str = "tail", k: int = 5, keys: str = "run") -> tuple[str, str]:
    cols = ", ".join(
        f"CASE WHEN count(DISTINCT fold) = {k} THEN {M6(m)} END AS {m}" for m in S.METRICS
    )
    return ("km", f"SELECT {keys}, pos, {cols}, CASE WHEN count(DISTINCT fold) = {k} THEN {M6('epoch::DOUBLE')} END AS epoch "
                  f"FROM {src} GROUP BY {keys}, pos")


COMPOSITE = ("kc", f"SELECT *, {R6('val_bleu + val_rouge1 + val_rouge2 + val_rougeL')} AS score_rouge12l, "
                   f"{R6('val_bleu + val_rougeL')} AS score_rougel FROM km")


def best_sql(src: str, col: str, keys: str = "run") -> str:
    return (f"SELECT {keys}, (-max({{'s': {col}, 'np': -pos}}).np)::INTEGER AS best_pos, "
            f"max({{'s': {col}, 'np': -pos}}).s AS best_score FROM {src} "
            f"WHERE {col} IS NOT NULL AND NOT isnan({col}) GROUP BY {keys}")


#: a grid of method (the run) x round (event days by halves of the month) x filtering (even and odd days)
GRID_KEYS = ["run", "round", "filtering"]
GRID_LOG = ("grid_log", """SELECT *, CASE WHEN seq % 30 < 15 THEN 1 ELSE 2 END AS round,
       CASE WHEN seq % 2 = 0 THEN 'true' ELSE 'false' END AS filtering FROM epoch_log""")
_K = ", ".join(GRID_KEYS)
GRID = ("grid", best_sql(
    f"(SELECT {_K}, pos, 'rouge12L' AS criterion, score_rouge12l AS score FROM kc "
    f"UNION ALL SELECT {_K}, pos, 'rougeL', score_rougel FROM kc)", "score", f"{_K}, criterion"))


def grid_ctes(n: int, where: str = "true") -> list[tuple[str, str]]:
    src = f"(SELECT * FROM grid_log WHERE {where})"
    return [GRID_LOG, tail_cte(n, "tail", src, _K, f"{LOG_COLS}, round, filtering"), mean_cte("tail", 5, _K), COMPOSITE, GRID]


def grid_log(spark, d):
    return X.epoch_log(spark, d).withColumns({
        "round": F.when(F.col("seq") % 30 < 15, 1).otherwise(2), "filtering": F.when(F.col("seq") % 2 == 0, "true").otherwise("false")})


@query("latest_run_tail", with_ctes(["epoch_log"], [tail_cte(21)], "SELECT * FROM tail"))
def latest_run_tail(spark, d):
    return S.latest_run(X.epoch_log(spark, d), 21)


@query("log_skip_head", with_ctes(["epoch_log"], [], f"""
SELECT {LOG_COLS}, (row_number() OVER (PARTITION BY run, fold ORDER BY seq) - 1)::INTEGER AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY run, fold ORDER BY seq) AS r FROM epoch_log)
WHERE NOT (fold = 0 AND r <= 5)"""))
def log_skip_head(spark, d):
    return S.skip_head(X.epoch_log(spark, d), fold=0, n=5)


@query("kfold_mean", with_ctes(["epoch_log"], [tail_cte(21), mean_cte()], "SELECT * FROM km"))
def kfold_mean(spark, d):
    return S.kfold_mean(S.latest_run(X.epoch_log(spark, d), 21), 5)


@query("kfold_composite", with_ctes(["epoch_log"], [tail_cte(21), mean_cte(), COMPOSITE], "SELECT * FROM kc"))
def kfold_composite(spark, d):
    return S.composite(S.kfold_mean(S.latest_run(X.epoch_log(spark, d), 21), 5))


@query("best_epoch", with_ctes(["epoch_log"], [tail_cte(21), mean_cte(), COMPOSITE], best_sql("kc", "score_rougel")))
def best_epoch(spark, d):
    return S.best_epoch(S.composite(S.kfold_mean(S.latest_run(X.epoch_log(spark, d), 21), 5)), "rougeL")


@query("best_epoch_grid", with_ctes(["epoch_log"], grid_ctes(21), "SELECT * FROM grid"))
def best_epoch_grid(spark, d):
    tail = S.latest_run(grid_log(spark, d), 21, (*GRID_KEYS, "fold"))
    return S.best_epoch_grid(S.composite(S.kfold_mean(tail, 5, GRID_KEYS)), GRID_KEYS)


@query("model_selection", with_ctes(["epoch_log"], [tail_cte(21), mean_cte(), COMPOSITE], best_sql("kc", "score_rouge12l")))
def model_selection(spark, d):
    return S.model_selection(X.epoch_log(spark, d), 21, 5, "rouge12L")


@query("late_best_epochs", with_ctes(["epoch_log"], grid_ctes(30, "filtering = 'true'"),
                                     "SELECT * FROM grid WHERE best_pos >= 5"))
def late_best_epochs(spark, d):
    return S.late_best_epochs(grid_log(spark, d), n=30, k=5, min_pos=5, keys=GRID_KEYS)


@query("mean_batch_loss", with_ctes(["epoch_log"], [("pb", """
SELECT run, fold, seq // 4 AS b, sum(floor(val_loss * 1e6 + 0.5))::BIGINT AS s, count(*) AS n
FROM epoch_log GROUP BY run, fold, seq // 4""")], f"""
SELECT run, fold, count(*) AS n_batches,
       {R6("sum((2 * s + n) // (2 * n))::DOUBLE / (count(*) * 1e6)")} AS mean_batch_loss
FROM pb GROUP BY run, fold"""))
def mean_batch_loss(spark, d):
    log = X.epoch_log(spark, d).withColumn("batch", F.expr("seq div 4"))
    return S.batch_mean_loss(log, ["run", "fold"], "batch", "val_loss")


@query("epoch_log_append", with_ctes(["epoch_log"], [], """
SELECT epoch, val_bleu, NULL::DOUBLE AS val_rouge, val_loss, CASE WHEN seq > 0 THEN val_rouge1 END AS val_rouge1,
       CASE WHEN seq > 0 THEN val_rouge2 END AS val_rouge2, CASE WHEN seq > 0 THEN val_rougeL END AS val_rougeL,
       data_length, fold AS kfold, run FROM epoch_log"""))
def epoch_log_append(spark, d):
    """A table under the checkpoint folder; the first append has narrower rows than the second."""
    log = X.epoch_log(spark, d)
    path = f"{checkpoint_dir(spark).rstrip('/')}/epoch-log-{uuid.uuid4().hex}"
    narrow = ["epoch", "val_bleu", "val_loss", "data_length", F.col("fold").alias("kfold"), "run"]
    sinks.append_epoch_log(log.where("seq <= 0").select(*narrow), path)
    sinks.append_epoch_log(log.where("seq > 0").select(*narrow, "val_rouge1", "val_rouge2", "val_rougeL"), path)
    return sinks.read_epoch_log(spark, path)
