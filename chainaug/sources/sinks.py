"""Sinks and append semantics: epoch log (S8), leaderboard (S9), training sets (S6),
generations (S7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The narrow header a fresh epoch log is created with (later rows add columns).
LOG_HEADER = T.StructType([
    T.StructField("epoch", T.IntegerType()),
    T.StructField("val_bleu", T.DoubleType()),
    T.StructField("val_rouge", T.DoubleType()),
    T.StructField("val_loss", T.DoubleType()),
])

LEADERBOARD = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("bert_score", T.DoubleType()),
    T.StructField("rouge_1", T.DoubleType()),
    T.StructField("rouge_2", T.DoubleType()),
    T.StructField("rouge_l", T.DoubleType()),
    T.StructField("bleu", T.DoubleType()),
])


def empty_epoch_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG_HEADER)


def union_epoch_log(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns are unioned by name; a column missing on one side is NULL there."""
    return existing.unionByName(rows, allowMissingColumns=True)


def append_epoch_log(rows: DataFrame, path: str) -> None:
    """S8 as a table append: Parquet with schema merge on read."""
    rows.write.mode("append").parquet(path)


def read_epoch_log(spark: SparkSession, path: str) -> DataFrame:
    """The table's columns, all files' together, with those of the narrow header where no file has them."""
    return union_epoch_log(empty_epoch_log(spark), spark.read.option("mergeSchema", "true").parquet(path))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, by Spark's own file-system layer."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def one_per_model(rows: DataFrame) -> DataFrame:
    """One row per model_name: of several in a batch, the one with the greatest scores."""
    names = [f.name for f in LEADERBOARD.fields]
    best = rows.groupBy("model_name").agg(F.max(F.struct(*names[1:])).alias("_s"))
    return best.select("model_name", *[F.col(f"_s.{n}").alias(n) for n in names[1:]])


def merge_leaderboard(existing: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Existing rows + new rows whose model_name is not there yet (idempotent re-runs)."""
    fresh = one_per_model(new_rows).join(existing.select("model_name"), "model_name", "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def append_leaderboard(new_rows: DataFrame, path: str) -> None:
    """S9 as a table append, creating the table when absent; re-appending a model is a no-op.  A table
    that is there but cannot be read is an error."""
    spark = new_rows.sparkSession
    fresh = one_per_model(new_rows)
    if exists(spark, path):
        fresh = fresh.join(spark.read.schema(LEADERBOARD).parquet(path).select("model_name"), "model_name", "left_anti")
    fresh.select(*[f.name for f in LEADERBOARD.fields]).write.mode("append").parquet(path)


def write_training_sets(sets: DataFrame, path: str) -> None:
    """One folder per (method, round), each row once; overwrite is idempotent."""
    sets.write.mode("overwrite").partitionBy("method", "round").parquet(path)


def read_training_set(spark: SparkSession, path: str, method: str, until_round: int) -> DataFrame:
    """The cumulative set "until i" of a method: the folders of its rounds up to i."""
    return spark.read.parquet(path).where((F.col("method") == method) & (F.col("round") <= until_round))


def write_generations(gen: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Generations partitioned by (model, round, target)."""
    w = gen.write.mode("overwrite").partitionBy(*[c for c in ("model", "round", "target") if c in gen.columns])
    if fmt == "csv":
        # texts come back as they are: quoted, inner quotes doubled, blanks at the ends kept
        w.options(header="true", quoteAll="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    else:
        w.parquet(path)
