"""Reading the given tables and cutting lineage with written tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package

#: rows of text in one Arrow batch: Python workers hold a batch and what they make of it
BATCH_ROWS = "1000"


def prepare(spark: SparkSession) -> None:
    """What every operator needs of a session: the package on the executors, and Arrow batches that
    fit whole texts (a smaller setting of the user stays)."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= int(BATCH_ROWS):
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the checkpoint folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


class Stage:
    """Tables written once and read by several later steps; ``drop`` frees those no longer needed.

    A written Parquet table survives lost executors and, unlike a checkpoint, is pruned by column."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._staged_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        delete(self.spark, df._staged_path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's own file-system layer (any store)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def semi_join_texts(docs: DataFrame, ids: DataFrame, key: str, n_ids: int, how: str = "left_semi", broadcast_ids: int = 2_000_000) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in ``ids`` (``n_ids`` rows, counted by the caller), or with
    ``how='left_anti'`` is not.

    Up to ``broadcast_ids`` ids (8 bytes each) the ids go to the rows; beyond it both sides are
    shuffled.  Both ways give the same rows."""
    side = F.broadcast(ids) if n_ids <= broadcast_ids else ids.hint("shuffle_hash")
    return docs.join(side, key, how)
