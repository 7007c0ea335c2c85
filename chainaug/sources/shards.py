"""W2 export: rows in a given order as range-sharded files with a position index.

Shard k holds the rows between two positions, in order; the index says for each file its first position, the one
past its last, its rows and its bytes.  So a reader seeks: it opens the files that hold the positions it wants
and no other, and a training run that stopped at row p starts there."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

INDEX = "file string, first long, past long, n_rows long, bytes long"


def export_ordered(rows: DataFrame, position: str, folder: str, shards: int | None = None) -> DataFrame:
    """Write ``rows`` in order of the unique column ``position`` into ``folder``/data; returns the index, which is written last
    (``folder``/index): a folder without one is an export that has not finished.

    The index is read from the files' metadata and their position column alone."""
    spark = rows.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, position).sortWithinPartitions(position).write.parquet(f"{folder}/data")
    written = spark.read.parquet(f"{folder}/data").select(position, "_metadata.file_name", "_metadata.file_size")
    index = written.groupBy(F.col("file_name").alias("file")).agg(
        F.min(position).alias("first"), (F.max(position) + 1).alias("past"), F.count(F.lit(1)).alias("n_rows"), F.max("file_size").alias("bytes"))
    index.coalesce(1).sortWithinPartitions("first").write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def files_between(spark: SparkSession, folder: str, start: int = 0, stop: int | None = None) -> list[str]:
    """The files that hold positions from ``start`` up to ``stop``, in order (one name per file)."""
    index = read_index(spark, folder).where(F.col("past") > start)
    if stop is not None:
        index = index.where(F.col("first") < stop)
    return [f"{folder}/data/{r['file']}" for r in index.orderBy("first").select("file").collect()]


def _between(df: DataFrame, position: str, start: int, stop: int | None) -> DataFrame:
    df = df.where(F.col(position) >= start)
    return df if stop is None else df.where(F.col(position) < stop)


def read_between(spark: SparkSession, folder: str, position: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """The rows at positions from ``start`` up to ``stop``, from their files only (spread over tasks, in no order)."""
    files = files_between(spark, folder, start, stop)
    if not files:
        return spark.read.parquet(f"{folder}/data").limit(0)
    return _between(spark.read.parquet(*files), position, start, stop)


def rows_in_order(spark: SparkSession, folder: str, position: str, start: int = 0, stop: int | None = None) -> Iterator[Row]:
    """The rows themselves, one file after another (a file is sorted; the driver holds one partition of it at a time)."""
    for file in files_between(spark, folder, start, stop):
        yield from _between(spark.read.parquet(file), position, start, stop).orderBy(position).toLocalIterator()
