"""P1 / K1 / W2 / W3 building block: exact global positions without a single-partition window.

Two passes, the zipWithIndex recipe in DataFrame form:
 1. range-partition on the (unique) order key, sort inside each partition and stamp
    ``monotonically_increasing_id`` (partition id in the high bits, local row in the low 33 bits);
    the result is checkpointed so partition contents are fixed;
 2. count rows per partition (one small job; the driver receives one number per partition,
    never rows), turn the counts into running offsets, and add the offset to the local row.

Global ``row_number() over (order by k)`` would move every row into one task; this keeps the
work spread over all range partitions.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_LOCAL_BITS = 33


def with_position(df: DataFrame, order: list, pos_col: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """Add ``pos_col`` = 0-based position of each row in the total order ``order``.

    ``order`` must be unique (append a key column to break ties)."""
    return positions(df, order, pos_col, num_partitions)[0]


def positions(df: DataFrame, order: list, pos_col: str = "pos", num_partitions: int | None = None):
    """(``df`` with ``pos_col``, total row count)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    ranged = materialize(ranged)
    pid = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    counts = dict(
        (r["_pid"], r["_n"])
        for r in ranged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n")).collect()
    )
    numbers = sorted(counts)
    begins = accumulate((counts[i] for i in numbers), initial=0)
    offsets = spark.createDataFrame(list(zip(numbers, begins)), "_pid long, _offset long")
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    placed = ranged.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid")  # one row per partition
    return placed.select(*df.columns, (F.col("_offset") + local).alias(pos_col)), sum(counts.values())


def with_running_start(df: DataFrame, order: list, weight: str, start_col: str = "start") -> DataFrame:
    """Add ``start_col`` = sum of ``weight`` over the rows before each row in the total order ``order``.

    The same two passes with sums in place of counts: running sums inside range partitions, plus the
    sum of the partitions before.  Meant for narrow rows (keys and weights)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.shiftright(F.monotonically_increasing_id(), _LOCAL_BITS)
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("_part", part))
    sums = ranged.groupBy("_part").agg(F.sum(weight).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return running.join(F.broadcast(sums), "_part").withColumn(start_col, F.col("_before") + F.col("_inside")).drop(
        "_part", "_inside", "_before")


def join_near(left: DataFrame, right: DataFrame, near: str, keys: list, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on (near, keys), with the columns of ``left`` and the further ones of ``right``.

    Only ``near`` deals rows out, so that a side that lies by it stays there (a join on several columns would deal both sides anew); a
    value of ``near`` should have few keys, which are compared in its join."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in [near, *keys]})
    same = [F.col(near) == F.col(f"_{near}")]
    for k in keys:
        same += [F.col(k) <= F.col(f"_{k}"), F.col(k) >= F.col(f"_{k}")]  # an equality would deal by it too
    return left.join(right, reduce(and_, same), how).drop(*[f"_{k}" for k in [near, *keys]])


def fold_of_position(pos: Column, n: Column | int, k: int) -> Column:
    """ntile(k) - 1 of a 0-based position among n rows: the first n mod k folds get one more row."""
    n = F.lit(n) if not isinstance(n, Column) else n
    q = F.floor(n / F.lit(k)).cast("long")
    r = (n % F.lit(k)).cast("long")
    big = r * (q + 1)
    return (
        F.when(pos < big, F.floor(pos / (q + 1)))
        .otherwise(r + F.floor((pos - big) / F.greatest(q, F.lit(1))))
        .cast("int")
    )


def with_group_position(df: DataFrame, keys: list, order: list, pos_col: str = "pos") -> DataFrame:
    """0-based position inside each group of ``keys`` under ``order`` without a window per group
    (a hot group would land in one task): global positions over (keys, order), minus each group's
    first position (one small aggregate joined back)."""
    g = with_position(df, [*keys, *order], "_gpos")
    starts = g.groupBy(*keys).agg(F.min("_gpos").alias("_start"))
    return g.join(starts, keys).withColumn(pos_col, F.col("_gpos") - F.col("_start")).drop("_gpos", "_start")
