"""Session helpers: a local session for tests/bench and the checkpoint folder rule."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8, app: str = "chainaug") -> SparkSession:
    """Local session used by tests and bench.  On a cluster the caller owns the session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # small local inputs: let coalescing keep one partition per core for CPU-heavy stages
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when nothing is configured and the master is local (tests, bench) do we pick a
    fresh folder under /tmp; on a cluster an unset folder is an error, never a local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        try:
            conf = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            conf = None
    if conf:
        sc.setCheckpointDir(conf)
        return conf
    if sc.master.startswith("local"):
        local = tempfile.mkdtemp(prefix="chainaug-ckpt-", dir="/tmp")
        sc.setCheckpointDir(local)
        return local
    raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (once per application), so that Python workers can import
    it wherever the driver was started.  The same as ``--py-files`` with a zip of the folder."""
    sc = spark.sparkContext
    with _SHIP_LOCK:
        if sc.applicationId in _SHIPPED:
            return
        here = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="chainaug-zip-"), "chainaug")
        sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
        _SHIPPED.add(sc.applicationId)


_MATERIALIZE_LOCK = threading.RLock()
_ADAPTIVE = "spark.sql.adaptive.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    The plan is made with adaptive execution off: an adaptive plan reports no output partitioning before
    it runs, so the checkpointed scan would forget that the data is already hash-partitioned (and
    co-partitioned joins on it would shuffle again).  Only the planning sees that setting, for some
    milliseconds; the job, and what other threads plan meanwhile, run as configured.  Python columns do not
    move rows either, but Spark forgets the partitioning below them; the stored frame is told it again."""
    checkpoint_dir(df.sparkSession)
    lies = _planned_lies(df)
    stored = df.checkpoint(eager=True)
    if lies is None or stored.columns.count(lies[0]) != 1 or hash_partitions(stored, lies[0]):
        return stored
    return _told(stored, *lies)


def _planned_lies(df: DataFrame) -> tuple[str, int] | None:
    """``_lies`` of the plan without adaptive execution."""
    with _MATERIALIZE_LOCK:  # a session setting: one planning at a time
        before = df.sparkSession.conf.get(_ADAPTIVE)
        df.sparkSession.conf.set(_ADAPTIVE, "false")
        try:
            return _lies(df._jdf.queryExecution().executedPlan())
        finally:
            df.sparkSession.conf.set(_ADAPTIVE, before)


#: operators that leave every row in its partition
_STAYS = ("ProjectExec", "FilterExec", "GenerateExec", "ArrowEvalPythonExec", "BatchEvalPythonExec", "WholeStageCodegenExec", "InputAdapter")


def _lies(plan) -> tuple[str, int] | None:
    """The column of a physical plan's output that its rows are hash-partitioned by, and the number of partitions; None if not known."""
    output = {str(a).removesuffix("L") for a in (plan.output().apply(i) for i in range(plan.output().size()))}
    while True:
        known = re.findall(r"hashpartitioning\((\w+)(#\d+)L?, (\d+)\)", plan.outputPartitioning().toString())
        if known:  # of the sides of a join, any that is in the output
            return next(((name, int(parts)) for name, number, parts in known if name + number in output), None)
        if plan.getClass().getSimpleName() not in _STAYS:
            return None
        plan = plan.child()


def _told(stored: DataFrame, column: str, parts: int) -> DataFrame:
    """A checkpointed frame whose scan reports that it is hash-partitioned by ``column``."""
    spark, plan = stored.sparkSession, stored._jdf.logicalPlan()
    sql, none = spark._jvm.org.apache.spark.sql, spark._jvm.scala.Option.empty()
    at = stored.columns.index(column)
    hashed = sql.catalyst.plans.physical.HashPartitioning(plan.output().slice(at, at + 1), parts)
    told = sql.execution.LogicalRDD(plan.output(), plan.rdd(), hashed, plan.outputOrdering(), False, none, spark._jsparkSession, none, none)
    return type(stored)(sql.classic.Dataset.ofRows(spark._jsparkSession, told), spark)


def hash_partitions(df: DataFrame, key: str) -> int | None:
    """The number of partitions of a frame that is known to be hash-partitioned by ``key`` alone, else None."""
    lies = _planned_lies(df.select("*"))
    return lies[1] if lies and lies[0] == key else None
