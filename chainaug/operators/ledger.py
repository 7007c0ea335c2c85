"""A ledger of generations, so that a stopped run goes on where it stopped.

A generation is stored under its round, target and idx and the digest of what it was made from (the generator's name and
the input).  The work of a run is its input anti-joined with the ledger; it is cut into chunks, and each
chunk is generated by its own job and counts from the moment that job has committed.  A run that is killed, or started
twice, makes anew only what had not been committed; a changed input or generator is work of its own."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import join_near

KEYS = ["round", "target", "idx", "digest"]
_BESIDE_IDX = ["round", "target", "digest"]
LEDGER = "round int, target string, idx long, digest string, generation string"


class Stopped(Exception):
    """A run that was told to stop after a number of chunks, with work left."""


class Ledger:
    """Generations in ``folder`` (in a store that all executors share).  ``generate(rows)`` adds the column
    ``generation`` to rows; ``name`` says which generator and version that is."""

    def __init__(self, spark: SparkSession, folder: str, generate: Callable[[DataFrame], DataFrame], name: str, chunk_rows: int = 1_000_000):
        self.spark, self.folder, self.generate, self.name, self.chunk_rows = spark, folder.rstrip("/"), generate, name, chunk_rows
        self.chunks_left: int | None = None  # chunks that may still be made, None for any number

    def digest(self, text: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{self.name}\n"), F.coalesce(text, F.lit(""))).cast("binary"), 256)

    def committed(self) -> list[str]:
        """The folders of chunks whose jobs have committed: one name per chunk, no rows."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/chunks/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(str(f.getPath().getParent()) for f in found or [])

    def _read(self) -> DataFrame:
        """The committed rows, dealt by idx: grouping by the keys moves them no more, nor does a join with rows that lie by idx."""
        paths = self.committed()
        if not paths:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(*paths).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "idx")

    def stored(self) -> DataFrame:
        """One row per key; where two runs made the same work, the smaller text."""
        return self._read().groupBy(*KEYS).agg(F.min("generation").alias("generation"))

    def run(self, rows: DataFrame) -> int:
        """Generate what the ledger lacks of ``rows(round, target, idx, input, ...)``, a committed chunk at a time;
        returns the number of rows made."""
        keyed = rows.withColumn("digest", self.digest(F.col("input"))).dropDuplicates(KEYS)
        todo = join_near(keyed, self._read().select(KEYS), "idx", _BESIDE_IDX, "left_anti")
        made = todo.count()
        n_chunks = -(-made // self.chunk_rows)
        work = f"{self.folder}/work/{uuid.uuid4().hex}"
        try:
            if n_chunks > 1:
                # a chunk's rows lie together, so that a chunk reads itself only
                chunked = todo.withColumn("chunk", F.pmod(F.xxhash64(*KEYS), F.lit(n_chunks)))
                chunked.write.partitionBy("chunk").option("compression", "zstd").parquet(work)
                todo = self.spark.read.parquet(work)
            for chunk in range(n_chunks):
                if self.chunks_left is not None:
                    if not self.chunks_left:
                        raise Stopped(f"{n_chunks - chunk} of {n_chunks} chunks left")
                    self.chunks_left -= 1
                part = todo.where(F.col("chunk") == chunk).drop("chunk") if n_chunks > 1 else todo
                # rows of like length meet in a generator's batches
                ordered = part.withColumn("input_length", F.length("input")).sortWithinPartitions("input_length", *KEYS).drop("input_length")
                out = self.generate(ordered).select(
                    F.col("round").cast("int").alias("round"), "target", F.col("idx").cast("long").alias("idx"), "digest", "generation")
                out.write.option("compression", "zstd").parquet(f"{self.folder}/chunks/{uuid.uuid4().hex}")
        finally:
            # what is left is found anew by the next run
            path = self.spark._jvm.org.apache.hadoop.fs.Path(work)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return made

    def generated(self, rows: DataFrame, needs: list | None = None) -> DataFrame:
        """``rows`` with their ``generation``: what is stored, after the rest has been made from the columns ``needs`` (all unless given)."""
        self.run(rows.select(needs) if needs else rows)
        keyed = rows.withColumn("digest", self.digest(F.col("input")))
        return join_near(keyed, self.stored(), "idx", _BESIDE_IDX).drop("digest")
