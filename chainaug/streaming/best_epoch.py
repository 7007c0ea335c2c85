"""X1 as a stateful stream: the best epoch of every run, kept up to date while its log arrives.

The state of a run is a ring: the last ``n`` log rows of each of its folds (by ``seq``), whatever order and however often they
arrive.  From it a run's fold means (A1), composites (A2) and best position (A3) follow, and the run's row goes out
whenever that changes.  No table is read back; the state of a run is bounded by folds x n rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.selection import CRITERIA
from .epoch_log import LOG_SCHEMA

BEST = "run string, best_pos int, best_score double"
_ROW = [f.name for f in LOG_SCHEMA.fields if f.name not in ("run", "fold", "seq")]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTS = {"score_rouge12l": ("val_bleu", "val_rouge1", "val_rouge2", "val_rougeL"), "score_rougel": ("val_bleu", "val_rougeL")}


def _millionths(x: float) -> int:
    return 0 if math.isnan(x) else math.floor(x * 1e6 + 0.5)


def _mean(values: list) -> float | None:
    """Mean of six-digit values over those that are there: whole millionths, one division."""
    there = [v for v in values if v is not None]
    if not there:
        return None
    return math.floor(float(sum(map(_millionths, there))) / (len(there) * 1e6) * 1e6 + 0.5) / 1e6


def best_of(folds: dict[int, list[dict]], k: int, criterion: str) -> tuple[int, float] | None:
    """(position, score) of the first maximum over the positions that all ``k`` folds have; rows lie in order of seq."""
    best = None
    if len(folds) < k:
        return None
    for pos in range(max(map(len, folds.values()), default=0)):
        here = [rows[pos] for rows in folds.values() if pos < len(rows)]
        if len(here) != k:
            continue
        means = [_mean([r[m] for r in here]) for m in _PARTS[CRITERIA[criterion]]]
        if any(m is None for m in means):
            continue
        total = 0.0
        for i, m in enumerate(means):
            total = total + m if i else m
        score = math.floor(total * 1e6 + 0.5) / 1e6
        if best is None or score > best[1]:
            best = (pos, score)
    return best


def _plain(value):
    """A cell of a frame as a plain value; what is missing is None."""
    return None if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)) else value


def _order(row: tuple) -> tuple:
    return tuple((v is not None, v if v is not None else 0) for v in row)


class EpochRing(StatefulProcessor):
    """The last ``n`` rows of each fold of a run.  Of two rows with one (fold, seq) the smaller stays, whichever came first."""

    def __init__(self, n: int, k: int, criterion: str):
        self.n, self.k, self.criterion = n, k, criterion

    def init(self, handle: StatefulProcessorHandle) -> None:
        types = {f.name: f.dataType.simpleString() for f in LOG_SCHEMA.fields}
        self.rows = handle.getMapState("rows", "fold int, seq long", ", ".join(f"{c} {types[c]}" for c in _ROW))
        self.last = handle.getValueState("last", "pos int, score double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ring = {tuple(at): tuple(row) for at, row in self.rows.iterator()}
        before = dict(ring)
        for frame in rows:
            frame = frame.astype(object).where(frame.notna(), None)
            for r in frame.to_dict("records"):
                if r["fold"] is None or r["seq"] is None:
                    continue
                at, row = (int(r["fold"]), int(r["seq"])), tuple(_plain(r[c]) for c in _ROW)
                row = tuple(int(v) if v is not None and c in ("epoch", "data_length") else v for c, v in zip(_ROW, row))
                if at not in ring or _order(row) < _order(ring[at]):
                    ring[at] = row
            ring = self._trimmed(ring)
        for at in before.keys() - ring.keys():
            self.rows.removeKey(at)
        for at, row in ring.items():
            if before.get(at) != row:
                self.rows.updateValue(at, row)
        folds: dict[int, list] = {}
        for fold, seq in sorted(ring):
            folds.setdefault(fold, []).append(dict(zip(_ROW, ring[fold, seq])))
        best = best_of(folds, self.k, self.criterion)
        if best is not None and (not self.last.exists() or tuple(self.last.get()) != best):
            self.last.update(best)
            yield pd.DataFrame({"run": [key[0]], "best_pos": [best[0]], "best_score": [best[1]]})

    def _trimmed(self, ring: dict) -> dict:
        """Only the last ``n`` of each fold: an older row can never come back into a full ring."""
        seqs: dict[int, list] = {}
        for fold, seq in ring:
            seqs.setdefault(fold, []).append(seq)
        least = {fold: sorted(s)[-self.n :][0] for fold, s in seqs.items()}
        return {at: row for at, row in ring.items() if at[1] >= least[at[0]]}

    def close(self) -> None:
        pass


def best_epochs(log: DataFrame, n: int = 21, k: int = 5, criterion: str = "rouge12L") -> DataFrame:
    """The stream ``log`` (LOG_SCHEMA) as a stream of BEST rows, one for each change of a run's best epoch.  Rows without a run, a
    fold or a seq belong to no ring."""
    rows = log.where("run is not null").groupBy("run")
    return rows.transformWithStateInPandas(EpochRing(n, k, criterion), outputStructType=BEST, outputMode="Update", timeMode="None")


def _replace(best_dir: str):
    """Write each run's newest row over its folder; a replayed batch writes the same."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(best_dir)

    return run


def follow(spark: SparkSession, source_dir: str, best_dir: str, checkpoint: str, n: int = 21, k: int = 5, criterion: str = "rouge12L",
           files_per_trigger: int = 1, available_now: bool = True):
    """Start the stream from the files of ``source_dir`` to the table ``best_dir``.  Its state lies in the state store under ``checkpoint``
    (RocksDB, which keyed state needs; the setting holds for this query only)."""
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
    writer = best_epochs(stream, n, k, criterion).writeStream.outputMode("update").foreachBatch(_replace(best_dir))
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.set(_PROVIDER, before)


def read_best(spark: SparkSession, best_dir: str) -> DataFrame:
    return spark.read.schema(BEST).parquet(best_dir).select(F.col("run"), "best_pos", "best_score")
