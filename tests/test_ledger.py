"""The generation ledger: a stopped run goes on, and nothing that was committed is made twice."""

import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chainaug.operators import chain as CH
from chainaug.operators import ledger as LG
from chainaug.operators.generate import generate_with_pandas
from chainaug.session import hash_partitions, materialize


@pytest.fixture()
def originals(spark):
    rows = [(i, i % 5, f"first {i} premise", f"second {i} one", f"so {i}") for i in range(60)]
    return spark.createDataFrame(rows, "idx long, fold int, premise_1 string, premise_2 string, conclusion string")


def counting(folder):
    """A generator that leaves a file per call, named by the rows it was given."""

    def generator(fold: int, rows: pd.DataFrame) -> pd.Series:
        assert "label" not in rows.columns and set(rows["fold"]) == {fold}
        assert list(rows["input"].str.len()) == sorted(rows["input"].str.len())
        for r in rows.itertuples():
            open(os.path.join(folder, f"{r.round}-{r.target}-{r.idx}-{uuid.uuid4().hex}"), "w").close()
        return rows["input"].str.upper()

    return lambda rows: generate_with_pandas(rows, generator)


def calls(folder):
    return sorted("-".join(f.split("-")[:3]) for f in os.listdir(folder))


EVERY = sorted(f"{r}-{t}-{i}" for r in (1, 2) for t in ("prem1", "prem2") for i in range(60))


@pytest.mark.parametrize("stops", [[0], [1], [3, 0, 2], [5, 4]])
def test_a_stopped_chain_makes_only_the_rest(spark, originals, tmpdir_path, stops):
    calls_in, store = os.path.join(tmpdir_path, "calls"), os.path.join(tmpdir_path, "ledger")
    os.mkdir(calls_in)
    ledger = LG.Ledger(spark, store, counting(calls_in), "upper", chunk_rows=25)
    for n in stops:
        before = len(calls(calls_in))
        ledger.chunks_left = n
        with pytest.raises(LG.Stopped):
            CH.chain(originals, 2, ledger=ledger)
        assert (len(calls(calls_in)) > before) == (n > 0)
    assert len(ledger.committed()) == sum(stops)
    ledger.chunks_left = None
    got = CH.chain(originals, 2, ledger=ledger)
    assert calls(calls_in) == EVERY  # each row once over all the runs
    want = CH.chain(originals, 2, pandas_generator=lambda fold, rows: rows["input"].str.upper())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    CH.chain(originals, 2, ledger=ledger)
    assert calls(calls_in) == EVERY  # and a finished chain makes nothing


def test_a_killed_chunk_is_not_counted(spark, originals, tmpdir_path):
    calls_in, store = os.path.join(tmpdir_path, "calls"), os.path.join(tmpdir_path, "ledger")
    os.mkdir(calls_in)

    def failing(fold, rows):
        if (rows["idx"] == 41).any():
            raise RuntimeError("the worker is gone")
        return rows["input"]

    ledger = LG.Ledger(spark, store, lambda rows: generate_with_pandas(rows, failing), "upper", chunk_rows=30)
    with pytest.raises(Exception, match="the worker is gone"):
        CH.chain(originals, 1, ledger=ledger)
    stored = ledger.stored()
    assert stored.where("idx = 41").isEmpty()
    before = stored.count()
    ledger.generate = counting(calls_in)
    assert CH.chain(originals, 1, ledger=ledger).count() == 120
    assert len(calls(calls_in)) == 120 - before


def test_changed_inputs_and_generators_are_work_of_their_own(spark, originals, tmpdir_path):
    rows = originals.select(F.lit(1).alias("round"), F.lit("prem1").alias("target"), "idx", "fold", F.col("premise_2").alias("input"))
    upper = LG.Ledger(spark, tmpdir_path, lambda r: r.withColumn("generation", F.upper("input")), "upper")
    assert (upper.run(rows), upper.run(rows)) == (60, 0)
    changed = rows.withColumn("input", F.when(F.col("idx") < 5, F.concat("input", F.lit("!"))).otherwise(F.col("input")))
    assert upper.run(changed) == 5
    other = LG.Ledger(spark, tmpdir_path, lambda r: r.withColumn("generation", F.reverse("input")), "reverse")
    assert other.run(rows) == 60
    assert {r["generation"] for r in upper.generated(changed).where("idx = 3").collect()} == {"SECOND 3 ONE!"}
    # repeated rows are made once and both get the text; a null input is made like an empty one
    twice = rows.union(rows).union(rows.limit(1).withColumn("idx", F.lit(99).cast("long")).withColumn("input", F.lit(None).cast("string")))
    assert upper.run(twice) == 1 and upper.generated(twice).count() == 121
    assert upper.generated(rows.where("false")).count() == 0


def test_work_is_kept_once_and_only_while_it_is_done(spark, originals, tmpdir_path):
    """A run stores the prompts of its work once, not the labels, and removes them; texts stored by idx are not dealt for the ledger."""
    seen = []

    def watching(rows):
        work = os.path.join(store, "work")
        seen.append((rows.columns, len(os.listdir(work)) if os.path.exists(work) else 0, "Exchange" in rows._jdf.queryExecution().executedPlan().toString()))
        return rows.withColumn("generation", F.upper("input"))

    store = os.path.join(tmpdir_path, "ledger")
    ledger = LG.Ledger(spark, store, watching, "upper", chunk_rows=25)
    ledger.chunks_left = 2
    stored = materialize(originals.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "idx"))
    with pytest.raises(LG.Stopped):
        CH.chain(stored, 1, ledger=ledger)
    assert not os.listdir(os.path.join(store, "work"))
    ledger.chunks_left = None
    done = CH.chain(stored, 1, ledger=ledger)
    assert done.count() == 120 and hash_partitions(done, "idx") and not os.listdir(os.path.join(store, "work"))
    assert all(n == 1 and not dealt and not {"label", "conclusion"} & set(columns) for columns, n, dealt in seen) and len(seen) >= 5


def test_keys_that_share_an_idx_or_have_none(spark, tmpdir_path):
    rows = spark.createDataFrame([(r, t, i, f"{r} {t} {i} {k}") for r in (1, 2) for t in ("a", "b", None) for i in (1, 2, None) for k in range(3)],
                                 "round int, target string, idx long, input string")
    ledger = LG.Ledger(spark, tmpdir_path, lambda x: x.withColumn("generation", F.upper("input")), "upper")
    assert ledger.run(rows) == 54
    got = ledger.generated(rows)  # a null key meets none
    assert sorted(r["generation"] for r in got.collect()) == sorted(f"{r} {t} {i} {k}".upper() for r in (1, 2) for t in "ab" for i in (1, 2) for k in range(3))
    assert got.where("generation <> upper(input)").isEmpty()
