"""Replicate vectors against a plain bootstrap, and their cost against the number of pairs."""

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainaug.operators import bootstrap as BS
from chainaug.operators import metrics as MT


def draw(seed, b, name):
    u = int(md5(f"{seed}:{(b - 1) // 4}:{name}".encode()).hexdigest()[8 * ((b - 1) % 4) : 8 * ((b - 1) % 4) + 8], 16)
    return next((k for k, bound in enumerate(BS.poisson_bounds()) if u < bound), 12)


def test_weights_are_poisson_draws_of_the_pair_alone():
    names = [f"run:{i}" for i in range(50)]
    w = BS.weights(names, 10, 7)
    assert w.tolist() == [[draw(7, b, n) for b in range(1, 11)] for n in names]
    many = BS.weights([str(i) for i in range(4000)], 100, 1)
    assert abs(many.mean() - 1) < 0.01 and abs(many.var() - 1) < 0.02


@pytest.mark.parametrize("partitions", [1, 7])
def test_sums_equal_a_plain_loop(spark, partitions):
    rows = [("a" if i % 3 else "b", i, i * i, 5 - i) for i in range(60)]
    df = spark.createDataFrame(rows, "run string, idx long, x long, y long").repartition(partitions)
    got = {(r["run"], r["b"]): (r["weight"], r["x"], r["y"]) for r in BS.replicate_sums(df, ["run"], ["x", "y"], 9, 3).collect()}
    want = {}
    for run, idx, x, y in rows:
        for b in range(1, 10):
            w, old = draw(3, b, f"{run}:{idx}"), want.get((run, b), (0, 0, 0))
            want[run, b] = (old[0] + w, old[1] + w * x, old[2] + w * y)
    assert got == want


def test_groups_with_null_keys_and_none_at_all(spark):
    df = spark.createDataFrame([(None, 1, 4), (None, 2, 6), ("a", 1, 5)], "run string, idx long, x long")
    assert {r["run"] for r in BS.replicate_sums(df, ["run"], ["x"], 5).collect()} == {None, "a"}
    assert BS.replicate_sums(df, [], ["x"], 5).count() == 5
    assert BS.replicate_sums(df.where("false"), ["run"], ["x"], 5).count() == 0


def test_what_is_shuffled_does_not_grow_with_the_pairs(spark):
    for n in (1000, 20_000):
        df = spark.range(0, n, 1, 4).select(F.lit("r").alias("run"), F.col("id").alias("idx"), (F.col("id") % 7).alias("x"))
        partial = df.select("run", "idx", "x")
        sums = BS.replicate_sums(partial, ["run"], ["x"], 20)
        assert sums.count() == 20
        plan = sums._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "MapInArrow" in plan


def test_intervals_hold_the_corpus_values(spark):
    texts = ["the cat sat on the mat today", "a dog ran over the hill at noon", "birds fly south when winter comes near"]
    pairs = spark.createDataFrame(
        [("r", i, texts[i % 3] if i % 4 else texts[i % 3].replace("the", "one"), texts[i % 3] + (" again" if i % 5 == 0 else "")) for i in range(80)],
        "run string, idx long, generation string, label string")
    got = {r["metric"]: r for r in MT.bootstrap(pairs, ["run"], replicates=60).collect()}
    assert set(got) == {"rouge1", "rouge2", "rougeL", "bleu"}
    centre = MT.rouge_corpus(MT.rouge_scores(pairs, ["run"]), ["run"]).first().asDict() | MT.corpus_bleu(pairs, ["run"]).first().asDict()
    for metric, r in got.items():
        assert r["q025"] < r["q500"] < r["q975"] and r["q025"] <= centre[metric] <= r["q975"]
        assert abs(r["q500"] - centre[metric]) < 0.05
    assert np.isfinite([r["q975"] for r in got.values()]).all()
