"""Ordered exports, length quantiles, digests and lookups."""

import math

import pytest
from pyspark.sql import functions as F

from chainaug.operators import augment as A
from chainaug.operators import profile as PR
from chainaug.sources import shards as SH


@pytest.fixture()
def export(spark, tmpdir_path):
    rows = spark.range(0, 1000).select(((F.col("id") * 37) % 1000).alias("pos"), F.concat(F.lit("row "), (F.col("id") * 37) % 1000).alias("text"))
    folder = f"{tmpdir_path}/export"
    SH.export_ordered(rows, "pos", folder, shards=9)
    return folder


def test_shards_follow_each_other(spark, export):
    index = SH.read_index(spark, export).orderBy("first").collect()
    assert 5 <= len(index) <= 9 and index[0]["first"] == 0 and index[-1]["past"] == 1000
    assert all(a["past"] == b["first"] for a, b in zip(index, index[1:]))
    assert all(r["n_rows"] == r["past"] - r["first"] and r["bytes"] > 0 for r in index)


@pytest.mark.parametrize("start, stop", [(0, None), (500, None), (371, 372), (100, 640), (999, None), (1000, None), (5, 5)])
def test_rows_come_back_in_order_from_any_position(spark, export, start, stop):
    want = [f"row {p}" for p in range(start, 1000 if stop is None else stop)]
    assert [r["text"] for r in SH.rows_in_order(spark, export, "pos", start, stop)] == want
    assert sorted(r["text"] for r in SH.read_between(spark, export, "pos", start, stop).collect()) == sorted(want)


def test_a_seek_opens_only_the_files_it_needs(spark, export):
    every = SH.files_between(spark, export)
    assert len(SH.files_between(spark, export, 371, 372)) == 1 < len(every)
    assert SH.files_between(spark, export, 500) == every[len(every) - len(SH.files_between(spark, export, 500)):]
    plan = SH.read_between(spark, export, "pos", 371, 372)
    assert len(plan.inputFiles()) == 1


def test_an_export_without_rows(spark, tmpdir_path):
    rows = spark.createDataFrame([], "pos long, text string")
    assert SH.export_ordered(rows, "pos", f"{tmpdir_path}/none").count() == 0
    assert list(SH.rows_in_order(spark, f"{tmpdir_path}/none", "pos")) == [] == SH.read_between(spark, f"{tmpdir_path}/none", "pos").collect()


@pytest.fixture()
def sets(spark):
    rows = [("original", 0, " ".join(["w"] * (i % 50)), None if i % 9 == 0 else "a b", f"c{i}") for i in range(200)]
    rows += [("prem1", 1 + i % 3, " ".join(["w"] * (i % 120)), "x", "y  z ") for i in range(300)]
    return spark.createDataFrame(rows, "source string, round int, premise_1 string, premise_2 string, conclusion string")


def test_quantiles_of_merged_histograms_are_exact(sets):
    cols = ["premise_1", "premise_2", "conclusion"]
    hist = A.round_prefixes(PR.length_histograms(sets, ["source", "round"], cols), 3)
    got = {(r["until_round"], r["text_col"]): r for r in PR.length_quantiles(hist, ["until_round", "text_col"], (1, 50, 95, 99, 100)).collect()}
    rows = sets.collect()
    for until in (1, 2, 3):
        for c in cols:
            sizes = sorted(len((r[c] or "").split()) for r in rows if r["round"] <= until)
            r = got[until, c]
            assert (r["n_rows"], r["max_tokens"]) == (len(sizes), sizes[-1])
            for q in (1, 50, 95, 99, 100):
                assert r[f"p{q}"] == sizes[math.ceil(len(sizes) * q / 100) - 1]


def test_sketches_are_close_and_merge(sets):
    parts = PR.length_sketches(sets, ["source", "round"], ["premise_1"])
    got = PR.sketch_quantiles(parts, ["text_col"]).first()
    sizes = sorted(len(r["premise_1"].split()) for r in sets.collect())
    assert (got["n_rows"], got["max_tokens"]) == (500, sizes[-1])
    for q in (50, 95, 99):
        rank = [i for i, s in enumerate(sizes) if s == got[f"p{q}"]]
        assert rank and min(abs(i / 500 - q / 100) for i in rank) < 0.03


def test_digest_counts_equal_row_counts(spark):
    rows = [(0, 1, "a", None), (0, 1, "a", ""), (1, 1, "a", None), (2, 2, "b", "x"), (3, 2, "b", "x"), (1, 3, "1:a", "-"), (2, 3, "1:a", None)]
    df = spark.createDataFrame(rows, "round int, idx long, text string, other string")
    got = {r["until_round"]: (r["n_dedup"], r["n_original"], r["gain_dedup"]) for r in PR.dedup_sizes(
        PR.row_digests(df, ["round"], ["idx", "text", "other"]), [], 3).collect()}
    assert got == {i: (n := len({r[1:] for r in rows if r[0] <= i}), 2, n - 2) for i in (1, 2, 3)}


def test_rows_of_one_digest_that_differ_are_an_error(spark):
    df = spark.createDataFrame([(0, bytearray(b"same"), 1), (1, bytearray(b"same"), 2)], "round int, digest binary, witness long")
    with pytest.raises(Exception, match="two different rows"):
        PR.dedup_sizes(df, [], 3).collect()


def test_lookup_reads_only_the_rows_asked_for(spark):
    valid = spark.createDataFrame([(i, f"p{i}", f"q{i}") for i in range(20)], "idx long, premise_1 string, premise_2 string")
    gen = spark.createDataFrame([(i, r, t, f"{t}-{r}-{i}") for i in range(20) for r in (1, 2) for t in ("prem1", "prem2") if i != 4 or t == "prem1"],
                                "idx long, round int, target string, generation string")
    asked = A.lookup(valid, gen, [3, 4, 99])
    assert sorted(map(tuple, asked.collect())) == [(3, r, "p3", f"prem1-{r}-3", "q3", f"prem2-{r}-3") for r in (1, 2)]
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    joins = [i for i, line in enumerate(plan.splitlines()) if "Join" in line]
    assert joins and sum("Filter" in line and "99" in line or "3,4,99" in line for line in plan.splitlines()[joins[0]:]) >= 2
    ids = spark.createDataFrame([(3,), (4,), (3,)], "idx long")
    assert sorted(map(tuple, A.lookup(valid, gen, ids).collect())) == sorted(map(tuple, asked.collect()))
    assert A.lookup(valid, gen).count() == 38 and A.lookup(valid, gen, []).count() == 0
