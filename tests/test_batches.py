"""Model-ready batches: padding, masks, labels, budgets and the placing of rows."""

import random

import pytest
from pyspark.sql import functions as F

from chainaug.operators import batches as B
from chainaug.operators.sequences import BOS, EOS, IGNORE, MASK, PAD, SO
from chainaug.session import materialize


@pytest.fixture(scope="module")
def encoded(spark):
    rng = random.Random(2)
    ids = lambda: [rng.randint(8, 99) for _ in range(rng.choice([0, 1, 3, 40]))]
    rows = [(p, 1000 + p % 7, ids(), ids(), ids(), [3], f"other {p}") for p in range(101)]
    return spark.createDataFrame(rows, "pos long, idx long, p1 array<int>, p2 array<int>, c array<int>, pre array<int>, bucket string").drop("bucket")


def plain_rows(encoded, max_len):
    """(family, pos) -> idx, input ids, labels, by plain lists."""
    out = {}
    for r in encoded.collect():
        out["encdec", r["pos"]] = r["idx"], ([BOS] + r["p1"] + [EOS] + r["p2"] + [EOS, MASK])[:max_len], ([BOS] + r["c"] + [EOS])[:max_len], PAD
        out["prefix", r["pos"]] = r["idx"], (r["pre"] + r["p1"] + [5] + r["p2"] + [EOS])[:max_len], (r["c"] + [EOS])[:max_len], PAD
        one = ([BOS] + r["p1"] + [6] + r["p2"] + [SO] + r["c"] + [EOS])[:max_len]
        out["causal", r["pos"]] = r["idx"], one, one, EOS
    return out


def check_batch(batch, rows):
    """A batch against the rows (idx, ids, labels, pad) that belong into it."""
    width, label_width = max(len(x[1]) for x in rows), max(len(x[2]) for x in rows)
    assert (batch["n_rows"], batch["width"], batch["label_width"]) == (len(rows), width, label_width)
    assert batch["keys"] == [x[0] for x in rows]
    assert batch["input_ids"] == [x[1] + [x[3]] * (width - len(x[1])) for x in rows]
    assert batch["attention_mask"] == [[1] * len(x[1]) + [0] * (width - len(x[1])) for x in rows]
    assert batch["labels"] == [x[2] + [IGNORE] * (label_width - len(x[2])) for x in rows]


@pytest.mark.parametrize("max_len", [256, 20])
def test_fixed_batches_hold_every_row_once_in_order(encoded, max_len):
    rows = plain_rows(encoded, max_len)
    got = B.fixed_batches(B.family_rows(encoded, "p1", "p2", "c", "pre", max_len), "pos", "idx", 8).collect()
    assert sorted((b["family"], b["batch_id"]) for b in got) == sorted((f, i) for f in B.FAMILIES for i in range(13))
    for b in got:
        places = range(b["batch_id"] * 8, min(b["batch_id"] * 8 + 8, 101))
        check_batch(b, [rows[b["family"], p] for p in places])
    assert {b["n_rows"] for b in got if b["batch_id"] == 12} == {5}


@pytest.mark.parametrize("budget, step", [(256, 32), (64, 8), (1, 16)])
def test_budget_batches_hold_every_row_once_within_the_budget(encoded, budget, step):
    rows, seen = plain_rows(encoded, 256), {}
    got = B.budget_batches(B.family_rows(encoded, "p1", "p2", "c", "pre", 256), "pos", "idx", budget, step).collect()
    for f in B.FAMILIES:
        buckets = {}
        for p in range(101):
            buckets.setdefault(-(-max(len(rows[f, p][1]), 1) // step) * step, []).append(p)
        for width, places in buckets.items():
            per = max(budget // width, 1)
            for i in range(0, len(places), per):
                seen[f, width, i // per] = places[i : i + per]
    assert sorted((b["family"], b["bucket"], b["batch_id"]) for b in got) == sorted(seen)
    for b in got:
        check_batch(b, [rows[b["family"], p] for p in seen[b["family"], b["bucket"], b["batch_id"]]])
        assert b["n_rows"] * b["width"] <= budget or b["n_rows"] == 1


def moves(df):
    """Exchanges of rows that carry ids, in the plan without adaptive execution."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = df.select("*")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return sum("Exchange hashpartitioning" in x for x in lines), lines


def test_ids_move_to_their_batch_once(encoded):
    one = B.fixed_batches(B.family_rows(B.with_batch(encoded, "pos", 8), "p1", "p2", "c", "pre", 256), "pos", "idx", 8)
    assert moves(one)[0] == 1
    two = B.fixed_batches(B.family_rows(encoded, "p1", "p2", "c", "pre", 256), "pos", "idx", 8)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    # stored by position, the rows of a budget take no exchange before the one to their batch
    stored = materialize(encoded.repartition(4, "pos"))
    _, lines = moves(B.budget_batches(B.family_rows(stored, "p1", "p2", "c", "pre", 256), "pos", "idx", 64))
    assert not any("Exchange" in x and "family" in x and "pos" in x and "batch_id" not in x for x in lines)


def test_repeated_positions_and_rows_that_are_their_own_target(spark):
    rows = [("f", p // 2, 10 + p, [p] * (p % 5 + 1), [p] * (p % 5 + 1) if p % 3 else [7], 0) for p in range(40)]
    df = spark.createDataFrame(rows, "family string, pos long, idx long, input_ids array<int>, labels array<int>, pad_id int")
    for b in B.fixed_batches(df, "pos", "idx", 4).collect():
        check_batch(b, [(r[2], r[3], r[4], r[5]) for r in rows if r[1] // 4 == b["batch_id"]])
    seen = [k for b in B.budget_batches(df, "pos", "idx", 64, 2).collect() for k in b["keys"]]
    alone = [p for p in range(40) if (p % 5 + 2) // 2 != ((p ^ 1) % 5 + 2) // 2]  # the other row of the position is in another bucket
    assert sorted(k for k in seen if k - 10 in alone) == [10 + p for p in alone]


def test_batches_of_no_rows(encoded):
    rows = B.family_rows(encoded.where("false"), "p1", "p2", "c", "pre", 256)
    assert B.fixed_batches(rows, "pos", "idx", 8).collect() == [] == B.budget_batches(rows, "pos", "idx", 64).collect()


def test_batches_without_a_window_or_a_single_partition(encoded):
    rows = B.family_rows(encoded, "p1", "p2", "c", "pre", 256, families=("causal",))
    plan = B.budget_batches(rows, "pos", "idx", 64)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" in plan
    text = B.fixed_batches(rows, "pos", "idx", 50).select(B.rows_text(F.col("attention_mask")).alias("m")).first()["m"]
    assert len(text.split(";")) == 50


def test_positions_take_no_literal_per_partition(spark):
    from chainaug.operators.numbering import positions, with_position

    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("key"))
    numbered, n = positions(df, ["key"], "pos", num_partitions=300)
    assert n == 5000 and numbered.where("pos <> key").isEmpty() and numbered.count() == 5000
    assert len(numbered._jdf.queryExecution().optimizedPlan().toString()) < 5000
    none, n = positions(df.where("false"), ["key"])
    assert n == 0 and none.columns == ["key", "pos"] and none.count() == 0
    assert with_position(df.withColumn("pos", F.lit("x")).drop("pos"), ["key"]).columns == ["key", "pos"]


def test_documents_are_bounded_by_bytes(spark):
    from chainaug.sources import html as HT

    rows = spark.range(0, 600).select((F.col("id") % 2).alias("k"), "id", F.expr("repeat('x', if(id = 7, 5000, 10))").alias("t"))
    docs = HT.bounded_documents(rows, ["k"], "id", ["t"], most_bytes=1000)
    sizes = [r[0] for r in docs.groupBy("k", "doc").agg(F.sum(F.length("t") + 19)).select("sum((length(t) + 19))").collect()]
    assert docs.count() == 600 and sorted(sizes)[-2] <= 1030 and max(sizes) <= 1000 + 5019
    order = [r["doc"] for r in docs.orderBy("k", "id").collect()]
    assert order == sorted(order)


def test_planning_a_checkpoint_leaves_the_session_as_it_was(spark):
    from chainaug.session import materialize

    seen = spark.conf.get("spark.sql.adaptive.enabled")
    stored = materialize(spark.range(0, 100).repartition(5, "id"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == seen
    joined = stored.groupBy("id").count()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("home", [1, 7, 1000])
def test_budget_rows_move_once_to_a_home(encoded, monkeypatch, home):
    monkeypatch.setattr(B, "HOME_ROWS", (home, home))
    stored = materialize(encoded.repartition(4, "idx"))
    args = ("p1", "p2", "c", "pre", 60)
    for budget, step in ((256, 32), (64, 8), (1, 16)):
        one = B.budget_family_batches(stored, *args, "pos", "idx", budget, step, near="idx")
        two = B.budget_batches(B.family_rows(stored, *args), "pos", "idx", budget, step)
        assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    _, lines = moves(B.budget_family_batches(stored, *args, "pos", "idx", 64, 8, near="idx"))
    ids = [x for x in lines if "Exchange" in x and "_home" in x]
    assert len(ids) == 1 and not any("Exchange" in x and "batch_id" in x and "_home" in x for x in lines)
    assert B.budget_family_batches(stored.where("false"), *args, "pos", "idx", 64, 8, near="idx").collect() == []


def test_budget_rows_of_repeated_positions(encoded):
    stored = materialize(encoded.union(encoded.where("pos % 5 = 0")).repartition(4, "idx"))
    one = B.budget_family_batches(stored, "p1", "p2", "c", "pre", 60, "pos", "idx", 64, 8, near="idx")
    seen = lambda df: sorted((r["family"], r["bucket"], r["batch_id"], r["n_rows"], r["keys"]) for r in df.collect())
    assert sum(r[3] for r in seen(one)) == 3 * (101 - 21 + 4 * 21)  # each copy meets the numbers of both
    assert seen(one) == seen(B.budget_batches(B.family_rows(stored, "p1", "p2", "c", "pre", 60), "pos", "idx", 64, 8))
