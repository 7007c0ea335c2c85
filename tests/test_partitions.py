"""Stored frames keep their partitioning through Python columns, and scoring leaves pairs where they lie."""

import pytest
from pyspark.sql import functions as F

from chainaug.functions.drop import drop_tokens
from chainaug.operators import metrics as MT
from chainaug.operators import sequences as SQ
from chainaug.operators.numbering import join_near
from chainaug.plans import all_queries as Q
from chainaug.plans import batch_queries as BQ
from chainaug.session import hash_partitions, materialize
from chainaug.sources import fixtures as X
from sf_paths import SF_SMALL


@pytest.fixture()
def stored(spark):
    rows = [(i % 40 if i % 9 else None, i, f"a{i % 7} b{i % 3} c{i} ", f"a{i % 5} x{i % 11}  b{i % 3}" if i % 8 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "idx long, round int, generation string, label string")
    return materialize(df.repartition(5, "idx"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_python_column_leaves_the_partitioning(spark, stored):
    dropped = materialize(stored.withColumn("d", drop_tokens(F.col("generation"), F.col("idx"), F.lit(3), whole=True)))
    assert hash_partitions(dropped, "idx") == 5
    assert "Exchange" not in plan_of(dropped.groupBy("idx").count())
    # told what is true: every row lies in the partition of its idx
    lies = dropped.select(F.spark_partition_id().alias("p"), F.pmod(F.hash("idx"), F.lit(5)).alias("h"))
    assert dropped.count() == 300 and lies.where("p <> h").isEmpty()
    # a renamed key, or a key made anew, is not the one that rows lie by
    for c in (F.col("idx") + 1, F.col("round").cast("long")):
        other = materialize(stored.withColumn("idx", c).withColumn("d", drop_tokens(F.col("generation"), F.col("idx"), F.lit(3), whole=True)))
        assert hash_partitions(other, "idx") is None


def test_scores_in_place_are_those_of_dealt_pairs(spark, stored):
    words = [(f"{c}{i}", (i * 7 + j) % 6) for j, c in enumerate("abcx") for i in range(11)] + [(None, 1)]
    vectors = [(k, [float(k + 1), float(k * k % 5), 1.0]) for k in range(4)] + [(4, None), (5, [1.0, None, 2.0])]
    coded = MT.CodedVectors(spark.createDataFrame(words, "token string, code long"), spark.createDataFrame(vectors, "code long, embedding array<double>"))
    table = coded.words.join(coded.vectors, "code").select("token", "embedding")
    carry = ["generation", "label"]
    want = MT.embedding_f1(stored, ["round"], table, stored=True, carry=carry)
    got = MT.embedding_f1(stored, ["round"], coded, stored=True, carry=carry)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "_bucket" not in plan  # no pair is dealt
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want) and got.count() == 300 and got.where("f1 > 0 and f1 < 1").count() > 50
    assert got.columns == want.columns
    assert hash_partitions(materialize(got.select("*")), "idx") == 5
    # without a partitioning, or with buckets asked for, they are dealt as before
    assert rows(MT.embedding_f1(stored.repartition(3), ["round"], coded, stored=True, carry=carry)) == rows(want)
    assert rows(MT.embedding_f1(stored, ["round"], coded, stored=True, carry=carry, buckets=4)) == rows(want)
    none = MT.CodedVectors(coded.words.where("false"), coded.vectors.where("false"))
    assert MT.embedding_f1(stored, ["round"], none, stored=True).where("f1 <> 0").isEmpty()


def test_generations_and_their_scores_lie_by_idx(spark):
    with X.query_scope():
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        for frame in (X.generated(spark, SF_SMALL), X.generation(spark, SF_SMALL), X.scored_generation(spark, SF_SMALL)):
            assert hash_partitions(frame, "idx") == n
    for name in ("band_filter", "pair_band_filter", "ori_mix", "aug_pair", "aug_mix"):
        assert "Exchange" not in plan_of(Q.QUERIES[name](spark, SF_SMALL)), name


def test_texts_are_encoded_where_they_lie(spark):
    rows = [(i, i % 13 if i % 9 else None, f" a{i % 5}  b\tc{i} " + "x " * (i % 4), None if i % 11 == 3 else f"b a{i % 3} zz{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "pos long, idx long, s string, t string")
    stored = materialize(df.repartition(5, "idx"))
    vocab = SQ.build_vocab(df.where("pos < 150"), ["s", "t"])
    cols = {"s": "s_ids", "t": "t_ids"}
    want = SQ.encode_columns(df, "pos", cols, vocab, keep=["pos", "idx"])
    got = SQ.encode_columns(stored, "pos", cols, vocab, keep=["pos", "idx"], by="idx")
    plan = plan_of(got)
    assert "CoGroups" not in plan and "_bucket" not in plan and "Exchange" not in plan
    ids = lambda x: sorted((r["pos"], r["idx"] or -1, r["s_ids"], r["t_ids"]) for r in x.collect())
    assert ids(got) == ids(want) and got.schema == want.schema
    some = lambda x: x.select("s_ids").where("exists(s_ids, x -> x > 8)").count()
    assert some(got) == some(want) > 0  # also where a plan needs no idx
    assert hash_partitions(materialize(got.select("*")), "idx") == 5
    assert ids(SQ.encode_columns(df, "pos", cols, vocab, keep=["pos", "idx"], by="idx")) == ids(want)  # not stored by idx: dealt
    assert SQ.encode_columns(stored, "pos", cols, vocab.where("false"), keep=["idx"], by="idx").where("exists(s_ids, x -> x <> 3)").isEmpty()


def test_batches_of_training_rows_move_ids_only(spark):
    """The training set is encoded without an exchange below the one that deals the ids to their batches."""
    with X.query_scope():
        encoded = BQ.encoded_rows(spark, SF_SMALL)
        assert "Exchange hash" not in plan_of(encoded) and hash_partitions(materialize(encoded.select("*")), "idx")


def test_repeated_rows_share_their_ids_as_before(spark, tmpdir_path):
    """Documents that repeat make positions that repeat; their texts are dealt by position."""
    for t in ("documents", "labels"):
        one = spark.read.parquet(f"{SF_SMALL}/{t}.parquet").where("doc_id < 60")
        one.union(one.where("doc_id < 30")).write.parquet(f"{tmpdir_path}/{t}.parquet")
    with X.query_scope():
        rows, apart = BQ.ordered_rows(spark, tmpdir_path)
        assert not apart and BQ.encoded_rows(spark, tmpdir_path).count() == rows.count()


def test_joins_near_an_idx_match_plain_ones(spark):
    left = spark.createDataFrame([(i % 4 if i % 5 else None, i % 3 if i % 7 else None, f"t{i % 2}", i) for i in range(60)], "idx long, k int, t string, x int")
    right = left.select("idx", "k", "t", (F.col("x") * 2).alias("y")).where("x % 3 = 0")
    for how in ("inner", "left_anti"):
        got = join_near(left, right, "idx", ["k", "t"], how)
        want = left.join(right, ["idx", "k", "t"], how)
        assert got.columns == ["idx", "k", "t", "x", *(["y"] if how == "inner" else [])]
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    stored = materialize(left.repartition(6, "idx"))
    near = join_near(stored, materialize(right.repartition(6, "idx")), "idx", ["k", "t"])
    assert "Exchange" not in plan_of(near)
