
import re

import pytest
from pyspark.sql import functions as F

from chainaug.operators import augment as A
from chainaug.operators import folds as K
from chainaug.operators import metrics as MT
from chainaug.operators import sequences as SQ
from chainaug.plans import all_queries as Q
from chainaug.sources import fixtures as X
from sf_paths import SF_MID, SF_SMALL


def test_folds_partition_valid_rows(spark):
    v = X.valid(spark, SF_MID)
    f = X.folds(spark, SF_MID)
    assert f.count() == v.count() == f.select("idx").distinct().count()
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_leakage_free_split_has_no_shared_idx(spark):
    t = A.training_set("ori_mix", X.valid(spark, SF_MID), X.generation(spark, SF_MID), True, 0.9, 0.99)
    splits = K.leakage_free_splits(t, X.folds(spark, SF_MID))
    for f in range(5):
        train, valid = (splits.where((F.col("f") == f) & (F.col("part") == p)) for p in ("train", "valid"))
        assert valid.count() > 0
        assert train.join(valid, "idx", "left_semi").count() == 0
        assert valid.where("round <> 0").count() == 0


def test_method_sizes_add_up(spark):
    v, g = X.valid(spark, SF_MID), X.generation(spark, SF_MID)
    n = {m: A.added_rows(m, v, g, True, 0.9, 0.99).count() for m in A.METHODS}
    assert n["aug_mix"] == n["ori_mix"] + n["aug_pair"]


def test_prefix_sizes_grow(spark):
    sizes = Q.QUERIES["augmentation_gain"](spark, SF_MID).collect()
    for m in A.METHODS:
        s = [r.n_rows for r in sorted((r for r in sizes if r.method == m), key=lambda r: r.until_round)]
        assert s == sorted(s) and len(s) == 3


def test_decode_encode_roundtrip(spark):
    v = X.valid(spark, SF_SMALL)
    vocab = SQ.build_vocab(v, ["premise_1", "premise_2", "conclusion"])
    e = SQ.encode_columns(v, "idx", {"conclusion": "ids"}, vocab)
    d = SQ.decode(e, "idx", "ids", vocab, "text")
    want = v.select("idx", F.array_join(SQ.ws_tokens(F.col("conclusion")), " ").alias("want"))
    assert d.join(want, "idx").where("text <> want").count() == 0


def test_encoding_deals_texts_and_distinct_tokens_only(spark):
    """No token is a row of its own; repeated keys share their ids, null keys and texts have none."""
    rows = [(i % 90 if i % 7 else None, f" a{i % 5}  b\tc{i} " + "x " * (i % 4), None if i % 11 == 3 else f"b a{i % 3} zz{i}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, s string, t string, i long")
    vocab = SQ.build_vocab(df.where("i < 150"), ["s", "t"])
    got = SQ.encode_columns(df, "k", {"s": "s_ids", "t": "t_ids"}, vocab)
    assert got.columns == ["k", "s", "t", "i", "s_ids", "t_ids"]
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    number = {r["token"]: r["id"] for r in vocab.collect()}
    items: dict = {}
    for k, s, t, _ in rows:
        if k is not None and t is not None:
            first, second = ([number.get(x, SQ.UNK) for x in text.split()] for text in (s, t))
            held = items.setdefault(k, ([], []))
            held[0].extend(enumerate(first))
            held[1].extend(enumerate(second, len(first)))
    want = {i: tuple([x for _, x in sorted(part)] for part in items.get(k, ([], []))) for k, _, _, i in rows}
    assert {r["i"]: (r["s_ids"], r["t_ids"]) for r in got.collect()} == want
    few = SQ.encode_columns(df, "k", {"s": "ids"}, vocab, keep=["i"], size=0)
    assert few.columns == ["i", "ids"] and few.count() == 200
    assert SQ.encode_columns(df.where("false"), "k", {"s": "ids"}, vocab).collect() == []
    assert SQ.encode_columns(df, "k", {"s": "ids"}, vocab.where("false"), keep=["ids", "k"]).where("exists(ids, x -> x <> 3)").isEmpty()


def test_whitespace_tokens_equal_split(spark):
    texts = ["", " ", "a", " a", "a ", "\t a \n\x0b b\f\r", "a  b", "\u00a0 x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", SQ.ws_tokens(F.col("t")).alias("w")).collect()
    assert all(r["w"] == [x for x in re.split("[ \t\n\r\f\x0b]+", r["t"]) if x] for r in got)


def test_identity_scores_are_one(spark):
    v = X.valid(spark, SF_SMALL).select(F.lit("id").alias("run"), "idx", F.col("conclusion").alias("generation"),
                                        F.col("conclusion").alias("label"))
    r = MT.rouge_scores(v, ["run"])
    assert r.where("rouge1 <> 1.0 OR rougeL <> 1.0").count() == 0
    long_enough = v.where(F.size(SQ.ws_tokens(F.col("label"))) >= 4)
    assert MT.corpus_bleu(long_enough, ["run"]).collect()[0].bleu == 1.0


PARTITION_CHECKED = ["kfold_assign", "ori_mix", "aug_mix", "corpus_bleu", "rouge_corpus", "embedding_f1_corpus",
                     "epoch_validation", "seeded_shuffle", "encode_ids"]


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_results_do_not_depend_on_partitioning(spark, parts):
    def run():
        return {n: sorted(tuple(r) for r in Q.QUERIES[n](spark, SF_SMALL).collect()) for n in PARTITION_CHECKED}

    base = run()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for n in PARTITION_CHECKED:
        assert got[n] == base[n], n


def test_group_positions_match_row_number(spark):
    from pyspark.sql import Window

    from chainaug.operators.numbering import with_group_position, with_position

    # one hot group holding most rows, plus small groups
    df = spark.range(5000).select(F.when(F.col("id") % 7 == 0, F.col("id") % 5).otherwise(F.lit(9)).alias("g"),
                                  (F.col("id") * 7919 % 5003).alias("k"))
    got = with_group_position(df, ["g"], ["k"]).select("g", "k", "pos")
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    glob = with_position(df, ["g", "k"], "p")
    assert sorted(r.p for r in glob.collect()) == list(range(5000))
