"""Hand-made fixtures for the traps listed in FIXTURES.md section 3."""

import math
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from chainaug.functions.lcs import lcs_length
from chainaug.operators import augment as A
from chainaug.operators import folds as K
from chainaug.operators import metrics as MT
from chainaug.operators import selection as S
from chainaug.operators import sequences as SQ
from chainaug.sources import files as FS
from chainaug.sources import html as HT
from chainaug.sources import sinks


def test_band_is_strict_and_rejects_null_nan(spark):
    df = spark.createDataFrame([(1, 0.95), (2, 0.99), (3, 0.96), (4, None), (5, float("nan")), (6, 0.9899)], "idx int, f1 double")
    got = sorted(r.idx for r in df.where(A.band(F.col("f1"), 0.95, 0.99)).collect())
    assert got == [3, 6]
    with pytest.raises(ValueError):
        A.band(F.col("f1"), 0.99, 0.95)


def test_filtering_switch():
    assert A.parse_filtering("true") is True and A.parse_filtering("false") is False
    with pytest.raises(ValueError):
        A.parse_filtering("yes")


@pytest.mark.parametrize("n", [0, 1, 4, 5, 7, 332])
def test_fold_sizes_match_ntile(spark, n):
    df = spark.range(n).withColumnRenamed("id", "idx")
    f = K.assign_folds(df, k=5).groupBy("fold").count().collect()
    sizes = sorted((r["count"] for r in f), reverse=True)
    q, r = divmod(n, 5)
    want = [q + 1] * r + [q] * (5 - r)
    assert sizes == [s for s in want if s > 0]


def test_folds_hash_mode_partitions_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "idx")
    f = K.assign_folds(df, k=5, mode="hash")
    assert f.count() == 1000 and f.select("idx").distinct().count() == 1000


def _logs(spark):
    rows = []
    for fold in range(5):
        for seq in range(25):
            v = 0.1 + 0.01 * min(seq, 10)  # plateau from seq 10: ties
            rows.append(Row(run="r", fold=fold, seq=seq, epoch=seq - 1, val_bleu=v, val_rouge1=v, val_rouge2=v,
                            val_rougeL=v, val_loss=1.0 - v, data_length=10))
    return spark.createDataFrame(rows)


def test_best_epoch_first_of_ties_and_tail_renumbered(spark):
    log = _logs(spark)
    tail = S.latest_run(log, 21)
    assert sorted(r.pos for r in tail.where("fold = 0").collect()) == list(range(21))
    best = S.model_selection(log, 21, 5).collect()[0]
    # tail keeps seq 4..24; the maximum is reached first at seq 10 -> pos 6
    assert best.best_pos == 6


def test_missing_fold_gives_null_mean_and_nan_is_skipped(spark):
    log = _logs(spark).where("NOT (fold = 3 AND seq < 10)")
    m = S.kfold_mean(S.latest_run(log, 21), 5)
    # fold 3 holds only 15 rows: positions 15..20 lack it and are NULL
    assert m.where("pos = 20").collect()[0].val_bleu is None
    assert m.where("pos = 14").collect()[0].val_bleu is not None
    nan_log = _logs(spark).withColumn("val_bleu", F.when(F.col("seq") == 12, F.lit(float("nan"))).otherwise(F.col("val_bleu")))
    best = S.best_epoch(S.composite(S.kfold_mean(S.latest_run(nan_log, 21), 5)), "rouge12L").collect()[0]
    assert best.best_pos == 6


def test_skip_head_renumbers(spark):
    out = S.skip_head(_logs(spark), fold=0, n=5)
    f0 = sorted((r.seq, r.pos) for r in out.where("fold = 0").collect())
    assert f0[0] == (5, 0) and len(f0) == 20


def test_recover_index_null_matches_null_and_keeps_first(spark):
    orig = spark.createDataFrame([(1, "c1"), (2, "c1"), (3, None)], "idx long, conclusion string")
    aug = spark.createDataFrame([(1, "prem1", "a", "b", "c1"), (0, "original", "x", "y", None)],
                                "round int, source string, premise_1 string, premise_2 string, conclusion string")
    cand = A.recover_index_candidates(aug, orig)
    assert sorted(r.idx for r in cand.collect()) == [1, 2, 3]
    first = A.recover_index(aug, orig, ["round", "source"])
    assert sorted((r.idx, r.source) for r in first.collect()) == [(1, "prem1"), (2, "prem1"), (3, "original")]
    assert first.count() == A.keep_first(cand, "idx", ["round", "source"]).count()


def test_dedup_rows_same_index_only(spark):
    rows = [("a", "b", "c", "yes", 1), ("a", "b", "c", "yes", 1), ("a", "b", "c", "yes", 2), (None, "b", "c", "yes", 3),
            (None, "b", "c", "yes", 3)]
    df = spark.createDataFrame(rows, "premise_1 string, premise_2 string, conclusion string, relation string, idx long")
    assert A.dedup_rows(df).count() == 3


def test_bleu_traps(spark):
    pairs = spark.createDataFrame(
        [("a", 1, "the cat sat on the mat", "the cat sat on the mat"),
         ("b", 1, "", "the cat sat"),
         ("b", 2, "the cat sat on the mat today", "the cat sat on the mat"),
         ("c", 1, "the the the", "the cat"),
         ("d", 1, "a b c d e", "a b c d e f g h i j")],
        "run string, idx long, generation string, label string")
    got = {r.run: r.bleu for r in MT.corpus_bleu(pairs, ["run"]).collect()}
    assert got["a"] == 1.0
    assert got["c"] == 0.0  # no 2-grams match: zero precision -> 0
    assert 0.0 < got["b"] < 1.0
    assert got["d"] == pytest.approx(math.exp(1 - 10 / 5), abs=1e-6)  # brevity penalty only


def test_rouge_traps(spark):
    pairs = spark.createDataFrame(
        [("r", 1, "The cat!", "the CAT"), ("r", 2, "dog", "cat"), ("r", 3, "...", "cat"), ("r", 4, "b a", "a b"),
         ("r", 5, "café au lait", "cafe au lait")],
        "run string, idx long, generation string, label string")
    got = {r.idx: r for r in MT.rouge_scores(pairs, ["run"]).collect()}
    assert got[1].rouge1 == 1.0 and got[1].rougeL == 1.0
    assert got[2].rouge1 == 0.0 and got[3].rouge1 == 0.0 and got[3].rougeL == 0.0
    assert got[4].rouge1 == 1.0 and got[4].rouge2 == 0.0 and got[4].rougeL == 0.5
    # 'café' -> 'caf' (an accented letter is a break): 2 of 3 tokens match
    assert got[5].rouge1 == pytest.approx(2 / 3, abs=1e-6)


def test_lcs_against_dp():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    def dp(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
        return t[-1][-1]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from("abcde"), max_size=40), st.lists(st.sampled_from("abcde"), max_size=90))
    def check(a, b):
        assert lcs_length(a, b) == dp(a, b)

    check()


def test_sequences_pad_shift_truncate(spark):
    df = spark.createDataFrame([(1, [10, 11, 12]), (2, [10] * 6), (3, [])], "idx int, ids array<int>")
    out = {r.idx: r for r in df.select(
        "idx", SQ.pad_right(F.col("ids"), 4, 0).alias("p"), SQ.attention_mask(F.col("ids"), 4).alias("m"),
        SQ.pad_left(F.col("ids"), 4).alias("l"), SQ.truncate_labels(F.col("ids"), 4)[0].alias("t"),
        SQ.truncate_labels(F.col("ids"), 4)[1].alias("tr"), *[c.alias(f"s{i}") for i, c in enumerate(SQ.decoder_shift(F.col("ids"), 4))],
    ).collect()}
    assert out[1].p == [10, 11, 12, 0] and out[1].m == [1, 1, 1, 0] and out[1].l == [0, 10, 11, 12]
    assert out[1].t == [10, 11, 12, -100] and out[1].tr is False
    assert out[2].p == [10] * 4 and out[2].tr is True and out[2].l == [10] * 6
    assert out[1].s0 == [10, 11, 0, 0] and out[1].s1 == [11, 12, -100, -100] and out[1].s2 == [1, 1, 0, 0]
    assert out[3].p == [0] * 4 and out[3].m == [0] * 4


def test_cp1252_csv(spark, tmpdir_path):
    raw = ('Premise 1,Premise 2,Syllogistic relation,Conclusion\r\n'
           '"caf\xe9, \x93quoted\x94","line one\nline two",yes,"He said ""hi"""\r\n'
           'NA,,no,plain\r\n').encode("latin-1")
    path = os.path.join(tmpdir_path, "corpus.csv")
    with open(path, "wb") as fh:
        fh.write(raw)
    rows = {r.idx: r for r in FS.read_corpus(spark, path).collect()}
    assert rows[0].premise_1 == "café, “quoted”"
    assert rows[0].premise_2 == "line one\nline two"
    assert rows[0].conclusion == 'He said "hi"'
    assert rows[1].premise_1 is None and rows[1].premise_2 is None and rows[1].relation == "no"


def test_interchange_drops_stray_index(spark, tmpdir_path):
    from pyspark.sql import types as T

    path = os.path.join(tmpdir_path, "x.csv")
    with open(path, "w") as fh:
        fh.write(',index,Premise 1,Premise 1_f1\n0,5,"a, b",0.97\n1,7,c,0.5\n')
    schema = T.StructType([T.StructField("index", T.LongType()), T.StructField("Premise 1", T.StringType()),
                           T.StructField("Premise 1_f1", T.DoubleType())])
    df = FS.read_interchange(spark, path, schema)
    assert df.columns == ["index", "Premise 1", "Premise 1_f1"]
    assert sorted(r["index"] for r in df.collect()) == [5, 7]


def test_family_keys_from_path(spark, tmpdir_path):
    from pyspark.sql import types as T

    for r in (1, 2):
        for f in (0, 1):
            d = os.path.join(tmpdir_path, f"prem1_aug_num_{r}_kfold_{f}.csv")
            with open(d, "w") as fh:
                fh.write("index,generation\n1,x\n")
    schema = T.StructType([T.StructField("index", T.LongType()), T.StructField("generation", T.StringType())])
    df = FS.read_family(spark, os.path.join(tmpdir_path, "*.csv"), schema,
                        {"round": r"aug_num_(\d+)", "fold": r"kfold_(\d+)", "_file": FS.WHOLE_PATH})
    assert sorted((r["round"], r["fold"]) for r in df.collect()) == [("1", "0"), ("1", "1"), ("2", "0"), ("2", "1")]
    assert FS.single_file_per_run(df.withColumn("run", F.lit("r")), "run").count() == 1


def test_html_first_table_escapes_and_empty_cells(spark):
    html = ("<html><table><thead><tr><th>idx</th><th>text</th></tr></thead><tbody>\n"
            "<tr><td>1</td><td>a &lt;b&gt; &amp;amp; c</td></tr>\n<tr><td>2</td><td></td></tr>\n"
            "<tr><td>3</td><td>two\n  lines</td></tr></tbody></table>"
            "<table><thead><tr><th>x</th></tr></thead><tbody><tr><td>9</td></tr></tbody></table></html>")
    docs = spark.createDataFrame([(1, html)], "doc int, html string")
    ext = HT.extract_first_table(docs, "html", ["doc"]).select("row_no", HT.cell("idx").alias("i"), HT.cell("text").alias("t"))
    rows = {r.row_no: (r.i, r.t) for r in ext.collect()}
    assert rows == {0: ("1", "a <b> &amp; c"), 1: ("2", None), 2: ("3", "two lines")}


def test_leaderboard_append_is_idempotent(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "board")
    rows = spark.createDataFrame([("m1", 0.9, 0.5, 0.3, 0.4, 0.2)], sinks.LEADERBOARD)
    sinks.append_leaderboard(rows, path)
    sinks.append_leaderboard(rows, path)
    # a stored row stays, and two rows of one new model are one
    more = spark.createDataFrame([("m1", 0.99, 0.5, 0.3, 0.4, 0.2), ("m2", 0.8, 0.4, 0.2, 0.3, 0.1), ("m2", 0.7, 0.9, 0.2, 0.3, 0.1)], sinks.LEADERBOARD)
    sinks.append_leaderboard(more, path)
    assert sorted((r.model_name, r.bert_score) for r in spark.read.parquet(path).collect()) == [("m1", 0.9), ("m2", 0.8)]
    assert sinks.merge_leaderboard(rows, more).count() == 2
    with open(os.path.join(path, "broken.parquet"), "w") as fh:
        fh.write("not parquet")
    with pytest.raises(Exception):  # a table that cannot be read is no absent table
        sinks.append_leaderboard(rows, path)


def test_epoch_log_union_by_name(spark):
    rows = spark.createDataFrame([(0, 0.1, 0.2, 0.3, 0.4, 0.5, 10, 0)],
                                 "epoch int, val_bleu double, val_loss double, val_rouge1 double, val_rouge2 double, "
                                 "val_rougeL double, data_length long, kfold int")
    u = sinks.union_epoch_log(sinks.empty_epoch_log(spark), rows)
    assert u.columns[:4] == ["epoch", "val_bleu", "val_rouge", "val_loss"] and u.collect()[0].val_rouge is None


def test_stream_is_idempotent_on_replay(spark, tmpdir_path):
    from chainaug.streaming import epoch_log as STR

    log = _logs(spark).withColumn("fold", F.col("fold").cast("int")).withColumn("seq", F.col("seq").cast("long")) \
        .withColumn("epoch", F.col("epoch").cast("int")).withColumn("data_length", F.col("data_length").cast("long"))
    src = os.path.join(tmpdir_path, "in")
    log.write.parquet(src)
    table, ckpt = os.path.join(tmpdir_path, "t"), os.path.join(tmpdir_path, "c")
    STR.ingest(spark, src, table, ckpt).awaitTermination()
    first = [sorted(map(str, spark.read.parquet(t).collect())) for t in (table, table + "_best")]
    # a second query with a fresh checkpoint replays every file: nothing is added twice
    STR.ingest(spark, src, table, os.path.join(tmpdir_path, "c2")).awaitTermination()
    assert spark.read.parquet(table).count() == log.count()
    assert spark.read.parquet(table + "_best").count() == 1
    assert first == [sorted(map(str, spark.read.parquet(t).collect())) for t in (table, table + "_best")]


def test_pandas_generator_hook_sees_one_fold_at_a_time(spark):
    from chainaug.operators.generate import generate_with_pandas

    rows = spark.createDataFrame([(i, i % 5, f"text {i}", "gold") for i in range(50)], "idx long, fold int, input string, label string")
    seen = []

    def gen(fold, pdf):
        assert (pdf["fold"] == fold).all() and "label" not in pdf.columns
        return pdf["input"].str.upper() + f" /{fold}"

    out = generate_with_pandas(rows, gen).collect()
    assert len(out) == 50 and all(r.generation == f"TEXT {r.idx} /{r.fold}" for r in out)


def test_writers_partition_layout_and_pruning(spark, tmpdir_path):
    from chainaug.plans import all_queries as Q
    from sf_paths import SF_SMALL

    sets = Q.QUERIES["ori_mix"](spark, SF_SMALL).withColumn("method", F.lit("ori_mix"))
    path = os.path.join(tmpdir_path, "sets")
    sinks.write_training_sets(sets, path)
    assert sorted(x for x in os.listdir(os.path.join(path, "method=ori_mix"))) == [f"round={i}" for i in range(4)]
    back = sinks.read_training_set(spark, path, "ori_mix", 2)
    assert "PartitionFilters: [isnotnull(method" in back._jdf.queryExecution().executedPlan().toString()
    assert back.count() == sets.where("round <= 2").count()
    sinks.write_training_sets(sets, path)  # overwrite is idempotent
    assert spark.read.parquet(path).count() == sets.count()
    gen_path = os.path.join(tmpdir_path, "gen")
    g = Q.QUERIES["generate_oof"](spark, SF_SMALL).withColumn("model", F.lit("builtin"))
    sinks.write_generations(g, gen_path)
    assert spark.read.parquet(gen_path).where("round = 1 AND target = 'prem1'").count() == \
        g.where("round = 1 AND target = 'prem1'").count()


def test_corpus_index_runs_across_files(spark, tmpdir_path):
    for name, rows in (("a.csv", ["x1", "x2", "x3"]), ("b.csv", ["y1", "y2"])):
        with open(os.path.join(tmpdir_path, name), "wb") as fh:
            body = "Premise 1,Premise 2,Syllogistic relation,Conclusion\r\n" + "".join(f"{r},p,yes,c\r\n" for r in rows)
            fh.write(body.encode("latin-1"))
    got = sorted((r.idx, r.premise_1) for r in FS.read_corpus(spark, os.path.join(tmpdir_path, "*.csv")).collect())
    assert got == [(0, "x1"), (1, "x2"), (2, "x3"), (3, "y1"), (4, "y2")]


def test_family_goes_by_each_files_header(spark, tmpdir_path):
    from pyspark.sql import types as T

    texts = {"a_aug_num_1.csv": ",index,generation\n0,17,hello\n1,18,\"x, \"\"y\"\"\"\n", "b_aug_num_2.csv": "index,generation\n19,plain\n",
             "c_aug_num_3.csv": "generation,index\nswapped,20\n"}
    for name, text in texts.items():
        with open(os.path.join(tmpdir_path, name), "w") as fh:
            fh.write(text)
    schema = T.StructType([T.StructField("index", T.LongType()), T.StructField("generation", T.StringType())])
    df = FS.read_family(spark, os.path.join(tmpdir_path, "*.csv"), schema, {"round": r"aug_num_(\d+)"})
    assert sorted((r["index"], r["generation"], r["round"]) for r in df.collect()) == [
        (17, "hello", "1"), (18, 'x, "y"', "1"), (19, "plain", "2"), (20, "swapped", "3")]
    assert FS.read_single_files(spark, os.path.join(tmpdir_path, "*.csv"), schema, r"aug_num_(\d+)").count() == 4
    with pytest.raises(ValueError, match="more than one file"):
        FS.read_single_files(spark, os.path.join(tmpdir_path, "*.csv"), schema, r"(aug_num)")


def test_corpus_missing_words_are_null(spark, tmpdir_path):
    body = "Premise 1,Premise 2,Syllogistic relation,Conclusion\r\n" + "".join(f"{w},p,yes,c\r\n" for w in ("NaN", "null", "n/a", "none", ""))
    with open(os.path.join(tmpdir_path, "c.csv"), "wb") as fh:
        fh.write(body.encode("latin-1"))
    rows = FS.read_corpus(spark, os.path.join(tmpdir_path, "c.csv")).orderBy("idx").collect()
    assert [r.premise_1 for r in rows] == [None, None, None, "none", None]


def test_html_index_column_missing_sections_and_headers(spark, tmpdir_path):
    head = '<tr style="x"><th></th><th>index</th><th>generation</th></tr>'
    one = f"<table><thead>{head}</thead><tbody><tr><th>0</th><td>17</td><td>hello</td></tr></tbody></table>"
    two = "<table><tr><td>index</td><td>generation</td></tr><tr><td>18</td><td>bye</td></tr></table>"
    for run, html in (("r1", one), ("r2", two), ("r3", "<p>no table</p>")):
        os.makedirs(os.path.join(tmpdir_path, run))
        with open(os.path.join(tmpdir_path, run, "gen.html"), "w") as fh:
            fh.write(html)
    rows = HT.read_html_files(spark, os.path.join(tmpdir_path, "*", "*.html"), ["index", "generation", "label"], {"run": r"/(r\d)/"})
    assert sorted((r["run"], r["index"], r["generation"], r["label"]) for r in rows.collect()) == [("r1", "17", "hello", None), ("r2", "18", "bye", None)]


def test_every_piece_is_in_one_triple(spark):
    import re

    from chainaug.sources import fixtures as X
    from sf_paths import SF_SMALL

    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in rows] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "One. Two"), (10**6 + 3, "A. b.  c. d. e. f. g. h"), (10**6 + 4, "A. b. c. ")]
    got = {}
    for r in X.triples(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "k").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {i for i, _ in rows}
    for i, text in rows:
        pieces = re.split("[.][ \t\n\r\f]+", text or "")
        if len(pieces) < 3:
            assert [(r.k, r.premise_1, r.premise_2, r.conclusion) for r in got[i]] == [(0, None, None, None)]
        else:
            assert ". ".join(x for r in got[i] for x in (r.premise_1, r.premise_2, r.conclusion)) == ". ".join(pieces)
            assert [r.k for r in got[i]] == list(range(len(pieces) // 3))


def test_pair_numbers_past_a_thousand_turns(spark, tmpdir_path):
    from chainaug.sources import fixtures as X

    turns = [(1, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(1, 2104)] + [(2, 1, "user", "u"), (2, 2, "assistant", "a")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(os.path.join(tmpdir_path, "conversations.parquet"))
    pairs = X.conversation_pairs(spark, tmpdir_path)
    assert pairs.count() == pairs.select("idx").distinct().count() == 1052


def test_vectors_are_cleaned_before_they_are_sent(spark):
    pairs = spark.createDataFrame([("r", 1, "a b c d", "a c e")], "run string, idx long, generation string, label string")
    big = 1e200
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", None), ("c", [big, big]), ("d", [1.0, None]), (None, [1.0, 1.0]), ("e", [1.0, 1.0])],
                                    "token string, embedding array<double>")
    one, two = (MT.embedding_f1(pairs, ["run"], vectors, buckets=n).collect() for n in (1, 5))
    assert str(one) == str(two) and one[0]["f1"] is not None


def test_batch_means_of_any_batch_size(spark):
    from chainaug.operators import selection as S

    rows = spark.range(100_000).select(F.lit("k").alias("k"), F.col("id"), (F.lit(3.0) + (F.col("id") % 7) / 10).alias("loss"))
    for size in (1, 16, 24, 32, 64, 4096):
        got = S.batch_mean_loss(rows.withColumn("batch", F.floor(F.col("id") / size)), ["k"], "batch", "loss").collect()[0]
        means = [sum(3 + (i % 7) / 10 for i in range(a, min(a + size, 100_000))) / (min(a + size, 100_000) - a) for a in range(0, 100_000, size)]
        assert got["n_batches"] == len(means) and abs(got["mean_batch_loss"] - sum(means) / len(means)) < 2e-6


def test_decoder_shift_flags_a_cut(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4, 5, 6],)], "ids array<int>")
    assert [r[0] for r in df.select(SQ.decoder_shift(F.col("ids"), 4)[3]).collect()] == [False, True]


def test_unrelated_text_of_equal_length_scores_nothing(spark):
    from chainaug.operators.generate import overlap_f1

    rows = [("x y z", "a b c", 0.0), ("a b c", "c b a", 1.0), ("a a b", "a b b", round(4 / 6, 6)), ("a", "a b c", 0.5), ("a a a", "a", 0.5)]
    df = spark.createDataFrame(rows, "g string, l string, want double")
    assert all(abs(r.f1 - r.want) < 1e-6 for r in df.select("want", overlap_f1(F.col("g"), F.col("l")).alias("f1")).collect())


def test_chain_generates_from_the_input_with_a_model_hook(spark):
    from chainaug.operators.chain import chain

    o = spark.createDataFrame([(i, i % 5, f"p{i}", f"q{i}", f"c{i}") for i in range(10)], "idx long, fold int, premise_1 string, premise_2 string, conclusion string")

    def model(fold, rows):
        assert not {"label", "premise_1", "premise_2"} & set(rows.columns) and (rows["fold"] == fold).all()
        return rows["input"].str.replace("Syllogistic: ", f"[{fold}] ")

    got = {(r["idx"], r["round"], r["target"]): r for r in chain(o, 2, pandas_generator=model).collect()}
    assert len(got) == 40
    assert got[3, 1, "prem1"]["generation"] == "[3] q3 <sep> c3"
    assert got[3, 2, "prem2"]["input"] == "Syllogistic: [3] q3 <sep> c3 <sep> c3" and got[3, 2, "prem2"]["label"] == "q3"


def test_bands_keep_some_generations_and_drop_some(spark):
    from chainaug.operators import augment as AU
    from chainaug.plans.merge_queries import CEIL, FLOOR
    from chainaug.sources import fixtures as X
    from sf_paths import SF_SMALL

    g = X.scored_generation(spark, SF_SMALL)
    kept = g.where(AU.band(F.col("f1"), FLOOR, CEIL)).count()
    assert 0.05 * g.count() < kept < 0.95 * g.count()
