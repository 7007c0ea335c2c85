"""Queries for profiling, folds, lookups, joins and set operations:
A5-A12, K2-K4, P1, P10, J4, J7-J10, U1, U5, W2, W3."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import phash
from ..operators import augment as A
from ..operators import folds as K
from ..operators import profile as PR
from ..operators.generate import drop_token_generator
from ..operators.numbering import with_position
from ..session import checkpoint_dir, materialize
from ..sources import fixtures as X
from ..sources import shards as SH
from .merge_queries import CEIL, FLOOR, _P12, _band, _method_sql
from .oracle_views import H, with_ctes
from .registry import query
from .sequence_queries import WS

SETS = _P12 + [
    ("sets", " UNION ALL ".join(
        f"SELECT '{m}' AS method, * FROM ({_method_sql(m, True)})" for m in A.METHODS)),
    ("prefixed", "SELECT u.until_round, s.* FROM sets s JOIN (SELECT unnest([1, 2, 3]) AS until_round) u "
                 "ON greatest(s.round, 1) <= u.until_round"),
]


def prefixed_sets(spark, d):
    sets = A.all_methods(*X.valid_and_generation(spark, d), True, FLOOR, CEIL)
    return A.round_prefixes(sets, 3)


@query("augmentation_gain", with_ctes(["generation", "valid"], SETS, """
SELECT method, until_round, count(*) AS n_rows, sum(CASE WHEN round = 0 THEN 1 ELSE 0 END)::BIGINT AS n_original,
       count(*) - sum(CASE WHEN round = 0 THEN 1 ELSE 0 END)::BIGINT AS gain
FROM prefixed GROUP BY method, until_round"""))
def augmentation_gain(spark, d):
    return PR.set_sizes(prefixed_sets(spark, d))


@query("avg_dataset_size", with_ctes(["generation", "valid"], SETS, """
SELECT count(*) AS n_sets, sum(n)::DOUBLE / count(*) AS avg_rows
FROM (SELECT method, until_round, count(*) AS n FROM prefixed GROUP BY ALL)"""))
def avg_dataset_size(spark, d):
    return PR.avg_set_size(PR.set_sizes(prefixed_sets(spark, d)))


@query("dedup_gain", with_ctes(["generation", "valid"], SETS, """
SELECT method, until_round, count(*) AS n_dedup, sum(CASE WHEN round = 0 THEN 1 ELSE 0 END)::BIGINT AS n_original,
       count(*) - sum(CASE WHEN round = 0 THEN 1 ELSE 0 END)::BIGINT AS gain_dedup
FROM (SELECT method, until_round, premise_1, premise_2, conclusion, relation, idx, min(round) AS round
      FROM prefixed GROUP BY ALL) GROUP BY method, until_round"""))
def dedup_gain(spark, d):
    rows = A.every_row(*X.valid_and_generation(spark, d), True, FLOOR, CEIL)
    return PR.dedup_sizes(A.with_methods(PR.row_digests(rows, ["source", "round"], A.TRAIN_COLS)), ["method"], 3)


_TEXTS = ["premise_1", "premise_2", "conclusion"]


@query("max_token_len", with_ctes(["generation", "valid"], SETS + [("lengths", f"""
SELECT method, until_round, unnest({_TEXTS}) AS text_col, unnest([{", ".join(f"len({WS(c)})" for c in _TEXTS)}]) AS n_tokens FROM prefixed""")], f"""
SELECT method, until_round, text_col, count(*) AS n_rows,
       {", ".join(f"list_sort(list(n_tokens))[(count(*) * {q} + 99) // 100] AS p{q}" for q in (50, 95, 99))}, max(n_tokens) AS max_tokens
FROM lengths GROUP BY ALL"""))
def max_token_len(spark, d):
    """Longest and 50th, 95th and 99th percentile token count of every text column of every training set."""
    rows = A.every_row(*X.valid_and_generation(spark, d), True, FLOOR, CEIL)
    parts = A.with_methods(PR.length_histograms(rows, ["source", "round"], _TEXTS))
    return PR.length_quantiles(A.round_prefixes(parts, 3), ["method", "until_round", "text_col"])


_OUTER = ("om", f"""SELECT coalesce(a.idx, b.idx) AS idx, coalesce(a.round, b.round) AS round, a.premise_1, b.premise_2
FROM (SELECT * FROM p1 WHERE {_band('premise_1_f1')}) a
FULL OUTER JOIN (SELECT * FROM p2 WHERE {_band('premise_2_f1')}) b ON a.idx = b.idx AND a.round = b.round""")


def outer_merged(spark, d) -> DataFrame:
    p1, p2 = A.premise_tables(X.generation(spark, d))
    a = p1.where(A.band(F.col("premise_1_f1"), FLOOR, CEIL)).select("idx", "round", "premise_1")
    b = p2.where(A.band(F.col("premise_2_f1"), FLOOR, CEIL)).select("idx", "round", "premise_2")
    return a.join(b, ["idx", "round"], "full_outer")


@query("outer_merge", with_ctes(["generation", "valid"], _P12 + [_OUTER], "SELECT * FROM om"))
def outer_merge(spark, d):
    return outer_merged(spark, d)


@query("null_counts", with_ctes(["generation", "valid"], _P12 + [_OUTER], """
SELECT count(*) AS n_rows, count(*) - count(idx) AS null_idx, count(*) - count(round) AS null_round,
       count(*) - count(premise_1) AS null_premise_1, count(*) - count(premise_2) AS null_premise_2 FROM om"""))
def null_counts(spark, d):
    return PR.null_counts(outer_merged(spark, d).select("idx", "round", "premise_1", "premise_2"))


@query("top_similarity_row", with_ctes(["generation"], [], """
SELECT round, target, idx, f1, generation FROM (
  SELECT *, row_number() OVER (PARTITION BY round, target ORDER BY f1 DESC, idx) AS r
  FROM generation WHERE f1 IS NOT NULL AND NOT isnan(f1)) WHERE r = 1"""))
def top_similarity_row(spark, d):
    return PR.top_row(X.generation(spark, d), ["round", "target"], "f1", "idx", ["generation"])


_RECOVER = [("aug", "SELECT round, source, premise_1, premise_2, conclusion FROM tset"),
            ("rec", """SELECT idx, round, source, premise_1, premise_2, conclusion FROM (
  SELECT a.*, k.idx, row_number() OVER (PARTITION BY k.idx ORDER BY a.round, a.source, a.premise_1, a.premise_2) AS r
  FROM aug a JOIN (SELECT DISTINCT conclusion, idx FROM valid) k ON a.conclusion IS NOT DISTINCT FROM k.conclusion)
WHERE r = 1""")]


def recovered(spark, d) -> DataFrame:
    g, v = X.generation(spark, d), X.valid(spark, d)
    t = A.training_set("aug_mix", v, g, True, FLOOR, CEIL).drop("idx", "relation")
    return A.recover_index(t, v, ["round", "source", "premise_1", "premise_2"]).select(
        "idx", "round", "source", "premise_1", "premise_2", "conclusion")


@query("recover_index", with_ctes(["generation", "valid"], _P12 + [("tset", _method_sql("aug_mix", True))] + _RECOVER,
                                  "SELECT * FROM rec"))
def recover_index(spark, d):
    return recovered(spark, d)


@query("index_uniqueness", with_ctes(["generation", "valid"], _P12 + [("tset", _method_sql("aug_mix", True))] + _RECOVER, """
SELECT count(*) AS n_rows, count(DISTINCT idx) AS n_distinct,
       (SELECT count(*) FROM valid v WHERE v.idx NOT IN (SELECT idx FROM rec)) AS n_missing,
       (SELECT count(*) FROM rec r WHERE r.idx NOT IN (SELECT idx FROM valid)) AS n_extra,
       count(*) = count(DISTINCT idx) AS is_unique
FROM rec"""))
def index_uniqueness(spark, d):
    # the recovered rows feed three checks (stats, missing, extra): derive them once
    return PR.key_check(materialize(recovered(spark, d)), X.valid(spark, d))


@query("dedup_keep_first", with_ctes(["generation"], [], """
SELECT idx, round, target, f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY idx ORDER BY f1 DESC, round, target) AS r FROM generation) WHERE r = 1"""))
def dedup_keep_first(spark, d):
    g = X.generation(spark, d)
    return A.keep_first(g, "idx", [F.col("f1").desc(), "round", "target"]).select("idx", "round", "target", "f1")


@query("split_sizes", with_ctes(["corpus"], [], f"""
SELECT split, relation, count(*) AS n_rows FROM (
  SELECT *, CASE WHEN {H("'split:' || idx")} % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM corpus)
GROUP BY ROLLUP (split, relation)"""))
def split_sizes(spark, d):
    return PR.split_sizes(X.corpus(spark, d))


@query("row_index", with_ctes([], [], "SELECT doc_id AS idx, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents"))
def row_index(spark, d):
    docs = X.table(spark, d, "documents").select(F.col("doc_id").alias("idx"))
    return with_position(docs, ["idx"], "pos")


@query("premise_lookup", with_ctes(["generation", "valid"], _P12, """
SELECT v.idx, p1.round, v.premise_1 AS original_premise_1, p1.premise_1 AS aug_premise_1,
       v.premise_2 AS original_premise_2, p2.premise_2 AS aug_premise_2
FROM valid v JOIN p1 ON v.idx = p1.idx JOIN p2 ON p1.idx = p2.idx AND p1.round = p2.round"""))
def premise_lookup(spark, d):
    return A.lookup(X.valid(spark, d), X.generation(spark, d))


@query("lookup_top_rows", with_ctes(["generation", "valid"], _P12 + [("top", """
SELECT DISTINCT idx FROM (SELECT idx, row_number() OVER (PARTITION BY round, target ORDER BY f1 DESC, idx) AS n
                          FROM generation WHERE f1 IS NOT NULL AND NOT isnan(f1)) WHERE n = 1""")], """
SELECT v.idx, p1.round, v.premise_1 AS original_premise_1, p1.premise_1 AS aug_premise_1,
       v.premise_2 AS original_premise_2, p2.premise_2 AS aug_premise_2
FROM valid v JOIN top USING (idx) JOIN p1 ON v.idx = p1.idx JOIN p2 ON p1.idx = p2.idx AND p1.round = p2.round"""))
def lookup_top_rows(spark, d):
    """P10 as the reference uses it: the rows of the highest similarities (A10), looked up in all tables."""
    g = X.generation(spark, d)
    return A.lookup(X.valid(spark, d), g, PR.top_row(g, ["round", "target"], "f1", "idx", ["generation"]))


@query("fold_semi_join", with_ctes(["valid", "folds"], [], """
SELECT idx, 'valid' AS part FROM valid WHERE idx IN (SELECT idx FROM folds WHERE fold = 0)
UNION ALL
SELECT idx, 'train' AS part FROM valid WHERE idx NOT IN (SELECT idx FROM folds WHERE fold = 0)"""))
def fold_semi_join(spark, d):
    members = X.folds(spark, d).where(F.col("fold") == 0).select("idx")
    v = X.valid(spark, d).select("idx")
    return K.fold_rows(v, members).withColumn("part", F.lit("valid")).unionByName(
        K.fold_rows(v, members, complement=True).withColumn("part", F.lit("train")))


@query("kfold_split", with_ctes(["folds"], [], """
SELECT f.f, idx, CASE WHEN fold = f.f THEN 'valid' ELSE 'train' END AS part
FROM folds CROSS JOIN (SELECT unnest(range(0, 5))::INTEGER AS f) f"""))
def kfold_split(spark, d):
    return K.kfold_splits(X.folds(spark, d))


@query("leakage_free_split", with_ctes(["generation", "valid", "folds"], _P12 + [("tset", _method_sql("ori_mix", True))], """
SELECT f.f, CASE WHEN fo.fold = f.f THEN 'valid' ELSE 'train' END AS part, t.idx, t.round, t.source
FROM tset t JOIN folds fo ON t.idx = fo.idx CROSS JOIN (SELECT unnest(range(0, 5))::INTEGER AS f) f
WHERE fo.fold <> f.f OR t.round = 0"""))
def leakage_free_split(spark, d):
    t = A.training_set("ori_mix", *X.valid_and_generation(spark, d), True, FLOOR, CEIL)
    return K.leakage_free_splits(t, X.folds(spark, d)).select("f", "part", "idx", "round", "source")


@query("train_volume", with_ctes(["generation", "valid", "folds"], _P12 + [("tset", _method_sql("ori_mix", True))], """
SELECT f.f, CASE WHEN fo.fold = f.f THEN 'valid' ELSE 'train' END AS part, count(*) AS n_rows
FROM tset t JOIN folds fo ON t.idx = fo.idx CROSS JOIN (SELECT unnest(range(0, 5))::INTEGER AS f) f
WHERE fo.fold <> f.f OR t.round = 0 GROUP BY ALL"""))
def train_volume(spark, d):
    """A12 (second half): training and validation volume of every fold run -- the data length a
    run logs -- over the leakage-free split of the augmented set."""
    return leakage_free_split(spark, d).groupBy("f", "part").agg(F.count(F.lit(1)).alias("n_rows"))


@query("final_split", with_ctes(["valid"], [], f"""
SELECT CASE WHEN {H("'split:' || idx")} % 10 = 0 THEN 'test' ELSE 'train' END AS part, idx FROM valid"""))
def final_split(spark, d):
    return X.valid(spark, d).select(PR.split_of().alias("part"), "idx")


@query("fold_union", with_ctes(["generation"], [], "SELECT idx, round, target, fold, generation FROM generation"))
def fold_union(spark, d):
    """Every fold's held-out rows go to a folder of the fold, in one pass; their union is one read of
    all folders."""
    from ..operators.generate import generation_rows

    rows = generation_rows(X.valid_folds(spark, d), 3)
    key = F.concat_ws(":", F.col("round"), F.col("target"), F.col("idx"))
    out = rows.select("idx", "round", "target", "fold", drop_token_generator(F.col("label"), key).alias("generation"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/folds-{uuid.uuid4().hex}"
    out.write.partitionBy("fold").parquet(path)
    return spark.read.schema(out.schema).parquet(path).select(*out.columns)


@query("generation_agreement", with_ctes(["scored_run"], [], """
SELECT a.run AS run_a, b.run AS run_b, count(*) AS n_rows,
       sum(CASE WHEN a.generation = b.generation THEN 1 ELSE 0 END)::BIGINT AS n_equal
FROM scored_run a JOIN scored_run b ON a.idx = b.idx
WHERE (a.run, b.run) IN (('run5', 'run10'), ('run5', 'run20'), ('run10', 'run20'))
GROUP BY a.run, b.run"""))
def generation_agreement(spark, d):
    return A.compare_generations(X.scored_run(spark, d), [("run5", "run10"), ("run5", "run20"), ("run10", "run20")])


@query("column_concat", with_ctes(["generation", "valid"], [], f"""
SELECT coalesce(l.pos, r.pos) AS pos, l.idx AS left_idx, l.premise_1, r.idx AS right_idx, r.generation
FROM (SELECT idx, premise_1, row_number() OVER (ORDER BY idx) - 1 AS pos FROM valid) l
FULL OUTER JOIN (SELECT idx, generation, row_number() OVER (ORDER BY idx, round, target) - 1 AS pos
                 FROM generation WHERE {_band('f1')}) r ON l.pos = r.pos"""))
def column_concat(spark, d):
    g = X.generation(spark, d).where(A.band(F.col("f1"), FLOOR, CEIL)).select("idx", "round", "target", "generation")
    left = with_position(X.valid(spark, d).select("idx", "premise_1"), ["idx"], "pos")
    right = with_position(g, ["idx", "round", "target"], "pos")
    j = left.withColumnRenamed("idx", "left_idx").join(
        right.select("pos", F.col("idx").alias("right_idx"), "generation"), "pos", "full_outer")
    return j.select("pos", "left_idx", "premise_1", "right_idx", "generation")


_SHUFFLED = f"""SELECT row_number() OVER (ORDER BY {H("'42:' || idx || ':' || round || ':' || source")}, idx, round, source) - 1 AS pos, * FROM tset"""


@query("shuffled_export", with_ctes(["generation", "valid"], _P12 + [("tset", _method_sql("ori_mix", True)), ("shuffled", _SHUFFLED)], """
SELECT pos, idx, round, source, premise_1, premise_2, conclusion FROM shuffled WHERE pos >= (SELECT count(*) // 2 FROM tset)"""))
def shuffled_export(spark, d):
    """The shuffled training rows as files, read back from the middle on."""
    t = A.training_set("ori_mix", *X.valid_and_generation(spark, d), True, FLOOR, CEIL)
    rows = t.join(seeded_shuffle(spark, d), ["idx", "round", "source"])
    folder = f"{checkpoint_dir(spark).rstrip('/')}/shuffled-{uuid.uuid4().hex}"
    n = SH.export_ordered(rows.select("pos", "idx", "round", "source", *_TEXTS), "pos", folder).agg(F.sum("n_rows")).first()[0] or 0
    return SH.read_between(spark, folder, "pos", n // 2)


@query("seeded_shuffle", with_ctes(["generation", "valid"], _P12 + [("tset", _method_sql("ori_mix", True))], f"""
SELECT row_number() OVER (ORDER BY {H("'42:' || idx || ':' || round || ':' || source")}, idx, round, source) - 1 AS pos,
       idx, round, source FROM tset"""))
def seeded_shuffle(spark, d):
    t = A.training_set("ori_mix", *X.valid_and_generation(spark, d), True, FLOOR, CEIL)
    k = t.select("idx", "round", "source").withColumn("_h", phash("42:", F.col("idx"), ":", F.col("round"), ":", F.col("source")))
    return with_position(k, ["_h", "idx", "round", "source"], "pos").select("pos", "idx", "round", "source")
