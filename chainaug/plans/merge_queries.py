"""Queries over the augmentation merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import augment as A
from ..sources import fixtures as X
from .metric_queries import emb_sql
from .oracle_views import with_ctes
from .registry import query

# Band of scores that keeps some generations and drops some (embedding F1 and token overlap alike).
FLOOR, CEIL = 0.90, 0.99

_P12 = [
    ("p1", "SELECT idx, round, generation AS premise_1, f1 AS premise_1_f1 FROM generation WHERE target = 'prem1'"),
    ("p2", "SELECT g.idx, g.round, g.generation AS premise_2, g.f1 AS premise_2_f1, v.conclusion "
           "FROM generation g JOIN valid v ON g.idx = v.idx WHERE g.target = 'prem2'"),
]


# the same premise tables with the embedding F1 of each generation for its score
SCORED = [("gp", "SELECT round, target, idx, generation, label FROM generation")] + emb_sql("gp", "round, target") + [
    ("scored", "SELECT g.* EXCLUDE (f1), e.f1 FROM generation g JOIN emb e USING (round, target, idx)")]
_P12S = SCORED + [(name, body.replace("FROM generation", "FROM scored")) for name, body in _P12]


def _band(c: str) -> str:
    return f"({c} > {FLOOR} AND {c} < {CEIL} AND NOT isnan({c}))"


_ORIG = "SELECT idx, 0 AS round, 'original' AS source, premise_1, premise_2, conclusion, relation FROM valid"
_J1 = ("SELECT p1.idx, p1.round, 'prem1' AS source, p1.premise_1, v.premise_2, v.conclusion, 'yes' AS relation "
       "FROM p1 JOIN valid v ON p1.idx = v.idx")
_J2 = ("SELECT p2.idx, p2.round, 'prem2' AS source, v.premise_1, p2.premise_2, p2.conclusion, 'yes' AS relation "
       "FROM p2 JOIN valid v ON p2.idx = v.idx")
_J3 = ("SELECT p1.idx, p1.round, 'pair' AS source, p1.premise_1, p2.premise_2, p2.conclusion, 'yes' AS relation "
       "FROM p1 JOIN p2 ON p1.idx = p2.idx AND p1.round = p2.round")


def _method_sql(method: str, filtering: bool) -> str:
    parts = [_ORIG]
    if method in ("ori_mix", "aug_mix"):
        parts.append(_J1 + (f" WHERE {_band('p1.premise_1_f1')}" if filtering else ""))
        parts.append(_J2 + (f" WHERE {_band('p2.premise_2_f1')}" if filtering else ""))
    if method in ("aug_pair", "aug_mix"):
        parts.append(_J3 + (f" WHERE {_band('p1.premise_1_f1')} AND {_band('p2.premise_2_f1')}" if filtering else ""))
    return "\nUNION ALL\n".join(parts)


def method_cte(method: str, filtering: bool = True, scored: bool = False) -> list[tuple[str, str]]:
    return (_P12S if scored else _P12) + [("tset", _method_sql(method, filtering))]


def training(spark, d, method, filtering=True, scored=False):
    g = X.scored_generation(spark, d) if scored else X.generation(spark, d)
    return A.training_set(method, X.valid(spark, d), g, filtering, FLOOR, CEIL)


@query("valid_syllogisms", with_ctes(["valid"], [], "SELECT idx, premise_1, premise_2, relation, conclusion FROM valid"))
def valid_syllogisms(spark, d):
    return A.valid_only(X.corpus(spark, d))


@query("kfold_assign", with_ctes(["folds"], [], "SELECT idx, fold FROM folds"))
def kfold_assign(spark, d):
    return X.folds(spark, d)


@query("generate_oof", with_ctes(["generation", "valid"], [], """
SELECT g.idx, round, target, fold, 'Syllogistic: ' || CASE target WHEN 'prem1' THEN premise_2 ELSE premise_1 END || ' <sep> ' || conclusion AS input,
       generation, label, f1 FROM generation g JOIN valid v ON g.idx = v.idx"""))
def generate_oof(spark, d):
    return X.generation_with_input(spark, d)


for _m in A.METHODS:
    def _make(m):
        def run(spark, d):
            return training(spark, d, m, True, scored=True)
        return run
    query(_m, with_ctes(["generation", "valid", "token_vectors"], method_cte(_m, True, scored=True), "SELECT * FROM tset"))(_make(_m))


@query("aug_pair_unfiltered", with_ctes(["generation", "valid"], method_cte("aug_pair", False), "SELECT * FROM tset"))
def aug_pair_unfiltered(spark, d):
    return training(spark, d, "aug_pair", False)


@query("band_filter", with_ctes(["generation", "token_vectors"], SCORED,
       f"SELECT idx, round, target, f1 FROM scored WHERE {_band('f1')}"))
def band_filter(spark, d):
    g = X.scored_generation(spark, d)
    return g.where(A.band(F.col("f1"), FLOOR, CEIL)).select("idx", "round", "target", "f1")


@query("pair_band_filter", with_ctes(["generation", "valid", "token_vectors"], _P12S,
       "SELECT p1.idx, p1.round, p1.premise_1_f1, p2.premise_2_f1 FROM p1 JOIN p2 ON p1.idx = p2.idx AND p1.round = p2.round "
       f"WHERE {_band('p1.premise_1_f1')} AND {_band('p2.premise_2_f1')}"))
def pair_band_filter(spark, d):
    v, g = X.valid(spark, d), X.scored_generation(spark, d)
    j = A.generated_pairs(g, v)
    return j.where(A.pair_band(F.col("premise_1_f1"), F.col("premise_2_f1"), FLOOR, CEIL)).select(
        "idx", "round", "premise_1_f1", "premise_2_f1")


@query("join_prem1_original", with_ctes(["generation", "valid"], _P12,
       "SELECT p1.idx, p1.round, p1.premise_1, p1.premise_1_f1, v.premise_2, v.conclusion, 'yes' AS relation "
       "FROM p1 JOIN valid v ON p1.idx = v.idx"))
def join_prem1_original(spark, d):
    p1, _ = A.premise_tables(X.generation(spark, d))
    return A.join_prem1_original(p1, X.valid(spark, d)).select(
        "idx", "round", "premise_1", "premise_1_f1", "premise_2", "conclusion", "relation")


@query("join_prem2_original", with_ctes(["generation", "valid"], _P12,
       "SELECT p2.idx, p2.round, v.premise_1, p2.premise_2, p2.premise_2_f1, p2.conclusion, 'yes' AS relation "
       "FROM p2 JOIN valid v ON p2.idx = v.idx"))
def join_prem2_original(spark, d):
    g, v = X.generation(spark, d), X.valid(spark, d)
    _, p2 = A.premise_tables(g)
    return A.join_prem2_original(A.attach_conclusion(p2, v), v).select(
        "idx", "round", "premise_1", "premise_2", "premise_2_f1", "conclusion", "relation")


@query("join_generated_pair", with_ctes(["generation", "valid"], _P12,
       "SELECT p1.idx, p1.round, p1.premise_1, p1.premise_1_f1, p2.premise_2, p2.premise_2_f1, p2.conclusion, "
       "'yes' AS relation FROM p1 JOIN p2 ON p1.idx = p2.idx AND p1.round = p2.round"))
def join_generated_pair(spark, d):
    v, g = X.valid_and_generation(spark, d)
    return A.generated_pairs(g, v).select(
        "idx", "round", "premise_1", "premise_1_f1", "premise_2", "premise_2_f1", "conclusion", "relation")


@query("attach_conclusion", with_ctes(["generation", "valid"], _P12,
       "SELECT idx, round, premise_2, premise_2_f1, conclusion FROM p2"))
def attach_conclusion(spark, d):
    g, v = X.generation(spark, d), X.valid(spark, d)
    _, p2 = A.premise_tables(g)
    return A.attach_conclusion(p2, v).select("idx", "round", "premise_2", "premise_2_f1", "conclusion")


@query("round_prefixes", with_ctes(["generation", "valid"], method_cte("ori_mix"),
       "SELECT u.until_round, t.* FROM tset t JOIN (SELECT unnest([1, 2, 3]) AS until_round) u "
       "ON greatest(t.round, 1) <= u.until_round"))
def round_prefixes(spark, d):
    return A.round_prefixes(training(spark, d, "ori_mix"), 3)


@query("dedup_rows", with_ctes(["generation", "valid"], method_cte("aug_mix"),
       "SELECT DISTINCT premise_1, premise_2, conclusion, relation, idx FROM tset"))
def dedup_rows(spark, d):
    return A.dedup_rows(training(spark, d, "aug_mix")).select(*A.TRAIN_COLS)
