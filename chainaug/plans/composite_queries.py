"""Composite pipelines and sinks: C1, C5, S3, S9, X1."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import augment as A
from ..operators import chain as CH
from ..operators import ledger as LG
from ..operators import metrics as MT
from ..session import checkpoint_dir
from ..sources import files
from ..sources import fixtures as X
from ..sources import html as HT
from ..sources import sinks
from ..streaming import best_epoch as BEST
from ..streaming import epoch_log as STR
from . import selection_queries  # noqa: F401 - its SQL is used below
from .merge_queries import CEIL, FLOOR, method_cte
from .metric_queries import emb_sql
from .oracle_views import H, R6, with_ctes
from .registry import ORACLE, query


@query("premise_merge", with_ctes(["generation", "valid", "token_vectors"],
                                  [("gp", "SELECT round, target, idx, generation, label FROM generation")]
                                  + emb_sql("gp", "round, target"), """
SELECT g.idx, g.round, g.target, g.generation AS aug_premise, e.f1 AS aug_f1,
       CASE WHEN g.target = 'prem1' THEN v.premise_2 ELSE v.premise_1 END AS other_premise, v.relation, v.conclusion
FROM generation g JOIN emb e ON g.idx = e.idx AND g.round = e.round AND g.target = e.target JOIN valid v ON g.idx = v.idx"""))
def premise_merge(spark, d):
    return CH.premise_merge(X.generated(spark, d), X.valid(spark, d), X.token_vectors(spark, d))


def _gen_sql(label: str, key: str) -> str:
    kept = (f"list_filter(list_transform(range(1, len(string_split({label}, ' ')) + 1), lambda i: CASE WHEN "
            f"{H(f'{key} || ' + chr(39) + ':' + chr(39) + ' || i')} % 10 = 0 THEN NULL ELSE string_split({label}, ' ')[i] END), "
            f"lambda x: x IS NOT NULL)")
    return f"array_to_string(CASE WHEN len({kept}) = 0 THEN string_split({label}, ' ') ELSE {kept} END, ' ')"


def _chain_round(src: str) -> str:
    key = f"round || ':' || target || ':' || idx || ':' || {H('input_premise')}"
    times = lambda x: f"len(list_filter({x}, lambda y: y = t))"
    overlap = f"coalesce(list_sum(list_transform(list_distinct(g), lambda t: least({times('g')}, {times('l')}))), 0)"
    return f"""SELECT idx, round, target, input, generation, label,
        {R6(f"(2 * {overlap})::DOUBLE / (len(g) + len(l))")} AS f1
        FROM (SELECT *, string_split(generation, ' ') AS g, string_split(label, ' ') AS l FROM (
          SELECT *, {_gen_sql("input", key)} AS generation
          FROM (SELECT *, 'Syllogistic: ' || input_premise || ' <sep> ' || conclusion AS input FROM ({src}))))"""


_R1 = """SELECT v.idx, 1 AS round, t.target, CASE t.target WHEN 'prem1' THEN v.premise_2 ELSE v.premise_1 END AS input_premise,
  v.conclusion, CASE t.target WHEN 'prem1' THEN v.premise_1 ELSE v.premise_2 END AS label
FROM valid v CROSS JOIN (SELECT unnest(['prem1', 'prem2']) AS target) t"""
_R2 = """SELECT v.idx, 2 AS round, t.target, CASE t.target WHEN 'prem1' THEN g2.generation ELSE g1.generation END AS input_premise,
  v.conclusion, CASE t.target WHEN 'prem1' THEN v.premise_1 ELSE v.premise_2 END AS label
FROM valid v JOIN c1 g1 ON v.idx = g1.idx AND g1.target = 'prem1' JOIN c1 g2 ON v.idx = g2.idx AND g2.target = 'prem2'
CROSS JOIN (SELECT unnest(['prem1', 'prem2']) AS target) t"""


@query("chain_two_rounds", with_ctes(["valid"], [("c1", _chain_round(_R1)), ("c2", _chain_round(_R2))],
                                     "SELECT * FROM c1 UNION ALL SELECT * FROM c2"))
def chain_two_rounds(spark, d):
    return CH.chain(X.valid(spark, d), 2)


@query("chain_resumed", with_ctes(["valid"], [("c1", _chain_round(_R1)), ("c2", _chain_round(_R2))],
                                  "SELECT * FROM c1 UNION ALL SELECT * FROM c2"))
def chain_resumed(spark, d):
    """C5 with a ledger: a run that stops after its first chunk, and a second that goes on from there."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    ledger = LG.Ledger(spark, folder, CH.generate_with_columns, "drop-token-10", chunk_rows=100_000)
    v, ledger.chunks_left = X.valid(spark, d), 1
    try:
        return CH.chain(v, 2, ledger=ledger)
    except LG.Stopped:
        ledger.chunks_left = None
        return CH.chain(v, 2, ledger=ledger)


@query("html_table_rows", with_ctes(["generation"], [], """
SELECT round, target, idx,
  nullif(replace(replace(replace(regexp_replace(regexp_replace(generation, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g'),
         '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '') AS generation,
  nullif(replace(replace(replace(regexp_replace(regexp_replace(label, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g'),
         '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '') AS label
FROM generation"""))
def html_table_rows(spark, d):
    """S3 round trip: generations rendered as HTML tables (documents of bounded size per round and
    target), then read back table -> rows -> cells."""
    g = HT.bounded_documents(X.generated(spark, d), ["round", "target"], "idx", ["generation", "label"])
    docs = HT.render_tables(g, ["round", "target", "doc"], "idx", ["idx", "generation", "label"])
    rows = HT.extract_first_table(docs, "html", ["round", "target"])
    return rows.select("round", "target", HT.cell("idx").try_cast("long").alias("idx"),
                       HT.cell("generation").alias("generation"), HT.cell("label").alias("label"))


def _leaderboard_sql() -> str:
    # every score is per run, so old rows + (new rows anti-joined on model_name) is the score grid of all runs
    return ORACLE["score_grid"]


@query("leaderboard_append", _leaderboard_sql())
def leaderboard_append(spark, d):
    """A table under the checkpoint folder.  The second batch holds one new model, and the stored models
    again with other scores, which must not replace the stored ones."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/leaderboard-{uuid.uuid4().hex}"
    sinks.append_leaderboard(MT.score_grid(X.scored_run(spark, d), X.token_vectors(spark, d), "run"), path)
    stored = spark.read.schema(sinks.LEADERBOARD).parquet(path)
    other = stored.withColumns({c: F.lit(2.0) for c in stored.columns if c != "model_name"})
    new = MT.score_grid(X.conversation_pairs(spark, d), X.token_vectors(spark, d), "run")
    sinks.append_leaderboard(new.unionByName(other), path)
    return spark.read.schema(sinks.LEADERBOARD).parquet(path)


@query("family_round_trip", with_ctes(["generation"], [], """
SELECT round, target, idx, nullif(generation, '') AS generation, nullif(label, '') AS label FROM generation"""))
def family_round_trip(spark, d):
    """Generations written as CSV under their keys, read back as one family with the keys of the paths."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/generations-{uuid.uuid4().hex}"
    cols = ["idx", "generation", "label"]
    gen = X.generated(spark, d).select(*cols, "round", "target")
    sinks.write_generations(gen, path, "csv")
    schema = gen.select(*cols).schema
    back = files.read_family(spark, f"{path}/*/*/*.csv", schema, {"round": r"round=(\d+)", "target": r"target=(\w+)"})
    return back.select(F.col("round").cast("int").alias("round"), "target", *cols)


@query("training_set_files", with_ctes(["generation", "valid"], method_cte("ori_mix"), "SELECT 'ori_mix' AS method, * FROM tset WHERE round <= 2"))
def training_set_files(spark, d):
    """The sets of all methods written by (method, round); one cumulative set read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/sets-{uuid.uuid4().hex}"
    sinks.write_training_sets(A.all_methods(*X.valid_and_generation(spark, d), True, FLOOR, CEIL), path)
    return sinks.read_training_set(spark, path, "ori_mix", 2).select("method", *A.SET_COLS)


@query("epoch_log_stream", with_ctes(["epoch_log"], [], "SELECT * FROM epoch_log"))
def epoch_log_stream(spark, d):
    work = f"{checkpoint_dir(spark).rstrip('/')}/epoch_log_stream-{uuid.uuid4().hex}"
    return STR.stream_epoch_log(X.epoch_log(spark, d), work)


@query("best_epoch_stream", ORACLE["model_selection"])
def best_epoch_stream(spark, d):
    """Every run's best epoch from a stream that keeps the last rows of its folds as state.  The log arrives out of
    order (files by a hash of its rows), and all of it twice."""
    work = f"{checkpoint_dir(spark).rstrip('/')}/best_epoch_stream-{uuid.uuid4().hex}"
    log = X.epoch_log(spark, d).select(*[f.name for f in STR.LOG_SCHEMA.fields])
    log.union(log).repartition(6, F.xxhash64("run", "fold", "seq")).write.parquet(f"{work}/incoming")
    BEST.follow(spark, f"{work}/incoming", f"{work}/best", f"{work}/checkpoint", n=21, k=5, files_per_trigger=2).awaitTermination()
    return BEST.read_best(spark, f"{work}/best")
