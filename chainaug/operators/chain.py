"""C1 (score and attach) and C5 (chained rounds).

C5: round 1 generates premise 1 from (premise 2, conclusion) and premise 2 from
(premise 1, conclusion).  Round r+1 generates premise 1 from (round-r generated premise 2,
conclusion) and premise 2 from (round-r generated premise 1, conclusion); labels are always the
original premises.  Bands are not applied between rounds.  Each round is materialised (reliable
checkpoint in the shared checkpoint folder) so the plan does not grow with the number of rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import phash
from ..functions.text import prompt_prefix
from ..session import materialize
from . import metrics as MT
from .generate import drop_token_generator, generate_with_pandas, overlap_f1
from .ledger import Ledger


def chain_key(round_: Column, target: Column, idx: Column, input_premise: Column) -> Column:
    """Generator key of a chained row: depends on the input premise, so round r+1 really
    depends on round r's output."""
    return F.concat_ws(":", round_, target, idx, phash(input_premise))


def _round_rows(originals: DataFrame, prev: DataFrame | None, r: int) -> DataFrame:
    fold = [c for c in ("fold",) if c in originals.columns]
    o = originals.select("idx", *fold, "premise_1", "premise_2", "conclusion")
    if prev is None:
        p1_in, p2_in = F.col("premise_2"), F.col("premise_1")
        base = o
    else:
        gen = prev.groupBy("idx").agg(
            F.max(F.when(F.col("target") == "prem1", F.col("generation"))).alias("g1"),
            F.max(F.when(F.col("target") == "prem2", F.col("generation"))).alias("g2"))
        base = o.join(gen, "idx")
        p1_in, p2_in = F.col("g2"), F.col("g1")
    rows = base.select(
        "idx", *fold, "conclusion",
        F.explode(F.array(
            F.struct(F.lit("prem1").alias("target"), p1_in.alias("input_premise"), F.col("premise_1").alias("label")),
            F.struct(F.lit("prem2").alias("target"), p2_in.alias("input_premise"), F.col("premise_2").alias("label")),
        )).alias("x"))
    return rows.select("idx", *fold, F.lit(r).alias("round"), "x.target", "x.input_premise", "conclusion", "x.label")


def generate_with_columns(rows: DataFrame, generator: Callable[[Column, Column], Column] = drop_token_generator) -> DataFrame:
    """Rows of a round with the ``generation`` of a column generator."""
    key = chain_key(F.col("round"), F.col("target"), F.col("idx"), F.col("input_premise"))
    return rows.withColumn("generation", generator(F.col("input"), key))


def chain(originals: DataFrame, rounds: int,
          generator: Callable[[Column, Column], Column] = drop_token_generator,
          pandas_generator: Callable | None = None, ledger: Ledger | None = None) -> DataFrame:
    """All rounds 1..rounds of chained generation, one materialised table per round.

    A generator gets the input premises as a prompt (``input``), never the label: ``generator`` as
    columns, or ``pandas_generator(fold, rows)`` a fold at a time (``originals`` then carry ``fold``).  With a
    ``ledger`` (and its generator) a round makes only what no earlier run has committed."""
    prev, out = None, []
    for r in range(1, rounds + 1):
        rows = _round_rows(originals, prev, r)
        rows = rows.withColumn("input", prompt_prefix(F.col("input_premise"), F.col("conclusion"), F.lit(""))[0])
        if ledger is not None:
            g = ledger.generated(rows, [c for c in rows.columns if c not in ("conclusion", "label")])  # the prompt holds the conclusion
        elif pandas_generator is not None:
            g = generate_with_pandas(rows, pandas_generator)
        else:
            g = generate_with_columns(rows, generator)
        g = g.withColumn("f1", overlap_f1(F.col("generation"), F.col("label")))
        g = materialize(g.select("idx", "round", "target", "input", "generation", "label", "f1"))
        out.append(g)
        prev = g
    result = out[0]
    for g in out[1:]:
        result = result.unionByName(g)
    return result


def premise_merge(generation: DataFrame, originals: DataFrame, vectors: DataFrame) -> DataFrame:
    """C1 (``generation`` hash-partitioned by idx, as stored by the generation step): score every generated
    premise against its label by embedding F1 (the text travels with its score), keep the raw premise
    tables, attach the conclusion by key, and build the next-round input rows: generated premise
    + its score + the other original premise + relation + conclusion."""
    g = MT.embedding_f1(
        generation.select("round", "target", "idx", "generation", "label"), ["round", "target"], vectors,
        stored=True, carry=["generation"])
    # J5 (conclusion by key) and J1/J2 (other original premise) in one join on idx
    j = g.join(originals.select("idx", "premise_1", "premise_2", "relation", "conclusion"), "idx")
    other = F.when(F.col("target") == "prem1", F.col("premise_2")).otherwise(F.col("premise_1"))
    return j.select("idx", "round", "target", F.col("generation").alias("aug_premise"), F.col("f1").alias("aug_f1"),
                    other.alias("other_premise"), "relation", "conclusion")
