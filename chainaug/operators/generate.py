"""G1: out-of-fold batch generation with a pluggable generator.

Two kinds of generator:
* a *column generator* ``(label: Column, key: Column) -> Column`` is an expression over the row (the
  built-in deterministic one below hashes an Arrow batch of rows at a time);
* a *pandas generator* ``fn(fold: int, pdf: DataFrame) -> Series`` runs in ``mapInPandas``
  (iterator form, so a model is loaded once per Python worker and reused across batches).
Rows carry their ``fold`` so the generator picks the model trained without that fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.drop import drop_tokens
from ..functions.overlap import token_f1
from ..functions.text import prompt_prefix


def drop_token_generator(label: Column, key: Column, modulus: int = 10) -> Column:
    """Built-in deterministic generator: split the target text on single spaces and drop the
    token at 1-based position i when H(key:i) mod ``modulus`` = 0; keep the text if every
    token would go."""
    return drop_tokens(label, key, F.lit(modulus), whole=True)


def overlap_f1(generation: Column, label: Column) -> Column:
    """Token F1: 2 |overlap| / (|generation| + |label|) on single-space tokens, where a token counts as
    often as both texts hold it."""
    return token_f1(generation, label)


def generate_with_pandas(
    rows: DataFrame,
    fn: Callable[[int, pd.DataFrame], pd.Series],
    input_col: str = "input",
    label_col: str = "label",
) -> DataFrame:
    """Apply a pandas generator per Arrow batch; output = input rows + ``generation`` string.

    Partitions stay as they are: each batch is split by fold so the generator receives rows
    of one fold at a time (and can hold one model per fold).  It generates from ``input_col`` and
    never sees ``label_col``."""
    if input_col not in rows.columns:
        raise ValueError(f"no column {input_col!r} to generate from")
    schema = T.StructType(list(rows.schema.fields) + [T.StructField("generation", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            parts = []
            for fold, part in pdf.groupby("fold", sort=False):
                part = part.copy()
                part["generation"] = list(fn(int(fold), part.drop(columns=[label_col], errors="ignore")))
                parts.append(part)
            yield pd.concat(parts)

    return rows.mapInPandas(run, schema=schema)


def generation_rows(valid_with_folds: DataFrame, rounds: int = 3, targets=("prem1", "prem2")) -> DataFrame:
    """(idx, fold, round, target, input premise pair, label) rows to generate: every valid row,
    once per round and premise target."""
    r = valid_with_folds.select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")
    )
    t = r.select("*", F.explode(F.array(*[F.lit(x) for x in targets])).alias("target"))
    label = F.when(F.col("target") == "prem1", F.col("premise_1")).otherwise(F.col("premise_2"))
    return t.withColumn("label", label).withColumn("input", input_prompt(F.col("target"), F.col("premise_1"), F.col("premise_2"), F.col("conclusion")))


def input_prompt(target: Column, premise_1: Column, premise_2: Column, conclusion: Column) -> Column:
    """What a model is given to write the target premise: the other premise and the conclusion (T2 form)."""
    other = F.when(target == "prem1", premise_2).otherwise(premise_1)
    return prompt_prefix(other, conclusion, F.lit(""))[0]
