"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and reread.

Registered as query ``pipeline``; counted as part of the subpackage ``llm``.  A stage takes
``(spark, docs, sf_dir)``, works on all rows that the one before it kept, and returns the columns of
``documents`` (the last: pieces of packed sequences)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainaug.llm import decontaminate, ngram_join, packing, quality, secret_scan
from chainaug.llm.tables import Stage, prepare, semi_join_texts, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more stay.  The classifier is fitted on the labelled rows
    among ``docs``, without the held-out fold; where there are none, all stay."""
    prepare(spark)
    return quality.keep_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: the
    one with the smallest doc_id.  Rows that share a doc_id stay or go together, those equal in every column
    as one row; rows without a doc_id stay."""
    prepare(spark)
    stage = Stage(spark)
    groups = stage.write(ngram_join.jaccard_components(docs, words_per_shingle=5, threshold=0.8), "groups")
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = semi_join_texts(docs, gone, "doc_id", gone.count(), how="left_anti").select(docs.columns)
    repeated = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates().union(kept.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten words of a ``benchmark`` item go."""
    prepare(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), n=10, action="document")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each secret in a text is replaced by its kind in brackets."""
    prepare(spark)
    return secret_scan.redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: The classifier and the packing have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    prepare(spark)
    stage = Stage(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        following = stage.write(step(spark, docs, sf_dir), name.replace(" ", "_"))
        if hasattr(docs, "_staged_path"):
            stage.drop(docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
