"""Plan shape: no single-partition exchange for numbering, filters below joins, one text
exchange for the n-gram metrics, column pruning at the scan."""

from chainaug.operators import metrics as MT
from chainaug.plans import all_queries as Q
from chainaug.sources import fixtures as X
from sf_paths import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_numbering_has_no_single_partition_exchange(spark):
    for name in ("kfold_assign", "row_index", "seeded_shuffle", "training_batches"):
        df = Q.QUERIES[name](spark, SF_SMALL)
        df.collect()
        assert "SinglePartition" not in _plan(df), name


def test_band_filters_sit_below_the_join(spark):
    df = Q.QUERIES["ori_mix"](spark, SF_SMALL)
    plan = _plan(df)
    lines = plan.splitlines()
    joins = [i for i, line in enumerate(lines) if "Join" in line]
    bands = [i for i, line in enumerate(lines) if "Filter" in line and "0.99" in line]
    assert joins and bands
    # each band filter is printed after (i.e. below) a join node: it runs on the join's input
    assert all(b > min(joins) for b in bands)


def test_ngram_metrics_shuffle_text_once(spark):
    pairs = X.scored_run(spark, SF_SMALL)
    df = MT.corpus_bleu(pairs, ["run"])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    # one exchange on (run, idx) for the texts and one on run for the final sums; the n-gram
    # aggregations reuse the first partitioning
    hashed = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "ShuffleQueryStage" in line]
    assert sum("hashpartitioning(run" in line and "idx" in line for line in plan.splitlines()) >= 1
    assert not any("hashpartitioning(run#" in line and "gram" in line for line in plan.splitlines()), hashed


def test_corpus_scan_prunes_columns(spark):
    df = X.corpus(spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "ReadSchema: struct<doc_id:bigint,quality:int>" in plan


def test_merges_are_co_partitioned(spark):
    """Valid rows and generations are stored hash-partitioned by idx, so the merge joins of the
    three methods run without any exchange."""
    for name in ("ori_mix", "aug_pair", "aug_mix"):
        df = Q.QUERIES[name](spark, SF_SMALL)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, (name, plan)
