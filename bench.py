"""Benchmark: headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; one warm-up, then the median of $BENCH_REPS timed runs per query.  Each run
executes the whole plan through the ``noop`` sink (no collect).  Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["ori_mix", "aug_mix", "aug_pair", "kfold_assign", "corpus_bleu", "rouge_n", "rouge_l",
            "embedding_f1", "score_grid", "model_selection", "premise_merge", "epoch_validation", "build_vocab",
            "chain_two_rounds", "html_table_rows"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = sys.argv[1:] or HEADLINE

    from chainaug.plans import all_queries as Q
    from chainaug.session import local_session

    spark = local_session(cpus=cpus, shuffle_partitions=max(8, cpus))
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in names:
        fn = Q.QUERIES[name]
        runs = []
        for i in range(reps + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "shuffle_partitions": max(8, cpus),
        "reps": reps,
    }))


if __name__ == "__main__":
    main()
