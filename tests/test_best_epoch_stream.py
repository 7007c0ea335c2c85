"""The stateful best-epoch stream against the batch plan."""

import os
import random

import pandas as pd
import pytest

from chainaug.operators import selection as S
from chainaug.streaming import best_epoch as B

NAMES = [f.name for f in B.LOG_SCHEMA.fields]


def made_log(seed=1, runs=("a", "b"), folds=5, last=9):
    rng, rows = random.Random(seed), []
    for run in runs:
        for fold in range(folds):
            for seq in range(rng.randint(last - 3, last)):
                rows.append((run, fold, seq * 2, seq - 1, *(round(rng.random(), 6) if rng.random() > 0.02 else None for _ in range(5)), 10 + seq))
    return rows


class Fake:
    """The states that a handle would give, in memory."""

    def __init__(self):
        self.map, self.value = {}, None

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return self

    def iterator(self):
        return iter(list(self.map.items()))

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def run_ring(batches, n, k=5):
    state, out, sizes = Fake(), [], []
    ring = B.EpochRing(n, k, "rouge12L")
    ring.init(state)
    for batch in batches:
        frame = pd.DataFrame(batch, columns=NAMES)
        out += [tuple(r) for f in ring.handleInputRows(("a",), iter([frame.iloc[:3], frame.iloc[3:]]), None) for r in f.itertuples(index=False)]
        sizes.append(len(state.map))
    return out, sizes


@pytest.mark.parametrize("n", [3, 6, 21])
def test_ring_equals_the_batch_plan_in_any_order(spark, n):
    rows = made_log(runs=("a",))
    want = S.model_selection(spark.createDataFrame(rows, B.LOG_SCHEMA), n, 5).collect()
    for seed in range(4):
        shuffled = rows + rows[::2]  # some rows arrive again
        random.Random(seed).shuffle(shuffled)
        out, sizes = run_ring([shuffled[i : i + 7] for i in range(0, len(shuffled), 7)], n)
        assert out[-1] == tuple(want[0]) and len(out) == len(dict.fromkeys(zip(range(len(out)), out)))
        assert all(a[1:] != b[1:] for a, b in zip(out, out[1:]))  # a row goes out on a change only
        assert max(sizes) <= 5 * n  # and the state is bounded


def test_of_two_rows_with_one_place_the_smaller_stays():
    row = lambda v: ("a", 0, 0, 0, v, v, v, v, v, 1)
    for order in ([0.5, 0.25], [0.25, 0.5]):
        assert run_ring([[row(v)] for v in order], 21, k=1)[0][-1] == ("a", 0, 1.0)


def test_folds_that_lack_a_position_and_rows_without_a_place():
    rows = [("a", f, s, 0, 0.1, 0.1, 0.1, 0.1 + s / 10, 0.0, 1) for f in range(5) for s in range(3 if f else 2)]
    out, _ = run_ring([rows[:-1] + [("a", None, 1, 0, 9.0, 9.0, 9.0, 9.0, 9.0, 1), ("a", 1, None, 0, 9.0, 9.0, 9.0, 9.0, 9.0, 1)]], 21)
    assert out == [("a", 1, 0.5)]  # position 2 is in four folds only
    assert run_ring([rows[:4]], 21)[0] == []


def test_stream_of_files_replayed_and_restarted_equals_the_batch_plan(spark, tmpdir_path):
    src, best, ckpt = (os.path.join(tmpdir_path, x) for x in ("in", "best", "checkpoint"))
    rows = made_log(3)
    random.Random(2).shuffle(rows)
    half = len(rows) // 2
    for part in (rows[:half], rows[half // 2 : half]):
        spark.createDataFrame(part, B.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    provider = spark.conf.get(B._PROVIDER)
    B.follow(spark, src, best, ckpt, files_per_trigger=2).awaitTermination()
    want = S.model_selection(spark.createDataFrame(rows[:half], B.LOG_SCHEMA)).collect()
    assert sorted(map(tuple, B.read_best(spark, best).collect())) == sorted(map(tuple, want))
    spark.createDataFrame(rows[half:], B.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    B.follow(spark, src, best, ckpt, files_per_trigger=2).awaitTermination()  # goes on from its state
    want = S.model_selection(spark.createDataFrame(rows, B.LOG_SCHEMA)).collect()
    assert len(want) == 2 and sorted(map(tuple, B.read_best(spark, best).collect())) == sorted(map(tuple, want))
    assert spark.conf.get(B._PROVIDER) == provider
