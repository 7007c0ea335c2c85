"""Token overlap and embedding F1 against plain loops."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from sf_paths import SF_SMALL

from chainaug.functions import embedding as EM
from chainaug.functions import overlap as OV
from chainaug.operators import metrics as MT
from chainaug.operators.generate import overlap_f1
from chainaug.sources import fixtures as X


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "b", " ", "  ", "c d", "é", "long-word"]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_overlap_equals_multisets():
    left, right = random_texts(4000, 1), random_texts(4000, 2)
    common, n_left, n_right = OV.overlap(pa.array(left), pa.array(right))
    for g, t, k, a, b in zip(left, right, common, n_left, n_right):
        g, t = g.split(" "), t.split(" ")
        assert (k, a, b) == ((Counter(g) & Counter(t)).total(), len(g), len(t))


def test_overlap_of_long_texts_is_linear():
    rng = random.Random(3)
    pair = [pa.array([" ".join(str(rng.randint(0, 5000)) for _ in range(20_000))]) for _ in range(2)]
    OV.overlap(*pair)
    began = time.perf_counter()
    OV.overlap(*pair)
    assert time.perf_counter() - began < 0.1


def test_overlap_column_of_nulls_empties_and_chunks(spark, monkeypatch):
    rows = [(None, "a"), ("a", None), ("", ""), ("a b", "b a"), ("a a b", "a b b"), ("x " * 5000, "x")]
    df = spark.createDataFrame(rows, "g string, t string")
    got = [r[0] for r in df.select(overlap_f1(df.g, df.t)).collect()]
    assert got[:5] == [None, None, 1.0, 1.0, 0.666667] and got[5] == pytest.approx(2 / 5002, abs=1e-6)
    assert list(OV.chunks(pa.array(["abc", "d", None, "efgh"]), pa.array(["", "x", "y", "z"]), 4)) == [(0, 1), (1, 3), (3, 4)]


def plain_f1(pred, ref, table):
    """All tokens against all tokens, dimension by dimension."""
    a, b = ([table[t] for t in side.split(" ") if t and t in table] for side in (pred, ref))
    if not a or not b:
        return 0.0, 0.0, 0.0

    def dot(x, y):
        total = 0.0
        for u, v in zip(x, y):
            total += u * v
        return total

    sims = [[dot(x, y) / (dot(x, x) ** 0.5 * dot(y, y) ** 0.5) for y in b] for x in a]
    r6 = lambda x: float(np.floor(x * 1e6 + 0.5) / 1e6)
    mean = lambda v: r6(sum(np.floor(x * 1e6 + 0.5) for x in v) / (len(v) * 1e6))
    p, r = mean([max(row) for row in sims]), mean([max(col) for col in zip(*sims)])
    return p, r, r6(2 * p * r / (p + r)) if p + r > 0 else 0.0


@pytest.fixture(scope="module")
def word_table():
    rng = np.random.default_rng(7)
    table = {f"w{i}": rng.normal(size=8).tolist() for i in range(40)}
    table["w40"] = [2 * x for x in table["w0"]]  # parallel to another token's vector
    return table


def arrow_table(table):
    return EM.vectors(pa.array(list(table), pa.large_string()), np.array(list(table.values())))


@pytest.mark.parametrize("cells, few", [(1 << 22, 1024), (50, 0), (1, 0)])
def test_scores_equal_a_plain_loop(word_table, monkeypatch, cells, few):
    """Also in blocks of one row, and with a pass per dimension for every size."""
    monkeypatch.setattr(EM, "BLOCK_CELLS", cells)
    monkeypatch.setattr(EM, "_FEW_CELLS", few)
    rng, words = random.Random(5), [*word_table, "unknown", ""]
    texts = [[" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(120)] for _ in range(2)]
    got = EM.score(*map(pa.array, texts), arrow_table(word_table))
    for pred, ref, row in zip(*texts, got):
        assert tuple(row) == plain_f1(pred, ref, word_table)


def test_a_zero_vector_makes_no_number():
    table = arrow_table({"zero": [0.0, 0.0], "one": [1.0, 0.0]})
    with np.errstate(invalid="ignore"):
        assert np.isnan(EM.score(pa.array(["zero one"]), pa.array(["one"]), table)[0]).any()


def test_scores_do_not_depend_on_buckets_and_use_one_vector_per_token(spark):
    pairs, table = X.scored_run(spark, SF_SMALL), X.token_vectors(spark, SF_SMALL)
    want = sorted(tuple(r) for r in MT.embedding_f1(pairs, ["run"], table, buckets=1).collect())
    assert len(want) == pairs.count()
    twice = table.union(table).union(spark.createDataFrame([(None, [1.0]), ("x", None), ("y", [None])], f"token string, embedding {table.schema['embedding'].dataType.simpleString()}"))
    for frame, buckets in ((table, 37), (twice, 5)):
        assert sorted(tuple(r) for r in MT.embedding_f1(pairs, ["run"], frame, buckets=buckets).collect()) == want


def test_vectors_travel_once_per_bucket_and_are_never_collected(spark):
    plan = MT.embedding_f1(X.scored_run(spark, SF_SMALL), ["run"], X.token_vectors(spark, SF_SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan
