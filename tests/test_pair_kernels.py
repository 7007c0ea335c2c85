"""The Arrow kernels of pair scores and of the built-in generator against plain loops."""

from collections import Counter
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chainaug.functions import drop as D
from chainaug.functions import embedding as EM
from chainaug.functions import ngrams as N
from chainaug.functions.lcs import lcs_length
from chainaug.operators import metrics as MT


def _texts(seed, n=60):
    rng = np.random.default_rng(seed)
    return ["", "a", "a a a", *(" ".join(rng.choice(list("abcdefgh"), size=rng.integers(1, 40))) for _ in range(n))]


def _grams(text, n):
    t = text.split(" ") if text else []
    return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))


def test_overlaps_match_counted_grams():
    a, b = _texts(1), _texts(2)[::-1]
    got = N.overlaps(pa.array(a), pa.array(b), (1, 2, 3, 4), lcs=True)
    split = lambda x: x.split(" ") if x else []
    assert got[0].tolist() == [len(split(x)) for x in a] and got[1].tolist() == [len(split(x)) for x in b]
    for n in (1, 2, 3, 4):
        assert got[1 + n].tolist() == [sum((_grams(x, n) & _grams(y, n)).values()) for x, y in zip(a, b)]
    assert got[6].tolist() == [lcs_length(split(x), split(y)) for x, y in zip(a, b)]
    assert [x.tolist() for x in N.overlaps(pa.array([], pa.string()), pa.array([], pa.string()), (1, 2))] == [[]] * 4


def test_ngram_overlap_explodes_no_grams(spark):
    """No Generate and no shuffle of texts: a row of numbers per pair is all that is dealt."""
    pairs = spark.createDataFrame([("x", 1, "a b c", "a b d"), ("x", 2, None, "a"), ("x", 1, "a b c", "a b d")], "run string, idx long, generation string, label string")
    ov = MT.ngram_overlap(pairs, ["run"], F.col("generation"), F.col("label"), (1, 2))
    plan = ov._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    assert [tuple(r) for r in ov.collect()] == [("x", 1, 3, 3, 4, 2)]  # copies of a pair add up; a pair without a text is left out


def test_cosines_match_the_plain_loop(monkeypatch):
    """Matrix products give the digits of the plain loop, also where all of them count as unsure."""
    rng = np.random.default_rng(3)
    tokens = pa.array([f"t{i}" for i in range(300)])
    table = EM.vectors(tokens, rng.normal(size=(300, 24)).astype(np.float32))
    sides = [pa.array([" ".join(f"t{i}" for i in rng.integers(0, 330, size=rng.integers(0, 50))) for _ in range(80)]) for _ in range(2)]
    got = EM.score(*sides, table)
    monkeypatch.setattr(EM, "_NEAR", 1.0)
    assert (got == EM.score(*sides, table)).all()
    place = {t: i for i, t in enumerate(tokens.to_pylist())}
    for k, (x, y) in enumerate(zip(*(s.to_pylist() for s in sides))):
        a, b = ([place[t] for t in s.split(" ") if t in place] for s in (x, y))
        if not a or not b:
            assert got[k].tolist() == [0, 0, 0]
            continue
        cos = EM._dots(table.rows[a], table.rows[b]) / np.outer(table.norms[a], table.norms[b])
        assert got[k, 0] == EM._round6(np.floor(cos.max(axis=1) * 1e6 + 0.5).sum() / (len(a) * 1e6))
        assert got[k, 1] == EM._round6(np.floor(cos.max(axis=0) * 1e6 + 0.5).sum() / (len(b) * 1e6))


def test_dropped_tokens_match_the_hash(spark, monkeypatch):
    texts = ["", "a", "a  b", " a b c d e f g h ", "é ü b", None]
    rows = spark.createDataFrame([(t, f"k{i}", m) for i, t in enumerate(texts) for m in (1, 2, 5)], "t string, k string, m long")

    def want(t, k, m, whole):
        if t is None:
            return None
        kept = [w for i, w in enumerate(t.split(" "), 1) if int(md5(f"{k}:{i}".encode()).hexdigest()[:8], 16) % m]
        return " ".join(kept) if kept or not whole else t

    for r in rows.select("*", *[D.drop_tokens(F.col("t"), F.col("k"), F.col("m"), w).alias(f"d{int(w)}") for w in (False, True)]).collect():
        assert (r.d0, r.d1) == (want(r.t, r.k, r.m, False), want(r.t, r.k, r.m, True))
    monkeypatch.setattr(D, "CHUNK_TOKENS", 1)
    assert D._drop(pa.array(["a b", None, "c"]), pa.array(["x", "y", "z"]), pa.array([3, 3, 3]), True).to_pylist() == [want("a b", "x", 3, True), None, want("c", "z", 3, True)]
