"""Tokens of a text dropped by a hash of their places, as an Arrow UDF."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: tokens hashed at once (a longer text is worked on alone)
CHUNK_TOKENS = 1 << 18


def _kept(texts: list, keys: list, moduli: list, whole: bool) -> list:
    split = [t.split(" ") for t in texts]
    places = [b":%d" % i for i in range(1, max(map(len, split), default=0) + 1)]
    digests = b"".join(md5(k + p, usedforsecurity=False).digest() for k, tokens in zip(keys, split) for p in places[: len(tokens)])
    draws = np.frombuffer(digests, dtype=">u4")[::4].astype(np.int64)
    sizes = [len(t) for t in split]
    keep = (draws % np.repeat(np.array(moduli, dtype=np.int64), sizes) != 0).tolist()
    out, at = [], 0
    for text, tokens, n in zip(texts, split, sizes):
        kept = [t for t, k in zip(tokens, keep[at : at + n]) if k]
        out.append(" ".join(kept) if kept or not whole else text)
        at += n
    return out


def _drop(texts: pa.Array, keys: pa.Array, moduli: pa.Array, whole: bool) -> pa.Array:
    rows = zip(texts.to_pylist(), keys.to_pylist(), moduli.to_pylist())
    out: list = [None] * len(texts)
    places, batch, tokens = [], [], 0
    for i, (text, key, modulus) in enumerate(rows):
        if text is None or key is None:
            continue
        places.append(i)
        batch.append((text, key.encode(), modulus))
        tokens += text.count(" ") + 1
        if tokens >= CHUNK_TOKENS:
            for j, kept in zip(places, _kept(*map(list, zip(*batch)), whole)):
                out[j] = kept
            places, batch, tokens = [], [], 0
    if batch:
        for j, kept in zip(places, _kept(*map(list, zip(*batch)), whole)):
            out[j] = kept
    return pa.array(out, pa.string())


@F.arrow_udf(StringType())
def _drop_some(texts: pa.Array, keys: pa.Array, moduli: pa.Array) -> pa.Array:
    return _drop(texts, keys, moduli, whole=True)


@F.arrow_udf(StringType())
def _drop_any(texts: pa.Array, keys: pa.Array, moduli: pa.Array) -> pa.Array:
    return _drop(texts, keys, moduli, whole=False)


def drop_tokens(text: Column, key: Column, modulus: Column, whole: bool) -> Column:
    """``text`` without the tokens (single-space split) at the 1-based places i where H(key:i) mod ``modulus`` = 0, joined by
    single spaces; null for a null.  ``whole`` keeps a text that would lose all its tokens."""
    return (_drop_some if whole else _drop_any)(text.cast("string"), key.cast("string"), modulus.cast("long"))
