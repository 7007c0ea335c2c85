"""Every registered query against its DuckDB oracle (row count, columns, values) at sf0.001."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from chainaug.plans import all_queries
from sf_paths import SF_SMALL

TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
NAMES = sorted(all_queries.QUERIES)  # those of the subpackage llm have tests of their own


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "tolist"):
        v = v.tolist()
    return v


def _rows(df, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in df.to_dict("records")), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    return c


def test_every_query_has_oracle():
    assert set(all_queries.ORACLE) == set(all_queries.QUERIES)
    assert set(all_queries.QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["idx", "round", "source", "premise_1", "premise_2", "conclusion", "relation"]


# Spark simple type -> DuckDB type name
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    got = _rows(sdf.toPandas(), cols)
    rel = con.sql(E.oracle_sql()[name])
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in sdf.schema.fields:
        assert TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) == duck_types.get(f.name), f.name
    want_df = rel.df()
    assert sorted(want_df.columns) == cols
    assert got == _rows(want_df, cols)
