import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_helpers import DOCS, TOKENIZER, edge_rows  # noqa: E402

from chainaug.llm.tables import prepare  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def ready(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """The edge rows with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(edge_rows(), DOCS).repartition(3)
    for name in ("start", "length", "component_id", "node", "key", "rank", "score", "ids", "part", "row", "bin"):
        df = df.withColumn(name, F.lit("extra"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids
