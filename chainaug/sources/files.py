"""File sources: S1 corpus CSV (Windows-1252), S2 interchange CSV, S4 / S5 file families whose
run keys live in the path.

Spark 4 rejects the 'windows-1252' charset name, so S1 reads ISO-8859-1 (a byte -> U+00XX
mapping) and ``translate``s the 0x80-0x9F block to the characters Windows-1252 puts there.
multiLine CSV is read one task per file: convert to Parquet once and run everything from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import with_position
from .family import read_files

# Windows-1252 characters for bytes 0x80-0x9F (undefined bytes 0x81, 0x8D, 0x8F,
# 0x90, 0x9D map to themselves).
CP1252_HIGH = (
    "€\u0081‚ƒ„…†‡ˆ‰Š‹Œ\u008dŽ\u008f"
    "\u0090‘’“”•–—˜™š›œ\u009džŸ"
)
LATIN1_HIGH = "".join(chr(c) for c in range(0x80, 0xA0))

CORPUS_CSV = T.StructType([
    T.StructField("Premise 1", T.StringType()),
    T.StructField("Premise 2", T.StringType()),
    T.StructField("Syllogistic relation", T.StringType()),
    T.StructField("Conclusion", T.StringType()),
])
# Fields that a CSV reader of data frames takes for missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
           "None", "n/a", "nan", "null")
CORPUS_NAMES = {"Premise 1": "premise_1", "Premise 2": "premise_2", "Syllogistic relation": "relation",
                "Conclusion": "conclusion"}


def cp1252_fix(c):
    return F.translate(c, LATIN1_HIGH, CP1252_HIGH)


def read_corpus(spark: SparkSession, path: str, schema: T.StructType = CORPUS_CSV) -> DataFrame:
    """S1 + P1: (idx, premise_1, premise_2, relation, conclusion); idx = 0-based position of the
    record in the file(s), assigned before any filter.  Fields of ``MISSING`` are NULL."""
    raw = (spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
           .option("encoding", "ISO-8859-1").schema(schema).csv(path))
    present = lambda c: F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`"))
    cols = [cp1252_fix(present(c)).alias(CORPUS_NAMES.get(c, c)) for c in raw.columns]
    keyed = raw.select(*cols, F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_mid"))
    return with_position(keyed, ["_file", "_mid"], "idx").select("idx", *[CORPUS_NAMES.get(c, c) for c in raw.columns])


def read_interchange(spark: SparkSession, path: str | list, schema: T.StructType) -> DataFrame:
    """UTF-8 CSV written by a DataFrame writer that may have added an unnamed leading index
    column; that column (empty header) is dropped."""
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    stray = [c for c in df.columns if c in ("", "_c0") or c.startswith("Unnamed")]
    df = df.drop(*stray)
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def with_path_keys(df: DataFrame, patterns: dict) -> DataFrame:
    """Run keys from the file path, e.g. {'round': r'aug_num_(\\d+)', 'fold': r'kfold_(\\d+)'}."""
    p = F.input_file_name()
    for name, rx in patterns.items():
        df = df.withColumn(name, F.regexp_extract(p, rx, 1))
    return df


def read_family(spark: SparkSession, glob: str, schema: T.StructType, patterns: dict, fmt: str = "csv") -> DataFrame:
    """The files of a glob in one frame, keys from their paths as text columns.

    CSV columns go by each file's own header (``family.read_files``), so files with and without a stray index column mix;
    each file is read once, by the task that it falls to."""
    if fmt != "csv":
        return with_path_keys(spark.read.schema(schema).parquet(glob), patterns)
    return read_files(spark, glob, schema, {name: (pattern, T.StringType()) for name, pattern in patterns.items()})


#: pattern of a key column that holds a file's whole path
WHOLE_PATH = "^(.+)$"


def single_file_per_run(df: DataFrame, run_col: str = "run", file_col: str = "_file") -> DataFrame:
    """Runs whose folder holds more than one file."""
    return df.groupBy(run_col).agg(F.countDistinct(file_col).alias("n_files")).where(F.col("n_files") > 1)


def read_single_files(spark: SparkSession, glob: str, schema: T.StructType, run_pattern: str, fmt: str = "csv") -> DataFrame:
    """The one generation file of every run folder; several files in a folder are an error."""
    df = read_family(spark, glob, schema, {"run": run_pattern, "_file": WHOLE_PATH}, fmt)
    several = [r["run"] for r in single_file_per_run(df).limit(10).collect()]
    if several:
        raise ValueError(f"more than one file in the folders of {', '.join(several)}")
    return df.drop("_file")
