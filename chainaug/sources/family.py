"""A family of generation files as one Spark source.

The keys of a run (round, target, model, fold, epoch) stand in the names of its files.  A partition is a file; the key columns
come from its path, and the values asked for (``only``) decide which files are read at all: a round or fold that is not asked
for is never opened.  They are options, not filters that Spark pushes down: Spark 4.1 keeps the partitions of a Python source from
one use of a frame to the next, filters included, so a frame used under two filters would give wrong rows.  Columns go by each file's
own header, so files with a stray index column, or with their columns in another order, mix.

Only file names pass through the driver; files are read by tasks, a batch of rows at a time."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from fnmatch import fnmatch
from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

NAME = "generation_files"
BLOCK_BYTES = 16 << 20  # a row of a CSV file lies within one such block
BATCH_ROWS = 1000


def split_glob(path: str) -> tuple[str, str]:
    """The folder above the first wildcard of a path, and the whole path as a pattern."""
    folder = re.split(r"[*?\[]", path, maxsplit=1)[0]
    return (folder.rsplit("/", 1)[0] or "/") if folder != path else path, path


def list_files(path: str) -> list[str]:
    """The files of a folder (with those of its folders), a file or a pattern, in order; hidden ones and markers are left out."""
    from pyarrow.fs import FileSelector, FileSystem, FileType

    path = re.sub("^file:/+", "/", path)
    scheme, inner = path.split("://", 1) if "://" in path else ("file", path)
    folder, pattern = split_glob(inner)
    store, base = FileSystem.from_uri(f"{scheme}://{folder}")
    info = store.get_file_info(base)
    if info.type == FileType.NotFound:
        return []
    found = [info] if info.type == FileType.File else store.get_file_info(FileSelector(base, recursive=True))
    names = [f.path for f in found if f.type == FileType.File and not f.base_name.startswith(("_", "."))]
    if pattern != folder:
        names = [n for n in names if fnmatch(n, pattern)]
    return [f"{scheme}://{n}" for n in sorted(names)]


class FilePartition(InputPartition):
    def __init__(self, file: str, keys: dict):
        self.file, self.keys = file, keys


class _FirstTable(HTMLParser):
    """The rows of the first table of a document: its first row names the columns."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.cell, self.inside, self.done = [], None, False, False

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.inside = True
        elif self.inside and tag == "tr":
            self.rows.append([])
        elif self.inside and tag in ("td", "th"):
            self._end()
            if not self.rows:
                self.rows.append([])
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._end()
        if tag == "table" and self.inside:
            self.inside, self.done = False, True

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _end(self):
        if self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()) or None)
            self.cell = None


def read_html(stream, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    parser = _FirstTable()
    while block := stream.read(BLOCK_BYTES):
        parser.feed(block.decode("utf-8", "replace"))
        if parser.done:
            break
    parser.close()
    header, *rows = parser.rows or [[]]
    at = {name: i for i, name in reversed(list(enumerate(header)))}
    for begin in range(0, len(rows), BATCH_ROWS):
        part = rows[begin : begin + BATCH_ROWS]
        columns = [pa.array([r[at[f.name]] if f.name in at and at[f.name] < len(r) else None for r in part], pa.string()).cast(f.type) for f in schema]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def read_csv(stream, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows by the file's own header; columns that it lacks are null, others are left out."""
    options = csv.ConvertOptions(
        column_types=schema, include_columns=schema.names, include_missing_columns=True, strings_can_be_null=True,
        quoted_strings_can_be_null=True, null_values=[""])
    try:
        reader = csv.open_csv(stream, csv.ReadOptions(block_size=BLOCK_BYTES), csv.ParseOptions(newlines_in_values=True), options)
    except pa.ArrowInvalid as e:
        if "Empty CSV file" in str(e):
            return
        raise
    for batch in reader:
        for begin in range(0, len(batch), BATCH_ROWS):
            yield batch.slice(begin, BATCH_ROWS)


class FamilyReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.path, self.patterns, self.format = options["path"], json.loads(options.get("keys", "{}")), options.get("fileformat", "csv")
        self.schema, self.only = schema, json.loads(options.get("only", "{}"))

    def _keys(self, file: str) -> dict:
        """Key values of a file, in their columns' types; a name without the key has a null."""
        out = {}
        for name, pattern in self.patterns.items():
            m = re.search(pattern, unquote(file))
            kind = self.schema[name].dataType
            out[name] = None if m is None else int(m[1]) if isinstance(kind, (T.IntegerType, T.LongType)) else m[1]
        return out

    def partitions(self) -> list[InputPartition]:
        files = [FilePartition(f, self._keys(f)) for f in list_files(self.path)]
        return [p for p in files if all(p.keys[name] in values for name, values in self.only.items())]

    def read(self, partition: FilePartition | None) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        if partition is None:  # Spark reads once even where there is no partition
            return
        whole = to_arrow_schema(self.schema)
        inner = pa.schema([f for f in whole if f.name not in self.patterns])
        store, path = FileSystem.from_uri(partition.file)
        with store.open_input_stream(path) as stream:
            for batch in (read_html if self.format == "html" else read_csv)(stream, inner):
                columns = [pa.array([partition.keys[f.name]] * len(batch), f.type) if f.name in self.patterns else batch[f.name] for f in whole]
                yield pa.RecordBatch.from_arrays(columns, schema=whole)


class FamilySource(DataSource):
    """``spark.read.format("generation_files").schema(...)`` with the options ``path``, ``keys`` (JSON: column -> pattern with one group,
    searched in the file's name), ``only`` (JSON: key column -> values asked for) and ``fileformat`` (``csv`` or ``html``); the
    schema holds the key columns too."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FamilyReader(schema, dict(self.options))


def read_files(spark: SparkSession, path: str, schema: T.StructType, keys: dict[str, tuple[str, T.DataType]] | None = None,
               only: dict[str, list] | None = None, fmt: str = "csv") -> DataFrame:
    """The files of ``path`` (folder, file or pattern) with the columns of ``schema`` and a column for each of ``keys``
    (name -> pattern and type); with ``only`` (key -> values) just the files of those values.  No file, no rows."""
    keys, only = keys or {}, only or {}
    unknown = sorted(set(only) - set(keys))
    if unknown:
        raise ValueError(f"no key named {', '.join(unknown)}")
    spark.dataSource.register(FamilySource)
    whole = T.StructType([*schema.fields, *(T.StructField(name, kind) for name, (_, kind) in keys.items())])
    return spark.read.format(NAME).schema(whole).options(
        path=path, fileformat=fmt, only=json.dumps(only), keys=json.dumps({name: pattern for name, (pattern, _) in keys.items()})).load()
