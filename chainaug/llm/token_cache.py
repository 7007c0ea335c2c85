"""Operator 13: token counts through a digest cache.

A count depends on a text's normalised content and on the tokenizer alone, so it is stored under the
digests of both.  Documents are joined to the stored counts by digest; of the contents that have none,
each distinct one is encoded once, and its count is appended to the cache.

The cache is a folder of Parquet tables, one folder per tokenizer version and one below it per append.
Rows are content-addressed: a repeated or half-seen append can only mean more or fewer hits, never another
count, so lost executors, replays and several writers at once do no harm."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import chunks
from .tables import Stage, scratch_path

COUNTS = "content binary, n_tokens long"
BROADCAST_MISSES = 20_000  # up to so many (a MB) the places to encode go to the rows, beyond it both sides shuffle
_CHUNK = 1 << 20  # bytes of text encoded at once: the library keeps about 100 bytes per token meanwhile
_REMEMBERED = 400_000  # words whose counts a worker remembers (about 100 bytes each)
#: fixed value: the pattern of pieces of a lower-casing tokenizer with word ends; no piece holds white space
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_FORM = "1"  # changes whenever ``normalised`` does


class TokenizerVersion:
    """A tokenizer file and what counts depend on: its content, the library and the normal form of texts.

    ``.json`` files are read by the tokenizers library, ``.model`` files by sentencepiece."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.content = f.read()
        if path.endswith(".model"):
            import sentencepiece as library

            self.spec: dict = {}
        else:
            import tokenizers as library

            self.spec = json.loads(self.content)
        self.library = library.__name__
        parts = (_FORM, self.library, library.__version__, hashlib.sha256(self.content).hexdigest())
        self.digest = hashlib.sha256("\n".join(parts).encode()).hexdigest()
        self.by_word = self._by_word()

    def _by_word(self) -> bool:
        """Whether the count of a text is the sum over its words (between ASCII white space): white space becomes
        one space that no piece holds, and added tokens neither hold nor take white space."""
        steps = (self.spec.get("normalizer") or {}).get("normalizers") or []
        pre = ((self.spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        return (
            any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps)
            and {s.get("type") for s in steps} <= {"NFC", "Replace", "Lowercase"}
            and pre.get("type") == "Split" and pre.get("behavior") == "Removed" and pre.get("invert") is True
            and pre.get("pattern") == {"Regex": PIECES}
            and not any(set(" \t\n\r\v\f") & set(a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"]
                        for a in self.spec.get("added_tokens") or []))

    def normalised(self, text: Column) -> Column:
        """A form of ``text`` with the same count, so that copies that differ in it share an entry.

        Where words count apart, runs of ASCII white space become one space and those at the ends go.  Where the
        tokenizer also lower-cases, so does this, but for ASCII texts only (elsewhere lower case may change how
        marks compose) and not where that would spell an added token, which is matched in the text as it stands."""
        if not self.by_word:
            return text
        white = r"[\t-\r][\t-\r ]*| [\t-\r ]+"
        form = F.trim(F.regexp_replace(text, white, " "))
        if not any(s.get("type") == "Lowercase" for s in self.spec["normalizer"]["normalizers"]):
            return form
        lower = F.lower(form)
        plain = F.octet_length(form) == F.char_length(form)
        for a in self.spec.get("added_tokens") or []:
            plain = plain & (F.instr(lower, a["content"].lower()) == 0)
        return F.when(plain, lower).otherwise(form)


@functools.cache
def _counter(library: str, content: bytes) -> Callable[[list[str]], list[int]]:
    if library == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(i) for i in model.encode(texts, num_threads=1)]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class _WordCounts:
    """Counts of texts as sums over their words; the words of earlier texts are remembered."""

    def __init__(self, count: Callable[[list[str]], list[int]]):
        self.count, self.known = count, {}

    def __call__(self, texts: list[str]) -> list[int]:
        words = [t.encode().split() for t in texts]  # bytes are split at ASCII white space only
        if len(self.known) > _REMEMBERED:
            self.known = {}
        new = list(set().union(*words).difference(self.known))
        self.known.update(zip(new, self.count([w.decode() for w in new])))
        return [sum(map(self.known.__getitem__, w)) for w in words]


@functools.cache
def _word_counter(library: str, content: bytes) -> _WordCounts:
    return _WordCounts(_counter(library, content))


def _count(library: str, content, by_word: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = (_word_counter if by_word else _counter)(library, content.value)
        for batch in batches:
            texts = batch["text"].to_pylist()
            n = [k for lo, hi in chunks(texts, _CHUNK) for k in count(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([batch["content"], pa.array(n, pa.int64())], ["content", "n_tokens"])

    return run


class CountCache:
    """Stored counts of one tokenizer version: ``content`` (SHA-256 of the normalised text), ``n_tokens``."""

    def __init__(self, spark: SparkSession, folder: str, version: TokenizerVersion):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/{version.digest}"

    def counts(self) -> DataFrame:
        """One row per content; an absent cache is an empty one."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], COUNTS)
        stored = self.spark.read.schema(COUNTS).option("recursiveFileLookup", "true").parquet(self.folder)
        return stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.folder}/{uuid.uuid4().hex}")


def _located(docs: DataFrame, stage: Stage) -> DataFrame:
    """``doc_id, text`` with the place of each row: its file's hash and its number in the file.  Rows that
    don't come straight from Parquet files are written as such first, so that a place always means the same row."""
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    try:
        meta = docs.metadataColumn("_metadata")
        return docs.select(
            F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
            F.xxhash64(meta.getField("file_path")).alias("file"), meta.getField("row_index").alias("row"))
    except AnalysisException:
        return _located(stage.write(plain, "rows"), stage)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_folder: str, limit: int = 2048) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: ``doc_id, n_bytes`` (UTF-8), ``n_tokens, over_limit``
    (``n_tokens > limit``).  ``cache_folder`` lies in a store that the executors share.

    A null text is empty: 0 bytes, 0 tokens.  Equal rows, and rows without a doc_id, keep a row each;
    equal contents are encoded once, however often they occur.  An empty table gives no rows and leaves the cache
    alone.  Further columns, whatever their names, are ignored."""
    spark, version = docs.sparkSession, TokenizerVersion(tokenizer_path)
    stage, cache = Stage(spark), CountCache(spark, cache_folder, version)
    rows = _located(docs, stage)
    keys = stage.write(rows.select(
        "doc_id", "file", "row", F.octet_length("text").cast("long").alias("n_bytes"),
        F.unhex(F.sha2(version.normalised(F.col("text")), 256)).alias("content")), "keys")
    # one place per content; both sides of the join have a content once, so copies weigh on no task
    first = keys.groupBy("content").agg(F.min(F.struct("file", "row")).alias("place"))
    missing = stage.write(first.join(cache.counts(), "content", "left_anti").select("content", "place.*"), "missing")
    n = missing.count()
    if n:
        side = F.broadcast(missing) if n <= BROADCAST_MISSES else missing.hint("shuffle_hash")
        texts = rows.select("file", "row", "text").join(side, ["file", "row"]).select("content", "text")
        content = spark.sparkContext.broadcast(version.content)
        cache.append(texts.mapInArrow(_count(version.library, content, version.by_word), COUNTS))
    n_tokens = F.coalesce("n_tokens", F.raise_error(F.lit("the token count cache lost an entry")).cast("long"))
    known = stage.write(cache.counts(), "known")  # written, so that a content that many rows share is split by the join
    return keys.join(known, "content", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens")).select(
        "*", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(spark: SparkSession) -> str:
    """A cache folder of its own in the shared folder."""
    return scratch_path(spark, "token_counts")
