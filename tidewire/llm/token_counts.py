"""Token counts with a digest cache.

A text is known by the digest of its normalised content, a tokenizer by the digest of its file, its library and the
library's version. The digests of a table are joined with those of the cache; what is missing is encoded, each distinct
content once, and appended to the cache; then every row takes its count from the cache. The cache is a folder of Parquet
files, one sub-folder a tokenizer digest, so that a new version never meets the counts of an old one.

Content is normalised by ``normalised``, which may only join texts that have equal counts; the default takes null for the
empty text and leaves all else as it is, since byte-level tokenizers count every byte.

Texts are not shuffled: a missing content is encoded where the first of its rows lies, told by row numbers, which are
broadcast up to ``BROADCAST_ROWS`` of them (beyond it texts are shuffled once, by row). A content that more than a thousandth
of all rows have is joined in parts.

Defined cases: a null text is an empty one, without tokens; texts of any length are counted whole, byte-level ones over
``PIECE`` characters in pieces cut before a space between two letters, where no token lies across; equal texts have equal
counts; rows may repeat and doc_ids be null; no rows give no rows and leave the cache as it is; columns to keep may have any
name but those added here. Two jobs that append the same content leave two equal rows, of which one is read. A job
that is lost leaves a cache without its rows.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked, numbered, removed, salted, shipped, written

#: Up to this many row numbers are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Characters beyond which a text of a byte-level vocabulary is encoded in pieces, and the texts encoded at once.
PIECE, AT_ONCE = 1 << 20, 256
#: More tokens than this are over the limit.
LIMIT = 1024

_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
_CACHE = "content binary, n_tokens long"


class Tokenizer(NamedTuple):
    """A tokenizer file as it was read on the driver."""

    kind: str
    source: bytes
    digest: str

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        kind = {".json": "tokenizers", ".model": "sentencepiece"}[Path(path).suffix]
        source = Path(path).read_bytes()
        version = f"{kind} {importlib.metadata.version(kind)} "
        return cls(kind, source, hashlib.sha256(version.encode() + source).hexdigest())


def _byte_level(spec: dict) -> bool:
    """Whether a cut before a space between two letters can't change a count."""
    before = spec.get("pre_tokenizer") or {}
    return before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not spec.get("normalizer")


def pieces(text: str, most: int = PIECE) -> list[str]:
    """The text in pieces of about so many characters, cut before a space between two letters."""
    out, at = [], 0
    while len(text) - at > most and (cut := _CUT.search(text, at + most)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def counter(tokenizer: Tokenizer) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of texts by the library of the tokenizer, as it does by default, without added ones."""
    if tokenizer.kind == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=tokenizer.source)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    spec = tokenizer.source.decode()
    made = tokenizers.Tokenizer.from_str(spec)
    made.no_truncation()
    made.no_padding()
    cut = _byte_level(json.loads(spec))

    def count(texts: list[str]) -> list[int]:
        if cut and any(len(t) > PIECE for t in texts):
            return [sum(len(made.encode(p, add_special_tokens=False)) for p in pieces(t)) for t in texts]
        return [len(e) for e in made.encode_batch_fast(texts, add_special_tokens=False)]

    return count


#: The counter of this worker process, by digest: a worker serves many tasks, and reading a vocabulary takes a while.
_HELD: dict[str, Callable[[list[str]], list[int]]] = {}


def token_count(text: Column, spark: SparkSession, tokenizer: Tokenizer) -> Column:
    """The number of tokens of a text (null: 0), by the library, without a cache."""
    shared = shipped(spark).sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        digest = shared.value.digest
        if digest not in _HELD:
            _HELD.clear()
            _HELD[digest] = counter(shared.value)
        for b in batches:
            n: list[int] = []
            for at in range(0, len(b), AT_ONCE):
                n += _HELD[digest]([t.as_py() or "" for t in b.slice(at, AT_ONCE)])
            yield pa.array(n, pa.int64())

    return F.arrow_udf(run, "long", F.ArrowUDFType.SCALAR_ITER)(text)


def normalised(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def cached(spark: SparkSession, cache: str, tokenizer: Tokenizer) -> DataFrame:
    """content and n_tokens of all that the cache has for a tokenizer, one row a content."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(cache, tokenizer))
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(_CACHE).parquet(_folder(cache, tokenizer)) if there else spark.createDataFrame([], _CACHE)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _folder(cache: str, tokenizer: Tokenizer) -> str:
    return f"{cache}/tokenizer={tokenizer.digest}"


def counted(docs: DataFrame, tokenizer: Tokenizer, cache: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", normal: Callable[[Column], Column] = normalised, limit: int = LIMIT) -> DataFrame:
    """The columns ``keep`` with content (the digest, in hexadecimal), n_bytes (of the text, in UTF-8), n_tokens and over_limit.
    The folder ``cache`` gets the counts that it did not have."""
    spark = shipped(docs.sparkSession)
    said = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("told"))
    rows = numbered(said, "row").withColumn("content", F.unhex(F.sha2(normal(F.col("told")), 256)))
    groups = written(rows.groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row")), "contents")
    misses = written(groups.join(cached(spark, cache, tokenizer), "content", "left_anti").select("row"), "misses")
    fresh = rows.join(checked(misses, BROADCAST_ROWS), "row").select("content", token_count(normal(F.col("told")), spark, tokenizer).alias("n_tokens"))
    fresh.write.mode("append").parquet(_folder(cache, tokenizer))
    removed(misses)
    counts = written(groups.join(cached(spark, cache, tokenizer), "content"), "counts")
    removed(groups)
    sized = rows.select("kept", "content", F.coalesce(F.octet_length("told"), F.lit(0)).cast("long").alias("n_bytes"))
    out = salted(sized, counts.select("content", "n", "n_tokens"), "content", "n")
    return out.select("kept.*", F.lower(F.hex("content")).alias("content"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
