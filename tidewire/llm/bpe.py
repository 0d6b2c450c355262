"""Byte-pair encoding and decoding with a contiguous rank array.

A text is cut into words by the vocabulary's pattern. A word holds its part boundaries and, next
to them, the rank of each adjacent pair, both in plain arrays: the least rank is looked up again
and again, its boundary deleted, and the two neighbouring ranks refreshed. Words of more than
``SHORT`` bytes keep the same order of merges (least rank, then leftmost) in a heap, since scanning
would take quadratic time. Words seen before come from a bounded cache in each task.

The vocabulary file is read on the driver and broadcast; its size is fixed by the vocabulary.

Defined cases: null counts as an empty text, which has no tokens; texts of any length are encoded
whole, in bounded pieces; pairs of equal rank are merged from the left; repeated rows are encoded alike; no rows give no
rows; further columns can be carried along (their texts do not go to Python), whatever their names but ``ids``.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shipped

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 128
#: Words whose ids a task keeps, where it only encodes and where it decodes too.
CACHE_WORDS, CACHE_WORDS_BOTH = 400_000, 65_536
MATCHES_AT_ONCE = 200_000
_NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands
    for itself, the other bytes for the letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """What encoding and decoding need of a vocabulary file of the tokenizers library."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.of_byte = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.pairs: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[ids[a], ids[b]] = rank
            self.made.append(ids[a + b])

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def short(self, word: bytes) -> list[int]:
        """Merges of a short word over its contiguous arrays."""
        parts = [self.of_byte[b] for b in word]
        bounds = list(range(len(parts) + 1))
        rank = self.pairs.get
        ranks = [rank(p, _NONE) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            parts[i] = self.made[least]
            del parts[i + 1], bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), _NONE)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), _NONE)
        return parts

    def long(self, word: bytes) -> list[int]:
        """The same merges, for a long word: linked parts, and a heap of (rank, place)."""
        parts = [self.of_byte[b] for b in word]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.pairs.get
        heap = [(r, i) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]), _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if parts[i] < 0 or (j := after[i]) >= n or rank((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (new := rank((parts[a], parts[after[a]]), _NONE)) != _NONE:
                    heapq.heappush(heap, (new, a))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> bytes:
        raw = word.encode()
        return array("i", self.short(raw) if len(raw) <= SHORT else self.long(raw)).tobytes()


class _Words(dict):
    """Token ids (as int32 bytes) of the words seen so far; emptied when full."""

    def __init__(self, vocabulary: Vocabulary, most: int):
        self.make, self.most = vocabulary.word, most

    def __missing__(self, word: str) -> bytes:
        ids = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, vocabulary: Vocabulary, most: int = CACHE_WORDS):
        self.words = _Words(vocabulary, most)
        self.special = vocabulary.special
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)

    def _plain(self, text: str, out: list[bytes]) -> None:
        of = self.words.__getitem__
        if len(text) < 1_000_000:
            out.extend(map(of, self.pattern.findall(text)))
            return
        found = self.pattern.finditer(text)
        while piece := b"".join(of(m[0]) for m in islice(found, MATCHES_AT_ONCE)):
            out.append(piece)

    def ids(self, text: str) -> bytes:
        """Token ids as int32 bytes; special tokens in the text keep their own ids."""
        out: list[bytes] = []
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            self._plain(text[at : m.start()], out)
            out.append(array("i", [self.special[m[0]]]).tobytes())
            at = m.end()
        self._plain(text[at:] if at else text, out)
        return b"".join(out)


def encoded(text: Column, spark: SparkSession, path: str) -> Column:
    """The token ids of a text (null: none), as array<int>."""
    shared = shipped(spark).sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value)
        for b in batches:
            ids = [encoder.ids(t.as_py()) if t.is_valid else b"" for t in b]
            ends = np.cumsum([0, *[len(x) // 4 for x in ids]], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))

    return F.arrow_udf(run, "array<int>", F.ArrowUDFType.SCALAR_ITER)(text)


def decoded(ids: Column, spark: SparkSession, path: str) -> Column:
    """The text that token ids stand for; bytes that are not UTF-8 become U+FFFD."""
    shared = shipped(spark).sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = shared.value.bytes_of.__getitem__
        for b in batches:
            yield pa.array([b"".join(map(of, x.values.to_numpy().tolist())).decode("utf-8", "replace") if x.is_valid else None for x in b], pa.string())

    return F.arrow_udf(run, "string", F.ArrowUDFType.SCALAR_ITER)(ids)


def round_trip(text: Column, spark: SparkSession, path: str) -> Column:
    """ids, the token ids of a text (null: none), and restored, whether they decode to it again, as a struct. One worker does
    both, so a task needs one vocabulary and the text stays where it is."""
    shared = shipped(spark).sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, of = Encoder(shared.value, CACHE_WORDS_BOTH), shared.value.bytes_of.__getitem__
        for b in batches:
            ids, same = [], []
            for t in b:
                told = t.as_py() or ""
                ids.append(encoder.ids(told))
                same.append(b"".join(map(of, np.frombuffer(ids[-1], np.int32).tolist())).decode("utf-8", "replace") == told)
            ends = np.cumsum([0, *[len(x) // 4 for x in ids]], dtype=np.int32)
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32))), pa.array(same, pa.bool_())], ["ids", "restored"])

    return F.arrow_udf(run, "struct<ids:array<int>,restored:boolean>", F.ArrowUDFType.SCALAR_ITER)(text)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ids, the token ids of ``text``."""
    return docs.select(*keep, encoded(F.col(text), docs.sparkSession, path).alias("ids"))


def decode(tokens: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text that the token ids stand for."""
    return tokens.select("*", decoded(F.col(ids), tokens.sparkSession, path).alias(to))


def default_path(spark: SparkSession) -> str:
    """The vocabulary of the registered query: spark.tidewire.vocabulary, else the public file."""
    known = spark.conf.get("spark.tidewire.vocabulary", None)
    if known:
        return known
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
