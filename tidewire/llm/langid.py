"""Language identification as multilingual mixture inference.

A document's letter trigrams are taken as drawn from a mixture of languages. Expectation
maximisation estimates the proportions; languages are then dropped from the set, least first, as
long as the penalised likelihood (log-likelihood less PENALTY * log(n) for each language) does not
fall. The prediction is the language of the largest share in the chosen set, the score its share.

Training: trigram counts of a bounded sample of labelled documents, TRAIN_DOCS of them by hash
of doc_id, each read whole. Predictions cover every document, each read whole.

Defined cases: a text that is null or has no letters is ``und`` with score 0; with no labelled
document every prediction is ``und``; a null doc_id is not held out and not learned from; a doc_id with several langs counts
for the least of them; of languages of equal share the first by name is predicted; repeated rows get equal predictions; texts
of any length are read whole; no rows give no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shipped

BINS = 1 << 16
#: Bound of the training sample, in documents.
TRAIN_DOCS = 4000
PENALTY = 3.0
SMOOTHING = 0.3
PIECE = 2_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_letters: np.ndarray | None = None


def letter_codes() -> np.ndarray:
    """For each code point, its lower-case letter, or 0 if it is no letter."""
    global _letters
    if _letters is None:
        codes = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                codes[i] = ord(low) if len(low) == 1 else i
        _letters = codes
    return _letters


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the trigrams of a text around its letters, and their counts. Runs of other
    characters count as one boundary. Long texts are counted in pieces and summed."""
    total = None
    for at in range(0, max(1, len(text)), PIECE):
        c = letter_codes()[np.frombuffer(text[max(0, at - 2) : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        c = np.concatenate(([0], c, [0])).astype(np.uint32)
        c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
        if len(c) < 3:
            continue
        h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        n = np.bincount((h >> np.uint32(16))[c[1:-1] != 0], minlength=BINS)
        total = n if total is None else total + n
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bins = np.flatnonzero(total)
    return bins, total[bins]


def mixture(like: np.ndarray, counts: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``like`` and the log-likelihood, by expectation maximisation."""
    k, n = like.shape[1], counts.sum()
    share = np.full(k, 1.0 / k)
    if k > 1:
        for _ in range(steps):
            mixed = like @ share
            new = share * ((counts / mixed) @ like) / n
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
    return share, float(counts @ np.log(like @ share))


def language_set(like: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """The chosen languages (column numbers) and their proportions."""
    price = penalty * np.log(counts.sum() + 1.0)
    chosen = np.arange(like.shape[1])
    share, ll = mixture(like, counts, 12)
    keep = share >= 0.02
    if not keep.all():
        chosen = chosen[keep]
        share, ll = mixture(like[:, chosen], counts, 12)
    while len(chosen) > 1:
        rest = np.delete(chosen, share.argmin())
        fewer, less = mixture(like[:, rest], counts, 12)
        if less + price < ll:
            break
        chosen, share, ll = rest, fewer, less
    return chosen, share


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Language names and the probabilities of each bin in each language (BINS x languages)."""
    shipped(docs.sparkSession)
    rows = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # one language of each sampled doc_id, whatever the order of rows
    sample = rows.groupBy("doc_id").agg(F.min("lang").alias("lang")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    labelled = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most TRAIN_DOCS rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                bins, n = trigrams(text.as_py())
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(bins), pa.string()), "bin": pa.array(bins.astype(np.int32)), "n": pa.array(n)})

    counted = labelled.select("lang", "text").mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # at most BINS rows a language
    langs = sorted(table["lang"].unique())
    freq = np.full((BINS, len(langs)), SMOOTHING)
    freq[table["bin"], table["lang"].map({x: i for i, x in enumerate(langs)})] += table["n"]
    return langs, freq / freq.sum(axis=0)


_SHARE = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def predicted(text: Column, spark: SparkSession, model: tuple[list[str], np.ndarray]) -> Column:
    """lang_pred, score and shares (the chosen languages with their proportions) of a text, as a struct. Only the text goes
    to Python, and only the struct comes back."""
    langs, table = model
    shared = shipped(spark).sparkContext.broadcast((langs, table.astype(np.float32)))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs, table = shared.value
        for b in batches:
            pred, score, shares = [], [], []
            for t in b:
                t = t.as_py()
                bins, n = trigrams(t) if t else ((), ())
                if not len(bins) or not langs:
                    pred.append("und"), score.append(0.0), shares.append([])
                    continue
                like = table[bins].astype(np.float64)
                chosen, share = language_set(like / like.max(axis=1, keepdims=True), n)
                best = share.argmax()
                pred.append(langs[chosen[best]]), score.append(float(min(1.0, share[best])))
                shares.append([{"lang": langs[i], "share": float(s)} for i, s in zip(chosen, share)])
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, _SHARE)], ["lang_pred", "score", "shares"])

    kind = "struct<lang_pred:string,score:double,shares:array<struct<lang:string,share:double>>>"
    # not deterministic in name only, so that a filter on the struct does not run it twice
    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()(text)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, lang_pred, score and shares (the chosen languages with their proportions)."""
    found = predicted(F.col("text"), docs.sparkSession, model or train(docs))
    return docs.select(*keep, found.alias("_found")).select(*keep, "_found.lang_pred", "_found.score", "_found.shares")
