"""Document fingerprints: bottom-k sketches of shingle hashes.

A document's shingles are its runs of five words (a text of fewer words is one shingle); its
sketch is the ``k`` smallest distinct 64-bit hashes of them, in order. Sketches merge by union, so
parts of a document, or of a corpus, can be sketched apart. From two sketches come estimates of
resemblance (Jaccard), containment and the number of distinct shingles. All of it is built from
DataFrame functions.

Defined cases: null counts as an empty text; an empty text has an empty sketch, which resembles
only another empty one (1.0, else 0.0); repeated rows get equal sketches; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, quantile_bounds, range_of, words_of

SHINGLE = 5
K = 128
DOCS_PER_RANGE = 4_000
_SPAN = float(2**64)


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """The distinct shingle hashes of a text, unordered."""
    hashed = F.transform(words_of(ascii_lower(text)), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        whole = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
        many = F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width)))
        return F.when(F.size(h) < width, whole).otherwise(F.array_distinct(many))

    # the array of word hashes is bound once, by a one-element transform
    return F.flatten(F.transform(F.array(hashed), runs))


def sketch(text: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(shingle_hashes(text)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's k smallest hashes found in both."""
    both = F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(merge(a, b, k)), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) / the k-th smallest hash
    as a share of the hash range."""
    share = (F.element_at(a, -1).cast("double") + F.lit(_SPAN / 2)) / F.lit(_SPAN)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: J (|A| + |B|) / ((1 + J) |A|), at most 1."""
    j = resemblance(a, b, k)
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text (never null), sketch."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), sketch(text, k).alias("sketch"))


def with_next(docs: DataFrame, k: int = K, docs_per_range: int = DOCS_PER_RANGE) -> DataFrame:
    """Adds next_text and next_sketch: those of the document with the next smaller doc_id (of the
    largest doc_id after the smallest).

    The texts are dealt once, to ranges of doc_id; each range also gets the one row that stands
    before it, so that a window inside the range finds every neighbour. What the driver sees is
    one doc_id for each range. Rows of equal doc_id follow each other by text."""
    ids = docs.select("doc_id")
    # ids are grouped so that equal ones share a range; the ranges are near-equal by rows
    n, top = ids.agg(F.count(F.lit(1)), F.max("doc_id")).first()
    bounds = quantile_bounds(ids, "doc_id", max(1, min(1000, -(-n // docs_per_range))))
    ends = {r.part: r.last for r in ids.groupBy(range_of(F.col("doc_id"), bounds).alias("part")).agg(F.max("doc_id").alias("last")).collect()}
    parts = sorted(ends)
    after = {ends[p]: q for p, q in zip(parts, parts[1:]) if ends[p] is not None}
    own = F.struct(range_of(F.col("doc_id"), bounds).alias("part"), F.lit(1).alias("own"))
    goes = [own]
    if after:
        to = F.create_map(*[F.lit(x) for pair in after.items() for x in pair])
        goes.append(F.when(F.col("doc_id").isin(list(after)), F.struct(F.element_at(to, F.col("doc_id")).alias("part"), F.lit(0).alias("own"))))
    if parts:
        goes.append(F.when(F.col("doc_id").eqNullSafe(F.lit(top)), F.struct(F.lit(parts[0]).alias("part"), F.lit(-1).alias("own"))))
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.array_compact(F.array(*goes))).alias("to"))
    dealt = dealt.select("doc_id", "text", "to.part", "to.own").repartition("part").withColumn("sketch", sketch(F.col("text"), k))
    up = Window.partitionBy("part").orderBy("own_first", "doc_id", "text")
    near = dealt.withColumn("own_first", F.least("own", F.lit(0)))
    near = near.withColumn("next_text", F.lag("text").over(up)).withColumn("next_sketch", F.lag("sketch").over(up))
    return near.filter("own = 1").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the first of the next
    document's, with their likeness."""
    near = with_next(docs, k)
    n = F.length("text")
    half = F.expr("length(text) div 2")
    near = near.withColumn("n_chars", n.cast("long")).withColumn("edited_text", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    return near.withColumn("edited_sketch", sketch(F.col("edited_text"), k))
