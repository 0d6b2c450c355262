"""Mixing sources to target weights.

The words of a source, its documents taken by doc_id, form one long row of blocks of ``block_words`` words (fewer
in small sources, so that each has ``BLOCKS_LEAST`` blocks or blocks of one word). A source's target becomes an exact
quota of blocks. A multivariate-hypergeometric splitting tree deals the quotas of all sources to output shards: each
node splits its blocks between its two halves without replacement, so every shard gets a random but exact
number of blocks of each source. The blocks of a source are permuted (a bijection on block numbers drawn by the seed,
so nothing is sorted); the shards draw disjoint pieces of that order, one after the other, each as long as its leaf of the
tree says, going round again after the last block. What no shard draws is not in the mix. Inside a shard the blocks are
shuffled by a hash.

Only DataFrame functions touch the rows. The driver sees one row per source (its quota).

Defined cases: a null or empty text has size 0 and is never taken from; a null source is a source
of its own, ordered last; no rows give no rows; repeated rows count as often as they occur (their
order within an equal doc_id is by size); a null doc_id is ordered first; texts of any length are read whole; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: The block order: its modulus (fixed, so that products stay in 64 bits), rounds, and how often a place may fall behind the end.
PRIME, ROUNDS, WALKS = (1 << 31) - 1, 6, 24
BLOCK_WORDS, BLOCKS_LEAST = 64, 256
SHARDS, SEED = 16, 7
#: Documents of a range of one source, over which a running sum is taken, about.
DOCS_PER_RANGE = 20_000


def sizes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, the columns in ``keep`` and the number of words of each text."""
    return docs.select("doc_id", "source", *keep, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2) -> DataFrame:
    """One row per source: source_size, weight and target. Targets are weight * level, where the
    level is raised until they sum to share * all words; a target stops at limit * source_size.
    Sources are filled in the order in which they reach their limit, which gives the level in one
    pass. The windows run over one row per source, not over documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = one.withColumn("nr", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.lit(list(weights)), (F.col("nr") - 1) % len(weights) + 1).cast("long"))
    full = Window.orderBy(F.col("source_size") * limit / F.col("weight"), "nr").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    one = one.withColumn("before", F.coalesce(F.sum("source_size").over(full), F.lit(0)) * limit).withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(full), F.lit(0)))
    one = one.withColumn("level", (F.sum("source_size").over(every) * share - F.col("before")) / F.col("left"))
    # the first source, in order of filling, that the level leaves below its limit fixes the level for the rest
    open_ = F.col("level") * F.col("weight") <= F.col("source_size") * limit
    one = one.withColumn("level", F.min(F.when(open_, F.struct(F.col("source_size") * limit / F.col("weight"), "nr", "level"))).over(every)["level"])
    target = F.least((F.col("source_size") * limit).cast("double"), F.col("level") * F.col("weight"))
    return one.select("source", "nr", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


#: Up to this many blocks numpy draws itself; beyond, the distribution is tabulated around its mode.
DRAWN = 10**8


def hypergeometric(rng: np.random.Generator, own: int, rest: int, want: int) -> int:
    """How many of ``own`` blocks are among ``want`` that are drawn without replacement from ``own`` + ``rest``, at any size. Large
    cases are drawn by the inverse of the distribution, whose terms follow from their neighbours' ratio; those left out lie
    more than twelve standard deviations off."""
    low, high = max(0, want - rest), min(own, want)
    if low == high:
        return low
    if own + rest <= DRAWN:
        return int(rng.hypergeometric(own, rest, want))
    total = own + rest
    mode = (own + 1) * (want + 1) // (total + 2)
    spread = 50 + int(12 * (want * (own / total) * (rest / total) * ((total - want) / (total - 1))) ** 0.5)
    low, high = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    ratio = np.log(own - k) + np.log(want - k) - np.log(k + 1) - np.log(rest - want + k + 1)
    weight = np.concatenate(([0.0], np.cumsum(ratio)))
    chance = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(chance, rng.random() * chance[-1], "right"))


def split_quotas(quotas: list[int], shards: int, seed: int = 7) -> list[list[int]]:
    """The multivariate-hypergeometric splitting tree: for each shard, how many blocks of each
    quota it gets. Rows sum to equal shares (within one), columns to the quotas."""
    rng = np.random.default_rng(seed)

    def draw(have: np.ndarray, want: int) -> np.ndarray:
        # without replacement, source by source
        out, left, want = np.zeros_like(have), int(have.sum()), int(want)
        for i, n in enumerate(map(int, have)):
            out[i] = got = hypergeometric(rng, n, left - n, want)
            left, want = left - n, want - got
        return out

    def split(have: np.ndarray, k: int) -> list[np.ndarray]:
        if k == 1:
            return [have]
        total = int(have.sum())
        first = draw(have, total * (k // 2) // k)
        return split(first, k // 2) + split(have - first, k - k // 2)

    return [[int(x) for x in leaf] for leaf in split(np.array(quotas, dtype=object).astype(np.int64), shards)]


def _keys(seed: int) -> list[tuple[int, int]]:
    """The multipliers of the rounds, from the seed: (of the square, of the source's number)."""
    rng = np.random.default_rng((seed, 0x5EED))
    return [tuple(int(x) for x in rng.integers(1 << 20, PRIME, 2)) for _ in range(ROUNDS)]


def place(block: Column, blocks: Column, source: Column, seed: int = SEED) -> Column:
    """The place of a block in its source's order: a Feistel network over numbers of two digits, to bases whose product is the least
    above ``blocks`` that is nearly a square. Each round adds to one digit a keyed square of the other modulo a prime; seed and
    source are the key. A place behind the last block goes through the network again until it is none; as fewer than one
    in the larger base are, ``WALKS`` rounds leave none (below 2^48 blocks)."""
    a = F.ceil(F.sqrt(blocks.cast("double"))).cast("long")
    b = F.floor((blocks + a - 1) / a).cast("long")

    def keyed(digit: Column, k: tuple[int, int]) -> Column:
        y = digit + (source.cast("long") * k[1]) % PRIME
        return (((y * y) % PRIME) * k[0] + y) % PRIME

    def through(x: Column) -> Column:
        out = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))
        for i, k in enumerate(_keys(seed)):
            turn = (lambda k: lambda s: F.struct(((s["l"] + keyed(s["r"], k)) % a).alias("l"), s["r"].alias("r")))(k) if i % 2 == 0 else (lambda k: lambda s: F.struct(s["l"].alias("l"), ((s["r"] + keyed(s["l"], k)) % b).alias("r")))(k)
            out = F.element_at(F.transform(F.array(out), turn), 1)  # each round is bound once
        return F.element_at(F.transform(F.array(out), lambda s: s["l"] * b + s["r"]), 1)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), through(block), lambda at, _: F.when(at >= blocks, through(at)).otherwise(at))
    return F.when(blocks <= 1, F.lit(0).cast("long")).otherwise(walked)


_DRAWS = "array<struct<shard:int,order:bigint,word_from:bigint,word_to:bigint,turn:int>>"


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in ``keep`` (which also order rows of equal doc_id and size), doc_id, size, source_size, target and draws: what
    the mix takes from each document, an array of (shard, order, word_from, word_to, turn), words from 0, word_to exclusive,
    by turn and place. A shard's output is its draws sorted by order."""
    spark = docs.sparkSession
    sized = written(sizes(docs, keep), "sizes")
    goals = written(targets(sized, weights, share, limit), "targets")
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.expr(f"source_size div {BLOCKS_LEAST}")))
    goals = goals.withColumn("block", block).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))
    last = place(F.col("blocks") - 1, F.col("blocks"), F.col("nr"), seed)

    def rounded(words: Column) -> Column:
        return F.least(F.floor(words / F.col("block") + 0.5), F.col("blocks") * limit)

    # the last block is short; what it lacks as often as it is drawn is made up for
    times = sum((F.when(last + F.col("blocks") * t < rounded(F.col("target")), 1).otherwise(0) for t in range(1, limit)), F.when(last < rounded(F.col("target")), 1).otherwise(0))
    goals = goals.withColumn("quota", rounded(F.col("target") + (F.col("blocks") * F.col("block") - F.col("source_size")) * times))
    quotas = [(r.nr, r.quota) for r in goals.select("nr", "quota").orderBy("nr").collect()]  # one row per source
    if not quotas:
        return sized.select(*keep, "doc_id", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.array().cast(_DRAWS).alias("draws"))
    # where each shard's piece of a source's order ends
    ends = np.cumsum(np.array(split_quotas([q for _, q in quotas], shards, seed)), axis=0).T
    dealt = spark.createDataFrame([(nr, row) for (nr, _), row in zip(quotas, ends.tolist())], "nr int, ends array<bigint>")
    goals = goals.join(dealt, "nr").drop("quota")

    # where each document starts in its source: sums over ranges of (source, doc_id) first, then inside a range
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sized.count() // DOCS_PER_RANGE))
    order = ["doc_id", "size", *keep]
    ranged = written(sized.repartitionByRange(n, "source", *order).withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("source", "part").agg(F.sum("size").alias("n")).select(F.col("source").alias("of"), F.col("part").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = bases.join(goals.withColumnRenamed("source", "s"), F.col("of").eqNullSafe(F.col("s"))).drop("s")
    within = Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.repartition(n, "source", "part").withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(bases, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    placed = placed.withColumn("start", F.col("base") + F.col("inner"))

    def draw(turn: int, b: Column) -> Column:
        lo = F.greatest(b * F.col("block") - F.col("start"), F.lit(0))
        hi = F.least((b + 1) * F.col("block") - F.col("start"), F.col("size"))
        # from the end on that is a shard's
        shard = lambda at: F.size(F.filter("ends", lambda e: e <= at))

        def drawn(at: Column) -> Column:
            return F.when(at < F.element_at("ends", -1), F.struct(shard(at).alias("shard"), F.xxhash64(F.lit(seed), "nr", at).alias("order"), lo.alias("word_from"), hi.alias("word_to"), F.lit(turn).alias("turn")))

        # the place is bound once, by a one-element transform
        return F.element_at(F.transform(F.array(place(b, F.col("blocks"), F.col("nr"), seed) + F.col("blocks") * turn), drawn), 1)

    first, last = F.expr("start div block"), F.expr("(start + size - 1) div block")
    seen = F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    drawn = F.concat(*[F.transform(seen, partial(draw, t)) for t in range(limit)])
    return placed.select(*keep, "doc_id", "size", "source_size", "target", F.array_compact(drawn).alias("draws"))


def taken(mixed: DataFrame) -> DataFrame:
    """Words that the mix takes of each document, repeats counted."""
    words = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["word_to"] - d["word_from"])
    return mixed.select("doc_id", "size", "source_size", "target", words.alias("taken"))


def shard_rows(mixed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix itself, as draws: one row per draw, dealt to its shard and shuffled inside it."""
    flat = mixed.select("doc_id", F.explode("draws").alias("d")).select("d.shard", "d.order", "doc_id", "d.word_from", "d.word_to")
    return flat.repartition(shards, "shard").sortWithinPartitions("shard", "order")


def mixed_texts(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """The mix as documents: one row per document and turn, with the words that were drawn in it and the space between them; a
    text drawn whole stays as it is. A row goes to the shard of its first draw and is shuffled there by that draw's order.
    ``key``, a column of both, is unique and not null; the columns are those of ``docs``."""
    turns = mixed.filter(F.size("draws") > 0).select(F.col(key).alias("_of"), F.col("size").alias("_size"), F.explode(turns_of(F.col("draws"))).alias("_turn"))
    pieces = F.regexp_extract_all("_doc.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))

    def cut(words: Column) -> Column:
        taken = F.transform("_turn", lambda d: F.slice(words, (d["word_from"] + 1).cast("int"), (d["word_to"] - d["word_from"]).cast("int")))
        return F.array_join(F.flatten(taken), "")

    # the words are bound once, by a one-element transform, not for each draw
    part = F.element_at(F.transform(F.array(pieces), cut), 1)
    words = F.aggregate("_turn", F.lit(0).cast("long"), lambda a, d: a + d["word_to"] - d["word_from"])
    text = F.when(words == F.col("_size"), F.col("_doc.text")).otherwise(part)
    rows = docs.select(F.struct("*").alias("_doc"), F.col(key).alias("_key")).join(turns, F.col("_key") == F.col("_of"))
    rows = rows.select(F.col("_doc").withField("text", text).alias("_doc"), F.element_at("_turn", 1).alias("_draw"))
    # several tasks for each shard where there is much of it; each is shuffled by itself
    spread = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(spread, F.col("_draw.shard"), F.pmod(F.col("_draw.order"), F.lit(-(-spread // shards)))).sortWithinPartitions("_draw.shard", "_draw.order")
    return rows.select("_doc.*")


def turns_of(draws: Column) -> Column:
    """Draws by turn, without the turns that have none."""
    turns = F.sequence(F.lit(0), F.array_max(F.transform(draws, lambda d: d["turn"])))
    return F.filter(F.transform(turns, lambda t: F.filter(draws, lambda d: d["turn"] == t)), lambda x: F.size(x) > 0)


def taken_sql(block_words: int = BLOCK_WORDS, seed: int = SEED) -> str:
    """The same result in DuckDB SQL."""
    def through(x: str) -> str:
        text = f"{{'l': ({x}) // eb, 'r': ({x}) % eb}}"
        for i, (square, own) in enumerate(_keys(seed)):
            one, two, base = ("l", "r", "ea") if i % 2 == 0 else ("r", "l", "eb")
            y = f"(d.{two} + (nr * {own}) % {PRIME})"
            new = f"(d.{one} + ((({y} * {y}) % {PRIME}) * {square} + {y}) % {PRIME}) % {base}"
            text = f"list_transform([{text}], lambda d: {{'l': {new if one == 'l' else 'd.l'}, 'r': {new if one == 'r' else 'd.r'}}})[1]"
        return f"list_transform([{text}], lambda d: d.l * eb + d.r)[1]"

    walked = f"list_reduce(range({WALKS}), lambda p, i: CASE WHEN p >= blocks THEN {through('p')} ELSE p END, {through('b')})"
    pick = f"WHEN true THEN {walked}"
    return f"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
o AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nr FROM o),
w AS (SELECT *, CASE (nr - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM n),
f AS (SELECT *, coalesce(sum(source_size) OVER b, 0) * 2 AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest,
      sum(source_size) OVER () AS total
      FROM w WINDOW b AS (ORDER BY source_size * 2 / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (CAST(total AS DOUBLE) * 1.5 - CAST(filled AS DOUBLE)) / CAST(rest AS DOUBLE) AS level FROM f),
m AS (SELECT level FROM l WHERE level * weight <= source_size * 2 ORDER BY source_size * 2 / weight, nr LIMIT 1),
t AS (SELECT source, nr, source_size, least(CAST(source_size * 2 AS DOUBLE), m.level * weight) AS target,
      greatest(1, least({block_words}, source_size // {BLOCKS_LEAST})) AS block FROM l, m),
r AS (SELECT *, CAST(ceil(source_size / CAST(block AS DOUBLE)) AS BIGINT) AS blocks FROM t), g AS (SELECT *, CAST(ceil(sqrt(CAST(blocks AS DOUBLE))) AS BIGINT) AS ea FROM r), u AS (SELECT *, (blocks + ea - 1) // greatest(ea, 1) AS eb FROM g),
v AS (SELECT *, least(CAST(floor(target / block + 0.5) AS BIGINT), blocks * 2) AS near, CASE WHEN blocks <= 1 THEN 0 {pick} END AS last FROM (SELECT *, blocks - 1 AS b FROM u)),
q AS (SELECT *, least(CAST(floor((target + (blocks * block - source_size) * (CASE WHEN last < near THEN 1 ELSE 0 END + CASE WHEN last + blocks < near THEN 1 ELSE 0 END)) / block + 0.5) AS BIGINT), blocks * 2) AS quota FROM v),
d AS (SELECT s.doc_id, s.size, q.source_size, q.target, q.block, q.blocks, q.quota, q.nr, q.ea, q.eb,
      CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source),
e AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(start // block, (start + size - 1) // block + 1) ELSE CAST([] AS BIGINT[]) END) AS b FROM d),
p AS (SELECT *, CASE WHEN blocks <= 1 THEN 0 {pick} END AS place FROM e),
k AS (SELECT doc_id, size, start, sum((least((b + 1) * block - start, size) - greatest(b * block - start, 0))
      * (CASE WHEN place < quota THEN 1 ELSE 0 END + CASE WHEN place + blocks < quota THEN 1 ELSE 0 END)) AS taken FROM p GROUP BY doc_id, size, start)
SELECT d.doc_id, d.size, d.source_size, d.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM d LEFT JOIN k ON d.doc_id = k.doc_id AND d.start = k.start AND d.size = k.size"""
