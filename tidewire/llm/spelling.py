"""Spelling variants: the words of a vocabulary that differ by one code point, and the commoner form that each goes back to.

One error falls into one half of a word, so a near word has either the first half or the second one unchanged. For the first,
the vocabulary is dealt in shards of (length, word) order, for the second in shards of (length, reversed word) order, and a word
goes as a query to the shards that may hold words of its own length (one replacement) or of one more (one insertion; deletions
are the same pairs seen from the longer word) that begin with its unchanged half. A shard's task holds a bidirectional
FM-index of its delimited words: the unchanged half is found by extending an interval to the left down to the
delimiter, then the interval is extended to the right, allowing one error, up to the next delimiter. Intervals of equal
prefixes are shared, so a level of all queries' prefixes reads each word of a shard at most once. The rank of a suffix
that begins with a delimiter gives the word.

Each pair is found in one way only: replacements once from each side, insertions at the last place that gives the longer
word, and from the second half only where the first one differs.

Defined cases: null texts have no words; a null doc_id counts as empty; runs of any length are taken whole; repeated rows count as
often as they are there, as all occurrences do; ties of n go to the word that is smaller in code-point order; words without a near
word have n_near 0; no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, removed, shipped, written

#: Letters of a run; words have at least so many code points and occurrences; a form has so many times the word's occurrences.
LETTERS, LEAST_LENGTH, LEAST_COUNT, TIMES = r"[A-Za-zÀ-ÿ]", 7, 2, 10
#: A run whose hash this number divides loses a code point.
EVERY = 31
#: Code points of a shard, about, and queries that one task puts to a shard before the shard is copied to further tasks.
SHARD_CHARS, SHARD_QUERIES = 1 << 18, 200_000

#: Symbols of the index: the end of the text, the delimiter, then the letters.
_END, _DELIMITER = 0, 1
_WIDE = 32


def words(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """word for each run of letters of ``docs``, after the losses, with at least so many code points."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("r"))
    runs = runs.select("d", F.translate("r", UPPER, LOWER).alias("r")).withColumn("h", F.crc32(F.concat("d", F.lit(":"), "r").cast("binary")))
    at = (F.col("h") % F.length("r")).cast("int")
    lost = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))
    return runs.select(F.when(F.col("h") % EVERY == 0, lost).otherwise(F.col("r")).alias("word")).filter(F.length("word") >= least)


def vocabulary(docs: DataFrame, least: int = LEAST_LENGTH, occurrences: int = LEAST_COUNT) -> DataFrame:
    """word and n, for words with at least so many occurrences in all documents."""
    return words(docs, least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= occurrences)


def _suffixes(text: np.ndarray) -> np.ndarray:
    """The suffix array of a text, by doubling of the sorted prefix."""
    n, width = len(text), 1
    rank = text.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank, width = new, width * 2
        if rank[order[-1]] == n - 1 or width >= n:
            return order


class _Ranks:
    """How many symbols below one stand before a place of a text's Burrows-Wheeler transform, by counts of blocks."""

    def __init__(self, text: np.ndarray, symbols: int):
        bwt = text[_suffixes(text) - 1].astype(np.uint8)
        n = len(bwt) // _WIDE + 1
        self.blocks = np.full((n, _WIDE), 255, np.uint8)
        self.blocks.reshape(-1)[: len(bwt)] = bwt
        counts = np.zeros((n + 1, symbols + 1), np.int32)
        np.add.at(counts, (np.arange(len(bwt)) // _WIDE + 1, bwt.astype(np.int64) + 1), 1)
        self.below = counts.cumsum(axis=0, dtype=np.int32).cumsum(axis=1, dtype=np.int32)
        self.first = self.below[-1]  # where the suffixes of each symbol begin

    def symbols(self, places: np.ndarray) -> np.ndarray:
        return self.blocks.reshape(-1)[places]

    def below_and_own(self, symbol: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols below ``symbol`` before ``place``, and those equal to it."""
        block, within = place // _WIDE, place % _WIDE
        row, ahead = self.blocks[block], np.arange(_WIDE, dtype=np.uint8) < within.astype(np.uint8)[:, None]
        less, same = _counted((row < symbol[:, None].astype(np.uint8)) & ahead), _counted((row == symbol[:, None].astype(np.uint8)) & ahead)
        low = self.below[block, symbol]
        return low + less, self.below[block, symbol + 1] - low + same


def _counted(marks: np.ndarray) -> np.ndarray:
    """Marks of each row: bytes are added eight at a time."""
    eight = marks.view(np.uint64).sum(axis=1, dtype=np.uint64)
    return ((eight * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


class Index:
    """A bidirectional FM-index of distinct words in code-point order. An interval is (place in the index, place in the index of
    the reversed text, size), in three arrays, one entry a query."""

    def __init__(self, words: list[str]):
        text = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self.letters = np.unique(text)[1:]
        coded = np.searchsorted(self.letters, text) + _DELIMITER + 1
        coded[text == 0] = _DELIMITER
        self.count = len(self.letters) + 2
        ended = [np.append(t, _END) for t in (coded, coded[::-1])]
        self.size = len(ended[0])
        self.ranks, self.reverse = (_Ranks(t, self.count) for t in ended)

    def coded(self, words: np.ndarray) -> np.ndarray:
        """Symbols of a matrix of code points; letters that the index lacks have the number of all symbols."""
        at = np.searchsorted(self.letters, words)
        known = (at < len(self.letters)) & (self.letters[np.minimum(at, len(self.letters) - 1)] == words)
        return np.where(known, at + _DELIMITER + 1, self.count)

    def everything(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.size, np.int64)

    @staticmethod
    def _extended(ranks: _Ranks, own: np.ndarray, other: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        below, at = ranks.below_and_own(symbol, own)
        below_end, at_end = ranks.below_and_own(symbol, own + size)
        return ranks.first[symbol] + at, other + below_end - below, at_end - at

    def left(self, state: tuple, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo, back, size = state
        return self._extended(self.ranks, lo, back, size, symbol)

    def right(self, state: tuple, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo, back, size = state
        back, lo, size = self._extended(self.reverse, back, lo, size, symbol)
        return lo, back, size

    def children(self, state: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(number of the state, symbol) of each letter that follows; the intervals of the states must not overlap."""
        _, back, size = state
        owner = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        key = np.unique(owner * (self.count + 1) + self.reverse.symbols(np.repeat(back, size) + inside))
        owner, symbol = key // (self.count + 1), key % (self.count + 1)
        letter = symbol > _DELIMITER
        return owner[letter], symbol[letter]

    def word(self, state: tuple) -> np.ndarray:
        """The numbers of the words whose delimiters begin the intervals: of the suffixes, the end and the last delimiter come first."""
        return state[0] - 2


def _cut(state: tuple, keep: np.ndarray) -> tuple:
    return tuple(x[keep] for x in state)


def near_in(index: Index, queries: np.ndarray, exact: int, longer: bool, second: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) for all words of the index that have the first ``exact`` code points of a query (a row of code points) and
    then one replacement, or one insertion (``longer``), up to their end. ``second``: the words are reversed, so that what is
    exact is the second half; insertions that leave the first half unchanged too are left out."""
    n, width = queries.shape
    w = index.coded(queries)
    left = np.arange(n)[(w[:, :exact] < index.count).all(axis=1)]
    # the unchanged half, once for equal ones: to the left, down to the delimiter
    halves, of = np.unique(w[left, :exact], axis=0, return_inverse=True)
    of = of.reshape(-1)
    state = index.everything(len(halves))
    alive = np.arange(len(halves))
    for symbols in [*(halves[:, j] for j in range(exact - 1, -1, -1)), np.full(len(halves), _DELIMITER)]:
        state = index.left(state, symbols[alive])
        there = state[2] > 0
        state, alive = _cut(state, there), alive[there]
    place = np.full(len(halves), -1)
    place[alive] = np.arange(len(alive))
    node = place[of]
    left, node = left[node >= 0], node[node >= 0]
    same = np.ones(len(left), bool)  # whether the query's letters from the half's end on are equal so far
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for j in range(exact, width + longer):
        if not len(left):
            break
        # every letter that follows a prefix, but the query's own
        owner, symbol = index.children(state)
        starts = np.searchsorted(owner, np.arange(len(state[0]) + 1))
        many = np.diff(starts)[node]
        who = np.repeat(np.arange(len(left)), many)
        child = np.repeat(starts[node], many) + np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
        c = symbol[child]
        ok = c != w[left[who], j] if j < width else np.ones(len(who), bool)
        if longer and second:
            ok &= ~(same[who] & (c == w[left[who], exact])) if j > exact else False
        who, c = who[ok], c[ok]
        at, query = index.right(_cut(state, node[who]), c), left[who]
        for i in [*range(j if longer else j + 1, width), -1]:
            symbol_i = w[query, i] if i >= 0 else np.full(len(query), _DELIMITER)
            fine = symbol_i < index.count
            at, query = index.right(_cut(at, fine), symbol_i[fine]), query[fine]
            at, query = _cut(at, at[2] > 0), query[at[2] > 0]
        found.append((query, index.word(at)))
        if j == width:
            break
        # on without an error, equal prefixes together
        fine = w[left, j] < index.count
        left, node, same = left[fine], node[fine], same[fine]
        same &= w[left, j] == w[left, exact]
        key, node = np.unique(node * (index.count + 1) + w[left, j], return_inverse=True)
        state = index.right(_cut(state, key // (index.count + 1)), key % (index.count + 1))
        there = state[2] > 0
        state, place = _cut(state, there), np.where(there, np.cumsum(there) - 1, -1)
        node = place[node.reshape(-1)]
        left, node, same = left[node >= 0], node[node >= 0], same[node >= 0]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _sharded(words: DataFrame, key: Column, shards: int) -> tuple[DataFrame, list[tuple]]:
    """The words in ranges of (length, key), and where the ranges begin: one (length, key, shard) a shard, in order."""
    ranged = words.select("word", "n", F.length("word").alias("length"), key.alias("key")).repartitionByRange(shards, "length", "key")
    held = written(ranged.withColumn("shard", F.spark_partition_id()), "shards")
    # one row a shard
    firsts = held.groupBy("shard").agg(F.min(F.struct("length", "key")).alias("least")).collect()
    return held, sorted((r["least"]["length"], r["least"]["key"], r["shard"]) for r in firsts)


def _near(words: DataFrame, shards: int, second: bool) -> DataFrame:
    """word, n, near, near_n for the pairs whose first (or ``second``) half is unchanged."""
    held, firsts = _sharded(words, F.reverse("word") if second else F.col("word"), shards)
    bounds, numbers = [f[:2] for f in firsts], [f[2] for f in firsts]

    def exact_of(length: int) -> int:
        return length - length // 2 if second else length // 2

    @F.arrow_udf("array<struct<shard:int,longer:boolean>>")
    def routes(key: pa.Array, length: pa.Array) -> pa.Array:
        out = []
        for k, size in zip(key.to_pylist(), length.to_pylist()):
            half = k[: exact_of(size)]
            out.append([{"shard": s, "longer": more} for more in (False, True) for s in numbers[max(0, bisect_right(bounds, (size + more, half)) - 1) : bisect_right(bounds, (size + more, half + "\U0010ffff"))]])
        return pa.array(out, pa.list_(pa.struct([("shard", pa.int32()), ("longer", pa.bool_())])))

    asked = held.select("key", "n", "length", F.explode(routes("key", "length")).alias("to")).select(F.col("to.shard").alias("shard"), F.lit(True).alias("query"), "length", F.col("to.longer").alias("longer"), "key", "n")
    # one row a shard: to how many tasks it goes
    parts = written(asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_QUERIES).cast("int").alias("parts")), "parts")
    asked = asked.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    indexed = held.join(F.broadcast(parts), "shard").select("shard", F.lit(False).alias("query"), "length", F.lit(False).alias("longer"), "key", "n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    columns = ["shard", "part", "query", "length", "longer", "key", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, names, counts = None, None, [], []
        for b in batches:
            place, query = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())), b.column(2).to_pylist()
            keys, n = b.column(5).to_pylist(), b.column(6).to_numpy()
            cuts = [i for i in range(b.num_rows) if not i or place[i] != place[i - 1] or query[i] != query[i - 1] or query[i] and (b.column(3)[i] != b.column(3)[i - 1] or b.column(4)[i] != b.column(4)[i - 1])]
            for start, end in zip(cuts, [*cuts[1:], b.num_rows]):
                if place[start] != now:
                    now, index, names, counts = place[start], None, [], []
                if not query[start]:
                    names += keys[start:end]
                    counts.append(n[start:end])
                    continue
                if index is None:
                    order = sorted(range(len(names)), key=names.__getitem__)
                    names, counts = [names[i] for i in order], np.concatenate(counts)[order]
                    index = Index(names)
                yield _pairs(index, names, counts, keys[start:end], n[start:end], b.column(3)[start].as_py(), b.column(4)[start].as_py())

    def _pairs(index: Index, names: list[str], counts: np.ndarray, keys: list[str], n: np.ndarray, length: int, longer: bool) -> pa.RecordBatch:
        matrix = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32).reshape(-1, length)
        query, word = near_in(index, matrix, exact_of(length), longer, second)
        back = slice(None, None, -1 if second else 1)
        a, b = [keys[i][back] for i in query], [names[i][back] for i in word]
        na, nb = n[query], counts[word] if len(word) else np.zeros(0, np.int64)
        if longer:  # the longer word is no query for its shorter one
            a, b, na, nb = a + b, b + a, np.concatenate((na, nb)), np.concatenate((nb, na))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(na, pa.int64()), pa.array(b, pa.string()), pa.array(nb, pa.int64())], ["word", "n", "near", "near_n"])

    dealt = indexed.select(*columns).unionByName(asked.select(*columns)).repartition("shard", "part").sortWithinPartitions("shard", "part", "query", "length", "longer", "key")
    return dealt.mapInArrow(run, "word string, n long, near string, near_n long")


def near_words(words: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """word, n, near, near_n for all pairs of words (column word, distinct, with n) one code point apart, both ways round."""
    shipped(words.sparkSession)
    chars = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    return _near(words, shards, False).unionByName(_near(words, shards, True))


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of a vocabulary (word, n)."""
    held = written(words, "vocabulary")
    nothing = held.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    grouped = nothing.unionByName(near_words(held)).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    formed = written(grouped.select("word", "n", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    # the last form: each round doubles the way that a word has gone; n grows with each form, so ways are short and have ends
    roots = written(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        longer = written(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        removed(roots)
        roots = longer.select("word", "root")
        roots._tidewire_path = longer._tidewire_path
        if not longer.filter("moved").limit(1).count():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_RUN = "[A-Za-zÀ-ÿ]{7,}"
#: The same rows in SQL. The checksum is worked out byte by byte, near words meet under what is left of them without one code point.
SQL = f"""WITH RECURSIVE crc AS MATERIALIZED (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) AS b(i)),
r AS MATERIALIZED (SELECT d, r, count(*) AS times FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(list_transform(regexp_extract_all(text, '{_RUN}'), lambda x: translate(x, '{UPPER}', '{LOWER}'))) AS r FROM documents) GROUP BY ALL),
h AS MATERIALIZED (SELECT r.*, xor(4294967295, list_reduce(list_transform(range(1, CAST(length(x) AS BIGINT), 2), lambda i: CAST(strpos('0123456789ABCDEF', x[i]) - 1 AS BIGINT) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 1),
 lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295)) AS h FROM (SELECT *, hex(encode(d || ':' || r)) AS x FROM r) r, crc),
w AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT times, CASE WHEN h % {EVERY} = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM h) WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS l FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT DISTINCT word, n, near, near_n FROM (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.l = b.l AND a.i = b.i AND a.word <> b.word
 UNION ALL SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON w.word = d.l UNION ALL SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON w.word = d.l)),
f AS MATERIALIZED (SELECT w.word, w.n, count(p.near) AS n_near, arg_min(p.near, ROW(-p.near_n, p.near)) AS near, max(p.near_n) AS near_n FROM w LEFT JOIN p ON p.word = w.word GROUP BY ALL),
g AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN near_n >= {TIMES} * n THEN near END AS form, CASE WHEN near_n >= {TIMES} * n THEN near_n END AS form_n FROM f),
s AS (SELECT word, word AS top, 0 AS k FROM g UNION ALL SELECT s.word, g.form, k + 1 FROM s JOIN g ON g.word = s.top WHERE g.form IS NOT NULL)
SELECT g.word, form, root, n, n_near, form_n FROM g JOIN (SELECT word, arg_max(top, k) AS root FROM s GROUP BY word) e ON e.word = g.word"""
