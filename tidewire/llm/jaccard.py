"""N-gram Jaccard join over a token-group matrix.

Tokens are the distinct five-word shingles of a text. Documents with the same token set are one class. Classes
are partitioned into groups of similar ones: a class belongs to the group of its first leading token, or of its
first common one if it has any, which near copies share; groups of more than ``MEMBERS`` classes are split. The
matrix lists, for each token, the groups whose union holds it, one row for each token and group. Its entries are
limited to leading tokens: if two sets reach the threshold, then in any common order of tokens their first
n - ceil(t n) + 1 tokens meet, so the number of leading tokens that two groups share, plus all their members' other
tokens, bounds the overlap of any two members. Only pairs of groups that can still reach the threshold are opened.
There each class is a query: the count of its tokens that the other group's union holds bounds its overlap with
every member, and the members of groups that pass are compared with it token by token. All links are found, inside
groups too; ``pairs`` returns them, ``join`` counts them.

The order puts rare tokens first (by hash) and common ones last. Common tokens fill the lead only in documents made
almost wholly of them, that is in large families, whose members share few groups, so no list is expanded into all pairs
of its documents. The order only affects speed, so the list of common tokens may come from a sketch (each task counts the
tokens that it meets at least twice) and may be bounded (``HOT_MOST``) without changing any result.

Tokens are 64-bit hashes of five words, compared within one pair of documents only, where a chance collision has a
probability of about 1e-14; classes, which are told apart in the whole table, have 128 bits.

Each text is read twice: for the sketch of common tokens, and for its signature (size, class, leading tokens), which is
written; documents of opened groups are read once more, for all their tokens.

Defined cases: a text without words, or null, has no shingles and links with nothing; a text of fewer
than five words is one shingle; equal doc_ids are one document per distinct text for linking and
give one row each; a null doc_id is its own component (null); no rows give no rows; texts of any length are read whole;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import checked, removed, shipped, written
from .components import components

WIDTH = 5
#: Similarity threshold, per cent.
PERCENT = 80
#: Tokens of this many documents and more are common; at most HOT_MOST of them are kept.
HOT, HOT_MOST = 32, 1 << 18
GROUP_BYTES = 1 << 20
#: Tokens that a task counts at once for the sketch of common ones.
COUNTED_AT_ONCE = 1 << 21
#: Pairs of documents held at once under the tokens of a batch.
PAIRS_AT_ONCE = 1 << 18
#: Classes in a group at most, about; columns of a matrix of members and tokens held at once.
MEMBERS, COLUMNS = 256, 4096
#: Tables of up to this many narrow rows (classes to open, pairs of groups) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 300_000


def token_sets(batches: Iterator[pa.RecordBatch], secret: wordhash.Key = wordhash.OPEN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of documents: ids, tokens (distinct in each document, rising) and bounds."""
    for ids, words, bounds in wordhash.groups(batches, lower=True, size=GROUP_BYTES, key=secret):
        n = np.diff(bounds)
        size = np.maximum(n - WIDTH + 1, n > 0)  # few words are one token, the whole sequence
        ends = np.concatenate(([0], np.cumsum(size)))
        grams, out, kept = wordhash.runs(words, WIDTH), np.empty(ends[-1], np.uint64), np.zeros(len(ids) + 1, np.int64)
        for i in range(len(ids)):
            mine = out[kept[i] : kept[i] + size[i]]
            if 0 < n[i] < WIDTH:  # apart from tokens of full width
                mine[:] = wordhash.mix(wordhash.runs(words[bounds[i] : bounds[i + 1]], int(n[i])) + np.uint64(n[i]))
            else:
                mine[:] = grams[bounds[i] : bounds[i] + size[i]]
            mine.sort()
            if len(mine) > 1:
                new = np.flatnonzero(mine[1:] != mine[:-1]) + 1
                if len(new) + 1 < len(mine):
                    mine[1 : len(new) + 1] = mine[new]
                    mine = mine[: len(new) + 1]
            kept[i + 1] = kept[i] + len(mine)
        yield ids, out[: kept[-1]], kept


def class_keys(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit keys of each token set."""
    n = np.diff(bounds).astype(np.uint64)
    keys = []
    for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(wordhash.mix(tokens ^ np.uint64(salt)), dtype=np.uint64)))
        keys.append(wordhash.mix(total[bounds[1:]] - total[bounds[:-1]] + n).view(np.int64))
    return keys[0], keys[1]


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n tokens with any set that reaches the threshold."""
    return -(-percent * n // 100)


def _own(bounds: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """Places of the first of equal sets within a group of documents; empty sets are left out."""
    some = np.flatnonzero(np.diff(bounds))
    _, first = np.unique(np.stack((c1[some], c2[some]), axis=1), axis=0, return_index=True)
    return np.sort(some[first])


def common_tokens(docs: DataFrame, percent: int, secret: wordhash.Key = wordhash.OPEN) -> np.ndarray:
    """Tokens of ``HOT`` and more documents, sorted; at most HOT_MOST, the most common ones. A sketch: each task counts
    blocks of ``COUNTED_AT_ONCE`` tokens (of distinct sets) and hands on those that it has met twice."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = np.empty(COUNTED_AT_ONCE, np.uint64), 0

        def repeated() -> pa.RecordBatch:
            token = held[:size]
            token.sort()
            edge = np.concatenate(([0], np.flatnonzero(token[1:] != token[:-1]) + 1, [size]))
            n = np.diff(edge)
            many = np.flatnonzero(n > 1)
            return pa.RecordBatch.from_arrays([pa.array(token[edge[many]].view(np.int64)), pa.array(n[many])], ["token", "n"])

        for _, tokens, bounds in token_sets(batches, secret):
            mine = np.zeros(len(bounds) - 1, bool)
            mine[_own(bounds, *class_keys(tokens, bounds))] = True
            tokens = tokens[np.repeat(mine, np.diff(bounds))]
            while len(tokens):
                more = tokens[: len(held) - size]
                held[size : size + len(more)] = more
                size, tokens = size + len(more), tokens[len(more) :]
                if size == len(held):
                    yield repeated()
                    size = 0
        if size:
            yield repeated()

    counted = docs.select("doc_id", "text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    hot = counted.filter(F.col("n") >= HOT).orderBy(F.desc("n"), "token").limit(HOT_MOST).select("token").toPandas()["token"]
    return np.sort(hot.to_numpy(np.int64).view(np.uint64))


def signatures(docs: DataFrame, percent: int, hot: np.ndarray, secret: wordhash.Key = wordhash.OPEN) -> DataFrame:
    """One row per row of ``docs`` with a doc_id: doc, n (set size), c1 and c2 (its class), and, given once for equal sets of a
    batch, key (its group before any split) and the leading tokens, rare and common ones."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def spread(values: np.ndarray, n: np.ndarray, own: np.ndarray, docs: int) -> pa.Array:
        size = np.zeros(docs, np.int64)
        size[own] = n
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(values.view(np.int64)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for ids, tokens, bounds in token_sets(batches, secret):
            c1, c2 = class_keys(tokens, bounds)
            n = np.diff(bounds)
            own = _own(bounds, c1, c2)
            mine = np.zeros(len(ids), bool)
            mine[own] = True
            token = tokens[np.repeat(mine, n)]
            common = hot[np.minimum(np.searchsorted(hot, token), len(hot) - 1)] == token if len(hot) else np.zeros(len(token), bool)
            size = n[own]
            start = np.cumsum(size) - size
            lead = size - _needed(size, percent) + 1
            before = np.concatenate(([0], np.cumsum(~common)))  # rare tokens before each place
            rare = before[start + size] - before[start]
            which = np.repeat(np.arange(len(own)), size)
            rank = before[:-1] - before[start][which]
            first = ~common & (rank < lead[which])
            last = common & (np.arange(len(token)) - start[which] - rank < (lead - rare)[which])
            rare, many = np.bincount(which[first], minlength=len(own)), np.bincount(which[last], minlength=len(own))
            key = np.zeros(len(ids), np.int64)
            firsts, lasts = token[first], token[last]
            for some, at, values in ((rare > 0, np.cumsum(rare) - rare, firsts), (many > 0, np.cumsum(many) - many, lasts)):
                key[own[some]] = values[at[some]].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(n), pa.array(c1), pa.array(c2), pa.array(key, mask=~mine), spread(firsts, rare, own, len(ids)), spread(lasts, many, own, len(ids))],
                ["doc", "n", "c1", "c2", "key", "rare", "common"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc long, n long, c1 long, c2 long, key long, rare array<long>, common array<long>")


def _pairs_met(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over matrix rows sorted by token and group: pairs of groups of fitting sizes under each rare
        token, with the number of tokens they meet under in this batch. The rows of the last
        token of a batch wait for the next one; rare tokens have short lists."""
        held = None
        last = False
        it = iter(batches)
        batch = next(it, None)
        while batch is not None:
            following = next(it, None)
            last = following is None
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = None
            token = table["token"].to_numpy()
            if len(token) and not last:
                cut = int(np.searchsorted(token, token[-1]))
                held, table, token = table.slice(cut), table.slice(0, cut), token[:cut]
            if len(token):
                yield from met(token, table)
            batch = following

    def met(token, table):
        group, n = (table[c].to_numpy().astype(np.int64) for c in ("grp", "n"))
        first = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (group[1:] != group[:-1]))))
        low, high = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first)
        token, group = token[first], group[first]
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        length = np.diff(np.append(start, len(token)))
        reach = np.repeat(start + length, length)
        left, right, held = [], [], 0
        place = np.flatnonzero(np.arange(len(token)) + 1 < reach)
        step = 1
        while len(place):
            for i in range(0, len(place), PAIRS_AT_ONCE):
                a = place[i : i + PAIRS_AT_ONCE]
                left.append(a)
                right.append(a + step)
                held += len(a)
                if held >= PAIRS_AT_ONCE:
                    yield from flushed(np.concatenate(left), np.concatenate(right), group, low, high)
                    left, right, held = [], [], 0
            step += 1
            place = place[place + step < reach[place]]
        if left:
            yield from flushed(np.concatenate(left), np.concatenate(right), group, low, high)

    def flushed(a, b, group, low, high):
        fits = (high[a] * 100 >= percent * low[b]) & (high[b] * 100 >= percent * low[a])
        a, b = a[fits], b[fits]
        if not len(a):
            return
        order = np.lexsort((group[b], group[a]))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.concatenate(([True], (group[a][1:] != group[a][:-1]) | (group[b][1:] != group[b][:-1]))))
        times = np.diff(np.append(new, len(a)))
        low, high = np.minimum.reduceat(np.minimum(low[a], low[b]), new), np.maximum.reduceat(np.maximum(high[a], high[b]), new)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (group[a[new]], group[b[new]], low, high, times)], ["a", "b", "low", "high", "met"])

    return run


def _overlaps(one: list[np.ndarray], two: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Tokens that each set of ``one`` shares with each set of ``two`` (None: ``one`` itself); 0 where a set's tokens
    in the union of the other group are too few for any of its members."""
    sides = [one] if two is None else [one, two]
    flat = [np.concatenate(x) for x in sides]
    which = [np.repeat(np.arange(len(x)), [len(t) for t in x]) for x in sides]
    n = [np.array([len(t) for t in x]) for x in sides]
    if two is None:
        union, count = np.unique(flat[0], return_counts=True)
        union = union[count > 1]
    else:
        union = np.intersect1d(flat[0], flat[1])
    out = np.zeros((len(one), len(sides[-1])), np.float32)
    if not len(union):
        return out
    kept = []
    for i, (t, w) in enumerate(zip(flat, which)):
        column = np.minimum(np.searchsorted(union, t), len(union) - 1)
        held = union[column] == t
        least = np.maximum(n[i - 1 if two is not None else 0].min(), _needed(n[i], percent))
        passes = np.bincount(w[held], minlength=len(n[i])) * (100 + percent) >= percent * (n[i] + least)
        held &= passes[w]
        order = np.argsort(column[held], kind="stable")
        kept.append((column[held][order], w[held][order]))
    for lo in range(0, len(union), COLUMNS):
        dense = []
        for (column, w), x in zip(kept, sides):
            part = slice(*np.searchsorted(column, (lo, lo + COLUMNS)))
            m = np.zeros((len(x), min(COLUMNS, len(union) - lo)), np.float32)
            m[w[part], column[part] - lo] = 1
            dense.append(m)
        out += dense[0] @ dense[-1].T
    return out


def _verified(percent: int, every: bool):
    """Over the members of opened pairs of groups (a, b, side, first, c1, w, tokens), sorted: with ``every`` all links as
    (x, y, nx, ny, overlap), else for each member with links x, the least member y connected with it by links found here,
    and how many classes (nx) and documents (ny) it links with."""
    def block(one: list[tuple], two: list[tuple]) -> tuple | None:
        if not one or (not two and len(one) < 2):
            return None
        got = _overlaps([r[2] for r in one], [r[2] for r in two] or None, percent)
        same = not two
        two = two or one
        (da, wa, na), (db, wb, nb) = ((np.array([r[0] for r in s]), np.array([r[1] for r in s]), np.array([len(r[2]) for r in s])) for s in (one, two))
        link = got.astype(np.int64) * (100 + percent) >= percent * (na[:, None] + nb[None, :])
        if same:
            np.fill_diagonal(link, False)
        if not link.any():
            return None
        if every:
            x, y = np.nonzero(np.triu(link) if same else link)
            swap = da[x] > db[y]
            pick = lambda u, v: np.where(swap, v[y], u[x])
            return pick(da, db), np.where(swap, da[x], db[y]), pick(na, nb), np.where(swap, na[x], nb[y]), got[x, y].astype(np.int64)
        ra, rb = da.copy(), db.copy()
        top = np.iinfo(np.int64).max
        while True:  # the least id spreads over the links
            if same:
                new = np.minimum(ra, np.where(link, ra[None, :], top).min(axis=1))
                done, ra = (new == ra).all(), new
            else:
                newa = np.minimum(ra, np.where(link, rb[None, :], top).min(axis=1))
                newb = np.minimum(rb, np.where(link, newa[:, None], top).min(axis=0))
                done, ra, rb = (newa == ra).all() and (newb == rb).all(), newa, newb
            if done:
                break
        rows = [(da, ra, link.sum(axis=1), link @ wb)] + ([] if same else [(db, rb, link.sum(axis=0), wa @ link)])
        d, r, links, documents = (np.concatenate(x) for x in zip(*rows))
        some = links > 0
        return d[some], r[some], links[some], documents[some], np.zeros(some.sum(), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, last, out, size = None, ([], []), None, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["x", "y", "nx", "ny", "overlap"])

        for b in batches:
            a, c, side, first, c1, w = (b.column(i).to_numpy() for i in range(6))
            at, values = b.column(6).offsets.to_numpy(), b.column(6).values.to_numpy()
            for i in range(len(a)):
                if now != (a[i], c[i]):
                    if (found := block(*held)) is not None:
                        out.append(found)
                        size += len(found[0])
                    if size >= PAIRS_AT_ONCE:
                        yield batch()
                        out, size = [], 0
                    now, held, last = (a[i], c[i]), ([], []), None
                if last != (side[i], first[i], c1[i]):  # else the same row of a table that holds it twice
                    last = side[i], first[i], c1[i]
                    held[side[i]].append((first[i], w[i], values[at[i] : at[i + 1]]))
        if (found := block(*held)) is not None:
            out.append(found)
        if out:
            yield batch()

    return run


def opened_sets(docs: DataFrame, members: DataFrame, secret: wordhash.Key = wordhash.OPEN) -> DataFrame:
    """The rows of ``members`` (first, c1, c2, grp, w) with their tokens, read from their first documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, (c1, c2, grp, w) = np.arange(b.num_rows), (b.column(i).to_numpy() for i in range(2, 6))
            for at, tokens, bounds in token_sets(iter([pa.RecordBatch.from_arrays([pa.array(rows), b.column(1)], ["row", "text"])]), secret):
                k1, k2 = class_keys(tokens, bounds)
                same = (c1[at] == k1) & (c2[at] == k2)  # else another text of the same doc_id
                keep, n = at[same], np.diff(bounds)[same]
                values = tokens[np.repeat(same, np.diff(bounds))].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), *(pa.array(x[keep]) for x in (c1, grp, w)), lists], ["first", "c1", "grp", "w", "tokens"])

    wanted = docs.select("doc_id", "text").join(checked(members, BROADCAST_ROWS), F.col("doc_id") == F.col("first"))
    return wanted.select("first", "text", "c1", "c2", "grp", "w").mapInArrow(run, "first long, c1 long, grp long, w long, tokens array<long>")


def _linked(docs: DataFrame, percent: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """One row per row of ``docs`` with a doc_id (doc, n, first, w: its class's least doc_id and number of rows), and what
    ``_verified`` finds in the opened groups."""
    shipped(docs.sparkSession)
    secret = wordhash.new_key()
    signed = written(signatures(docs, percent, common_tokens(docs, percent, secret), secret), "signed")
    whole = signed.filter("n > 0").groupBy("c1", "c2").agg(F.min("key").alias("key"), F.min("doc").alias("first"), F.count(F.lit(1)).alias("w"))
    classes = written(whole, "classes")
    # the number of parts of large groups: at most one row for each MEMBERS classes
    parts = written(classes.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts")).filter("parts > 1"), "parts")
    parts = checked(parts, BROADCAST_ROWS)

    def grouped(df: DataFrame) -> DataFrame:
        return df.join(parts, "key", "left").withColumn("grp", F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.col("key").bitwiseXOR(F.pmod("c1", "parts"))))

    leads = grouped(signed.filter("key is not null"))
    rare = leads.select(F.explode("rare").alias("token"), "grp", F.col("n").cast("int").alias("n"))
    met = rare.repartition("token").sortWithinPartitions("token", "grp").mapInArrow(_pairs_met(percent), "a long, b long, low long, high long, met long")
    # the matrix by common tokens: few groups hold each of them
    dense = leads.select(F.explode("common").alias("token"), "grp", "n").groupBy("token", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    dense = written(dense, "dense")
    left, right = dense.select("token", F.col("grp").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha")), dense.select("token", F.col("grp").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    fits = (F.col("ha") * 100 >= F.col("lb") * percent) & (F.col("hb") * 100 >= F.col("la") * percent)
    more = left.join(right, "token").filter((F.col("a") < F.col("b")) & fits).select("a", "b", F.least("la", "lb").alias("low"), F.greatest("ha", "hb").alias("high"), F.lit(1).cast("long").alias("met"))
    counted = met.unionByName(more).groupBy("a", "b").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("met").alias("met"))
    # the least overlap that reaches the threshold, less all tokens behind the lead
    asked = (F.col("low") + F.col("high")) * percent / (100 + percent) - F.col("high") * percent / 100
    members = written(grouped(classes).select("c1", "c2", "grp", "first", "w"), "members")
    alone = members.groupBy("grp").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("grp").alias("a"), F.col("grp").alias("b"))
    opened = counted.filter(F.col("met") > asked - 1e-6).select("a", "b").unionByName(alone)
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("grp")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("grp")), F.struct(F.lit(1).alias("side"), F.col("b").alias("grp"))))
    sides = written(opened.select("a", "b", F.explode(both).alias("s")).select("a", "b", "s.side", "s.grp"), "sides")
    wanted = written(members.join(sides.select("grp").distinct(), "grp", "left_semi"), "wanted")
    rows = opened_sets(docs, wanted, secret).join(checked(sides, BROADCAST_ROWS), "grp").select("a", "b", "side", "first", "c1", "w", "tokens")
    rows = rows.repartition("a", "b").sortWithinPartitions("a", "b", "side", "first", "c1")
    found = written(rows.mapInArrow(_verified(percent, every), "x long, y long, nx long, ny long, overlap long"), "found")
    sized = written(signed.select("doc", "n", "c1", "c2").join(classes.select("c1", "c2", "first", "w"), ["c1", "c2"], "left").drop("c1", "c2"), "sized")
    for done in (dense, members, sides, wanted, classes, signed):
        removed(done)
    return sized, found


def pairs(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All links between classes: a < b (their class_ids), na, nb (shingles) and overlap. Documents of one class,
    which ``join`` names, link with each other and with all of a linked class."""
    _, found = _linked(docs, percent, True)
    return found.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("nx").alias("na"), F.col("ny").alias("nb"), "overlap")


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (the least doc_id with the same shingles) and n_links (how many other
    rows link with it, those of its class too) of every row."""
    sized, found = _linked(docs, percent, False)
    copies = sized.filter("doc <> first").select(F.col("doc").alias("a"), F.col("first").alias("b"))
    group = components(found.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(copies))
    counts = found.groupBy(F.col("x").alias("of")).agg(F.sum("ny").alias("links"))
    rows = sized.join(group, F.col("doc") == F.col("node"), "left").join(counts, F.col("first") == F.col("of"), "left")
    none = F.lit(None).cast("long")
    links = F.coalesce(F.col("w") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    rows = rows.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"), F.coalesce("first", "doc").alias("class_id"), links.alias("n_links"))
    return rows.unionByName(docs.filter(F.col("doc_id").isNull()).select("doc_id", *[none.alias(c) for c in ("n_shingles", "component_id", "class_id", "n_links")]))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
i AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS t FROM i),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y, k = nx AND k = ny AS same FROM (SELECT p.*, a.n AS nx, b.n AS ny FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y) WHERE 100 * k >= 80 * (nx + ny - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT w.doc_id, coalesce((SELECT n FROM c WHERE c.doc_id = w.doc_id), 0) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = w.doc_id) AS component_id,
 least(w.doc_id, coalesce((SELECT min(y) FROM l WHERE l.x = w.doc_id AND same), w.doc_id)) AS class_id, (SELECT count(*) FROM l WHERE l.x = w.doc_id) AS n_links FROM w"""
