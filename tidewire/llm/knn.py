"""Exact top-k search as a Voronoi kNN join, for integer inner products.

Vectors are scaled to integers and grouped by their nearest pivot. For each cell the driver learns
a summary only: its size, radius, largest norm and the k + 1 least distances to the pivot. With
q = p_i + a and x = p_j + b, q.x lies within p_i.p_j -+ (|a| |p_j| + |q| |b|); the summaries thus give
each query cell a score that k + 1 vectors are sure to reach, and each data vector the best score
it can have with any query of the cell. A vector is sent only to the groups of query cells where that best score is
high enough, and each group is solved by itself. Large groups are split: queries into blocks,
vectors by a salt, and the partial answers are merged.

Of equal vectors only the k + 1 with the least ids can be answers, so only these take part: copies
never pile up.

Defined cases: vectors that are null, empty, or hold a null or a non-finite component take no part, nor do
rows without vec_id; shorter vectors count as padded with zeros; fewer than k candidates give
fewer rows; a repeated vec_id counts each time, though never as a candidate of a query of that id; no rows give no
rows; components beyond a long once scaled count as the largest long, and so do scores, whose order is then that of the
vec_ids; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shipped, written

K = 5
SCALE = 256
#: Pivots: about half the square root of the number of distinct vectors, at most so many.
PIVOTS = 256
QUERIES_AT_ONCE, VECTORS_AT_ONCE = 1024, 8192
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
    return good.select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)


def _scores(q: pa.Array, x: pa.Array, dim: int) -> np.ndarray:
    """Integer inner products: in doubles where these are exact, else in Python's integers."""
    a, b = _matrix(q, dim), _matrix(x, dim)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * dim < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array(c.to_pylist(), dtype=object).reshape(len(c), dim) for c in (q, x)]
    return whole[0] @ whole[1].T


def _grouped(pivots: np.ndarray, cells: list[int], loads: list[int]) -> dict[int, int]:
    """Query cells by group: neighbouring cells share one until it holds QUERIES_AT_ONCE queries."""
    left, out, group, load = dict(zip(cells, loads)), {}, 0, 0
    at = cells[0]
    while left:
        load += left.pop(at)
        out[at] = group
        if load >= QUERIES_AT_ONCE:
            group, load = group + 1, 0
        if left:
            rest = list(left)
            at = rest[int(((pivots[rest] - pivots[at]) ** 2).sum(axis=1).argmin())]
    return out


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows where ``is_query`` holds (over vec_id) their k
    best rows of all others, by integer inner product, ties to the smaller vec_id."""
    spark = shipped(vectors.sparkSession)
    rows = scaled(vectors, scale)
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not dim:
        return nothing
    rows = rows.select("vec_id", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).alias("v"), is_query.alias("is_query"))
    near = Window.partitionBy("v").orderBy("vec_id")
    # the limit on the rank is applied before the shuffle too, so copies arrive as a few rows a task
    kept = written(rows.withColumn("nr", F.row_number().over(near)).filter(F.col("nr") <= k + 1).drop("nr").withColumn("is_query", F.lit(False)).unionByName(rows.filter("is_query")), "vectors")
    data, queries = kept.filter("not is_query"), kept.filter("is_query")
    n = data.count()
    most = int(min(PIVOTS, max(4, n**0.5 / 2)))
    chosen = data.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(most).collect()
    pivots = np.array([r.v for r in chosen], dtype=np.float64)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                piece = b.slice(i, 4096)
                x = _matrix(piece.column(1), dim)
                far = (x**2).sum(axis=1)[:, None] - 2 * (x @ p.T) + (p**2).sum(axis=1)
                cell = far.argmin(axis=1)
                away = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(cell.astype(np.int32)), pa.array(away), pa.array(np.sqrt((x**2).sum(axis=1)))], ["vec_id", "v", "is_query", "cell", "away", "norm"])

    placed = written(kept.mapInArrow(assign, "vec_id long, v array<long>, is_query boolean, cell int, away double, norm double"), "placed")
    data, queries = placed.filter("not is_query"), placed.filter("is_query")
    sums = queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away"), F.max("norm").alias("norm")).orderBy("cell").collect()
    if not sums:
        return nothing
    closest = data.select("cell", "away").withColumn("nr", F.row_number().over(Window.partitionBy("cell").orderBy("away"))).filter(F.col("nr") <= k + 1)
    closest = closest.select("cell", "away").toPandas()  # k + 1 rows a cell
    sizes = {r.cell: r.n for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}

    # what each query cell is sure to reach, and how far off a vector may be to matter for it
    norms = np.sqrt((pivots**2).sum(axis=1))
    cells = [r.cell for r in sums]
    radius, norm = np.array([r.away for r in sums]), np.array([r.norm for r in sums])
    inner, spread = pivots[cells] @ pivots.T, radius[:, None] * norms[None, :]
    sure = (inner - spread)[:, closest["cell"]] - norm[:, None] * closest["away"].to_numpy()[None, :]
    floor = np.sort(sure, axis=1)[:, ::-1][:, k] if sure.shape[1] > k else np.full(len(cells), -np.inf)
    slack = 1e-6 * (1 + np.abs(floor)) if len(floor) else 0
    least = (np.where(np.isfinite(floor), floor - slack, -np.inf)[:, None] - inner - spread) / np.maximum(norm, 1e-12)[:, None]
    group_of = _grouped(pivots, cells, [r.n for r in sums])
    groups = sorted(set(group_of.values()))
    # from which distance on a vector of a cell goes to a group
    least_by_group = np.array([least[[c for c, x in enumerate(cells) if group_of[x] == g]].min(axis=0) for g in groups])
    norm_by_group = np.array([norm[[c for c, x in enumerate(cells) if group_of[x] == g]].max() for g in groups])
    floor_by_group = np.array([(np.where(np.isfinite(floor), floor - slack, -np.inf))[[c for c, x in enumerate(cells) if group_of[x] == g]].min() for g in groups])
    loads = np.array([sum(r.n for r in sums if group_of[r.cell] == g) for g in groups])
    blocks = np.maximum(1, -(-loads // QUERIES_AT_ONCE)).astype(int)
    salts = max(1, -(-sum(sizes.values()) // VECTORS_AT_ONCE))
    plan = spark.sparkContext.broadcast((least_by_group, norm_by_group, floor_by_group, blocks, {c: g for c, g in group_of.items()}))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to the groups, and their blocks, where it can be an answer."""
        least, norm, floor, blocks, _ = plan.value
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                piece = b.slice(i, 4096)
                cell, away, size = (piece.column(c).to_numpy() for c in (3, 4, 5))
                need = (away[:, None] >= least[:, cell].T) & (size[:, None] * norm[None, :] >= floor[None, :])
                row, group = np.nonzero(need)
                times = blocks[group]
                row, group = np.repeat(row, times), np.repeat(group, times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), piece.column(1).take(pa.array(row)), pa.array(group.astype(np.int32)), pa.array(block.astype(np.int32))], ["vec_id", "v", "group", "block"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query to its group's block."""
        _, _, _, blocks, group_of = plan.value
        for b in batches:
            group = np.array([group_of[c] for c in b.column(3).to_pylist()], np.int32)
            block = (b.column(0).to_numpy() // 50 % blocks[group]).astype(np.int32) if len(group) else group
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(group), pa.array(block)], ["query_id", "q", "group", "block"])

    sent = data.mapInArrow(send, "vec_id long, v array<long>, group int, block int").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))
    asked = queries.mapInArrow(ask, "query_id long, q array<long>, group int, block int").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, asks = right["vec_id"].to_numpy(), left["query_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], right["v"].combine_chunks().take(pa.array(order))
            for i in range(0, left.num_rows, 256):
                score = _scores(left["q"].combine_chunks().slice(i, 256), vectors, dim)
                for q, s in zip(asks[i : i + 256], score):
                    other = np.flatnonzero(ids != q)
                    best = other[np.argsort(-s[other], kind="stable")[:k]]
                    out[0] += [q] * len(best)
                    out[1] += ids[best].tolist()
                    out[2] += [min(max(x, LOWEST), HIGHEST) for x in s[best].tolist()]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out)})

    keys = ["group", "block", "salt"]
    part = asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH e AS (SELECT vec_id, [floor(CAST(x AS DOUBLE) * 256) for x in embedding] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
      FROM e q JOIN e x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""
