"""Centroid clustering of integer vectors by scalar lookup tables.

Vectors are packed once into blocks: the distinct values that each dimension has in the block, and for each component the
number of its value. A round sends the centroids to the tasks (a few thousand integers); a task tabulates, for each
dimension, occurring value and centroid, the squared difference, and a distance is then the sum of one gathered entry a
dimension. What comes back is, for each task, the sums and counts of each cluster, added up by Spark in exact decimals.
The vectors stay where they are: nothing is shuffled by vector or cluster, so a cluster of any share is no hot key, and a
lost executor costs its tasks only.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component take no part; ties
go to the smaller cluster; repeated rows count as often as they are there; ids may repeat or be null (a null id is hashed
as an empty one, ties of the hash go to the smaller vector); with fewer vectors than clusters there are as many clusters as vectors;
no vectors give no rows. Components are exact up to 2^40 in size after scaling and clipped there; distances and sums
of distances beyond a long are returned as its largest value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shipped, written

#: Vectors of a block, so that the number of a value takes two bytes.
BLOCK = 4096
#: Values from which squared differences may leave 64 bits: such blocks go by Python's integers.
SMALL = 1 << 27
#: Components are clipped here, so that sums over 10^11 vectors fit exact decimals.
CLIP, LONG = 1 << 40, (1 << 63) - 1
#: What a round returns besides the sum of each dimension: number and total distance of a cluster's vectors.
_N, _DISTANCE = -1, -2


class Model(NamedTuple):
    """Centroids, the inertia of each cluster under them, and of all clusters before each round and at the end."""

    centroids: list[list[int]]
    inertia: list[int]
    history: list[int]

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def usable(vector: Column, width: int) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == width) & F.coalesce(fine, F.lit(False))


def packed(vectors: DataFrame, width: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for up to ``BLOCK`` vectors: ids, values (of each dimension in turn, rising), ends (where the values of each
    dimension end) and codes (for each dimension the place of each vector's value), as bytes of numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                ids, x = b.column(0).slice(at, BLOCK), b.column(1).slice(at, BLOCK).flatten().to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(x.astype(np.float64) * scale), -float(CLIP), float(CLIP)).astype(np.int64).reshape(-1, width)
                found = [np.unique(x[:, d], return_inverse=True) for d in range(width)]
                ends = np.cumsum([len(v) for v, _ in found]).astype(np.int32)
                parts = (np.concatenate([v for v, _ in found]), ends, np.stack([c.astype(np.uint16) for _, c in found]))
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["ids", "values", "ends", "codes"])

    kept = vectors.filter(usable(F.col(vector), width)).select(F.col(vec_id).cast("long"), F.col(vector).cast("array<double>"))
    return kept.mapInArrow(run, "ids array<long>, values binary, ends binary, codes binary")


class _Block:
    """A packed block, and its vectors' nearest centroids by a table of squared differences."""

    def __init__(self, values: bytes, ends: bytes, codes: bytes):
        self.values, self.ends = np.frombuffer(values, np.int64), np.frombuffer(ends, np.int32)
        self.width = len(self.ends)
        self.codes = np.frombuffer(codes, np.uint16).reshape(self.width, -1) + np.concatenate(([0], self.ends[:-1])).astype(np.int32)[:, None]
        self.sizes = np.diff(self.ends, prepend=0)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        small = max(abs(int(self.values.min())), abs(int(self.values.max())), int(abs(centroids).max())) < SMALL
        kind = np.int64 if small and self.width << 56 <= LONG else object
        own = np.repeat(centroids.astype(kind).T, self.sizes, axis=0)
        table = (self.values.astype(kind)[:, None] - own) ** 2
        out = np.zeros((self.codes.shape[1], len(centroids)), kind)
        for row in self.codes:
            out += table[row]
        best = out.argmin(axis=1)
        return best, out[np.arange(len(best)), best]

    def sums(self, chosen: np.ndarray) -> np.ndarray:
        """The sum of each dimension over the chosen vectors."""
        x = self.values[self.codes[:, chosen]]
        return x.sum(axis=1) if not x.size or abs(x).max() < 1 << 50 else x.astype(object).sum(axis=1)


_BLOCK = ["values", "ends", "codes"]


def _round(blocks: DataFrame, centroids: list[list[int]]) -> dict[tuple[int, int], int]:
    """(cluster, dimension) to sum, with the number and the total distance of each cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = np.array(centroids, object), {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                block = _Block(*row)
                best, distance = block.nearest(at)
                for k in np.unique(best).tolist():
                    mine = best == k
                    for d, s in enumerate([*block.sums(mine).tolist(), int(mine.sum()), int(distance[mine].astype(object).sum())]):
                        key = k, d if d < block.width else (_N, _DISTANCE)[d - block.width]
                        total[key] = total.get(key, 0) + int(s)
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([d for _, d in keys], pa.int32()), pa.array([Decimal(total[k]) for k in keys], pa.decimal128(38, 0))], ["cluster", "part", "s"])

    # clusters x (dimensions + 2) rows
    found = blocks.select(*_BLOCK).mapInArrow(run, "cluster int, part int, s decimal(38,0)").groupBy("cluster", "part").agg(F.sum("s").alias("s"))
    return {(r.cluster, r.part): int(r.s) for r in found.collect()}


def first_centroids(vectors: DataFrame, k: int, seed: int, width: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> list[list[int]]:
    """The ``k`` usable vectors whose ids have the smallest hashes, as integers, in the order of the hashes."""
    good = vectors.filter(usable(F.col(vector), width))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(vec_id).cast("string"), F.lit(""))), 256)
    rows = good.select(hashed.alias("h"), F.col(vector).cast("array<double>").alias("v")).orderBy("h", "v").limit(k).collect()
    return [[max(-CLIP, min(CLIP, int(np.floor(x * scale)))) if abs(x) * scale < CLIP else (CLIP if x > 0 else -CLIP) for x in r.v] for r in rows]


def fit(blocks: DataFrame, centroids: list[list[int]], rounds: int) -> Model:
    """Rounds of assignment to the nearest centroid and replacement by the floor of the mean, from ``centroids`` on."""
    history = []
    for left in range(rounds, -1, -1):
        found = _round(blocks, centroids) if centroids else {}
        inertia = [found.get((k, _DISTANCE), 0) for k in range(len(centroids))]
        history.append(sum(inertia))
        if left:
            centroids = [[found[k, d] // found[k, _N] for d in range(len(c))] if (k, _N) in found else c for k, c in enumerate(centroids)]
    return Model(centroids, inertia, history)


def assigned(blocks: DataFrame, model: Model) -> DataFrame:
    """vec_id, cluster and distance (squared) of every packed vector."""
    centroids = model.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(centroids, object)
        for b in batches:
            for ids, *row in zip(*(c.to_pylist() for c in b.columns)):
                best, distance = _Block(*row).nearest(at)
                if distance.dtype == object:
                    distance = np.minimum(distance, LONG).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return blocks.select("ids", *_BLOCK).mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    shipped(vectors.sparkSession)
    blocks = written(packed(vectors, width, scale), "blocks")
    model = fit(blocks, first_centroids(vectors, k, seed, width, scale), rounds)
    per = F.array(*[F.lit(min(i, LONG)).cast("long") for i in model.inertia] or [F.lit(0).cast("long")])
    digests = F.array(*[F.lit(d) for d in model.digests()] or [F.lit("")])
    at = F.col("cluster") + 1
    return assigned(blocks, model).select("vec_id", "cluster", "distance", F.element_at(per, at).alias("cluster_inertia"), F.lit(min(sum(model.inertia), LONG)).cast("long").alias("inertia"), F.element_at(digests, at).alias("centroid_sha256"))


def sql(k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, scale: int = 1024) -> str:
    """The same rows in SQL, for ids that do not repeat."""
    dims = f"range(1, {width + 1})"
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k, x FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})"]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v.x, min(list_sum(list_transform({dims}, lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) * {k} + c.k) AS best FROM v CROSS JOIN c{r} c GROUP BY vec_id, v.x)")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM
 (SELECT best % {k} AS k, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, unnest({dims}) AS d(i) GROUP BY ALL) GROUP BY k) m ON m.k = c.k)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(best % {k} AS INT) AS cluster, CAST(best // {k} AS BIGINT) AS distance, CAST(sum(best // {k}) OVER (PARTITION BY best % {k}) AS BIGINT) AS cluster_inertia,
 CAST(sum(best // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON c.k = best % {k}"""
