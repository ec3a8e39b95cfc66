"""Nearest neighbours by collision counting over query-centred windows.

Every vector is projected on a fixed set of random directions; a shard keeps one
sorted array per direction.  A query opens a window around its own projection
in each array and widens all of them step by step (virtual rehashing: wider
windows stand for larger radii, nothing is built again).  A vector that falls
into enough windows is verified by its true distance.  The search ends when the
k-th best distance is below the radius that the windows stand for, or when the
windows hold the whole shard, so that a query always gets k neighbours if
there are as many.

Shards are cut by a hash of the id, so equal vectors spread evenly; queries visit
all shards, and only k rows a query and shard move on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shared import stage

#: Random directions, half width of a window in radii, and share of windows that make a candidate.
#: A point within the radius falls into a window with probability 0.73.
DIRECTIONS, HALF_WIDTH, SHARE = 48, 1.1, 0.55
#: Factor by which windows grow.
GROWTH = 1.2
#: Most vectors in a shard.
SHARD = 1 << 18
SEED = 11


def shards_for(n: int) -> int:
    """Shards of about 16 times the square root of n vectors, and not more than SHARD."""
    return max(1, int(np.ceil(np.sqrt(n) / 16)), -(-n // SHARD))


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((DIRECTIONS, dim))


class Index:
    """Sorted projections of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.directions = directions(vectors.shape[1])
        projected = self.directions @ self.vectors.T.astype(np.float64)
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        # All arrays in one, each moved beyond the one before: one search serves all directions.
        self.least = self.sorted[:, 0].copy()
        self.gap = float((self.sorted[:, -1] - self.least).max()) + 1.0
        self.move = 2 * self.gap * np.arange(len(self.least))
        self.flat = (self.sorted - self.least[:, None] + self.move[:, None]).ravel()
        self.flat_order = self.order.ravel()
        self.start = self._start()

    def _start(self) -> float:
        """A first radius: half the least distance between different vectors of an even sample."""
        some = self.vectors[:: max(1, len(self.ids) // 256)].astype(np.float64)
        best = np.inf
        for v in some[:64]:
            d = np.sqrt(((some - v) ** 2).sum(axis=1))
            d = d[d > 0]
            best = min(best, d.min()) if len(d) else best
        return best / 2 if np.isfinite(best) else 1.0

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and distances of the k nearest, ties to the smaller id."""
        n, m = self.sorted.shape[1], len(self.directions)
        center = self.directions @ query - self.least
        need = int(np.ceil(SHARE * m))
        counts = np.zeros(n, dtype=np.int64)
        first = n * np.arange(m)  # where each direction begins in the joined arrays

        def edges(shift: float, side: str) -> np.ndarray:
            inside = np.clip(center + shift, -0.5, self.gap) + self.move
            return np.clip(np.searchsorted(self.flat, inside, side), first, first + n)

        low = edges(0.0, "left")
        high = low.copy()
        verified = self.ids == query_id
        ids, distances = np.zeros(0, np.int64), np.zeros(0)
        radius = self.start
        while True:
            half = HALF_WIDTH * radius
            a, b = edges(-half, "left"), edges(half, "right")
            a, b = np.minimum(a, low), np.maximum(b, high)
            spans = [*zip(a.tolist(), low.tolist()), *zip(high.tolist(), b.tolist())]
            met = [self.flat_order[x:y] for x, y in spans if x < y]
            if met:
                counts += np.bincount(np.concatenate(met), minlength=n)
            low, high = a, b
            if not np.isfinite(half):  # components beyond what projections can hold: verify all that is left
                counts[:] = m
            new = np.flatnonzero((counts >= need) & ~verified)
            if len(new):
                verified[new] = True
                d = np.sqrt(((self.vectors[new].astype(np.float64) - query) ** 2).sum(axis=1))
                ids, distances = np.concatenate([ids, self.ids[new]]), np.concatenate([distances, d])
                best = np.lexsort((ids, distances))[:k]
                ids, distances = ids[best], distances[best]
            if len(ids) == k and distances[-1] <= radius:
                break
            if verified.all():
                break
            radius *= GROWTH
        return ids, distances


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of rows that take part, one for each id (of several, the smallest vector).

    Out: NULL ids, NULL, empty and all-zero vectors, vectors with NULL, NaN or infinite components.
    """
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        .filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
        .filter(~odd & F.exists("vector", lambda x: x != 0))
        .groupBy("id")
        .agg(F.min("vector").alias("vector"))
    )


def nearest(
    vectors: DataFrame, query_ids: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), the neighbour's id and score (Euclidean distance) for every query.

    ``query_ids``: SQL condition on ``id`` that says which vectors are queries.
    Only vectors of equal length are neighbours.  Fewer than k candidates: all of
    them; none: no row.
    """
    rows = stage(valid_vectors(vectors, id_col, vector_col), "vectors")
    shards = shards_for(rows.count())
    dim = F.size("vector").alias("dim")
    members = rows.select(
        dim, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "vector"
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asked = rows.filter(query_ids).select(dim, every, F.lit(True).alias("asks"), "id", "vector")
    dealt = members.unionByName(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks", "id")

    def run(batches):
        now, ids, parts, index = None, [], [], None
        for batch in batches:
            dims, shard = batch.column("dim").to_numpy(), batch.column("shard").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            keys = batch.column("id").to_numpy()
            vector = batch.column("vector")
            changes = (np.diff(dims) != 0) | (np.diff(shard) != 0) | (np.diff(asks.astype(np.int8)) != 0)
            cuts = np.flatnonzero(changes) + 1
            out = []
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
                if a == b:
                    continue
                if (dims[a], shard[a]) != now:
                    now, ids, parts, index = (dims[a], shard[a]), [], [], None
                block = vector.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, dims[a])
                if not asks[a]:
                    ids.append(keys[a:b])
                    parts.append(block)
                    continue
                if index is None and ids:
                    index, parts = Index(np.concatenate(ids), np.concatenate(parts)), []
                for q, v in zip(keys[a:b], block) if index is not None else ():
                    found, distances = index.search(q, v, k)
                    out.append((np.full(len(found), q), found, distances))
            if out:
                q, i, d = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(d)], names=["query_id", "id", "score"])

    found = dealt.mapInArrow(run, "query_id long, id long, score double")
    ranked = Window.partitionBy("query_id").orderBy("score", "id")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
