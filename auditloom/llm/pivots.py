"""Centroid clustering of integer vectors with a pivot table (LAESA).

The distance of every vector to a few fixed pivots is computed once and stored beside its integer components. In each
round the distances of the centroids to the pivots bound all distances from below: ``max_p |d(v, p) - d(c, p)| <= d(v, c)``.
The centroid with the least bound gets the first exact integer distance; centroids whose bound is not above the best exact
distance so far survive and get theirs, all others are never looked at. Ties go to the smaller number, so the result is
that of a full search.

Plan: one ordered top-k finds the first centroids, one map writes the pivot table, each round is one map over that table with
a sum per task and cluster, and the driver only holds k centroids. Nothing is shuffled but these sums.

Defined results: vectors with another number of components, or with a null or non-finite one, are not kept and not returned;
with fewer kept vectors than k there are as many clusters as vectors; equal ids are all clustered, the smaller components come
first among first centroids; a null id is kept (its hash is that of an empty number). Integers beyond 2^62 are set to that
bound; distances and sums beyond 64 bits are returned as the largest 64-bit value, while assignments stay exact. Repeated
vectors may be first centroids together: the smaller number then takes all. Other columns are not read; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.cut import written

DIMENSIONS, CLUSTERS, ROUNDS, PIVOTS, SCALE = 64, 40, 5, 8, 256.0
#: Up to this size of components, squared distances fit 64-bit integers; larger ones are compared as unbounded integers.
SMALL, MOST, LIMIT = 1 << 26, 1 << 62, (1 << 63) - 1
#: Vectors that are bounded and compared together.
BLOCK = 4096


def kept(vectors: DataFrame, id_col: str, vec_col: str, dimensions: int) -> DataFrame:
    """``_id`` and ``_x`` (doubles) of the vectors that take part."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.coalesce((F.size(vec_col) == dimensions) & fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("_id"), x.alias("_x"))


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as 64-bit integers, set to +-2^62 beyond that."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -float(MOST), float(MOST)).astype(np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; plain integers of any size where 64 bits may not do."""
    if max(_reach(v), _reach(c)) <= SMALL:
        d = v - c
        return np.einsum("ij,ij->i", d, d)
    d = v.astype(object) - c.astype(object)
    return (d * d).sum(axis=1) if len(d) else np.zeros(0, object)


def _reach(a: np.ndarray) -> int:
    return max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0))))


def roots(v: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances (rounded square roots) of all vectors to all points."""
    return np.stack([np.sqrt(squared(v, p[None, :]).astype(np.float64)) for p in points], axis=1) if len(points) else np.zeros((len(v), 0))


def bounds(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Squared lower bounds, vectors by centroids, from distances to the pivots; a little less for the rounding of roots."""
    least = np.zeros((len(near), len(far)))
    for p in range(near.shape[1]):
        np.maximum(least, np.abs(near[:, p, None] - far[None, :, p]), out=least)
    slack = 1e-6 + 1e-12 * (near.max(axis=1, initial=0.0)[:, None] + far.max(axis=1, initial=0.0)[None, :])
    return np.maximum(least - slack, 0.0) ** 2


def nearest(v: np.ndarray, near: np.ndarray, centroids: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector, its exact squared distance, and how many exact distances that took."""
    least = bounds(near, far)
    cluster = least.argmin(axis=1)
    best = squared(v, centroids[cluster])
    first, exact = cluster.copy(), len(v)
    for c in range(len(centroids)):
        rows = np.flatnonzero((least[:, c] <= best.astype(np.float64)) & (first != c))
        if not len(rows):
            continue
        exact += len(rows)
        d = squared(v[rows], centroids[c][None, :])
        better = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
        cluster[rows[better]] = c
        if best.dtype != d.dtype:
            best, d = best.astype(object), d.astype(object)
        best[rows[better]] = d[better]
    return cluster, best, exact


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """_id, integer components, distances to the pivots."""
    dimensions = pivots.shape[1]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = whole(_matrix(b.column("_x"), dimensions, np.float64))
            near = roots(v, pivots)
            lists = (pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel())) for m in (v, near))
            yield pa.RecordBatch.from_arrays([b.column("_id"), *lists], ["_id", "v", "near"])
    return rows.mapInArrow(store, "_id long, v array<long>, near array<double>")


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """At most n distinct points, each the farthest from those before it."""
    chosen, gap = [0], squared(points, points[0][None, :])
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, squared(points, points[chosen[-1]][None, :]))
    return points[chosen]


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int, pivots: int):
    for batch in batches:
        for s in range(0, batch.num_rows, BLOCK):
            b = batch.slice(s, BLOCK)
            yield b, _matrix(b.column("v"), dimensions, np.int64), _matrix(b.column("near"), pivots, np.float64)


def summed(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of each non-empty cluster: one row per task and cluster, then one per cluster."""
    k, dimensions = centroids.shape
    far = roots(centroids, pivots)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), object)
        for _, v, near in _blocks(batches, dimensions, len(pivots)):
            cluster, _, _ = nearest(v, near, centroids, far)
            count += np.bincount(cluster, minlength=k)
            exact = v if _reach(v) <= MOST // BLOCK else v.astype(object)
            for c in np.unique(cluster):
                total[c] += exact[cluster == c].sum(axis=0).astype(object)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(count[some], pa.int64()),
             pa.array([[Decimal(int(x)) for x in total[c]] for c in some], pa.list_(pa.decimal128(38, 0)))], ["cluster", "n", "s"])

    sums = table.mapInArrow(add, "cluster int, n long, s array<decimal(38,0)>").groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(dimensions)])
    return {r["cluster"]: (int(r["n"]), [int(r[f"s{j}"]) for j in range(dimensions)]) for r in sums.collect()}


def assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """_id, cluster, distance (squared, at most 2^63 - 1) of every vector."""
    dimensions, far = centroids.shape[1], roots(centroids, pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, v, near in _blocks(batches, dimensions, len(pivots)):
            cluster, best, _ = nearest(v, near, centroids, far)
            best = np.minimum(best, LIMIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(cluster, pa.int32()), pa.array(best, pa.int64())], ["_id", "cluster", "distance"])
    return table.mapInArrow(assign, "_id long, cluster int, distance long")


def clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
             seed: int = 2, dimensions: int = DIMENSIONS, pivots: int = PIVOTS) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector after ``rounds`` rounds.

    The first centroids are the k vectors with the least hash of ``<seed>:<id>``; at most k rows come to the driver, and k
    sums a round.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, id_col, vec_col, dimensions)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.select(name.alias("_name"), "_x").orderBy("_name", "_x").limit(k).collect()
    result = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], result)
    centroids = whole(np.array([r["_x"] for r in first], np.float64))
    fixed = farthest_first(centroids, pivots)
    table = written(pivot_table(rows, fixed))
    for _ in range(rounds):
        centroids = centroids.copy()
        for c, (n, s) in summed(table, centroids, fixed).items():
            centroids[c] = [x // n for x in s]
    done = written(assigned(table, centroids, fixed))
    each = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    every = min(LIMIT, sum(int(r["d"]) for r in each))
    facts = spark.createDataFrame([(r["cluster"], min(LIMIT, int(r["d"])), every, hashlib.sha256(
        ",".join(str(int(x)) for x in centroids[r["cluster"]]).encode()).hexdigest()) for r in each],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per cluster: at most k.
    return done.join(F.broadcast(facts), "cluster").select(F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 2, dimensions: int = DIMENSIONS) -> str:
    """The same result by full search, over ``embeddings``."""
    steps = [f"""v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})""",
             f"x AS (SELECT r, unnest(range({dimensions})) AS j, unnest(v) AS x FROM v)",
             f"""c0 AS (SELECT c, unnest(range({dimensions})) AS j, unnest(v) AS y FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c FROM v) WHERE c < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT r, min(d * 1000 + c) AS m FROM (SELECT r, c, CAST(sum((x - y) * (x - y)) AS HUGEINT) AS d FROM x JOIN c{i} USING (j) GROUP BY r, c) GROUP BY r)")
        if i < rounds:
            steps.append(f"""c{i + 1} AS (SELECT o.c, o.j, coalesce((s - ((s % n) + n) % n) // n, o.y) AS y FROM c{i} o LEFT JOIN (
 SELECT a.m % 1000 AS c, j, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM x JOIN a{i} a USING (r) GROUP BY 1, 2) g ON g.c = o.c AND g.j = o.j)""")
    return "WITH " + ",\n".join(steps) + f""",
h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY j)) AS sha FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(m % 1000 AS INTEGER) AS cluster, CAST(m // 1000 AS BIGINT) AS distance,
       CAST(sum(m // 1000) OVER (PARTITION BY m % 1000) AS BIGINT) AS cluster_inertia, CAST(sum(m // 1000) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN h ON h.c = m % 1000"""
