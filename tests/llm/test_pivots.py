"""Centroid clustering against a full search in plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np

from auditloom.llm import pivots

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance string, v string, near string, _x int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", "c", 2) for i, v in rows], SCHEMA)


def plain(rows, k, rounds, dimensions, seed=2):
    kept = [(i, [max(-2**62, min(2**62, math.floor(256.0 * x) if abs(256.0 * x) < INF else (2**62 if x > 0 else -2**62))) for x in v], v) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), x, v) for i, v, x in kept)[:k]
    centroids = [v for _, _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v, _ in kept]
    for _ in range(rounds):
        of = assign()
        for j in range(len(centroids)):
            own = [v for (_, v, _), (_, c) in zip(kept, of) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    of, top = assign(), 2**63 - 1
    each = {j: sum(min(d, top) for d, c in of if c == j) for j in range(len(centroids))}
    return [(i, c, min(d, top), min(each[c], top), min(sum(each.values()), top), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
            for (i, _, _), (d, c) in zip(kept, of)]


def check(spark, rows, k, rounds, dimensions):
    got = [tuple(r) for r in pivots.clusters(frame(spark, rows), k=k, rounds=rounds, dimensions=dimensions, pivots=3).collect()]
    order = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=order) == sorted(plain(rows, k, rounds, dimensions), key=order)


def test_vectors_ties_and_odd_rows(spark):
    r = random.Random(3)
    centre = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, .2) for x in r.choice(centre)]) for i in range(300)]
    rows += [(400 + i, [float(r.randrange(-1, 2)) / 64 for _ in range(6)]) for i in range(60)] + [(5, rows[5][1])] * 3 + [(500, [0.0] * 6)] * 4
    rows += [(600, None), (601, []), (602, [1.0] * 5), (603, [1.0] * 7), (604, [1.0] * 5 + [None]), (605, [1.0] * 5 + [NAN]), (606, [INF] + [0.0] * 5), (None, [.5] * 6)]
    check(spark, rows, 12, 4, 6)


def test_few_and_none(spark):
    check(spark, [(1, [0.1, 0.2]), (2, [0.3, -0.1])], 5, 2, 2)
    empty = pivots.clusters(frame(spark, [(1, None)]))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_numbers_beyond_64_bits(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([1e3, 1e7, 1e12, 3e16, -1e300, 1e300]) * r.random() for _ in range(3)]) for i in range(80)]
    check(spark, rows, 6, 3, 3)


def test_bounds_prune_without_loss():
    r = np.random.default_rng(1)
    centre = r.integers(-400, 400, (20, 16))
    v = centre[r.integers(0, 20, 2000)] + r.integers(-20, 20, (2000, 16))
    fixed = pivots.farthest_first(centre, 8)
    cluster, best, exact = pivots.nearest(v, pivots.roots(v, fixed), centre, pivots.roots(centre, fixed))
    full = ((v[:, None, :] - centre[None]) ** 2).sum(axis=2)
    assert (cluster == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all() and exact < 0.5 * full.size
