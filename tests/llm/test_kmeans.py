"""Clustering with bounds: against plain clustering in whole numbers, and over odd vectors."""

import hashlib
import math

import numpy as np
import pytest

from auditmill.llm import kmeans


def plain(rows, k, rounds, width=64):
    """(vec_id, vector) rows clustered in Python's whole numbers."""
    kept = [(i, [math.floor(256 * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == width and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes()))
    c = [list(x) for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in kept]
        for j in range(len(c)):
            own = [x for (_, x), a in zip(kept, at) if a == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    return sorted(((i, near(x)[1], near(x)[0]) for i, x in kept), key=str), c


def vectors(rng, n, groups):
    """Groups close together, with rows that repeat and components that tie."""
    centres = rng.normal(size=(groups, 64))
    x = centres[rng.integers(groups, size=n)] + rng.normal(size=(n, 64)) * 0.3
    x = np.round(x * 4) / 4
    x[: n // 5] = x[0]
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("seed,n,k", [(1, 400, 40), (2, 300, 7), (3, 30, 40), (4, 5, 1)])
def test_against_plain(spark, seed, n, k):
    rows = vectors(np.random.default_rng(seed), n, 6)
    got, c = kmeans.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), k, 5)
    want, centres = plain(rows, k, 5)
    assert sorted(map(tuple, got.collect()), key=str) == want and c.tolist() == centres


def test_bounds_never_decide_ties():
    """Whatever the bounds leave undecided is scanned; clusters are those of a full scan in every round, and most vectors need none."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(3000, 64)) * 3 + rng.integers(12, size=3000)[:, None] * 40).astype(np.int64)
    c = x[:12].copy()
    at, upper, lower = kmeans.scan(x, c)
    scanned = []
    for step in range(6):
        new = c + (rng.integers(-3, 4, size=c.shape) if step % 2 else 0)
        if step == 3:
            new[5] = new[4]  # two centroids in one place: the smaller number
        drift = np.sqrt(((new - c) ** 2).sum(1).astype(float)) * (1 + kmeans.SLACK) + kmeans.LEAST
        at, upper, lower, n = kmeans.reassign(x, at, upper, lower, new, drift)
        scanned.append(n)
        d = kmeans.squared(x, new)
        assert (at == d.argmin(1)).all()
        real = np.sqrt(np.sort(d, 1).astype(float))
        assert (upper >= real[:, 0]).all() and (lower <= np.sqrt(np.where(np.arange(12) == at[:, None], 1 << 62, d).min(1).astype(float))).all()
        c = new
    assert max(scanned[:3]) < 1500 and scanned[3] > scanned[2]


def test_exact_beyond_doubles():
    x = np.array([[1 << 26] * 64, [-(1 << 26)] * 64, [(1 << 26) - 1] + [1 << 26] * 63], np.int64)
    assert kmeans.squared(x, x).tolist() == [[sum((a - b) ** 2 for a, b in zip(p, q)) for q in x.tolist()] for p in x.tolist()]


def test_odd_vectors(spark):
    one, nan, inf = [0.5] * 64, float("nan"), float("inf")
    rows = [(1, one), (1, one), (None, one), (2, None), (3, []), (4, one[:63]), (5, [*one[:63], nan]), (6, [*one[:63], inf]), (7, [*one[:63], None]), (8, [*one[:63], -inf]), (9, [-0.001] * 64), (10, [1e30] * 64), (11, one + [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "7 as cluster", "'x' as v", "8 as distance", "9 as upper")
    got = kmeans.cluster_table(df, k=3).collect()
    assert sorted((str(r.vec_id) for r in got)) == ["1", "1", "9", "None"]
    want, _ = plain([r for r in rows if r[0] != 10], 3, 5)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want and len({r.inertia for r in got}) == 1
    assert kmeans.cluster_table(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert kmeans.cluster_table(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")).collect() == []
