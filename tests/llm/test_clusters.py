"""Hamerly's k-means (operator 12) against full scans."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import clusters


def brute(rows, k, rounds, seed=1):
    """[(id, cluster, distance)] by full scans in Python integers."""
    import math

    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            if own := [v for (_, v), a in zip(kept, at, strict=True) if a == j]:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((i, *near(v)[::-1]) for i, v in kept), centres


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize(("n", "spread"), [(400, 0.02), (300, 1.0)])
def test_whole_runs_equal_full_scans(spark, n, spread):
    r = np.random.default_rng(n)
    middle = r.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in middle[i % 6] + r.normal(size=8) * spread]) for i in range(n)]
    rows += [(i + n, rows[i][1]) for i in range(20)]  # equal vectors
    state, centres = clusters.kmeans(table(spark, rows), k=5, rounds=6, dimension=8)
    got = sorted((x["vec_id"], x["cluster"], x["distance"]) for x in state.collect())
    want, want_centres = brute(rows, 5, 6)
    assert got == want and centres.tolist() == want_centres
    scans = state.agg(F.avg("scans")).first()[0]
    assert scans < (2.5 if spread < 0.1 else 7)  # of seven assignments


def test_ties_go_to_the_smaller_number():
    now = clusters.Round(np.array([[0, 0], [4, 0], [4, 0]]), np.zeros(3))
    v = np.array([[2, 0], [4, 0], [3, 0]])
    # bounds that touch are no reason to keep a centroid
    cluster, upper, lower, scanned = clusters.assign(v, np.array([1, 2, -1]), np.array([2.0, 0.0, np.inf]), np.array([2.0, 0.0, -np.inf]), now)
    assert cluster.tolist() == [0, 1, 1] and scanned.all()
    assert (upper >= np.array([2, 0, 1])).all() and (lower <= np.array([2, 0, 1])).all()


def test_bounds_hold_over_rounds():
    r = np.random.default_rng(5)
    v = r.integers(-50, 50, size=(500, 4))
    now = clusters.Round(v[:7].copy(), np.zeros(7))
    cluster, upper, lower = np.full(500, -1), np.full(500, np.inf), np.full(500, -np.inf)
    skipped = 0
    for _ in range(8):
        cluster, upper, lower, scanned = clusters.assign(v, cluster, upper, lower, now)
        skipped += (~scanned).sum()
        d = np.sqrt(((v[:, None] - now.centroids[None]) ** 2).sum(-1))
        assert cluster.tolist() == d.argmin(1).tolist() and (upper >= d.min(1)).all() and (lower <= np.sort(d, 1)[:, 1]).all()
        sums = {j: (int((cluster == j).sum()), v[cluster == j].sum(0).tolist()) for j in range(7) if (cluster == j).any()}
        now = clusters.moved(now, sums)
    assert skipped > 500


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5]), (1, [0.5, -0.5]), (None, [2.0, 2.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [nan, 0.0]), (7, [inf, 0.0]), (8, []), (9, [3e38, -3e38]), (10, [-0.001, 0.0])]
    df = table(spark, rows).withColumn("cluster", F.lit("own")).withColumn("v", F.lit(1)).withColumn("distance", F.lit(None))
    out = clusters.report(*clusters.kmeans(df, dimension=2)).collect()
    assert sorted((r["vec_id"] or 0) for r in out) == [0, 1, 1, 9, 10] and len({r["cluster"] for r in out}) == 4
    assert {r["distance"] for r in out} == {0} and {r["inertia"] for r in out} == {0}
    top = f"{clusters.LIMIT},{-clusters.LIMIT}"
    assert hashlib.sha256(top.encode()).hexdigest() in {r["centroid_sha256"] for r in out}


def test_floor_of_negative_means():
    now = clusters.Round(np.array([[0, 0]]), np.zeros(1))
    assert clusters.moved(now, {0: (2, [-3, 3])}).centroids.tolist() == [[-2, 1]]


def test_empty_table(spark):
    state, centres = clusters.kmeans(table(spark, []))
    assert clusters.report(state, centres).count() == 0
