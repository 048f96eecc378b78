"""Exact integer k-means with Hamerly's bounds (operator 12).

Components become integers, so assignments, centroids and inertia are exact and alike on any cluster.  Each vector
carries its centroid, one upper bound of the distance to it and one lower bound of the distance to all others.  After
the centroids move, the upper bound grows by the drift of its own centroid and the lower one shrinks by the largest drift of
another.  A vector whose upper bound is strictly below the lower one, or below half the way to the nearest other centroid,
keeps its centroid; else its upper bound is made tight by one exact distance, and if that does not decide either, all
centroids are scanned in integers.  Bounds are doubles that are rounded away from the decision, so that ties always get the scan.

The state (vector, centroid, bounds) is a table in the shared folder that each round reads once and writes once, in
tasks of the same rows: nothing is exchanged but a row of sums for each centroid and task.  The driver holds the
centroids alone, ``k`` times the dimension.

Defined cases: vectors that are null, of another length, or with a null, NaN or infinite component are left out; a component
beyond ``LIMIT`` counts as that bound, so that squared distances fit in a long; repeated rows are vectors
of their own, and so are rows with a null id, which start no centroid while others can; fewer vectors than ``k`` make as
many centroids; without vectors there are no rows; extra columns are ignored; a sum beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import bounded, materialise, release

#: Components are x times this, rounded down.
SCALE = 64
#: The largest integer of a component: 64 squares of twice this fit in a long.
LIMIT = 1 << 27
#: Bounds move this part of themselves away from a decision.
SLACK = 1e-9
STATE = "vec_id long, v array<int>, cluster int, upper double, lower double, scans int, distance long"


def integers(embeddings: DataFrame, dimension: int) -> DataFrame:
    """(vec_id, v) of the whole vectors, as integers."""
    e = F.col("embedding")
    whole = (F.size(e) == dimension) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    part = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double"), F.lit(2.0**40)), F.lit(-(2.0**40))) * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    return embeddings.filter(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform(e, part).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id; rows of one id in the order of their components."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


@dataclass
class Round:
    """Centroids and how far each has moved since the last assignment."""

    centroids: np.ndarray
    drift: np.ndarray

    def half_gap(self) -> np.ndarray:
        """For each centroid, half the distance to the nearest other, rounded down."""
        c = self.centroids.astype(np.float64)
        gap = np.sqrt(((c[:, None, :] - c[None, :, :]) ** 2).sum(-1))
        np.fill_diagonal(gap, np.inf)
        return gap.min(1) / 2 * (1 - SLACK)

    def other_drift(self) -> np.ndarray:
        """For each centroid, the largest drift of another."""
        if len(self.drift) == 1:
            return np.zeros(1)
        order = np.argsort(self.drift)
        out = np.full(len(self.drift), self.drift[order[-1]])
        out[order[-1]] = self.drift[order[-2]]
        return out


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def assign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, now: Round) -> tuple[np.ndarray, ...]:
    """(cluster, upper, lower, whether all centroids were scanned) after a move of the centroids; all arrays are new.

    A cluster of -1 has no bounds yet.
    """
    half, other = now.half_gap(), now.other_drift()
    cluster, known = cluster.copy(), cluster >= 0
    own = np.where(known, cluster, 0)
    upper = np.where(known, (upper + now.drift[own]) * (1 + SLACK), np.inf)
    lower = np.where(known, (lower - other[own]) * (1 - SLACK) - SLACK, -np.inf)
    bar = np.maximum(lower, half[own])
    unsure = np.flatnonzero(~(known & (upper < bar)))
    tight = unsure[known[unsure]]
    upper[tight] = np.sqrt(squared(v[tight], now.centroids[cluster[tight]])) * (1 + SLACK)
    scan = unsure[~(known[unsure] & (upper[unsure] < bar[unsure]))]
    if len(scan):
        d = np.stack([squared(v[scan], c) for c in now.centroids], 1)
        best = d.argmin(1)  # the first of equals
        rows = np.arange(len(scan))
        cluster[scan], upper[scan] = best, np.sqrt(d[rows, best]) * (1 + SLACK)
        d[rows, best] = np.iinfo(np.int64).max
        lower[scan] = np.sqrt(d.min(1)) * (1 - SLACK)
    scanned = np.zeros(len(v), dtype=bool)
    scanned[scan] = True
    return cluster, upper, lower, scanned


def _pass(now: Round, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.int64)
            at = {n: b[n].to_numpy(zero_copy_only=False) for n in ("cluster", "upper", "lower", "scans")}
            cluster, upper, lower, scanned = assign(v, at["cluster"], at["upper"], at["lower"], now)
            distance = squared(v, now.centroids[cluster]) if last else np.zeros(len(v), dtype=np.int64)
            columns = [b["vec_id"], b["v"], cluster.astype(np.int32), upper, lower, at["scans"] + scanned.astype(np.int32), distance]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["vec_id", "v", "cluster", "upper", "lower", "scans", "distance"])

    return run


def _sums(state: DataFrame, k: int, dimension: int) -> dict[int, tuple[int, list[int]]]:
    """Rows and sums of components of each centroid's vectors."""
    parts = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dimension)]
    return {r["cluster"]: (r["n"], [r[f"s{i}"] for i in range(dimension)]) for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *parts).collect()}


def moved(now: Round, sums: dict[int, tuple[int, list[int]]]) -> Round:
    """Every non-empty centroid becomes the mean of its vectors, rounded down."""
    new = now.centroids.copy()
    for c, (n, s) in sums.items():
        new[c] = [x // n for x in s]
    return Round(new, np.sqrt(((new - now.centroids).astype(np.float64) ** 2).sum(1)) * (1 + SLACK))


def kmeans(embeddings: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dimension: int = 64) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, upper, lower, scans, distance) of every kept vector after the rounds, and the centroids.

    ``scans`` is how often all centroids were scanned for the vector, of ``rounds`` + 1 assignments.
    """
    vectors = bounded(integers(embeddings, dimension))
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], STATE), centroids
    now = Round(centroids, np.zeros(len(centroids)))
    state = vectors.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(float("-inf")).alias("lower"), F.lit(0).alias("scans"), F.lit(0).cast("long").alias("distance"))
    for r in range(rounds + 1):
        after = materialise(state.mapInArrow(_pass(now, r == rounds), STATE), "vectors")
        release(state.sparkSession, state)
        state = after
        if r < rounds:
            now = moved(now, _sums(state, k, dimension))
    return state, now.centroids


def report(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans) of every vector."""
    fits = lambda n: n if n < 1 << 63 else None
    sums = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    facts = [(i, fits(sums.get(i, 0)), fits(sum(sums.values())), ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())]
    named = state.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, components string")
    joined = state.join(F.broadcast(named.withColumn("centroid_sha256", F.sha2("components", 256))), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")


def _sql(k: int, rounds: int, seed: int, dimension: int) -> str:
    """The same assignments in SQL, for small tables: every vector meets every centroid in every round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (SELECT v.r, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} c USING (i) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT r, cluster, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""
m{r} AS MATERIALIZED (SELECT a.cluster, v.i, sum(v.x) AS s, count(*) AS n FROM a{r} a JOIN v USING (r) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, c.i, CASE WHEN m.n IS NULL THEN c.x ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster, i))""")
    return f"""
WITH e AS MATERIALIZED (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, unnest(range(1, {dimension + 1})) AS i, unnest(v) AS x FROM e),
c0 AS MATERIALIZED (
  SELECT cluster, unnest(range(1, {dimension + 1})) AS i, unnest(v) AS x
  FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS cluster FROM e) WHERE cluster < {k}),{",".join(steps)},
h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT e.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{rounds} a JOIN e USING (r) JOIN h USING (cluster)
"""


SQL = _sql(16, 3, 1, 64)
