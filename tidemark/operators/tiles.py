"""Distances, volumes and clusters of questions' vectors whose numbers are not bounded.

A question's vectors are dealt into tiles of about ``TILE`` vectors.  Each two tiles of a question meet once, as two matrices of one
row, so that a question of many vectors is many tasks and no task holds more than two tiles.  What comes out of a pair of tiles is a
few numbers, never its distances.

Input tables have question_id, condition (``stale_only`` or ``current_only``), vec_id and ``v``, an array of doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import distances as ds
from tidemark.operators.index import small
from tidemark.shared import forgotten, shuffles_cleaned, written

TILE = 512
#: Intervals of one pass of the search for a median, and its passes: distances are told apart to 2^-36 of the largest.
BINS, PASSES = 4096, 3
#: Squared distances below this part of the vectors' own are taken from differences instead of products.
NEAR = 1e-9


def tiled(v: DataFrame, size: int = TILE, more: tuple[str, ...] = ()) -> DataFrame:
    """(question_id, tile, last, ids, sides, m): a question's vectors in tiles 0 to last; m is a tile's matrix row by row.  Columns of ``more`` are arrays."""
    rows = written(v.select(F.col("question_id").cast("long").alias("question_id"), "vec_id", (F.col("condition") == "stale_only").alias("side"), "v", *more, F.monotonically_increasing_id().alias("row")))
    tiles = rows.groupBy("question_id").agg(F.ceil(F.count("*") / size).alias("tiles"))
    dealt = rows.join(small(tiles), "question_id").withColumn("tile", F.pmod("row", "tiles"))
    each = dealt.groupBy("question_id", "tile").agg((F.first("tiles") - 1).alias("last"), F.sort_array(F.collect_list(F.struct("vec_id", "side", "v", *more))).alias("x"))
    out = written(each.select("question_id", "tile", "last", F.col("x.vec_id").alias("ids"), F.col("x.side").alias("sides"), F.flatten("x.v").alias("m"), *(F.col(f"x.{c}").alias(c) for c in more)))
    forgotten(rows)
    return out


def tile_pairs(tiles: DataFrame) -> DataFrame:
    """Each two tiles of a question once, and each tile with itself."""
    carried = [c for c in tiles.columns if c not in ("question_id", "tile", "last")]
    a = tiles.select("question_id", F.col("tile").alias("i"), F.explode(F.sequence("tile", "last")).alias("j"), *(F.col(c).alias(f"a_{c}") for c in carried))
    b = tiles.select("question_id", F.col("tile").alias("j"), *(F.col(c).alias(f"b_{c}") for c in carried))
    return a.join(b, ["question_id", "j"])


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and y."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    scale = xx[:, None] + yy[None, :]
    d = scale - 2 * (x @ y.T)
    i, j = np.nonzero(d < NEAR * scale)
    d[i, j] = ((x[i] - y[j]) ** 2).sum(1)
    return np.maximum(d, 0)


def _pair(row) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Distances of a pair of tiles, and where the sides xx, yy and xy are among its different pairs."""
    x, y = (np.asarray(m, float).reshape(len(s), -1) for m, s in ((row.a_m, row.a_sides), (row.b_m, row.b_sides)))
    a, b = np.asarray(row.a_sides, bool), np.asarray(row.b_sides, bool)
    once = np.triu(np.ones((len(a), len(b)), bool), 1) if row.i == row.j else np.ones((len(a), len(b)), bool)
    both = a[:, None] == b[None, :]
    return np.sqrt(squares(x, y)), {"xx": once & both & a[:, None], "yy": once & both & ~a[:, None], "xy": once & ~both}


def over_pairs(pairs: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """The rows that ``fn`` makes of each pair of tiles."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                yield pd.DataFrame(list(fn(row)), columns=names)

    return pairs.mapInPandas(run, schema)


def _sides(v: DataFrame) -> DataFrame:
    n = lambda c: F.sum((F.col("condition") == c).cast("double"))
    return v.groupBy(F.col("question_id").cast("long").alias("question_id")).agg(n("stale_only").alias("nx"), n("current_only").alias("ny"))


def energy(v: DataFrame, size: int = TILE) -> DataFrame:
    """(question_id, energy): twice the mean distance between the sides, less those within each (a vector's zero distance to itself counts there)."""

    def sums(row):
        d, at = _pair(row)
        yield row.question_id, *(float(d[at[s]].sum()) for s in ("xx", "yy", "xy"))

    found = over_pairs(tile_pairs(tiled(v, size)), sums, "question_id long, xx double, yy double, xy double").groupBy("question_id").agg(*(F.sum(s).alias(s) for s in ("xx", "yy", "xy")))
    nx, ny = F.col("nx"), F.col("ny")
    value = 2 * F.col("xy") / (nx * ny) - 2 * F.col("xx") / (nx * nx) - 2 * F.col("yy") / (ny * ny)
    return found.join(_sides(v), "question_id").select("question_id", F.greatest(F.lit(0.0), value).alias("energy"))


def _median(pairs: DataFrame) -> DataFrame:
    """(question_id, sigma): the median of a question's positive distances, by histograms that each pass makes finer around the two middle ranks."""

    def spread(row):
        d, at = _pair(row)
        x = d[at["xx"] | at["yy"] | at["xy"]]
        yield row.question_id, int((x > 0).sum()), float(x.max(initial=0))

    known = over_pairs(pairs, spread, "question_id long, n long, top double").groupBy("question_id").agg(F.sum("n").alias("n"), F.max("top").alias("top")).filter("n > 0")
    middle = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.floor((F.col("n") - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("which"), F.floor(F.col("n") / 2).alias("rank"))))
    at = known.select("question_id", F.lit(0.0).alias("lo"), (F.col("top") * (1 + 1e-12)).alias("hi"), middle.alias("m")).select("question_id", "lo", "hi", "m.*")

    def counts(row):
        d, where = _pair(row)
        x = d[where["xx"] | where["yy"] | where["xy"]]
        for which, lo, hi in zip(row.whiches, row.los, row.his, strict=True):
            inside = x[(x > 0) & (x >= lo) & (x < hi)]
            bins = np.minimum(((inside - lo) / (hi - lo) * BINS).astype(int), BINS - 1)
            some, n = np.unique(bins, return_counts=True)
            yield from ((row.question_id, int(which), int(b), int(c)) for b, c in zip(some, n, strict=True))

    for _ in range(PASSES):
        at = written(at)
        asked = at.groupBy("question_id").agg(F.collect_list("which").alias("whiches"), F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))
        found = over_pairs(pairs.join(small(asked), "question_id"), counts, "question_id long, which int, bin int, c long").groupBy("question_id", "which", "bin").agg(F.sum("c").alias("c"))
        # at most BINS rows for a question and rank
        upto = F.sum("c").over(Window.partitionBy("question_id", "which").orderBy("bin"))
        steps = found.withColumn("upto", upto).join(at, ["question_id", "which"]).filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
        width = (F.col("hi") - F.col("lo")) / BINS
        at = steps.select("question_id", "which", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), (F.col("lo") + F.col("bin") * width).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"))
    return at.groupBy("question_id").agg(F.avg((F.col("lo") + F.col("hi")) / 2).alias("sigma"))


def mmd(v: DataFrame, size: int = TILE) -> DataFrame:
    """(question_id, mmd): U-statistic of the RBF kernel, its bandwidth the median of the positive distances of all pairs."""
    pairs = tile_pairs(tiled(v, size))
    sigma = written(_median(pairs))

    def kernels(row):
        d, at = _pair(row)
        k = np.exp(-d * d / max(2 * row.sigma * row.sigma, 1e-12))
        yield row.question_id, *(float(k[at[s]].sum()) for s in ("xx", "yy", "xy"))

    sums = over_pairs(pairs.join(small(sigma), "question_id"), kernels, "question_id long, xx double, yy double, xy double").groupBy("question_id").agg(*(F.sum(s).alias(s) for s in ("xx", "yy", "xy")))
    nx, ny = F.col("nx"), F.col("ny")
    mean = lambda s, n: F.when(n > 0, F.col(s) / n).otherwise(0.0)
    value = mean("xx", nx * (nx - 1) / 2) + mean("yy", ny * (ny - 1) / 2) - 2 * mean("xy", nx * ny)
    return sums.join(_sides(v), "question_id").select("question_id", F.greatest(F.lit(0.0), value).alias("mmd"))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=x.copy(), where=n > 0)


#: Cells whose sums of products a task holds before it passes them on.
CELLS = 256


def volumes(v: DataFrame, dim: int = 10, eps: float = 1e-10) -> DataFrame:
    """(question_id, condition, volume): sum of ln(s^2 + eps) over the leading singular values s of a cell's centred unit vectors.

    The squares of the singular values are the eigenvalues of the sum of outer products, less that of the mean; these sums are made in each
    task, entry by entry added up by an aggregate, and taken apart as one matrix of dimension x dimension a cell.
    """

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(q, c, z.shape[0], z.ravel()) for (q, c), z in held.items()], columns=["question_id", "condition", "side", "z"])
            held.clear()
            return out

        for b in batches:
            for key, g in b.groupby(["question_id", "condition"]):
                x = _unit(np.stack(g["v"].to_list()).astype(float))
                # the last row and column hold the sums and the number
                x = np.concatenate([x, np.ones((len(x), 1))], 1)
                held[key] = held.get(key, 0) + x.T @ x
                if len(held) >= CELLS:
                    yield rows()
        if held:
            yield rows()

    parts = v.select(F.col("question_id").cast("long").alias("question_id"), "condition", "v").mapInPandas(products, "question_id long, condition string, side int, z array<double>")
    entries = parts.select("question_id", "condition", "side", F.posexplode("z").alias("i", "x")).groupBy("question_id", "condition", "side", "i").agg(F.sum("x").alias("x"))
    whole = entries.groupBy("question_id", "condition", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("z"))

    def logs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for q, c, side, z in zip(b["question_id"], b["condition"], b["side"], b["z"], strict=True):
                z = np.asarray(z, float).reshape(side, side)
                n, s = z[-1, -1], z[-1, :-1]
                k = min(dim, int(round(n)) - 1, side - 1)
                w = np.sort(np.linalg.eigvalsh(z[:-1, :-1] - np.outer(s, s) / n))[::-1][:k] if k > 0 else np.zeros(0)
                out.append((q, c, float(np.log(np.maximum(w, 0) + eps).sum())))
            yield pd.DataFrame(out, columns=["question_id", "condition", "volume"])

    return whole.mapInPandas(logs, "question_id long, condition string, volume double")


def sliced(v: DataFrame, projections: int = 128, seed: int = 42) -> DataFrame:
    """(question_id, swd): mean distance of the quantile functions of both sides over random projections; 0 where a side is empty.

    Projections are rows.  Their places come from one sort by ranges of (question, projection, side, value), with a running count over
    tasks; each value of the larger side meets the two values of the other that its level lies between.
    """

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = None
        for b in batches:
            if not b.num_rows:
                continue
            x = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if w is None:
                w = np.random.default_rng(seed).normal(size=(projections, x.shape[1]))
                w /= np.linalg.norm(w, axis=1, keepdims=True) + 1e-12
            of = pa.array(np.repeat(np.arange(b.num_rows), projections))
            yield pa.RecordBatch.from_arrays([b["question_id"].take(of), b["side"].take(of), pa.array(np.tile(np.arange(projections, dtype=np.int32), b.num_rows)), pa.array((x @ w.T).ravel())], names=["question_id", "side", "projection", "x"])

    rows = v.select(F.col("question_id").cast("long").alias("question_id"), (F.col("condition") == "stale_only").alias("side"), "v").mapInArrow(project, "question_id long, side boolean, projection int, x double")
    group = ["question_id", "projection", "side"]
    dealt = written(rows).withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*group, "x", "salt").sortWithinPartitions(*group, "x")
    placed = written(dealt.select(*group, "x", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    spans = placed.groupBy(*group, "part").agg(F.min("row").alias("first"), F.count("*").alias("c"))
    before = spans.withColumn("base", F.coalesce(F.sum("c").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = written(placed.join(small(written(before.drop("c"))), [*group, "part"]).select(*group, "x", (F.col("row") - F.col("first") + F.col("base")).alias("rank")))
    sizes = v.groupBy(F.col("question_id").cast("long").alias("question_id")).agg(F.count_if(F.col("condition") == "stale_only").alias("nx"), F.count_if(F.col("condition") != "stale_only").alias("ny"))
    sized = ranked.join(small(written(sizes)), "question_id").filter("nx > 0 and ny > 0").withColumn("large", (F.col("nx") >= F.col("ny")) == F.col("side"))
    small_side = sized.filter(~F.col("large")).select("question_id", "projection", F.col("rank").alias("lo"), F.col("x").alias("y"))
    nexts = small_side.select("question_id", "projection", (F.col("lo") - 1).alias("lo"), F.col("y").alias("next"))
    steps = small_side.join(nexts, ["question_id", "projection", "lo"], "left")
    n, m = F.greatest("nx", "ny"), F.least("nx", "ny")
    level = F.when(n > 1, F.col("rank") * (m - 1) / (n - 1)).otherwise(0.0)
    large = sized.filter("large").select("question_id", "projection", "x", level.alias("at")).withColumn("lo", F.floor(F.col("at") + 1e-12))
    met = large.join(steps, ["question_id", "projection", "lo"])
    y = F.col("y") + F.coalesce(F.col("next") - F.col("y"), F.lit(0.0)) * F.greatest(F.col("at") - F.col("lo"), F.lit(0.0))
    found = met.groupBy("question_id").agg(F.avg(F.abs(F.col("x") - y)).alias("swd"))
    return sizes.select("question_id").join(found, "question_id", "left").withColumn("swd", F.coalesce("swd", F.lit(0.0)))


def _units(v: DataFrame) -> DataFrame:
    """(question_id, vec_id, v) with vectors of length one; a zero vector as it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(v=list(_unit(np.stack(b["v"].to_list()).astype(float)))) if len(b) else b

    return v.select(F.col("question_id").cast("long").alias("question_id"), "vec_id", "v").mapInPandas(run, "question_id long, vec_id long, v array<double>")


def _merged(ids: np.ndarray, sums: np.ndarray, sizes: np.ndarray, most: float) -> dict[int, int]:
    """Of clusters in one task: whom each is part of in the end; the two nearest are joined while they are nearer than ``most``.

    ids are in order.  Each cluster's nearest one is kept, and looked for again only where that one was joined.
    """
    into, sizes = {int(i): int(i) for i in ids}, sizes.astype(float)
    means = sums / sizes[:, None]
    d = means @ means.T
    np.subtract(1, d, out=d)
    np.fill_diagonal(d, np.inf)
    near = d.argmin(1)
    far = d[np.arange(len(ids)), near]
    for _ in range(len(ids) - 1):
        i = int(far.argmin())
        if far[i] >= most:
            break
        a, b = sorted((i, int(near[i])))
        row = (sizes[a] * d[a] + sizes[b] * d[b]) / (sizes[a] + sizes[b])
        row[[a, b]] = np.inf
        d[a], d[:, a], d[b], d[:, b] = row, row, np.inf, np.inf
        sizes[a] += sizes[b]
        into[int(ids[b])] = int(ids[a])
        far[b] = np.inf
        lost = np.flatnonzero((near == a) | (near == b))
        closer = (row < far) | ((row == far) & (near > a))
        far[closer], near[closer] = row[closer], a
        for k in {a, *lost.tolist()} - {b}:
            near[k] = d[k].argmin()
            far[k] = d[k, near[k]]

    def root(i: int) -> int:
        while into[i] != i:
            i = into[i]
        return i

    return {i: root(i) for i in into}


#: Rows of a tile that meet the other tile at once.
MEET = 256


def _nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, others: np.ndarray, most: float, both: bool) -> Iterator[tuple[int, float, int]]:
    """(cluster, far, other): the nearest of ``others`` to each of ids, and with ``both`` the other way round, where it is nearer than ``most``.

    ids are in order within a tile, so the first of equals is the smallest.  Only what is near enough is looked at beyond its product.
    """
    far_other, of_other = np.full(len(others), np.inf), np.zeros(len(others), int)
    for at in range(0, len(ids), MEET):
        d = x[at : at + MEET] @ y.T
        near = np.subtract(1, d, out=d) < most
        near &= ids[at : at + MEET, None] != others[None, :]
        for r in np.flatnonzero(near.any(1)).tolist():
            k = np.flatnonzero(near[r])
            far = d[r, k]
            first = far.argmin()
            yield int(ids[at + r]), float(far[first]), int(others[k[first]])
            if both:
                closer = far < far_other[k]
                far_other[k[closer]], of_other[k[closer]] = far[closer], ids[at + r]
    yield from ((int(others[k]), float(far_other[k]), int(of_other[k])) for k in np.flatnonzero(far_other < most).tolist())


#: Clusters of a tile of average linkage; a question of twice as many is finished in one task.
LINKED = 2048


def average_linkage(v: DataFrame, similarity: float = 0.82, size: int = LINKED) -> DataFrame:
    """(question_id, vec_id, cluster): average-linkage clusters by cosine, merged while their mean distance is below 1 - similarity.

    The mean distance of two clusters is one less the product of their mean unit vectors, so a cluster is the sum of its vectors and their
    number; equal vectors are one from the start.  In each round clusters find their nearest one over pairs of tiles, and those that are each
    other's nearest are merged, which for average linkage gives what merging the nearest two one by one gives.  What two clusters become is
    no nearer to a third than the nearer of them was: a cluster keeps its nearest one until that is merged, and one that has none near enough
    is done.  A question of up to two tiles of clusters is finished in one task.  A cluster is named by its smallest vec_id; equal distances
    go to the smaller name.
    """
    most, key = 1 - similarity, ["question_id", "cluster"]
    units = written(_units(v))
    # a zero vector is far from its copies, too
    zero = F.when(F.exists("v", lambda x: x != 0), 0).otherwise(F.col("vec_id") + 1)
    sets = written(units.groupBy("question_id", "v", zero.alias("zero")).agg(F.min("vec_id").alias("cluster"), F.count("*").alias("n")))
    clusters = sets.select(*key, F.when(F.col("zero") == 0, F.transform("v", lambda x: x * F.col("n"))).otherwise(F.col("v")).alias("v"), "n")
    copies = sets.filter("n > 1").select("question_id", "v", "cluster")
    members = written(units.join(small(copies), ["question_id", "v"], "left").select("question_id", "vec_id", F.coalesce("cluster", "vec_id").alias("cluster")))

    def finish(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("cluster")
        into = _merged(g["cluster"].to_numpy(), np.stack(g["v"].to_list()).astype(float), g["n"].to_numpy(), most)
        return pd.DataFrame({"question_id": g["question_id"].iloc[0], "cluster": list(into), "into": list(into.values())})

    def nearest(row, both=True):
        x, y = (np.asarray(m, float).reshape(len(i), -1) for m, i in ((row.a_m, row.a_ids), (row.b_m, row.b_ids)))
        yield from ((row.question_id, *r) for r in _nearest(x, y, np.asarray(row.a_ids), np.asarray(row.b_ids), most, both and row.i != row.j))

    def in_tiles(rows: DataFrame) -> DataFrame:
        return tiled(rows.select("question_id", F.lit("stale_only").alias("condition"), F.col("cluster").alias("vec_id"), F.transform("v", lambda x: x / F.col("n")).alias("v")), size)

    def found(rows: DataFrame, asked: DataFrame | None) -> DataFrame:
        """The nearest clusters of all rows, or of those asked for."""
        if asked is None:
            pairs = tile_pairs(in_tiles(rows))
        else:
            b = in_tiles(rows).select("question_id", F.col("tile").alias("j"), "last", F.col("ids").alias("b_ids"), F.col("m").alias("b_m"))
            a = in_tiles(asked).drop("last").join(small(b.select("question_id", "last").distinct()), "question_id")
            a = a.select("question_id", F.lit(-1).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("j"), F.col("ids").alias("a_ids"), F.col("m").alias("a_m"))
            pairs = a.join(b.drop("last"), ["question_id", "j"])
        far = over_pairs(pairs, nearest if asked is None else lambda row: nearest(row, False), "question_id long, cluster long, far double, other long")
        return far.groupBy(*key).agg(F.min(F.struct("far", "other")).alias("b")).select(*key, "b.other")

    best = None
    while True:
        few = written(clusters.groupBy("question_id").agg(F.count("*").alias("clusters")).filter(F.col("clusters") <= 2 * size).select("question_id"))
        done = clusters.join(small(few), "question_id", "left_semi").groupBy("question_id").applyInPandas(finish, "question_id long, cluster long, into long")
        rest = written(clusters.join(small(few), "question_id", "left_anti"))
        if not rest.limit(1).count():
            return _moved(members, written(done))
        asked = None
        if best is not None:
            kept = best.join(rest.select(*key), key, "left_semi")
            lost = written(rest.join(kept.select(*key), key, "left_anti"))
            asked = lost if 2 * lost.count() < rest.count() else None
        best = written(found(rest, None) if asked is None else kept.unionByName(found(rest, asked)))
        back = best.select("question_id", F.col("cluster").alias("other"), F.col("other").alias("cluster"))
        # each other's nearest: the larger name goes into the smaller
        merges = written(best.join(back, [*key, "other"]).filter("other < cluster").select(*key, F.col("other").alias("into")))
        members = _moved(members, written(done.unionByName(merges)))
        if not merges.limit(1).count():
            if asked is None:
                return members
            # equal distances that went round in a circle: all look again
            best, clusters = None, rest
            continue
        touched = written(merges.select(*key).unionByName(merges.select("question_id", F.col("into").alias("cluster"))))
        live = rest.join(best.select(*key), key, "left_semi")
        other = live.select("question_id", F.col("cluster").alias("into"), F.col("v").alias("w"), F.col("n").alias("k"))
        pairs = live.join(merges, key).join(other, ["question_id", "into"])
        joined = pairs.select("question_id", F.col("into").alias("cluster"), F.zip_with("v", "w", lambda x, y: x + y).alias("v"), (F.col("n") + F.col("k")).alias("n"))
        clusters = written(live.join(small(touched), key, "left_anti").unionByName(joined))
        gone = touched.select("question_id", F.col("cluster").alias("other"))
        best = written(best.join(small(touched), key, "left_anti").join(small(gone), ["question_id", "other"], "left_anti"))


def _moved(members: DataFrame, moves: DataFrame) -> DataFrame:
    """members (question_id, vec_id, cluster) under the names that their clusters go into."""
    return written(members.join(small(moves), ["question_id", "cluster"], "left").select("question_id", "vec_id", F.coalesce("into", "cluster").alias("cluster")))


def _lengths(row) -> np.ndarray:
    """Distances of a pair of tiles of unit vectors; a vector is no neighbour of its own."""
    x, y = (np.asarray(m, float).reshape(len(i), -1) for m, i in ((row.a_m, row.a_ids), (row.b_m, row.b_ids)))
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ y.T))
    if row.i == row.j:
        np.fill_diagonal(d, np.inf)
    return d


def _both(row, d: np.ndarray) -> list[tuple[str, str, np.ndarray]]:
    """A pair of tiles from the side of each of them; a tile with itself once."""
    return [("a", "b", d), ("b", "a", d.T)][: 1 if row.i == row.j else 2]


def spanning_tree(units: DataFrame, least: int, size: int = TILE) -> DataFrame:
    """(question_id, far, i, j): the edges of the spanning tree of each question's mutual reachability, in Boruvka's rounds.

    In each round all components find their shortest edge to another one over pairs of tiles; edges are ordered by (length, ids), so that
    what the components choose has no circle.  Components halve at least, and their new names are found by doubling pointers.
    """

    def nearest(row):
        for own, _, d in _both(row, _lengths(row)):
            k = min(least, d.shape[1])
            yield from ((row.question_id, int(i), x[x < np.inf].tolist()) for i, x in zip(getattr(row, f"{own}_ids"), np.partition(d, k - 1, axis=1)[:, :k], strict=True))

    found = over_pairs(tile_pairs(tiled(_conditioned(units), size)), nearest, "question_id long, vec_id long, x array<double>")
    core = found.groupBy("question_id", "vec_id").agg(F.sort_array(F.flatten(F.collect_list("x"))).alias("x")).select("question_id", "vec_id", F.coalesce(F.get("x", F.lit(least - 1)), F.array_max("x")).alias("core"))
    rows = written(units.join(core, ["question_id", "vec_id"]).withColumn("comp", F.col("vec_id")))
    tree = None

    def shortest(row):
        d = _lengths(row)
        reach = np.maximum(np.maximum(np.asarray(row.a_core)[:, None], np.asarray(row.b_core)[None, :]), d)
        reach[np.asarray(row.a_comp)[:, None] == np.asarray(row.b_comp)[None, :]] = np.inf
        for own, other, r in _both(row, reach):
            ids, comps, others, far_comps = (np.asarray(getattr(row, f"{s}_{n}")) for s, n in ((own, "ids"), (own, "comp"), (other, "ids"), (other, "comp")))
            k = r.argmin(1)  # ids are in order, so the first of equals has the smallest
            far = r[np.arange(len(ids)), k]
            lo, hi = np.minimum(ids, others[k]), np.maximum(ids, others[k])
            seen = set()
            for at in np.lexsort((hi, lo, far, comps)).tolist():
                if far[at] < np.inf and comps[at] not in seen:
                    seen.add(comps[at])
                    yield row.question_id, int(comps[at]), float(far[at]), int(lo[at]), int(hi[at]), int(far_comps[k[at]])

    while True:
        with shuffles_cleaned(units.sparkSession):
            dealt = tiled(_conditioned(rows), size, ("core", "comp"))
            edges = over_pairs(tile_pairs(dealt), shortest, "question_id long, comp long, far double, i long, j long, other long")
            best = written(edges.groupBy("question_id", "comp").agg(F.min(F.struct("far", "i", "j", "other")).alias("e")).select("question_id", "comp", "e.*"))
            forgotten(dealt)
        if not best.limit(1).count():
            return tree if tree is not None else best.select("question_id", "far", "i", "j")
        new = best.select("question_id", "far", "i", "j").distinct()
        tree = written(new if tree is None else tree.unionByName(new))
        back = best.select("question_id", F.col("comp").alias("other"), F.col("other").alias("comp"), F.lit(True).alias("mutual"))
        up = best.join(back, ["question_id", "comp", "other"], "left")
        up = written(up.select("question_id", "comp", F.when(F.col("mutual") & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("into")))
        while True:
            above = up.select("question_id", F.col("comp").alias("into"), F.col("into").alias("next"))
            jumped = written(up.join(above, ["question_id", "into"]).select("question_id", "comp", F.col("next").alias("into"), (F.col("next") != F.col("into")).alias("moved")))
            up = jumped.drop("moved")
            if not jumped.filter("moved").limit(1).count():
                break
        old, rows = rows, written(rows.join(small(up), ["question_id", "comp"], "left").select("question_id", "vec_id", "v", "core", F.coalesce("into", "comp").alias("comp")))
        forgotten(old)


def _conditioned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("condition", F.lit("stale_only"))


def density_clusters(v: DataFrame, least: int = 5, size: int = TILE) -> DataFrame:
    """(question_id, vec_id, cluster): hierarchical density clusters, named by their smallest vec_id; noise is a cluster of its own each.

    A question that fits a tile is clustered there.  Of a larger one the spanning tree is found in rounds; one task then takes its edges,
    three numbers a vector and no vectors, from short to long.
    """
    units = written(_units(v))
    counts = written(units.groupBy("question_id").agg(F.count("*").alias("n")))
    few = counts.filter(F.col("n") <= size).select("question_id")
    schema = "question_id long, vec_id long, cluster long"

    def named(q: int, ids: np.ndarray, labels: np.ndarray) -> pd.DataFrame:
        first = {c: int(ids[labels == c].min()) for c in np.unique(labels) if c >= 0}
        return pd.DataFrame({"question_id": q, "vec_id": ids, "cluster": [first.get(c, int(i)) for c, i in zip(labels, ids, strict=True)]})

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_id")
        return named(g["question_id"].iloc[0], g["vec_id"].to_numpy(), ds.density_clusters(np.stack(g["v"].to_list()).astype(float), least))

    def of_tree(g: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([g["i"], g["j"]]))
        edges = list(zip(g["far"].tolist(), np.searchsorted(ids, g["i"]).tolist(), np.searchsorted(ids, g["j"]).tolist(), strict=True))
        return named(g["question_id"].iloc[0], ids, ds.clusters_of_tree(len(ids), edges, least) if len(ids) >= 2 * least else np.full(len(ids), -1))

    near = units.join(small(few), "question_id", "left_semi").groupBy("question_id").applyInPandas(whole, schema)
    large = written(units.join(small(few), "question_id", "left_anti"))
    if not large.limit(1).count():
        return near
    return near.unionByName(spanning_tree(large, least, size).groupBy("question_id").applyInPandas(of_tree, schema))
