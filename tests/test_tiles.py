"""Distances, volumes and clusters over tiles, against NumPy on whole cells."""

import itertools

import numpy as np
import pytest

from tidemark import catalog
from tidemark.operators import distances, tiles


def cells(seed=0, sizes=((0, 23, 31), (1, 1, 1), (2, 12, 0), (3, 40, 9), (4, 2, 1)), d=6):
    rng = np.random.default_rng(seed)
    out = {}
    for q, nx, ny in sizes:
        x, y = rng.normal(size=(nx, d)), rng.normal(loc=0.3, size=(ny, d))
        if nx > 20:
            x[3:6] = x[0]  # equal vectors
        out[q] = (x, y)
    return out


def table(spark, data):
    rows, n = [], 0
    for q, sides in data.items():
        for side, m in zip(("stale_only", "current_only"), sides, strict=True):
            for v in m.tolist():
                rows.append((q, side, n, v))
                n += 1
    return spark.createDataFrame(rows, "question_id int, condition string, vec_id long, v array<double>").repartition(3)


def far(x, y):
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))


@pytest.mark.parametrize("size", [5, 512])
def test_energy_and_mmd(spark, size):
    data = {q: c for q, c in cells().items() if len(c[0]) and len(c[1])}
    v = table(spark, data)
    energy = {r["question_id"]: r["energy"] for r in tiles.energy(v, size).collect()}
    mmd = {r["question_id"]: r["mmd"] for r in tiles.mmd(v, size).collect()}
    for q, (x, y) in data.items():
        assert energy[q] == pytest.approx(max(0, 2 * far(x, y).mean() - far(x, x).mean() - far(y, y).mean()), abs=1e-9)
        both = np.concatenate([x, y])
        once = np.array([np.sqrt(((a - b) ** 2).sum()) for a, b in itertools.combinations(both, 2)])
        sigma = np.median(once[once > 0])
        k = lambda a, b: np.exp(-(far(a, b) ** 2) / max(2 * sigma**2, 1e-12))  # noqa: B023, E731
        own = lambda a: (k(a, a).sum() - len(a)) / (len(a) * (len(a) - 1)) if len(a) > 1 else 0.0
        assert mmd[q] == pytest.approx(max(0, own(x) + own(y) - 2 * k(x, y).mean()), abs=1e-8)


def test_volumes_of_cells(spark):
    data = cells(1)
    got = {(r["question_id"], r["condition"]): r["volume"] for r in tiles.volumes(table(spark, data), dim=4).collect()}
    for q, sides in data.items():
        for side, x in zip(("stale_only", "current_only"), sides, strict=True):
            if not len(x):
                assert (q, side) not in got
                continue
            u = x / np.linalg.norm(x, axis=1, keepdims=True)
            s = np.linalg.svd(u - u.mean(0), compute_uv=False)[: min(4, len(x) - 1, 6)]
            assert got[q, side] == pytest.approx(float(np.log(s * s + 1e-10).sum()), abs=1e-5)


def test_sliced_distances(spark):
    data = cells(2)
    got = {r["question_id"]: r["swd"] for r in tiles.sliced(table(spark, data), projections=16, seed=3).collect()}
    w = np.random.default_rng(3).normal(size=(16, 6))
    w /= np.linalg.norm(w, axis=1, keepdims=True) + 1e-12
    for q, (x, y) in data.items():
        if not len(x) or not len(y):
            assert got[q] == 0
            continue
        at = np.linspace(0, 1, max(len(x), len(y)))
        level = lambda m, k: np.interp(at, np.linspace(0, 1, len(m)), np.sort(m @ w[k]))  # noqa: B023, E731
        assert got[q] == pytest.approx(np.mean([np.abs(level(x, k) - level(y, k)).mean() for k in range(16)]), abs=1e-9)


def linkage(x, similarity):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    sets = [[i] for i in range(len(x))]
    while len(sets) > 1:
        away, i, j = min((np.mean([d[p, q] for p in sets[i] for q in sets[j]]), i, j) for i in range(len(sets)) for j in range(i))
        if away >= 1 - similarity:
            break
        sets[j] += sets.pop(i)
    return {frozenset(s) for s in sets}


@pytest.mark.parametrize("size", [6, 512])
def test_average_linkage_in_rounds(spark, size):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(5, 6))
    data = {0: (middle[rng.integers(0, 5, 24)] + rng.normal(scale=0.5, size=(24, 6)), rng.normal(size=(7, 6))), 1: (rng.normal(size=(3, 6)), rng.normal(size=(1, 6)))}
    got = {}
    for r in tiles.average_linkage(table(spark, data), 0.4, size).collect():
        got.setdefault((r["question_id"], r["cluster"]), set()).add(r["vec_id"])
    first = 0
    for q, sides in data.items():
        x = np.concatenate(sides)
        want = {frozenset(first + i for i in s) for s in linkage(x, 0.4)}
        assert {frozenset(s) for (p, _), s in got.items() if p == q} == want
        first += len(x)
    assert all(min(s) == c for (_, c), s in got.items()) and max(map(len, got.values())) > 3


def linkage_of_all(x, similarity):
    """As linkage, with zero vectors as clusters of their own."""
    some = np.flatnonzero(np.abs(x).sum(1))
    return {frozenset(int(some[i]) for i in s) for s in linkage(x[some], similarity)} | {frozenset([int(i)]) for i in np.flatnonzero(np.abs(x).sum(1) == 0)}


@pytest.mark.parametrize("size", [4, 512])
def test_average_linkage_of_copies(spark, monkeypatch, size):
    """Copies of a vector are one from the start, so the rounds do not grow with them; copies of a zero vector stay apart."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 6)), 40, 0), rng.normal(size=(17, 6)), np.zeros((2, 6)), 3 * rng.normal(size=(4, 6))])
    rounds, first = [], tiles.over_pairs
    monkeypatch.setattr(tiles, "over_pairs", lambda *a: rounds.append(1) or first(*a))
    got = {}
    for r in tiles.average_linkage(table(spark, {0: (x[:30], x[30:])}), 0.3, size).collect():
        got.setdefault(r["cluster"], set()).add(r["vec_id"])
    assert {frozenset(s) for s in got.values()} == linkage_of_all(x, 0.3) and all(min(s) == c for c, s in got.items())
    assert len(rounds) < 20


def test_a_cell_of_many_tiles(spark):
    """One question of many vectors is many rows of work, none with more than two tiles."""
    data = cells(6, sizes=((0, 1500, 900),), d=3)
    pairs = tiles.tile_pairs(tiles.tiled(table(spark, data), 300))
    shape = pairs.selectExpr("size(a_ids) as a", "size(b_ids) as b").collect()
    assert len(shape) == 36 and max(max(r) for r in shape) <= 330
    x, y = data[0]
    energy = tiles.energy(table(spark, data), 300).first()["energy"]
    assert energy == pytest.approx(2 * far(x, y).mean() - far(x, x).mean() - far(y, y).mean(), abs=1e-9)


@pytest.mark.parametrize("size", [9, 512])
def test_density_clusters_of_a_spanning_tree_in_rounds(spark, size):
    rng = np.random.default_rng(8)
    middle = np.eye(6)[:3] * 4
    data = {0: (np.concatenate([middle[k] + rng.normal(scale=0.3, size=(9, 6)) for k in range(3)]), rng.normal(size=(6, 6))), 1: (rng.normal(size=(4, 6)), rng.normal(size=(2, 6))), 2: (rng.normal(size=(11, 6)), rng.normal(size=(9, 6)))}
    got = {(r["question_id"], r["vec_id"]): r["cluster"] for r in tiles.density_clusters(table(spark, data), 4, size).collect()}
    first = 0
    for q, sides in data.items():
        labels = distances.density_clusters(np.concatenate(sides), 4)
        ids = np.arange(first, first + len(labels))
        want = {i: (int(ids[labels == c].min()) if c >= 0 else int(i)) for i, c in zip(ids, labels, strict=True)}
        assert {i: got[q, i] for i in ids} == want
        first += len(labels)
    assert len({got[0, i] for i in range(27)}) < 15


def test_density_clusters_query(spark):
    """The whole query against one pass over all pairs of each question."""
    sf = "/root/testdata/sf0.001"
    got = {r["vec_id"]: r["cluster"] for r in catalog.QUERIES["density_clusters"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    assert len(got) == len(rows)
    for q in {r["label"] for r in rows}:
        own = [r for r in rows if r["label"] == q]
        labels, ids = distances.density_clusters(np.array([r["embedding"] for r in own], float), 4), np.array([r["vec_id"] for r in own])
        assert [got[i] for i in ids] == [int(ids[labels == c].min()) if c >= 0 else int(i) for i, c in zip(ids, labels, strict=True)]


def test_rounds_of_a_tree_leave_no_tiles(spark):
    """Tables of vectors that a round has read are gone after it, however many rounds there are."""
    from pathlib import Path

    from tidemark import shared

    kept = Path(shared.shared_dir(spark).removeprefix("file://"))
    units = shared.written(tiles._units(table(spark, cells(4, sizes=((0, 30, 25),)))))
    before = set(kept.glob("*"))
    assert tiles.spanning_tree(units, 4, 9).count() == 54
    wide = [p for p in set(kept.glob("*")) - before if {"v", "m"} & set(spark.read.parquet(str(p)).columns)]
    assert len(wide) <= 2
