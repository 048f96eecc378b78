"""Detectors linear in a basis: against plain NumPy forms, and nested scores as a whole."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import families
from tidemark.operators import newton as nt

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 2)) * [1, 3] + [0.5, -1]
    return x, ((x[:, 0] - 0.5) ** 2 + (x[:, 1] / 3) ** 2 + rng.normal(scale=0.4, size=50) > 1.2).astype(float)


def table(spark, x, y):
    return spark.createDataFrame([(i, int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "doc_id long, y int, f1 double, f2 double").repartition(3)


def scaled(a):
    sd = a.std(0)
    return (a - a.mean(0)) / np.where(sd > 0, sd, 1)


def rbf(a, b, g):
    return np.exp(-g * ((a[:, None] - b[None]) ** 2).sum(-1))


def bspline(x, lo, hi, knots):
    """Quadratic B-splines by the recursion of Cox and de Boor, one value after another."""
    step = (hi - lo) / (knots - 1)
    t = lo + step * np.arange(-2, knots + 2)

    def basis(i, k, v):
        if k == 0:
            return float(t[i] <= v < t[i + 1])
        return (v - t[i]) / (t[i + k] - t[i]) * basis(i, k - 1, v) + (t[i + k + 1] - v) / (t[i + k + 1] - t[i + 1]) * basis(i + 1, k - 1, v)

    return np.array([[basis(i, 2, min(v, hi - 1e-12 * step)) for i in range(knots)] for v in x])


def test_bases(data):
    x, y = data
    shape = nt.Shape(50, int(y.sum()), x.min(0), x.max(0), x.mean(0), x.std(0), x)
    f = nt.BasisFamily(("f1", "f2"), "spline", {})
    want = np.concatenate([bspline(x[:, j], x[:, j].min(), x[:, j].max(), 4) for j in range(2)], 1)
    assert nt.columns(f, {"knots": 4}, shape, x) == pytest.approx(want, abs=1e-6)
    # beyond the ends the splines go on as lines
    far = np.array([[x[:, 0].max() + d, 0.0] for d in (0.0, 1.0, 2.0)])
    out = nt.columns(f, {"knots": 4}, shape, far)
    assert out[2] - out[1] == pytest.approx(out[1] - out[0], abs=1e-9)
    # with every row as a landmark, products of the features are the kernel
    k = nt.columns(nt.BasisFamily(("f1", "f2"), "kernel", {}), {"gamma": 0.5}, shape, x)
    assert k @ k.T == pytest.approx(rbf(scaled(x), scaled(x), 0.5), abs=1e-8)


@pytest.mark.parametrize(("name", "setting"), [("l2_logistic", {"c": 0.1}), ("quadratic_logistic", {"c": 100.0}), ("additive_gam", {"knots": 3, "c": 1.0}), ("rbf_svm", {"c": 10.0, "gamma": "scale"})])
def test_fits_are_the_minimum(spark, data, name, setting):
    """No small step in any direction makes the stated loss less, computed from its formula."""
    x, y = data
    family = families.families(["f1", "f2"], 50)[name]
    m = families.fit(family, table(spark, x, y), **setting)
    a = m.matrix(x)
    weight = setting["c"] * np.where(y > 0, 50 / (2 * y.sum()), 50 / (2 * (50 - y.sum())))
    sign = 2 * y - 1
    each = (lambda f: np.maximum(0, 1 - sign * f) ** 2) if name == "rbf_svm" else (lambda f: np.log1p(np.exp(-sign * f)))
    total = lambda w: w @ w / 2 + (weight * each(a @ w)).sum()
    rng = np.random.default_rng(1)
    assert all(total(m.w + d * s) >= total(m.w) - 1e-7 for d in rng.normal(size=(60, len(m.w))) for s in (1e-3, -1e-3))
    scores = {r["doc_id"]: r["score"] for r in families.predict(family, m, table(spark, x, y)).collect()}
    assert [scores[i] for i in range(50)] == pytest.approx((1 / (1 + np.exp(-a @ m.w))).tolist())
    assert nt.loaded(nt.dumped(m)).score(x) == pytest.approx(m.score(x))


def test_a_gaussian_process_by_its_textbook_form(spark, data):
    """The mode by Newton's steps over the whole kernel, variances from it, and the probit approximation of the mean."""
    x, y = data
    family = families.families(["f1", "f2"], 50)["gaussian_process"]
    m = families.fit(family, table(spark, x, y), width=0.7)
    z = scaled(x)
    k, f = rbf(z, z, 1 / (2 * 0.49)), np.zeros(50)
    for _ in range(50):
        p = 1 / (1 + np.exp(-f))
        w = p * (1 - p)
        root = np.sqrt(w)
        b = w * f + y - p
        inner = np.eye(50) + root[:, None] * k * root[None]
        f = k @ (b - root * np.linalg.solve(inner, root * (k @ b)))
    new = np.array([[0.0, 0.0], [2.0, 4.0], [-1.0, 3.0]])
    s = rbf((new - x.mean(0)) / x.std(0), z, 1 / (2 * 0.49))
    p = 1 / (1 + np.exp(-f))
    w = p * (1 - p)
    var = 1 - np.einsum("ij,jk,ik->i", s, np.linalg.inv(k + np.diag(1 / w)), s)
    want = 1 / (1 + np.exp(-(s @ (y - p)) / np.sqrt(1 + np.pi / 8 * var)))
    assert m.score(new) == pytest.approx(want, abs=1e-4)


def average_precision(y, score):
    total = hit = 0.0
    order = sorted(set(score.tolist()), reverse=True)
    out = seen = 0.0
    for s in order:
        at = score == s
        hit, total = hit + y[at].sum(), total + at.sum()
        out, seen = out + (hit / y.sum() - seen) * hit / total, hit / y.sum()
    return out


def quadratic(x, y, c, new):
    i, j = np.triu_indices(x.shape[1])
    make = lambda m: np.concatenate([m, m[:, i] * m[:, j]], 1)
    a, b = make(x), make(new)
    mean, sd = a.mean(0), a.std(0)
    sd = np.where(sd > 0, sd, 1)
    a, b = (np.concatenate([(m - mean) / sd, np.ones((len(m), 1))], 1) for m in (a, b))
    weight = c * np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w = np.zeros(a.shape[1])
    value = lambda w: w @ w / 2 + (weight * np.logaddexp(0, -(2 * y - 1) * (a @ w))).sum()
    for _ in range(200):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve((a.T * (weight * p * (1 - p))) @ a + np.eye(len(w)), a.T @ (weight * (p - y)) + w)
        rate = 1.0
        while value(w - rate * step) > value(w) and rate > 1e-8:
            rate /= 2
        w = w - rate * step
    return 1 / (1 + np.exp(-b @ w))


def test_out_of_fold_query_over_the_whole_grid(spark):
    """Folds as Spark deals them; every setting fitted on every inner part, the best one on each outer part."""
    from tidemark.plans import models

    rows = models._core(spark, SF).filter("split = 't0'").select("doc_id", "y", *models._FEATURES)
    dealt = sorted(families._dealt(rows, 2, 2, "0").collect(), key=lambda r: r["doc_id"])
    x, y = np.array([[r[f] for f in models._FEATURES] for r in dealt]), np.array([r["y"] for r in dealt], float)
    fold, inner = np.array([r["fold"] for r in dealt]), np.array([r["inner"] for r in dealt])
    want = {}
    for o in range(2):
        means = []
        for c in (0.01, 0.1, 1.0, 10.0, 100.0):
            aps = []
            for i in range(2):
                train, test = ((fold != o) & same for same in (inner[:, o] != i, inner[:, o] == i))
                aps.append(average_precision(y[test], quadratic(x[train], y[train], c, x[test])))
            means.append(round(float(np.mean(aps)), 9))
        c = (0.01, 0.1, 1.0, 10.0, 100.0)[means.index(max(means))]
        want |= dict(zip([r["doc_id"] for r, f in zip(dealt, fold, strict=True) if f == o], quadratic(x[fold != o], y[fold != o], c, x[fold == o]), strict=True))
    got = {r["doc_id"]: r["score"] for r in catalog.QUERIES["detector_oof"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=2e-5)


def test_jobs_do_not_grow_with_folds_and_settings(spark, data):
    x, y = data
    rows = table(spark, x, y).withColumns({"fold": F.pmod("doc_id", F.lit(5)).cast("int"), "inner": F.array(*(F.pmod("doc_id", F.lit(3)).cast("int") for _ in range(5)))})
    family = families.families(["f1", "f2"], 50)["l2_logistic"]
    tracker = spark.sparkContext.statusTracker()

    def jobs(tasks):
        before = len(tracker.getJobIdsForGroup(None))
        nt.fit_parts(rows, tasks)
        return len(tracker.getJobIdsForGroup(None)) - before

    few = jobs([(family, {"c": 1.0}, (-1, -1))])
    many = jobs([(family, {"c": c}, (o, i)) for c, o, i in itertools.product((0.1, 1.0), range(5), range(3))])
    assert many <= few + 12
