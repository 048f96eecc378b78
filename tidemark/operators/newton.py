"""Detectors that are linear in a basis, fitted for all folds and settings at once.

A basis turns features into columns: the features themselves, their squares and products, quadratic B-splines of each, or an RBF kernel
by landmarks (Nystrom's features, whose products are the kernel between landmarks).  What is fitted minimises
|w|^2 / 2 + C * sum of weighted losses by Newton's steps; the constant is one of the columns and is shrunk like them.

A fit of some setting on some part of the folds is a task of the search.  One pass over the rows adds up gradients and Hessians of
all tasks in the workers; what they add up to is summed by an aggregate, and the driver gets a small matrix a task.
The number of jobs is that of the steps, however many folds and settings there are.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that stand for all in a kernel; with no more training rows than these the kernel is exact.
LANDMARKS = 64
STEPS, TOLERANCE = 30, 1e-9


@dataclass(frozen=True)
class BasisFamily:
    """kind: linear, quadratic, spline or kernel; loss: logistic or hinge (squared); gaussian: with a Gaussian process's link."""

    features: tuple[str, ...]
    kind: str
    grid: dict[str, tuple] = field(default_factory=dict)
    loss: str = "logistic"
    gaussian: bool = False

    def settings(self) -> list[dict]:
        return [dict(zip(self.grid, v, strict=True)) for v in itertools.product(*self.grid.values())]


def _spline(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, knots: int) -> np.ndarray:
    """Quadratic B-splines of each column over equal steps from lo to hi, the last of each left out; beyond the ends they go on as lines."""
    out = []
    for j in range(x.shape[1]):
        step = max((hi[j] - lo[j]) / (knots - 1), 1e-12)
        u = np.clip((x[:, j] - lo[j]) / step, 0, knots - 1)
        beyond = (x[:, j] - lo[j]) / step - u
        n = knots + 1
        cols, slopes = np.zeros((len(x), n)), np.zeros((len(x), n))
        k = np.minimum(u.astype(int), knots - 2)
        t, at = u - k, np.arange(len(x))
        for shift, value, slope in ((0, (1 - t) ** 2 / 2, t - 1), (1, (-2 * t * t + 2 * t + 1) / 2, 1 - 2 * t), (2, t * t / 2, t)):
            cols[at, k + shift], slopes[at, k + shift] = value, slope
        out.append((cols + slopes * beyond[:, None])[:, :-1])
    return np.concatenate(out, 1)


@dataclass
class Shape:
    """What a basis needs to know of its training rows."""

    n: int
    positives: int
    lo: np.ndarray
    hi: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    landmarks: np.ndarray


def columns(family: BasisFamily, s: dict, shape: Shape, x: np.ndarray) -> np.ndarray:
    """The basis before it is scaled."""
    if family.kind == "linear":
        return x
    if family.kind == "quadratic":
        i, j = np.triu_indices(x.shape[1])
        return np.concatenate([x, x[:, i] * x[:, j]], 1)
    if family.kind == "spline":
        return _spline(x, shape.lo, shape.hi, s["knots"])
    scale = np.where(shape.sd > 0, shape.sd, 1.0)
    a, z = ((m - shape.mean) / scale for m in (x, shape.landmarks))
    width = 1 / (2 * s["width"] ** 2) if "width" in s else (1 / x.shape[1] if s["gamma"] == "scale" else s["gamma"])
    kernel = lambda p, q: np.exp(-width * np.maximum((p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * p @ q.T, 0))
    value, vector = np.linalg.eigh(kernel(z, z))
    keep = value > 1e-10
    return kernel(a, z) @ (vector[:, keep] / np.sqrt(value[keep]))


@dataclass
class Model:
    """A fitted detector."""

    family: BasisFamily
    setting: dict
    shape: Shape
    mean: np.ndarray
    sd: np.ndarray
    w: np.ndarray
    spread: np.ndarray | None = None

    def matrix(self, x: np.ndarray) -> np.ndarray:
        made = columns(self.family, self.setting, self.shape, x)
        if self.family.kind == "kernel":
            return made if self.family.gaussian else np.concatenate([made, np.ones((len(made), 1))], 1)
        return np.concatenate([(made - self.mean) / np.where(self.sd > 0, self.sd, 1.0), np.ones((len(made), 1))], 1)

    def weights(self, y: np.ndarray) -> np.ndarray:
        """Of rows, so that both classes count alike; a Gaussian process takes them as they are."""
        if self.family.gaussian:
            return np.ones(len(y))
        n, p = self.shape.n, self.shape.positives
        return float(self.setting.get("c", 1.0)) * np.where(y > 0, n / (2 * max(p, 1)), n / (2 * max(n - p, 1)))

    def pass_(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Loss, gradient and Hessian of these rows, one after another."""
        a, s, sign = self.matrix(x), self.weights(y), 2.0 * y - 1
        f = a @ self.w
        if self.family.loss == "hinge":
            short = np.maximum(0, 1 - sign * f)
            loss, g, h = s * short**2, -2 * s * sign * short, 2 * s * (short > 0)
        else:
            p = 1 / (1 + np.exp(-np.clip(f, -500, 500)))
            loss, g, h = s * np.logaddexp(0, -sign * f), s * (p - y), s * p * (1 - p)
        return np.concatenate([[loss.sum()], a.T @ g, ((a * h[:, None]).T @ a).ravel()])

    def score(self, x: np.ndarray) -> np.ndarray:
        a = self.matrix(x)
        f = a @ self.w
        if self.spread is not None:
            # what the landmarks do not explain of a point's variance of one stays
            f = f / np.sqrt(1 + np.pi / 8 * (np.einsum("ij,jk,ik->i", a, self.spread, a) + np.maximum(0, 1 - (a * a).sum(1))))
        return 1 / (1 + np.exp(-np.clip(f, -500, 500)))


def dumped(m: Model) -> str:
    """A model as JSON."""
    plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else v
    fields = {k: plain(v) for k, v in vars(m).items() if k not in ("family", "shape")}
    return json.dumps({**fields, "family": vars(m.family), "shape": {k: plain(v) for k, v in vars(m.shape).items()}})


def loaded(text: str) -> Model:
    """The model of a JSON text."""
    x = json.loads(text)
    array = lambda v: np.array(v, float) if isinstance(v, list) else v
    family = x.pop("family")
    family = BasisFamily(tuple(family.pop("features")), grid={k: tuple(v) for k, v in family.pop("grid").items()}, **family)
    shape = Shape(**{k: array(v) for k, v in x.pop("shape").items()})
    return Model(family, x.pop("setting"), shape, **{k: array(v) for k, v in x.items()})


def _summed(rows: DataFrame, features: tuple[str, ...], parts: list, tasks: list, fn) -> dict[int, np.ndarray]:
    """What ``fn(task, x, y)`` adds up to over the rows of each task's part; a task's numbers are one row for the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            x, y = b[list(features)].to_numpy(float), b["y"].to_numpy(float)
            for k, task in enumerate(tasks):
                at = _in_part(b, parts[k])
                if at.any():
                    held[k] = held.get(k, 0) + fn(task, x[at], y[at])
        yield pd.DataFrame({"task": list(held), "z": list(held.values())})

    parted = rows.mapInPandas(run, "task int, z array<double>").select("task", F.posexplode("z").alias("i", "x")).groupBy("task", "i").agg(F.sum("x").alias("x"))
    whole = parted.groupBy("task").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("z"))
    return {r["task"]: np.array(r["z"]) for r in whole.collect()}


def _in_part(b: pd.DataFrame, part: tuple[int, int]) -> np.ndarray:
    """Whether rows are in the training part (outer fold, inner fold), -1 for none left out."""
    at = np.ones(len(b), bool)
    if part[0] >= 0:
        at &= b["fold"].to_numpy() != part[0]
    if part[1] >= 0:
        at &= np.array([i[max(part[0], 0)] != part[1] for i in b["inner"]], bool)
    return at


def _shapes(rows: DataFrame, features: tuple[str, ...], parts: list) -> dict:
    """Numbers, ends and moments of each part, and its landmarks: the rows of the smallest hashes."""
    kept = list(dict.fromkeys(parts))
    d = len(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moments: dict[int, np.ndarray] = {}
        ends: dict[int, tuple] = {}
        marks: dict[int, list] = {k: [] for k in range(len(kept))}
        for b in batches:
            x, y, h = b[list(features)].to_numpy(float), b["y"].to_numpy(float), b["hash"].to_numpy()
            for k, part in enumerate(kept):
                at = _in_part(b, part)
                if at.any():
                    z = np.concatenate([[at.sum(), y[at].sum()], x[at].sum(0), (x[at] ** 2).sum(0)])
                    moments[k] = moments.get(k, 0) + z
                    lo, hi = ends.get(k, (np.inf, -np.inf))
                    ends[k] = np.minimum(lo, x[at].min(0)), np.maximum(hi, x[at].max(0))
                    marks[k] = sorted(marks[k] + list(zip(h[at].tolist(), x[at].tolist(), strict=True)))[:LANDMARKS]
        yield pd.DataFrame([(k, moments[k], *ends[k], [float(v) for _, m in marks[k] for v in m], [i for i, _ in marks[k]]) for k in moments], columns=["k", "z", "lo", "hi", "marks", "hashes"])

    out: dict = {}
    # a row for each part and task of Spark, of a size that features and landmarks bound
    per = rows.mapInPandas(run, "k int, z array<double>, lo array<double>, hi array<double>, marks array<double>, hashes array<long>")
    for r in per.toLocalIterator():
        z, lo, hi, marks = out.get(r["k"], (0, np.inf, -np.inf, []))
        m = list(zip(r["hashes"], np.array(r["marks"]).reshape(-1, d).tolist(), strict=True))
        out[r["k"]] = z + np.array(r["z"]), np.minimum(lo, r["lo"]), np.maximum(hi, r["hi"]), sorted(marks + m)[:LANDMARKS]
    shapes = {}
    for k, (z, lo, hi, marks) in out.items():
        mean = z[2 : 2 + d] / z[0]
        shapes[kept[k]] = Shape(int(z[0]), int(z[1]), lo, hi, mean, np.sqrt(np.maximum(z[2 + d :] / z[0] - mean**2, 0)), np.array([m for _, m in marks]))
    return shapes


def fit_parts(rows: DataFrame, tasks: list[tuple[BasisFamily, dict, tuple[int, int]]]) -> list[Model]:
    """Models of (family, setting, part); rows have the features, y and, where parts leave folds out, fold and inner."""
    features = tasks[0][0].features
    missing = {"fold": F.lit(0), "inner": F.array(F.lit(0))}
    rows = rows.select(*features, F.col("y").cast("double").alias("y"), *(F.col(c) if c in rows.columns else v.alias(c) for c, v in missing.items()), F.xxhash64(*features, "y").alias("hash")).persist()
    parts = [p for *_, p in tasks]
    shapes = _shapes(rows, features, parts)
    models = [Model(f, s, shapes[p], np.zeros(1), np.ones(1), np.zeros(1)) for f, s, p in tasks]

    def moments(m: Model, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        c = columns(m.family, m.setting, m.shape, x)
        return np.concatenate([c.sum(0), (c * c).sum(0)])

    for k, z in _summed(rows, features, parts, models, moments).items():
        m = models[k]
        half = len(z) // 2
        m.mean = z[:half] / m.shape.n
        m.sd = np.sqrt(np.maximum(z[half:] / m.shape.n - m.mean**2, 0))
        m.w = np.zeros(half + (not m.family.gaussian))
    best: dict[int, tuple] = {}
    open_ = list(range(len(models)))
    for _ in range(STEPS):
        found = _summed(rows, features, [parts[k] for k in open_], [models[k] for k in open_], lambda m, x, y: m.pass_(x, y))
        left = []
        for at, k in enumerate(open_):
            m, z = models[k], found[at]
            d = len(m.w)
            value, g, h = z[0] + m.w @ m.w / 2, z[1 : 1 + d] + m.w, z[1 + d :].reshape(d, d) + np.eye(d)
            if k in best and value > best[k][0] + 1e-9 * abs(best[k][0]):
                m.w = (m.w + best[k][1]) / 2  # too far: half the way back
                left.append(k)
                continue
            best[k] = (value, m.w)
            if m.family.gaussian:
                m.spread = np.linalg.inv(h)
            if np.abs(g).max() > TOLERANCE * max(1.0, m.shape.n):
                m.w = m.w - np.linalg.solve(h, g)
                left.append(k)
        open_ = left
        if not open_:
            break
    for k in open_:
        models[k].w = best[k][1]
    rows.unpersist()
    return models


def score_parts(rows: DataFrame, models: list[Model], held: list[tuple[int, int]]) -> DataFrame:
    """rows with option and score, for each model the rows that its fold (outer, inner) holds out; an outer fold of -1 holds all."""
    features = models[0].family.features
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, (m, (outer, inner)) in enumerate(zip(models, held, strict=True)):
                if outer < 0:
                    at = np.ones(len(b), bool)
                elif inner < 0:
                    at = (b["fold"] == outer).to_numpy()
                else:
                    at = (b["fold"] != outer).to_numpy() & np.array([i[outer] == inner for i in b["inner"]], bool)
                if at.any():
                    yield b[at].assign(option=k, score=m.score(b.loc[at, list(features)].to_numpy(float)))

    return rows.mapInPandas(run, f"{fields}, option int, score double")
