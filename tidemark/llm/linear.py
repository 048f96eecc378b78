"""Sparse logistic regression on the driver and the bounded labelled samples it is fitted on."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialise, release

#: No text takes more than this part of the bytes of a sample, and a sample of fewer rows is reported.
SHARE, LEAST = 16, 100


def labelled_sample(docs: DataFrame, labels: DataFrame | None, label: str, rows: int, size: int, seed: int) -> list[tuple[str, object]]:
    """(text, label) of at most ``rows`` rows of docs and ``size`` bytes of text, where label is not null.

    ``label`` is a column of ``labels`` (joined by doc_id), or of docs where labels is None.  The rows with
    the smallest seeded hashes of doc_id are taken in that order, without those that do not fit in the bytes that
    are left, so the sample is the same in every run; equal ids come in the order of their texts' hashes.  A text
    of more than 1 / ``SHARE`` of ``size`` is taken only if no other has a label.  Rows without text count as empty.
    Only ids, hashes and lengths are joined and sorted; texts are read for the chosen ids.  A sample of fewer than
    ``LEAST`` rows or two labels gives a warning.
    """
    spark = docs.sparkSession
    key = ["h", "doc_id", "t"]
    slim = [F.xxhash64("doc_id", F.lit(seed)).alias("h"), "doc_id", F.xxhash64("text").alias("t"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")]
    known = None if labels is None else labels.filter(F.col(label).isNotNull()).select("doc_id", F.col(label).alias("label"))

    def labelled(d: DataFrame, *more) -> DataFrame:
        if known is None:
            return d.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(*slim, *more, F.col(label).alias("label"))
        return d.filter("doc_id is not null").select(*slim, *more).join(known, "doc_id")

    def fitting(found, total: int = 0):
        for r in found:
            if total + r["n"] <= size:
                total += r["n"]
                yield r

    for most in (size // SHARE, size):
        ids = [r["doc_id"] for r in fitting(labelled(docs).filter(F.col("n") <= most).select(*key, "n").orderBy(*key).limit(rows).collect())]
        if ids:
            break
    else:
        warnings.warn(f"no labelled text for {label}", stacklevel=2)
        return []
    # bounded by ``rows`` ids, so that the broadcast is as well
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in sorted(set(ids))], "doc_id long"))
    if known is not None:
        known = known.join(chosen, "doc_id", "left_semi")
    taken = materialise(labelled(docs.join(chosen, "doc_id", "left_semi"), F.coalesce("text", F.lit("")).alias("text")), "sample")
    out = [(r["text"], r["label"]) for r in fitting(taken.filter(F.col("n") <= most).orderBy(*key).limit(rows).toLocalIterator())]
    release(spark, taken)
    if len(out) < LEAST or len({x for _, x in out}) < 2:
        warnings.warn(f"{label} is learnt from {len(out)} rows with {len({x for _, x in out})} labels", stacklevel=2)
    return out


class Rows:
    """A sparse matrix by rows."""

    def __init__(self, begin: np.ndarray, index: np.ndarray, value: np.ndarray, dim: int):
        self.begin, self.index, self.value, self.dim = begin, index, value, dim
        self.row = np.repeat(np.arange(len(begin) - 1, dtype=np.int32), np.diff(begin))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.index], minlength=len(self.begin) - 1)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * r[self.row], minlength=self.dim)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_logistic(x: Rows, y: np.ndarray, l2: float, steps: int = 60, memory: int = 8, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the (weighted) mean log loss plus l2/2 times the squared weights, by L-BFGS."""
    n = len(y)
    weight = np.full(n, 1 / n) if weight is None else weight / weight.sum()

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = p[:-1], p[-1]
        z = x.dot(w) + b
        value = float(weight @ (np.logaddexp(0, z) - y * z)) + l2 / 2 * float(w @ w)
        r = weight * (sigmoid(z) - y)
        return value, np.append(x.back(r) + l2 * w, r.sum())

    p = np.zeros(x.dim + 1)
    value, grad = loss(p)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = -grad, []
        for s, g, rho in reversed(past):
            alphas.append(rho * (s @ d))
            d = d - alphas[-1] * g
        if past:
            s, g, _ = past[-1]
            d *= (s @ g) / (g @ g)
        for (s, g, rho), a in zip(past, reversed(alphas)):
            d += s * (a - rho * (g @ d))
        slope, step = float(grad @ d), 1.0 if past else min(1.0, 1 / max(np.abs(grad).sum(), 1e-12))
        for _ in range(30):
            new_value, new_grad = loss(p + step * d)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, g = step * d, new_grad - grad
        if s @ g > 1e-12:
            past = [*past[-memory + 1 :], (s, g, 1 / (s @ g))]
        done = value - new_value < 1e-8 * max(1.0, abs(value))
        p, value, grad = p + s, new_value, new_grad
        if done:
            break
    return p[:-1], float(p[-1])


def fit_platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * score + b) is calibrated on held-out scores.

    Platt's smoothed targets keep it finite where the classes can be told apart without error; Newton steps
    are halved until they lower the loss.
    """
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([score, np.ones(len(score))], 1)
    p = np.array([1.0, 0.0])
    loss = lambda q: float((np.logaddexp(0, x @ q) - target * (x @ q)).sum()) + 1e-3 * float(q @ q)
    for _ in range(100):
        z = sigmoid(x @ p)
        gradient = x.T @ (z - target) + 2e-3 * p
        hessian = x.T @ (x * np.maximum(z * (1 - z), 1e-9)[:, None]) + 2e-3 * np.eye(2)
        step, now = np.linalg.solve(hessian, gradient), loss(p)
        while loss(p - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        p = p - step
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0]), float(p[1])
