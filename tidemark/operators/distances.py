"""Means, entropy, divergence and clusters of answers, per question cell; distances over all pairs are in ``tiles``.

Texts of a cell that are compared with each other are bounded by the sampling plan (16 answers).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v over its length; a zero vector as it is."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def centroids(v: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, centroid): means per dimension, combined before the exchange."""
    per = v.select(*keys, F.posexplode("v").alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("m"))
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def entropy(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """-sum p ln(p + 1e-12), at least 0."""
    c = rows.groupBy(*keys, label).agg(F.count("*").alias("c"))
    total = c.groupBy(*keys).agg(F.sum("c").alias("n"))
    p = F.col("c") / F.col("n")
    return c.join(total, keys).groupBy(*keys).agg(F.greatest(F.lit(0.0), -F.sum(p * F.log(p + 1e-12))).alias("entropy"))


def js(rows: DataFrame, key: str, label: str, left: Column, right: Column) -> DataFrame:
    """Jensen-Shannon divergence, base 2, of a label's shares on the two sides."""
    c = rows.groupBy(key, label).agg(F.sum(left.cast("double")).alias("l"), F.sum(right.cast("double")).alias("r"))
    t = c.groupBy(key).agg(F.sum("l").alias("nl"), F.sum("r").alias("nr"))
    p, q = F.col("l") / F.greatest("nl", F.lit(1e-12)), F.col("r") / F.greatest("nr", F.lit(1e-12))
    m = F.greatest((p + q) / 2, F.lit(1e-12))
    term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return c.join(t, key).groupBy(key).agg((0.5 * F.sum(term(p)) + 0.5 * F.sum(term(q))).alias("js"))


def per_cell(v: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """fn(pandas frame of a cell) for each cell."""
    return v.groupBy(*keys).applyInPandas(fn, schema)


def matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["v"].to_list()).astype(float) if len(pdf) else np.zeros((0, 0))


def hashed_embedding(texts: DataFrame, key: str, text: Column, bins: int = 768) -> DataFrame:
    """(key, bin, value): unit vectors of signed token counts, each token in the bin that a hash of it names; sparse, zeros left out."""
    from tidemark.functions import text as tx

    h = F.md5("token")
    part = lambda lo: F.conv(F.substring(h, lo, 8), 16, 10).cast("long")
    rows = texts.select(key, F.explode(tx.tokens(text)).alias("token")).select(key, F.pmod(part(1), F.lit(bins)).alias("bin"), F.when(part(9) % 2 == 0, 1.0).otherwise(-1.0).alias("w"))
    sums = rows.groupBy(key, "bin").agg(F.sum("w").alias("x")).filter("x <> 0")
    norm = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return sums.join(norm, key).select(key, "bin", (F.col("x") / F.col("norm")).alias("value"))


def each_once(rows: DataFrame, text: str, encode) -> DataFrame:
    """rows with what ``encode`` (a function of a table of distinct texts) adds to each text: equal texts are encoded once."""
    return rows.join(encode(rows.select(text).distinct()), text)


def equivalence_clusters(rows: DataFrame, keys: list[str], item: str, text: str, same) -> DataFrame:
    """rows with component: the smallest item that a chain of equivalent texts of its cell leads to.

    ``same`` is an expression of two texts.  Each two rows of a cell are compared once; cells are bounded by the sampling
    plan, so their links are closed cell by cell.
    """
    x = rows.select(*keys, F.col(item).alias("_i"), F.col(text).alias("_a"))
    y = rows.select(*keys, F.col(item).alias("_j"), F.col(text).alias("_b"))
    links = x.join(y, keys).filter("_i < _j").filter(same(F.col("_a"), F.col("_b"))).select(*keys, "_i", "_j")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema.fields[:-1]) + ", component long"

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        up: dict[int, int] = {}

        def root(i: int) -> int:
            while up.setdefault(i, i) != i:
                up[i] = i = up[up[i]]
            return i

        for i, j in zip(pdf["_i"], pdf["_j"]):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
        items = sorted(up)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "_i": items, "component": [root(i) for i in items]})[[*keys, "_i", "component"]]

    found = links.groupBy(*keys).applyInPandas(close, fields).withColumnRenamed("_i", item)
    return rows.join(found, [*keys, item], "left").withColumn("component", F.coalesce("component", F.col(item).cast("long")))


def density_clusters(x: np.ndarray, least: int = 5) -> np.ndarray:
    """Hierarchical density clusters of unit rows by Euclidean distance, -1 for noise.

    Rows are joined by the spanning tree of their mutual reachability (the larger of their distance and of the distances to
    their ``least``-th neighbours).  Of its hierarchy, branches of ``least`` rows or more count as clusters, and those that
    outlast what they split into are chosen.
    """
    n = len(x)
    if n < 2 * least:
        return np.full(n, -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, norm, out=x.copy(), where=norm > 0)
    d = np.sqrt(np.maximum(0, 2 - 2 * u @ u.T))
    core = np.sort(d, axis=1)[:, min(least, n - 1)]
    reach = np.maximum(np.maximum(core[:, None], core[None, :]), d)
    # Prim's tree
    best, source, out, edges = reach[0].copy(), np.zeros(n, int), np.ones(n, bool), []
    out[0] = False
    for _ in range(n - 1):
        j = int(np.argmin(np.where(out, best, np.inf)))
        edges.append((best[j], int(source[j]), j))
        out[j] = False
        closer = out & (reach[j] < best)
        best[closer], source[closer] = reach[j][closer], j
    return clusters_of_tree(n, edges, least)


def clusters_of_tree(n: int, edges: list[tuple[float, int, int]], least: int) -> np.ndarray:
    """Clusters of n rows, -1 for noise, from the edges (length, row, row) of their spanning tree."""
    node, size, kids, top = list(range(n)), [1] * n, {}, list(range(n))

    def root(i: int) -> int:
        while node[i] != i:
            node[i] = i = node[node[i]]
        return i

    for far, i, j in sorted(edges):
        a, b = root(i), root(j)
        if size[top[a]] < size[top[b]]:
            a, b = b, a
        new = len(size)
        size.append(size[top[a]] + size[top[b]])
        kids[new] = (top[a], top[b], max(far, 1e-12))
        node[b], top[a] = a, new
    # the branches: from each, how long it lasts and what it splits into
    whole = len(size) - 1
    born, stability, splits, order, todo = {whole: 0.0}, {}, {}, [], [whole]
    while todo:
        k = todo.pop()
        order.append(k)
        here, total, below = k, 0.0, []
        while here in kids:
            a, b, far = kids[here]
            density = 1 / far
            big = [c for c in (a, b) if size[c] >= least]
            total += (density - born[k]) * (size[here] if len(big) != 1 else size[here] - size[big[0]])
            if len(big) != 1:
                below = [(c, density) for c in big]
                break
            here = big[0]
        stability[k], splits[k] = total, [c for c, _ in below]
        born.update(below)
        todo += splits[k]
    # children come after their branch in this order, so they are weighed first
    own, gains = {}, {}
    for k in reversed(order):
        under = sum(gains[c] for c in splits[k])
        own[k] = not splits[k] or stability[k] >= under
        gains[k] = stability[k] if own[k] else under
    labels, number, todo = np.full(n, -1), 0, [whole]
    while todo:
        k = todo.pop()
        if not own[k]:
            todo += splits[k]
        elif k != whole:
            rows = [k]
            while rows:
                r = rows.pop()
                if r < n:
                    labels[r] = number
                else:
                    rows += kids[r][:2]
            number += 1
    return labels


def noise_apart(labels: np.ndarray) -> np.ndarray:
    """Each row of noise (-1) as a cluster of its own."""
    out, free = labels.copy(), int(labels.max(initial=-1)) + 1
    for i in np.flatnonzero(labels < 0).tolist():
        out[i], free = free, free + 1
    return out
