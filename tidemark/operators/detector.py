"""Reference-frozen normalisation, threshold choice and metrics of a risk score.

Cumulative counts run over distinct scores, which are pre-aggregated, so no window sees single rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_counts(reference: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """values with below and upto: reference rows less than, and at most, the value; and their number total.

    A range join would compare all pairs: both sides are put in one order instead, with counts per distinct
    value.  The running count goes over blocks of distinct values and then within each block.
    """
    r = reference.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("c"))
    v = values.select(F.col(column).alias("x")).distinct().withColumn("c", F.lit(0).cast("long"))
    points = r.unionByName(v).groupBy("x").agg(F.sum("c").alias("c"))
    upto = prefix_sum(points, "x", "c", "upto")
    total = reference.agg(F.count("*").alias("total"))
    keyed = upto.select(F.col("x").alias(column), (F.col("upto") - F.col("c")).alias("below"), "upto")
    return values.join(keyed, column).crossJoin(F.broadcast(total))


#: Distinct values of a block of a running sum.
BLOCK = 100_000


def numbered(rows: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """rows with their place (from 0) in the order of a unique key, without a window over the whole table."""
    points = rows.select(key).withColumn("_one", F.lit(1).cast("long"))
    return rows.join(prefix_sum(points, key, "_one", name).select(key, (F.col(name) - 1).alias(name)), key)


def quantiles(rows: DataFrame, column: str, qs: list[float]) -> DataFrame:
    """One row q0, q1, ...: exact quantiles, linear between the values on both sides, from counts of distinct values."""
    points = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("c")).persist()
    upto = prefix_sum(points, "x", "c", "upto").crossJoin(F.broadcast(points.agg(F.sum("c").alias("n"))))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("x")))
    place = lambda q: (F.col("n") - 1) * F.lit(q)
    out = upto.agg(F.first("n").alias("n"), *(f(at(g(place(q)))).alias(f"{k}{i}") for i, q in enumerate(qs) for k, g, f in (("lo", F.floor, lambda c: c), ("hi", F.ceil, lambda c: c))))
    part = lambda q: (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
    return out.select(*((F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * part(q)).alias(f"q{i}") for i, q in enumerate(qs)))


def prefix_sum(points: DataFrame, order: str, value: str, name: str, blocks: int | None = None) -> DataFrame:
    """Running sum over distinct ``order`` values: in range blocks in parallel, plus the sum of the blocks before.

    There is a block for each ``BLOCK`` values, so a block's window does not grow with the table.
    """
    points = points.persist()
    blocks = blocks or max(2, -(-points.count() // BLOCK))
    cuts = points.filter(F.col(order).isNotNull()).agg(F.percentile_approx(order, F.array(*(F.lit(i / blocks) for i in range(1, blocks))), 1000).alias("cuts"))
    block = F.size(F.filter("cuts", lambda c: c < F.col(order)))
    dealt = points.crossJoin(F.broadcast(cuts)).withColumn("block", block).drop("cuts")
    sums = dealt.groupBy("block").agg(F.sum(value).alias("s"))
    before = sums.select("block", F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    w = Window.partitionBy("block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(before), "block").withColumn(name, F.sum(value).over(w) + F.col("base")).drop("block", "base")


def mid_rank(below: Column, upto: Column, total: Column) -> Column:
    return (below + upto) / (2.0 * total)


def clipped_ecdf(upto: Column, total: Column) -> Column:
    return F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), (upto - 0.5) / total))


def robust_scale(reference: DataFrame, column: str) -> DataFrame:
    """One row (median, scale): scale is IQR / 1.349, else the deviation, else 1."""
    q = quantiles(reference, column, [0.25, 0.5, 0.75]).crossJoin(F.broadcast(reference.agg(F.stddev_pop(column).alias("sd"))))
    iqr = (F.col("q2") - F.col("q0")) / 1.349
    return q.select(F.col("q1").alias("median"), F.when(iqr >= 1e-12, iqr).when(F.col("sd") >= 1e-12, F.col("sd")).otherwise(1.0).alias("scale"))


def robust_z(value: Column) -> Column:
    return F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (value - F.col("median")) / F.col("scale")))


def quantile_higher(rows: DataFrame, column: str, q: float) -> DataFrame:
    """The sorted value at ceil((n - 1) q), found through counts of distinct values."""
    points = rows.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("c"))
    upto = prefix_sum(points, "x", "c", "upto")
    n = rows.agg(F.count("*").alias("n"))
    return upto.crossJoin(F.broadcast(n)).filter(F.col("upto") > F.ceil((F.col("n") - 1) * F.lit(q))).agg(F.min("x").alias("threshold"))


def confusion(rows: DataFrame, threshold: Column | float, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and risk lift; an empty denominator gives 0 (lift: null)."""
    hit, y = F.col("score") >= threshold, F.col("y") == 1
    n = lambda c: F.sum(c.cast("long"))
    c = rows.groupBy(*(keys or [])).agg(n(y & hit).alias("tp"), n(~y & hit).alias("fp"), n(y & ~hit).alias("fn"), n(~y & ~hit).alias("tn"), F.avg(y.cast("double")).alias("prevalence"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": precision, "recall": recall, "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))}).withColumn("risk_lift", F.try_divide("precision", "prevalence"))


def _curve(rows: DataFrame) -> DataFrame:
    """Per distinct score: positives and negatives with it, and at or above it, and their totals."""
    by = rows.groupBy("score").agg(F.sum("y").cast("long").alias("p"), F.sum(1 - F.col("y")).cast("long").alias("m"))
    up = prefix_sum(prefix_sum(by.withColumn("neg", -F.col("score")), "neg", "p", "tp"), "neg", "m", "fp").drop("neg")
    totals = rows.agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("negs"))
    return up.crossJoin(F.broadcast(totals))


def auroc_ap(rows: DataFrame) -> DataFrame:
    """AUROC with ties at half weight, and average precision; null for one class."""
    c = _curve(rows)
    wins = F.sum(F.col("m") * (F.col("tp") - F.col("p")) + 0.5 * F.col("m") * F.col("p"))
    ap = F.sum(F.try_divide(F.col("p"), F.col("pos")) * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
    return c.agg(F.try_divide(wins, F.first("pos") * F.first("negs")).alias("auroc"), F.when(F.first("negs") > 0, ap).alias("auprc"))


def auroc_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auroc) of each group, ties at half weight; null for one class.  Ranks run over a group's distinct scores."""
    by = rows.groupBy(*keys, "score").agg(F.sum("y").cast("long").alias("p"), F.sum(1 - F.col("y")).cast("long").alias("m"))
    up = by.withColumn("tp", F.sum("p").over(Window.partitionBy(*keys).orderBy(F.desc("score"))))
    wins = F.sum(F.col("m") * (F.col("tp") - F.col("p")) + 0.5 * F.col("m") * F.col("p"))
    return up.groupBy(*keys).agg(F.try_divide(wins, F.sum("p") * F.sum("m")).alias("auroc"))


def metrics_by(rows: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """(keys, auroc, auprc, f1, precision, threshold) of each group at its best threshold, in one plan.

    Scores of 0 to 1 are rounded, so a group has at most 10 ** digits + 1 of them, and its window is bounded.
    """
    by = rows.groupBy(*keys, F.round("score", digits).alias("score")).agg(F.sum("y").cast("long").alias("p"), F.sum(1 - F.col("y")).cast("long").alias("m"))
    down = Window.partitionBy(*keys).orderBy(F.desc("score"))
    all_ = Window.partitionBy(*keys)
    up = by.select("*", F.sum("p").over(down).alias("tp"), F.sum("m").over(down).alias("fp"), F.sum("p").over(all_).alias("pos"), F.sum("m").over(all_).alias("negs"))
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    best = F.struct(F.round(2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos")), 12).alias("f1"), F.round(precision, 12).alias("precision"), F.col("score").alias("threshold"))
    wins = F.sum(F.col("m") * (F.col("tp") - F.col("p")) + 0.5 * F.col("m") * F.col("p"))
    out = up.groupBy(*keys).agg(F.try_divide(wins, F.first("pos") * F.first("negs")).alias("auroc"), F.sum(F.try_divide(F.col("p"), F.col("pos")) * precision).alias("auprc"), F.max(best).alias("_b"))
    return out.select(*keys, "auroc", "auprc", "_b.*")


def best_f1(rows: DataFrame) -> DataFrame:
    """The threshold (a score, 0 or 1) with the largest (F1, precision, threshold)."""
    c = _curve(rows)
    cand = c.select("score", "tp", "fp", "pos")
    n = cand.agg(F.max("pos").alias("pos"), F.max("tp").alias("tp0"), F.max("fp").alias("fp0"), F.coalesce(F.max(F.when(F.col("score") >= 1, F.col("tp"))), F.lit(0)).alias("tp1"), F.coalesce(F.max(F.when(F.col("score") >= 1, F.col("fp"))), F.lit(0)).alias("fp1"))
    ends = n.select(F.explode(F.array(F.struct(F.lit(0.0).alias("score"), F.col("tp0").alias("tp"), F.col("fp0").alias("fp"), "pos"), F.struct(F.lit(1.0).alias("score"), F.col("tp1").alias("tp"), F.col("fp1").alias("fp"), "pos"))).alias("s")).select("s.*")
    f1, precision = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    return cand.unionByName(ends).select(F.struct(F.round(f1, 12).alias("f1"), F.round(precision, 12).alias("precision"), F.col("score").alias("threshold")).alias("s")).agg(F.max("s").alias("s")).select("s.*")


def stratified_folds(rows: DataFrame, k: int, salt: str) -> DataFrame:
    """fold 0 .. k - 1 by the md5 order within each class, so that folds are alike and reproducible.

    A class is put in order in blocks by the first digits of the hash; a block's first place is the number of rows in the
    blocks before it, so no window holds a whole class.
    """
    h = F.md5(F.concat(F.lit(f"{salt}|"), F.col("doc_id").cast("string")))
    dealt = rows.withColumn("_h", h).withColumn("_b", F.left("_h", F.lit(3)))
    sizes = dealt.groupBy("y", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("y").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("y", "_b", before.alias("_base"))
    place = F.col("_base") + F.row_number().over(Window.partitionBy("y", "_b").orderBy("_h", "doc_id")) - 1
    return dealt.join(F.broadcast(bases), ["y", "_b"]).withColumn("fold", (place % k).cast("int")).drop("_h", "_b", "_base")
