"""Queries of the risk detector: normalisation, thresholds, metrics, folds, selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import detector as dt
from tidemark.plans.views import SCORED_LABELS, scored_labels


def _rows(spark, sf):
    return scored_labels(spark, sf)


def _split(spark, sf):
    s = _rows(spark, sf)
    return s.filter("split = 't0'"), s.filter("split = 'future'")


_RANK = f"WITH {SCORED_LABELS}, r AS (SELECT score FROM scored WHERE split = 't0'), v AS (SELECT * FROM scored WHERE split = 'future'), c AS (SELECT doc_id, (SELECT count(*) FROM r WHERE r.score < v.score) AS below, (SELECT count(*) FROM r WHERE r.score <= v.score) AS upto, (SELECT count(*) FROM r) AS total FROM v)"


@query(f"{_RANK} SELECT doc_id, round((below + upto) / (2.0 * total), 6) AS mid_rank FROM c")
def ecdf_midrank(spark, sf):
    r = dt.rank_counts(*_split(spark, sf), "score")
    return r.select("doc_id", F.round(dt.mid_rank(F.col("below"), F.col("upto"), F.col("total")), 6).alias("mid_rank"))


@query(f"{_RANK} SELECT doc_id, round(greatest(1e-4, least(1 - 1e-4, (upto - 0.5) / total)), 6) AS ecdf FROM c")
def ecdf_clipped(spark, sf):
    r = dt.rank_counts(*_split(spark, sf), "score")
    return r.select("doc_id", F.round(dt.clipped_ecdf(F.col("upto"), F.col("total")), 6).alias("ecdf"))


@query(f"{_RANK}, p AS (SELECT doc_id, (below + upto) / (2.0 * total) AS m, greatest(1e-4, least(1 - 1e-4, (upto - 0.5) / total)) AS e FROM c) SELECT doc_id, round((1 - m) * (1 - e), 6) AS low_low, round(m * (1 - e), 6) AS high_low, round((1 - m) * e, 6) AS low_high, round(m * e, 6) AS high_high FROM p")
def quadrant_scores(spark, sf):
    """Products of the shift and uncertainty axes."""
    r = dt.rank_counts(*_split(spark, sf), "score").select("doc_id", dt.mid_rank(F.col("below"), F.col("upto"), F.col("total")).alias("m"), dt.clipped_ecdf(F.col("upto"), F.col("total")).alias("e"))
    m, e = F.col("m"), F.col("e")
    return r.select("doc_id", F.round((1 - m) * (1 - e), 6).alias("low_low"), F.round(m * (1 - e), 6).alias("high_low"), F.round((1 - m) * e, 6).alias("low_high"), F.round(m * e, 6).alias("high_high"))


@query(f"""WITH {SCORED_LABELS}, q AS (SELECT quantile_cont(score, 0.5) AS med, (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / 1.349 AS iqr, stddev_pop(score) AS sd FROM scored WHERE split = 't0')
  SELECT doc_id, round(greatest(-8.0, least(8.0, (score - med) / CASE WHEN iqr >= 1e-12 THEN iqr WHEN sd >= 1e-12 THEN sd ELSE 1.0 END)), 6) AS robust_z FROM scored, q WHERE split = 'future'""")
def robust_z(spark, sf):
    """Future scores against the frozen median and scale of the first update."""
    t0, future = _split(spark, sf)
    return future.crossJoin(F.broadcast(dt.robust_scale(t0, "score"))).select("doc_id", F.round(dt.robust_z(F.col("score")), 6).alias("robust_z"))


@query()
def rank_gaussian(spark, sf):
    """Normal quantiles of the clipped ECDF."""
    def ppf(p: pd.Series) -> pd.Series:
        from statistics import NormalDist

        inverse = NormalDist().inv_cdf
        return p.map(inverse).astype(float)

    r = dt.rank_counts(*_split(spark, sf), "score")
    return r.select("doc_id", F.round(F.pandas_udf(ppf, "double")(dt.clipped_ecdf(F.col("upto"), F.col("total"))), 6).alias("rank_gaussian"))


@query(f"WITH {SCORED_LABELS}, s AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM scored WHERE y = 0) SELECT 0.9 AS q, score AS threshold FROM s WHERE i = ceil((n - 1) * 0.9)")
def quantile_higher(spark, sf):
    return dt.quantile_higher(_rows(spark, sf).filter("y = 0"), "score", 0.9).select(F.lit(0.9).alias("q"), "threshold")


_METRIC = """SELECT {k} count(*) FILTER (WHERE y = 1 AND hit) AS tp, count(*) FILTER (WHERE y = 0 AND hit) AS fp, count(*) FILTER (WHERE y = 1 AND NOT hit) AS fn, count(*) FILTER (WHERE y = 0 AND NOT hit) AS tn, avg(CAST(y AS DOUBLE)) AS prev FROM {t} {g}"""
_OUT = """CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1, round(coalesce(tp / nullif(tp + fp, 0), 0.0) / nullif(prev, 0), 6) AS risk_lift"""


def _rounded(c, keys=()):
    return c.select(*keys, "tp", "fp", "fn", "tn", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "risk_lift")))


@query(f"WITH {SCORED_LABELS}, h AS (SELECT *, score >= 0.03 AS hit FROM scored), c AS ({_METRIC.format(k='split,', t='h', g='GROUP BY split')}) SELECT split, {_OUT} FROM c")
def confusion_metrics(spark, sf):
    return _rounded(dt.confusion(_rows(spark, sf), 0.03, ["split"]), ["split"])


_AUC = """c AS (SELECT score, sum(y) AS p, sum(1 - y) AS m FROM scored GROUP BY 1), u AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(m) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pos, sum(m) OVER () AS negs FROM c)"""


@query(f"WITH {SCORED_LABELS}, {_AUC} SELECT round(sum(m * (tp - p) + 0.5 * m * p) / (any_value(pos) * any_value(negs)), 6) AS auroc, round(sum(p / pos * (tp / (tp + fp))), 6) AS auprc FROM u")
def auroc_ap(spark, sf):
    return dt.auroc_ap(_rows(spark, sf)).select(F.round("auroc", 6).alias("auroc"), F.round("auprc", 6).alias("auprc"))


_BEST = """cand AS (SELECT DISTINCT t FROM (SELECT score AS t FROM scored UNION ALL SELECT 0.0 UNION ALL SELECT 1.0)), e AS (SELECT t, sum(CASE WHEN score >= t THEN y ELSE 0 END) AS tp, sum(CASE WHEN score >= t THEN 1 - y ELSE 0 END) AS fp, sum(y) AS pos FROM cand, scored GROUP BY 1),
  f AS (SELECT t, round(coalesce(2.0 * tp / nullif(tp + fp + pos, 0), 0.0), 12) AS f1, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 12) AS precision FROM e), best AS (SELECT * FROM f ORDER BY f1 DESC, precision DESC, t DESC LIMIT 1)"""


@query(f"WITH {SCORED_LABELS}, {_BEST} SELECT round(f1, 6) AS f1, round(precision, 6) AS precision, t AS threshold FROM best")
def best_f1_threshold(spark, sf):
    return dt.best_f1(_rows(spark, sf)).select(F.round("f1", 6).alias("f1"), F.round("precision", 6).alias("precision"), "threshold")


@query(f"WITH {SCORED_LABELS.replace('FROM labels l JOIN', 'FROM labels l JOIN')}, t0 AS (SELECT * FROM scored WHERE split = 't0'), {_BEST.replace('scored', 't0')}, h AS (SELECT s.*, score >= t AS hit FROM scored s, best WHERE split = 'future'), c AS ({_METRIC.format(k='', t='h', g='')}) SELECT {_OUT} FROM c")
def frozen_transfer(spark, sf):
    """The threshold chosen on the first update, applied to the future without a refit."""
    t0, future = _split(spark, sf)
    best = dt.best_f1(t0).select(F.col("threshold").alias("cut"))
    return _rounded(dt.confusion(future.crossJoin(F.broadcast(best)), F.col("cut")))


@query(f"WITH {SCORED_LABELS}, f AS (SELECT doc_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('5|' || CAST(doc_id AS VARCHAR))) - 1) % 5 AS INTEGER) AS fold FROM scored) SELECT * FROM f")
def stratified_folds(spark, sf):
    return dt.stratified_folds(_rows(spark, sf), 5, "5").select("doc_id", "y", "fold")


@query(f"""WITH {SCORED_LABELS}, s AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM scored WHERE y = 0), t AS (SELECT score AS cut FROM s WHERE i = ceil((n - 1) * 0.9)), h AS (SELECT y, score >= cut AS hit FROM scored, t)
  SELECT round(avg(CASE WHEN y = 0 THEN CAST(hit AS DOUBLE) END), 6) AS false_alarm_rate, round(avg(CASE WHEN y = 1 THEN CAST(hit AS DOUBLE) END), 6) AS detection_rate FROM h""")
def stable_null_control(spark, sf):
    """Alarm rates at the 90 % quantile of stable events."""
    rows = _rows(spark, sf)
    h = rows.crossJoin(F.broadcast(dt.quantile_higher(rows.filter("y = 0"), "score", 0.9))).withColumn("hit", (F.col("score") >= F.col("threshold")).cast("double"))
    return h.agg(F.round(F.avg(F.when(F.col("y") == 0, F.col("hit"))), 6).alias("false_alarm_rate"), F.round(F.avg(F.when(F.col("y") == 1, F.col("hit"))), 6).alias("detection_rate"))


_MODELS = "m AS (SELECT p_brand AS model, p_type AS representation, round(avg(p_retailprice) / 2000, 6) AS f1, round(avg(p_size) / 50, 6) AS auprc, round(min(p_size) / 50.0, 6) AS auroc FROM part GROUP BY 1, 2)"


@query(f"WITH {_MODELS}, b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, auprc DESC, auroc DESC, representation) AS n, max(f1) OVER () AS top FROM m) SELECT model, representation, f1, CAST(f1 >= top - 0.05 AS INTEGER) AS within_margin FROM b WHERE n = 1")
def model_selection(spark, sf):
    """Per model the representation that sorts first by F1, AUPRC, AUROC; flagged if close to the best."""
    from tidemark.plans.views import table

    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("model"), F.col("p_type").alias("representation")).agg(F.round(F.avg("p_retailprice") / 2000, 6).alias("f1"), F.round(F.avg("p_size") / 50, 6).alias("auprc"), F.round(F.min("p_size") / 50, 6).alias("auroc"))
    w = Window.partitionBy("model").orderBy(F.desc("f1"), F.desc("auprc"), F.desc("auroc"), "representation")
    top = p.agg(F.max("f1").alias("top"))
    return p.withColumn("n", F.row_number().over(w)).filter("n = 1").crossJoin(F.broadcast(top)).select("model", "representation", "f1", (F.col("f1") >= F.col("top") - 0.05).cast("int").alias("within_margin"))


@query()
def logistic_detector(spark, sf):
    """Out-of-fold probabilities of a logistic detector on the score and its square (one fit a fold)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = dt.stratified_folds(_rows(spark, sf), 3, "oof").withColumns({"x": F.col("score") * 10, "xx": F.col("score") * F.col("score") * 100, "label": F.col("y").cast("double")})
    rows = VectorAssembler(inputCols=["x", "xx"], outputCol="features").transform(rows)
    out = None
    for fold in range(3):
        model = LogisticRegression(regParam=0.001, standardization=False).fit(rows.filter(F.col("fold") != fold))
        part = model.transform(rows.filter(F.col("fold") == fold)).select("doc_id", "fold", "y", "probability")
        out = part if out is None else out.unionByName(part)
    from pyspark.ml.functions import vector_to_array

    return out.select("doc_id", "fold", "y", F.round(vector_to_array("probability")[1], 6).alias("probability"))
