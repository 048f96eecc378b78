"""Queries of paired and resampling statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import resample as rs
from tidemark.operators.detector import numbered
from tidemark.plans.views import QUESTION_METRICS, SCORED_LABELS, question_metrics, scored_labels

_DIFF = f"""{QUESTION_METRICS}, d0 AS (SELECT a.question_id, round(b.accuracy - a.accuracy, 6) AS d FROM question_metrics a JOIN question_metrics b ON a.question_id = b.question_id AND a.condition = 'current_only' AND b.condition = 'stale_only'),
  d AS (SELECT question_id, d, question_id % 4 AS g, row_number() OVER (PARTITION BY question_id % 4 ORDER BY question_id) - 1 AS pos FROM d0)"""


def _diffs(spark, sf):
    q = question_metrics(spark, sf)
    a, b = (q.filter(F.col("condition") == c).select("question_id", F.col("accuracy").alias(n)) for c, n in (("current_only", "a"), ("stale_only", "b")))
    d = a.join(b, "question_id").select("question_id", F.round(F.col("b") - F.col("a"), 6).alias("d"), (F.col("question_id") % 4).alias("g"))
    return d.withColumn("pos", (F.row_number().over(Window.partitionBy("g").orderBy("question_id")) - 1).cast("long"))


def _draw(seed: str, r: str, s: str, n: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || CAST({r} AS VARCHAR) || '|' || CAST({s} AS VARCHAR)), 1, 8))::BIGINT % {n})"


@query(f"""WITH {_DIFF}, n AS (SELECT g, count(*) AS n FROM d GROUP BY 1), s AS (SELECT g, n, r, unnest(range(0, n)) AS slot FROM (SELECT g, n, unnest(range(0, 200)) AS r FROM n)), k AS (SELECT g, r, {_draw('boot', 'r', 'slot', 'n')} AS pick FROM s),
  m AS (SELECT k.g, r, avg(d) AS m FROM k JOIN d ON d.g = k.g AND d.pos = k.pick GROUP BY 1, 2), q AS (SELECT g, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
  SELECT q.g, round(avg(d.d), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM q JOIN d ON d.g = q.g GROUP BY 1""")
def bootstrap_ci(spark, sf):
    """Mean paired difference and its bootstrap interval, by group."""
    b = rs.bootstrap_mean(_diffs(spark, sf), "g", "d", 200, "boot")
    return b.select("g", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query(f"""WITH {_DIFF}, o AS (SELECT g, abs(round(avg(d), 12)) AS observed FROM d GROUP BY 1), e AS (SELECT g, r, abs(round(avg(d * CASE WHEN {_draw('perm', 'r', 'pos', '2')} = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END), 12)) AS s FROM (SELECT *, unnest(range(0, 300)) AS r FROM d) GROUP BY 1, 2)
  SELECT o.g, round(CASE WHEN any_value(observed) = 0 THEN 1.0 ELSE (count(*) FILTER (WHERE s >= observed) + 1) / 301.0 END, 6) AS p FROM o JOIN e ON o.g = e.g GROUP BY 1""")
def permutation_p(spark, sf):
    return rs.sign_flip(_diffs(spark, sf), "g", "d", 300, "perm").select("g", F.round("p", 6).alias("p"))


@query(f"WITH {_DIFF} SELECT g, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN count(*) <= 1 OR stddev_samp(d) = 0 THEN 0.0 ELSE avg(d) / stddev_samp(d) END, 6) AS dz FROM d GROUP BY 1")
def cohens_dz(spark, sf):
    sd = F.coalesce(F.stddev_samp("d"), F.lit(0.0))
    return _diffs(spark, sf).groupBy("g").agg(F.count("*").alias("n"), F.round(F.when(sd == 0, 0.0).otherwise(F.avg("d") / sd), 6).alias("dz"))


@query(f"""WITH {_DIFF}, nz AS (SELECT g, d, abs(d) AS a FROM d WHERE d <> 0), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY g, a) AS t FROM nz),
  s AS (SELECT g, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS wp, sum((t * t - 1) / 48.0) AS ties FROM r GROUP BY 1) SELECT g, CAST(n AS BIGINT) AS n, round(wp, 6) AS w_plus, round((wp - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties), 6) AS z FROM s""")
def wilcoxon(spark, sf):
    """Signed ranks with tie correction: the sum of positive ranks and its normal score."""
    nz = _diffs(spark, sf).filter("d <> 0").select("g", "d", F.abs("d").alias("a"))
    same, order = Window.partitionBy("g", "a"), Window.partitionBy("g").orderBy("a")
    t = F.count("*").over(same)
    r = nz.withColumns({"rk": F.rank().over(order) + (t - 1) / 2.0, "t": t})
    n = F.col("n")
    s = r.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rk")).otherwise(0.0)).alias("wp"), F.sum((F.col("t") * F.col("t") - 1) / 48.0).alias("ties"))
    z = (F.col("wp") - n * (n + 1) / 4.0) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties"))
    return s.select("g", "n", F.round("wp", 6).alias("w_plus"), F.round(z, 6).alias("z"))


_CLUST = f"""{SCORED_LABELS}, c AS (SELECT doc_id, doc_id % 40 AS cluster, y, CAST(score >= 0.03 AS INTEGER) AS hit FROM scored), ids AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT cluster FROM c)),
  s AS (SELECT r, slot, n FROM (SELECT unnest(range(0, 100)) AS r, any_value(n) AS n FROM ids), LATERAL (SELECT unnest(range(0, n)) AS slot)), k AS (SELECT r, {_draw('clu', 'r', 'slot', 'n')} AS pos FROM s),
  m AS (SELECT r, sum(y * hit) AS tp, sum((1 - y) * hit) AS fp, sum(y * (1 - hit)) AS fn FROM k JOIN ids USING (pos) JOIN c USING (cluster) GROUP BY 1), f AS (SELECT coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM m)"""


@query(f"WITH {_CLUST} SELECT round(quantile_cont(f1, 0.025), 6) AS f1_low, round(quantile_cont(f1, 0.975), 6) AS f1_high, round(quantile_cont(recall, 0.025), 6) AS recall_low, round(quantile_cont(recall, 0.975), 6) AS recall_high FROM f")
def clustered_bootstrap(spark, sf):
    """Whole clusters are drawn; counts are summed per cluster before any draw."""
    c = scored_labels(spark, sf).select((F.col("doc_id") % 40).alias("cluster"), "y", (F.col("score") >= 0.03).cast("int").alias("hit"))
    y, hit = F.col("y"), F.col("hit")
    sums = c.groupBy("cluster").agg(F.sum(y * hit).alias("tp"), F.sum((1 - y) * hit).alias("fp"), F.sum(y * (1 - hit)).alias("fn"))
    sums = numbered(sums, "cluster").withColumn("one", F.lit(1))
    m = rs.rounds_of(sums, "one", 100, "clu").join(sums.withColumnRenamed("pos", "pick").drop("one"), "pick").groupBy("round").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    f1, recall = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    q = m.select(f1.alias("f1"), recall.alias("recall")).agg(*(F.percentile(x, F.array(F.lit(0.025), F.lit(0.975))).alias(x) for x in ("f1", "recall")))
    return q.select(*(F.round(F.col(x)[i], 6).alias(f"{x}_{n}") for x in ("f1", "recall") for i, n in enumerate(("low", "high"))))


@query(f"""WITH {QUESTION_METRICS}, l AS (SELECT question_id, metric, condition, v FROM (SELECT question_id, condition, unnest(['accuracy', 'semantic_entropy']) AS metric, unnest([accuracy, semantic_entropy]) AS v FROM question_metrics)),
  p AS (SELECT a.metric, b.condition, b.v - a.v AS d FROM l a JOIN l b ON a.question_id = b.question_id AND a.metric = b.metric AND a.condition = 'current_only' AND b.condition <> 'current_only')
  SELECT metric, condition, CAST(count(*) AS BIGINT) AS n, round(avg(d), 6) AS mean_diff, round(coalesce(avg(d) / nullif(stddev_samp(d), 0), 0.0), 6) AS dz FROM p GROUP BY 1, 2""")
def paired_table(spark, sf):
    """Each metric and comparison with the baseline: unpivot, pair, aggregate."""
    long = question_metrics(spark, sf).select("question_id", "condition", F.expr("stack(2, 'accuracy', accuracy, 'semantic_entropy', semantic_entropy) as (metric, v)"))
    base = long.filter("condition = 'current_only'").select("question_id", "metric", F.col("v").alias("b"))
    d = long.filter("condition <> 'current_only'").join(base, ["question_id", "metric"]).withColumn("d", F.col("v") - F.col("b"))
    sd = F.stddev_samp("d")
    return d.groupBy("metric", "condition").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_diff"), F.round(F.coalesce(F.try_divide(F.avg("d"), sd), F.lit(0.0)), 6).alias("dz"))


@query(f"""WITH {QUESTION_METRICS}, c AS (SELECT unnest(['current_only', 'mixed', 'stale_only']) AS condition), n AS (SELECT unnest([4, 8, 16, 32]) AS n), r AS (SELECT condition, accuracy, row_number() OVER (PARTITION BY condition ORDER BY question_id) AS rn FROM question_metrics)
  SELECT r.condition, n.n, round(avg(accuracy), 6) AS mean, round(var_pop(accuracy), 6) AS variance FROM r JOIN n ON r.rn <= n.n GROUP BY 1, 2""")
def stability_curve(spark, sf):
    """Metrics over the first n samples for growing n."""
    r = question_metrics(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("condition").orderBy("question_id"))).filter("rn <= 32")
    each = r.select("condition", "accuracy", "rn", F.explode(F.array(*map(F.lit, (4, 8, 16, 32)))).alias("n")).filter("rn <= n")
    return each.groupBy("condition", "n").agg(F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.var_pop("accuracy"), 6).alias("variance"))


