"""Queries of prompts, audits, cross tables and unions of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import probe as pb
from tidemark.operators import resample as rs
from tidemark.operators.detector import numbered
from tidemark.plans.views import ARTICLES, SCORED_LABELS, articles, scored_labels, table

_ROUND = "CAST(round(avg(CASE WHEN {0} THEN 1.0::DOUBLE ELSE 0 END), 6) AS DOUBLE)"


@query("""WITH q AS (SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN '2021-12-22T00:00:00' WHEN 'assistant' THEN '2022-08-31T00:00:00' END AS t FROM conversations)
  SELECT conv_id, turn, CASE WHEN t IS NULL THEN 'Question: ' || text ELSE 'As of ' || split_part(t, 'T', 1) || ': ' || text END AS prompt FROM q""")
def prompt_times(spark, sf):
    """Prompts that name the date of their snapshot where the condition has one."""
    t = F.when(F.col("role") == "user", "2021-12-22T00:00:00").when(F.col("role") == "assistant", "2022-08-31T00:00:00")
    q = table(spark, sf, "conversations").withColumn("t", t)
    return q.select("conv_id", "turn", F.when(F.col("t").isNull(), F.concat(F.lit("Question: "), "text")).otherwise(F.concat(F.lit("As of "), F.split_part("t", F.lit("T"), F.lit(1)), F.lit(": "), "text")).alias("prompt"))


@query(f"""WITH {ARTICLES} SELECT lang, CAST(count(*) AS BIGINT) AS n, {_ROUND.format("length(text) >= 80")} AS long_enough, {_ROUND.format("ts <= TIMESTAMP '2023-06-30'")} AS before_cutoff, {_ROUND.format("contains(text, chr(10))")} AS has_lines,
  round(avg(CASE WHEN length(text) >= 80 THEN CAST(ts <= TIMESTAMP '2023-06-30' AS INTEGER) END), 6) AS before_if_long FROM articles GROUP BY 1""")
def coverage_audit(spark, sf):
    """Rates by language; a rate without a denominator is null."""
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    long, before = F.length("text") >= 80, F.col("ts") <= F.lit("2023-06-30").cast("timestamp")
    return articles(spark, sf).groupBy("lang").agg(
        F.count("*").alias("n"), rate(long).alias("long_enough"), rate(before).alias("before_cutoff"), rate(F.contains("text", F.lit("\n"))).alias("has_lines"), rate(F.when(long, before)).alias("before_if_long")
    )


@query(f"WITH {ARTICLES}, d AS (SELECT article_id, ts, count(*) AS c FROM articles WHERE ts <= TIMESTAMP '2023-06-30' GROUP BY 1, 2) SELECT CAST(count(*) AS BIGINT) AS versions, CAST(count(DISTINCT article_id) AS BIGINT) AS articles, CAST(sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated FROM d")
def cutoff_audit(spark, sf):
    """What a cutoff lets through: versions, articles and repeated versions."""
    d = articles(spark, sf).filter("ts <= timestamp'2023-06-30'").groupBy("article_id", "ts").agg(F.count("*").alias("c"))
    per = d.groupBy("article_id").agg(F.count("*").alias("v"), F.sum((F.col("c") > 1).cast("int")).alias("r"))
    return per.agg(F.sum("v").alias("versions"), F.count("*").alias("articles"), F.sum("r").alias("repeated"))


@query("""SELECT o_orderpriority AS priority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS o, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS p FROM orders GROUP BY 1""")
def crosstab_counts(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return c.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


_DRAW = "(('0x' || substr(md5('cls|' || CAST(r AS VARCHAR) || '|' || CAST(slot AS VARCHAR)), 1, 8))::BIGINT % n)"


@query(f"""WITH {SCORED_LABELS}, p AS (SELECT y, CAST(score >= 0.03 AS INTEGER) AS hit, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM scored), k AS (SELECT r, {_DRAW} AS pos FROM (SELECT r, n, unnest(range(0, n)) AS slot FROM (SELECT unnest(range(0, 40)) AS r, any_value(n) AS n FROM p))),
  m AS (SELECT r, sum(y * hit) AS tp, sum((1 - y) * hit) AS fp, sum(y) AS pos, count(*) AS n FROM k JOIN p USING (pos) GROUP BY 1), v AS (SELECT coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, tp / pos AS recall FROM m WHERE pos > 0 AND pos < n)
  SELECT CAST(count(*) AS BIGINT) AS rounds, round(quantile_cont(precision, 0.025), 6) AS precision_low, round(quantile_cont(precision, 0.975), 6) AS precision_high, round(quantile_cont(recall, 0.025), 6) AS recall_low, round(quantile_cont(recall, 0.975), 6) AS recall_high FROM v""")
def classifier_bootstrap(spark, sf):
    """Intervals of precision and recall; rounds that drew one class are left out."""
    rows = scored_labels(spark, sf).select("doc_id", "y", (F.col("score") >= 0.03).cast("int").alias("hit")).withColumn("one", F.lit(1))
    rows = numbered(rows, "doc_id")
    drawn = rs.rounds_of(rows, "one", 40, "cls").join(rows.select(F.col("pos").alias("pick"), "y", "hit"), "pick")
    y, hit = F.col("y"), F.col("hit")
    m = drawn.groupBy("round").agg(F.sum(y * hit).alias("tp"), F.sum((1 - y) * hit).alias("fp"), F.sum("y").alias("pos"), F.count("*").alias("n")).filter("pos > 0 and pos < n")
    v = m.select(F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"), (F.col("tp") / F.col("pos")).alias("recall"))
    q = v.agg(F.count("*").alias("rounds"), *(F.percentile(c, F.array(F.lit(0.025), F.lit(0.975))).alias(c) for c in ("precision", "recall")))
    return q.select("rounds", *(F.round(F.col(c)[i], 6).alias(f"{c}_{n}") for c in ("precision", "recall") for i, n in enumerate(("low", "high"))))


@query("""WITH u AS (SELECT c_custkey AS id, c_acctbal AS v, 0 AS run FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, c_acctbal + 1, 1 FROM customer), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY run) AS n FROM u) SELECT id, round(v, 2) AS v, run FROM f WHERE n = 1""")
def union_first_run(spark, sf):
    """Runs put together, the first run that has an id wins."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    u = c.filter("v > 0").withColumn("run", F.lit(0)).unionByName(c.withColumn("v", F.col("v") + 1).withColumn("run", F.lit(1)))
    best = u.groupBy("id").agg(F.min_by(F.struct("v", "run"), "run").alias("s"))
    return best.select("id", F.round("s.v", 2).alias("v"), "s.run")


@query("""WITH x AS (SELECT s_suppkey AS id, s_nationkey % 3 AS stratum, round(s_acctbal / 10000, 4) AS risk, s_acctbal > 7000 AS target, s_suppkey % 5 AS relation, s_suppkey % 2 AS style FROM supplier), q AS (SELECT stratum, count(*) AS quota FROM x WHERE target GROUP BY 1),
  r AS (SELECT x.*, coalesce(quota, 0) AS quota, row_number() OVER (PARTITION BY x.stratum ORDER BY risk DESC, id) AS n FROM x LEFT JOIN q ON q.stratum = x.stratum WHERE NOT target), c AS (SELECT relation, style, count(*) AS common FROM x WHERE target GROUP BY 1, 2),
  o AS (SELECT r.id, r.stratum, row_number() OVER (ORDER BY common DESC NULLS LAST, CASE WHEN common IS NOT NULL THEN r.relation END NULLS FIRST, CASE WHEN common IS NOT NULL THEN r.style END NULLS FIRST, risk DESC, id) AS k FROM r LEFT JOIN c ON c.relation = r.relation AND c.style = r.style WHERE n > quota)
  SELECT id, stratum FROM r WHERE n <= quota UNION ALL SELECT id, stratum FROM o WHERE k <= (SELECT count(*) FROM x WHERE target) - (SELECT count(*) FROM r WHERE n <= quota)""")
def stratum_controls(spark, sf):
    """As many controls of each stratum as it has targets, the riskiest first; what a stratum lacks comes by relation and style, then from any."""
    x = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).alias("stratum"), F.round(F.col("s_acctbal") / 10000, 4).alias("risk"), (F.col("s_acctbal") > 7000).alias("target"),
        (F.col("s_suppkey") % 5).alias("relation"), (F.col("s_suppkey") % 2).alias("style"),
    )
    return pb.quota_controls(x.filter("target"), x.filter("not target"), ["stratum"], ["relation", "style"]).select("id", "stratum")
