"""Queries of the evidence probe."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import probe as pb
from tidemark.plans.views import table

_ACC = "round(avg(CASE WHEN l_linenumber = {0} THEN CAST(l_returnflag = 'N' AS DOUBLE) END), 6) AS {1}"
PROBE = f"""probe AS (SELECT l_suppkey AS question_id, round(avg(CASE WHEN l_linenumber >= 6 THEN CAST(l_returnflag <> 'A' AS DOUBLE) END), 6) AS old, {', '.join(_ACC.format(i + 1, f'p{i + 1}') for i in range(5))},
  l_suppkey % 2 = 0 AS injected, l_suppkey % 3 = 0 AS moved FROM lineitem GROUP BY l_suppkey)"""


def _probe(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    n = (F.col("l_returnflag") == "N").cast("double")
    accs = [F.round(F.avg(F.when(F.col("l_linenumber") == i + 1, n)), 6).alias(f"p{i + 1}") for i in range(5)]
    old = F.round(F.avg(F.when(F.col("l_linenumber") >= 6, (F.col("l_returnflag") != "A").cast("double"))), 6).alias("old")
    return l.groupBy(F.col("l_suppkey").alias("question_id")).agg(old, *accs).withColumns({"injected": F.col("question_id") % 2 == 0, "moved": F.col("question_id") % 3 == 0})


_P = [f"p{i}" for i in range(1, 6)]
_LINKED = """CASE WHEN round(old - p1, 9) < 0.3 THEN 'p1_natural|no_degradation_on_probe_rerun' WHEN {2} AND injected THEN 'p2_support_presence|retrieval_coverage_failure' WHEN {2} THEN 'p2_support_presence|stochastic_recovery_without_context_change'
  WHEN {3} AND moved THEN 'p3_support_first|ranking_or_position_sensitivity' WHEN {3} THEN 'p3_support_first|stochastic_recovery_without_context_change' WHEN {4} THEN 'p4_evidence_only|evidence_extraction_or_context_complexity_failure'
  WHEN {5} THEN 'p5_fact_card|evidence_utilization_or_answer_realization_failure' ELSE 'none|persistent_after_explicit_fact' END"""
_BACK = {i: f"(round(p{i} - p1, 9) >= 0.02 AND p{i} >= greatest(0.0, round(old - 0.3, 9)))" for i in range(2, 6)}
_L = _LINKED.replace("{2}", _BACK[2]).replace("{3}", _BACK[3]).replace("{4}", _BACK[4]).replace("{5}", _BACK[5])


def _linked(spark, sf):
    p = [F.col(c) for c in _P]
    return _probe(spark, sf).withColumn("r", pb.linked_recovery(F.col("old"), p, F.col("injected"), F.col("moved"), 0.3, 0.02, 0.3))


@query(f"WITH {PROBE}, r AS (SELECT question_id, {_L} AS s FROM probe) SELECT question_id, split_part(s, '|', 1) AS stage, split_part(s, '|', 2) AS mechanism FROM r")
def mechanism_linked(spark, sf):
    return _linked(spark, sf).select("question_id", "r.stage", "r.mechanism")


@query(f"WITH {PROBE}, r AS (SELECT question_id % 2 AS cohort, {_L} AS s FROM probe) SELECT cohort, split_part(s, '|', 1) AS stage, split_part(s, '|', 2) AS mechanism, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2, 3")
def mechanism_counts(spark, sf):
    return _linked(spark, sf).groupBy((F.col("question_id") % 2).alias("cohort"), "r.stage", "r.mechanism").agg(F.count("*").alias("n"))


_HB = {i: f"(round(p{i} - p1, 9) >= g AND p{i} >= a)" for i in range(2, 6)}
_H = f"""CASE WHEN p1 >= 0.5 THEN 'no_failure_on_rerun' WHEN {_HB[2]} AND injected THEN 'retrieval_coverage_failure' WHEN {_HB[3]} AND moved THEN 'ranking_or_position_sensitivity' WHEN {_HB[4]} THEN 'evidence_extraction_or_context_complexity_failure'
  WHEN {_HB[5]} THEN 'evidence_utilization_or_answer_realization_failure' WHEN {_HB[2]} OR {_HB[3]} THEN 'stochastic_recovery_without_context_change' ELSE 'persistent_after_explicit_fact' END"""


@query(f"WITH {PROBE}, t AS (SELECT unnest([0.01, 0.03, 0.05]) AS g), u AS (SELECT unnest([0.3, 0.35]) AS a), r AS (SELECT g, a, {_H} AS mechanism FROM probe, t, u) SELECT CAST(g AS DOUBLE) AS gain, CAST(a AS DOUBLE) AS least, mechanism, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2, 3")
def recovery_grid(spark, sf):
    """Mechanisms under a grid of thresholds."""
    grid = F.explode(F.array(*(F.struct(F.lit(g).alias("gain"), F.lit(a).alias("least")) for g in (0.01, 0.03, 0.05) for a in (0.3, 0.35)))).alias("g")
    rows = _probe(spark, sf).select("*", grid)
    r = pb.historical_recovery([F.col(c) for c in _P], F.col("injected"), F.col("moved"), F.col("g.gain"), F.col("g.least"))
    return rows.select("g.gain", "g.least", r["mechanism"].alias("mechanism")).groupBy("gain", "least", "mechanism").agg(F.count("*").alias("n"))


_DOCS = """docs AS (SELECT doc_id // 8 AS q, doc_id, text AS d FROM documents), a AS (SELECT q, coalesce(list(d ORDER BY doc_id) FILTER (WHERE doc_id % 8 >= q % 6), []) AS cur, coalesce(list(d ORDER BY doc_id) FILTER (WHERE doc_id % 8 < q % 6), []) AS old FROM docs GROUP BY q)"""


def _contexts(spark, sf):
    """Whole documents, eight in a row a question; 0 to 5 of them are stale, by question, and all are used."""
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 8).alias("q"), "doc_id", F.col("text").alias("d"))
    stale = F.pmod("doc_id", F.lit(8)) < F.pmod("q", F.lit(6))
    of = lambda side: F.transform(F.array_sort(F.collect_list(F.when(stale == side, F.struct("doc_id", "d")))), lambda s: s["d"])
    return d.groupBy("q").agg(of(False).alias("cur"), of(True).alias("old"))


@query(f"""WITH {_DOCS}, o AS (SELECT q, CASE WHEN len(cur) >= len(old) THEN cur ELSE old END AS f, CASE WHEN len(cur) >= len(old) THEN old ELSE cur END AS s FROM a)
  SELECT q AS question_id, md5(array_to_string(list_filter(flatten(list_transform(range(1, len(f) + 1), lambda i: [f[i], s[i]])), lambda x: x IS NOT NULL), '|')) AS context_md5 FROM o""")
def interleaved_context(spark, sf):
    return _contexts(spark, sf).select(F.col("q").alias("question_id"), F.md5(F.array_join(pb.interleave(F.col("cur"), F.col("old")), "|")).alias("context_md5"))


@query(f"""WITH {_DOCS} SELECT q AS question_id, md5(array_to_string(list_concat(list_transform(cur, lambda d, i: '[current doc ' || CAST(i AS VARCHAR) || ']' || chr(10) || d), list_transform(old, lambda d, i: '[stale doc ' || CAST(i AS VARCHAR) || ']' || chr(10) || d)), chr(10))) AS context_md5 FROM a""")
def labelled_context(spark, sf):
    c = _contexts(spark, sf)
    return c.select(F.col("q").alias("question_id"), F.md5(F.array_join(F.concat(pb.labelled(F.col("cur"), "current"), pb.labelled(F.col("old"), "stale")), "\n")).alias("context_md5"))


@query(f"""WITH {_DOCS}, p AS (SELECT *, unnest([0, 25, 50, 75, 100]) AS pct FROM a), r AS (SELECT q, pct, len(cur) AS nc, len(old) AS ns, CAST(round_even(8 * pct / 100.0, 0) AS INTEGER) AS s FROM p), g AS (SELECT *, gcd(s, 8 - s) AS g FROM r),
  f AS (SELECT *, s // g AS us, (8 - s) // g AS uc FROM g), k AS (SELECT *, least(g, CASE WHEN us > 0 THEN ns // us ELSE g END, CASE WHEN uc > 0 THEN nc // uc ELSE g END) AS k FROM f)
  SELECT q AS question_id, pct, CAST(CASE WHEN k > 0 THEN us * k ELSE least(s, ns) END AS INTEGER) AS n_stale, CAST(CASE WHEN k > 0 THEN uc * k ELSE least(8 - s, nc) END AS INTEGER) AS n_current FROM k""")
def ratio_mix(spark, sf):
    rows = _contexts(spark, sf).select("q", F.size("cur").alias("nc"), F.size("old").alias("ns"), F.explode(F.array(*map(F.lit, (0, 25, 50, 75, 100)))).alias("pct"))
    return rows.select(F.col("q").alias("question_id"), "pct", pb.ratio_counts(F.col("pct"), 8, F.col("nc"), F.col("ns")).alias("k")).select("question_id", "pct", F.col("k.stale").alias("n_stale"), F.col("k.current").alias("n_current"))


@query(f"""WITH {_DOCS}, r AS (SELECT q, list_transform(cur, lambda d, i: '[retrieved rank ' || CAST(i AS VARCHAR) || '] ' || d) AS docs, coalesce(old[1], 'none') AS sup FROM a), w AS (SELECT q, sup, docs, CASE WHEN list_contains(docs, sup) THEN docs ELSE list_append(docs[1:greatest(len(docs) - 1, 0)], sup) END AS p2 FROM r),
  x AS (SELECT *, list_prepend(sup, list_filter(p2, lambda d: d <> sup)) AS p3 FROM w) SELECT q AS question_id, CAST(len(docs) AS INTEGER) AS n1, md5(array_to_string(p2, '|')) AS p2, md5(array_to_string(list_transform(p3, lambda d, i: CASE WHEN regexp_matches(d, '^\\[retrieved rank \\d+\\]') THEN '[retrieved rank ' || CAST(i AS VARCHAR) || ']' || regexp_replace(d, '^\\[retrieved rank \\d+\\]', '') ELSE d END), '|')) AS p3, sup AS p4 FROM x""")
def evidence_ladder(spark, sf):
    """The five contexts of each question; the third with its ranks rewritten."""
    c = _contexts(spark, sf).select("q", F.transform("cur", lambda d, i: F.concat(F.lit("[retrieved rank "), (i + 1).cast("string"), F.lit("] "), d)).alias("docs"), F.coalesce(F.get("old", F.lit(0)), F.lit("none")).alias("sup"))
    lad = c.select("q", pb.evidence_ladder(F.col("docs"), F.col("sup"), F.lit("fact")).alias("l"))
    return lad.select(
        F.col("q").alias("question_id"), F.size("l.p1_natural").alias("n1"), F.md5(F.array_join("l.p2_support_presence", "|")).alias("p2"), F.md5(F.array_join(pb.rewrite_ranks(F.col("l.p3_support_first")), "|")).alias("p3"), F.get("l.p4_evidence_only", F.lit(0)).alias("p4")
    )


@query(f"WITH {PROBE}, r AS (SELECT question_id, CASE WHEN old - p1 >= 0.3 THEN CASE WHEN p2 < 0.33 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN p2 < 0.33 THEN 'FP' ELSE 'TN' END END AS cohort FROM probe) SELECT cohort, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1")
def probe_cohorts(spark, sf):
    c = pb.cohort(F.col("old") - F.col("p1") >= 0.3, F.col("p2") < 0.33)
    return _probe(spark, sf).select(c.alias("cohort")).groupBy("cohort").agg(F.count("*").alias("n"))


@query()
def matched_controls(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 4).alias("transition"), (F.col("s_suppkey") % 5).alias("relation"), (F.col("s_suppkey") % 2).alias("style"), F.round(F.col("s_acctbal") / 10000, 4).alias("risk"))
    return pb.match_controls(s.filter("risk > 0.8"), s.filter("risk <= 0.8"), 200)


@query(f"WITH {PROBE} SELECT stage, CAST(count(*) AS BIGINT) AS n, round(avg(v), 6) AS accuracy, round(avg(v - p1), 6) AS gain, round(coalesce(stddev_samp(v), 0.0), 6) AS sd FROM (SELECT p1, unnest(['p1', 'p2', 'p3', 'p4', 'p5']) AS stage, unnest([p1, p2, p3, p4, p5]) AS v FROM probe) GROUP BY 1")
def probe_summary(spark, sf):
    long = _probe(spark, sf).select("p1", F.expr("stack(5, 'p1', p1, 'p2', p2, 'p3', p3, 'p4', p4, 'p5', p5) as (stage, v)"))
    return long.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("accuracy"), F.round(F.avg(F.col("v") - F.col("p1")), 6).alias("gain"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 6).alias("sd"))



_GAIN_DRAW = "(('0x' || substr(md5('gain|' || CAST(r AS VARCHAR) || '|' || CAST(slot AS VARCHAR)), 1, 8))::BIGINT % n)"


@query(f"""WITH {PROBE}, g AS (SELECT stage, v - p1 AS d, row_number() OVER (PARTITION BY stage ORDER BY question_id) - 1 AS pos, count(*) OVER (PARTITION BY stage) AS n FROM (SELECT question_id, p1, unnest(['p2', 'p3', 'p4', 'p5']) AS stage, unnest([p2, p3, p4, p5]) AS v FROM probe) WHERE v - p1 IS NOT NULL),
  s AS (SELECT stage, n, r, unnest(range(0, n)) AS slot FROM (SELECT stage, any_value(n) AS n, unnest(range(0, 100)) AS r FROM g GROUP BY stage)), k AS (SELECT stage, r, {_GAIN_DRAW} AS pos FROM s), m AS (SELECT k.stage, r, avg(d) AS m FROM k JOIN g ON g.stage = k.stage AND g.pos = k.pos GROUP BY 1, 2),
  a AS (SELECT stage, avg(d) AS mean FROM g GROUP BY 1) SELECT m.stage, round(any_value(mean), 6) AS gain, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m JOIN a ON a.stage = m.stage GROUP BY 1""")
def probe_gain_ci(spark, sf):
    """The gain of each stage over the first, with its bootstrap interval."""
    from pyspark.sql import Window

    from tidemark.operators import resample as rs

    long = _probe(spark, sf).select("question_id", F.expr("stack(4, 'p2', p2 - p1, 'p3', p3 - p1, 'p4', p4 - p1, 'p5', p5 - p1) as (stage, d)")).filter("d is not null")
    rows = long.withColumn("pos", (F.row_number().over(Window.partitionBy("stage").orderBy("question_id")) - 1).cast("long"))
    b = rs.bootstrap_mean(rows, "stage", "d", 100, "gain")
    return b.select("stage", F.round("mean", 6).alias("gain"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""SELECT o_orderkey AS id, 'changed_future' AS split, strftime(o_orderdate, '%Y-%m') AS time_x, o_orderstatus AS change_label, o_orderkey % 2 = 0 AS injected, o_orderkey % 3 = 0 AS moved FROM orders""")
def record_metadata(spark, sf):
    """Records annotated with their part in the study, and their nested metadata as columns."""
    i = F.col("o_orderkey")
    meta = F.struct(F.date_format("o_orderdate", "yyyy-MM").alias("time_x"), F.col("o_orderstatus").alias("change_label"), F.struct((i % 2 == 0).alias("injected"), (i % 3 == 0).alias("moved")).alias("intervention"))
    rows = table(spark, sf, "orders").select(i.alias("id"), meta.alias("metadata"))
    return pb.flattened(pb.annotated(rows, split="changed_future"), "metadata", ["split", "time_x", "change_label"], {"injected": "intervention.injected", "moved": "intervention.moved"})
