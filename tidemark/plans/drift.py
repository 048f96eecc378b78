"""Queries of outcomes and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import drift as dr
from tidemark.plans.views import EVENT_QUALITY, QUESTION_METRICS, event_quality, question_metrics

_OUT = """CASE WHEN accuracy_stale < 0.32 AND accuracy_current < 0.32 THEN 'persistent_failure' WHEN round(accuracy_stale - accuracy_current, 9) >= 0.02 THEN 'new_degradation'
  WHEN round(accuracy_current - accuracy_stale, 9) >= 0.02 OR (change_label = 'changed' AND accuracy_current >= 0.33) THEN 'recovery_or_adaptive_success' ELSE 'normal' END"""


def _outcomes(spark, sf):
    e = event_quality(spark, sf)
    return e.withColumn("outcome_state", dr.outcome(F.col("accuracy_stale"), F.col("accuracy_current"), F.col("change_label"), 0.02, 0.32, 0.33))


@query(f"WITH {EVENT_QUALITY} SELECT question_id, {_OUT} AS outcome_state FROM event_quality")
def outcome_states(spark, sf):
    return _outcomes(spark, sf).select("question_id", "outcome_state")


@query(f"WITH {EVENT_QUALITY}, o AS (SELECT {_OUT} AS outcome_state FROM event_quality) SELECT outcome_state, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM o GROUP BY 1")
def state_counts(spark, sf):
    o = _outcomes(spark, sf)
    total = o.agg(F.count("*").alias("total"))
    # rounded in doubles, as SQL does: the digits of 41 / 640 end in a five, its double times a million in less
    rate = F.round(F.col("n") / F.col("total") * 1e6) / 1e6
    return o.groupBy("outcome_state").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("outcome_state", "n", rate.alias("rate"))


@query(f"WITH {EVENT_QUALITY}, o AS (SELECT question_id, {_OUT} AS s FROM event_quality) SELECT question_id, CAST(s = 'new_degradation' AS INTEGER) AS target FROM o WHERE s IN ('new_degradation', 'normal', 'recovery_or_adaptive_success')")
def primary_subset(spark, sf):
    o = _outcomes(spark, sf).filter(F.col("outcome_state") != "persistent_failure")
    return o.select("question_id", (F.col("outcome_state") == "new_degradation").cast("int").alias("target"))


_BASE = f"""{QUESTION_METRICS}, q AS (SELECT *, accuracy - 0.5 * contradiction_rate - 0.5 * stale_answer_rate AS quality_score FROM question_metrics),
  b AS (SELECT q.*, max(CASE WHEN condition = 'current_only' THEN semantic_entropy END) OVER w AS be, max(CASE WHEN condition = 'current_only' THEN semantic_volume END) OVER w AS bv, max(CASE WHEN condition = 'current_only' THEN quality_score END) OVER w AS bq FROM q WINDOW w AS (PARTITION BY question_id)),
  d AS (SELECT *, quality_score - bq AS delta_quality, abs(semantic_entropy - be) AS de, abs(semantic_volume - bv) AS dv FROM b),
  z AS (SELECT *, (coalesce(de, 0) - avg(coalesce(de, 0)) OVER ()) / stddev_pop(coalesce(de, 0)) OVER () AS ze, (coalesce(dv, 0) - avg(coalesce(dv, 0)) OVER ()) / stddev_pop(coalesce(dv, 0)) OVER () AS zv, (centroid_shift - avg(centroid_shift) OVER ()) / stddev_pop(centroid_shift) OVER () AS zc FROM d),
  m AS (SELECT *, round(0.4 * zv + 0.4 * ze + 0.2 * zc, 9) AS shift_magnitude, round(delta_quality, 9) AS dq FROM z)"""


@query(f"""WITH {_BASE} SELECT question_id, condition, round(shift_magnitude, 6) AS shift_magnitude, round(delta_quality, 6) AS delta_quality, CASE WHEN condition = 'current_only' THEN 'baseline' WHEN shift_magnitude < 1 AND abs(dq) < 0.05 THEN 'inert_change'
  WHEN shift_magnitude >= 1 AND dq >= 0.05 THEN 'adaptive_shift' WHEN shift_magnitude >= 1 AND dq <= -0.05 THEN 'harmful_drift' ELSE 'benign_shift' END AS drift_label FROM m""")
def drift_labels(spark, sf):
    d = dr.drift_frame(question_metrics(spark, sf))
    return d.select("question_id", "condition", F.round("shift_magnitude", 6).alias("shift_magnitude"), F.round("delta_quality", 6).alias("delta_quality"), "drift_label")


_DROP = "greatest(0.0, round(max(CASE WHEN condition = 'stale_only' THEN accuracy END) OVER k - max(CASE WHEN condition = 'current_only' THEN accuracy END) OVER k, 9))"


@query(f"""WITH {_BASE}, x AS (SELECT *, {_DROP} AS drp FROM m WINDOW k AS (PARTITION BY question_id)) SELECT question_id, condition, round(drp, 6) AS current_performance_drop, CASE WHEN condition = 'current_only' THEN 'baseline' WHEN drp > 0.05 AND shift_magnitude >= 1 THEN 'benchmark_regression_with_semantic_shift'
  WHEN drp > 0.05 THEN 'benchmark_regression_without_semantic_shift' WHEN shift_magnitude >= 1 THEN 'semantic_shift_without_benchmark_regression' ELSE 'no_benchmark_drift' END AS benchmark_drift_label,
  round(current_answer_rate - stale_answer_rate, 6) AS current_pull, round(CASE WHEN condition = 'mixed' THEN least(current_answer_rate, stale_answer_rate) ELSE 0.0 END, 6) AS mixed_conflict_rate,
  CAST(condition = 'stale_only' AND round(stale_answer_rate - current_answer_rate, 9) > 0.05 AS INTEGER) AS temporal_answer_flip FROM x""")
def temporal_drift_metrics(spark, sf):
    d = dr.with_baseline(dr.drift_frame(question_metrics(spark, sf)), "question_id", ["accuracy"], "current_only").withColumnRenamed("accuracy_base", "acc_current")
    d = dr.with_baseline(d, "question_id", ["accuracy"], "stale_only").withColumnRenamed("accuracy_base", "acc_stale")
    drop = F.greatest(F.lit(0.0), F.round(F.col("acc_stale") - F.col("acc_current"), 9))
    cur, old = F.col("current_answer_rate"), F.col("stale_answer_rate")
    return d.withColumn("drp", drop).select(
        "question_id", "condition", F.round("drp", 6).alias("current_performance_drop"), dr.benchmark_label(F.col("condition"), F.col("drp"), F.col("shift_magnitude")).alias("benchmark_drift_label"),
        F.round(cur - old, 6).alias("current_pull"), F.round(F.when(F.col("condition") == "mixed", F.least(cur, old)).otherwise(0.0), 6).alias("mixed_conflict_rate"),
        ((F.col("condition") == "stale_only") & (F.round(old - cur, 9) > 0.05)).cast("int").alias("temporal_answer_flip"),
    )


@query(f"WITH {QUESTION_METRICS} SELECT a.question_id, a.condition, CAST(a.n_clusters - coalesce(b.n_clusters, a.n_clusters) AS DOUBLE) AS delta_clusters, round(a.semantic_entropy - coalesce(b.semantic_entropy, a.semantic_entropy), 6) AS delta_entropy FROM question_metrics a LEFT JOIN question_metrics b ON a.question_id = b.question_id AND b.condition = 'current_only'")
def baseline_delta(spark, sf):
    d = dr.with_baseline(question_metrics(spark, sf), "question_id", ["n_clusters", "semantic_entropy"], "current_only")
    delta = lambda c: F.round(F.col(c) - F.coalesce(f"{c}_base", c), 6)
    return d.select("question_id", "condition", delta("n_clusters").cast("double").alias("delta_clusters"), delta("semantic_entropy").alias("delta_entropy"))


@query(f"""WITH {QUESTION_METRICS} SELECT condition, CAST(count(DISTINCT question_id) AS BIGINT) AS n_questions, round(avg(accuracy), 6) AS accuracy_mean, round(coalesce(stddev_samp(accuracy), 0), 6) AS accuracy_std, round(coalesce(stddev_samp(accuracy), 0) / sqrt(greatest(count(accuracy), 1)), 6) AS accuracy_se,
  round(avg(semantic_volume), 6) AS semantic_volume_mean, round(coalesce(stddev_samp(semantic_volume), 0), 6) AS semantic_volume_std, round(coalesce(stddev_samp(semantic_volume), 0) / sqrt(greatest(count(semantic_volume), 1)), 6) AS semantic_volume_se FROM question_metrics GROUP BY 1""")
def condition_summary(spark, sf):
    return dr.condition_summary(question_metrics(spark, sf), ["accuracy", "semantic_volume"])


@query(f"""WITH {QUESTION_METRICS}, r AS (SELECT question_id, condition, semantic_volume, 'primary' AS embedding_model_role FROM question_metrics UNION ALL SELECT question_id, condition, semantic_entropy, 'robustness' FROM question_metrics), p AS (SELECT * FROM r WHERE embedding_model_role = 'primary')
  SELECT condition, CAST(count(DISTINCT question_id) AS BIGINT) AS n_questions, round(avg(semantic_volume), 6) AS semantic_volume_mean, round(coalesce(stddev_samp(semantic_volume), 0), 6) AS semantic_volume_std, round(coalesce(stddev_samp(semantic_volume), 0) / sqrt(greatest(count(semantic_volume), 1)), 6) AS semantic_volume_se FROM p GROUP BY 1""")
def primary_role_summary(spark, sf):
    """Summary of the primary embedding model's rows, where metrics have a row for each model."""
    m = question_metrics(spark, sf)
    roles = [m.select("question_id", "condition", F.col(c).alias("semantic_volume"), F.lit(r).alias("embedding_model_role")) for c, r in (("semantic_volume", "primary"), ("semantic_entropy", "robustness"))]
    return dr.condition_summary(dr.of_role(roles[0].unionByName(roles[1])), ["semantic_volume"])


@query(f"WITH {QUESTION_METRICS} SELECT question_id, max(CASE WHEN condition = 'current_only' THEN accuracy END) AS current_only, max(CASE WHEN condition = 'mixed' THEN accuracy END) AS mixed, max(CASE WHEN condition = 'stale_only' THEN accuracy END) AS stale_only FROM question_metrics GROUP BY 1")
def pivot_conditions(spark, sf):
    return question_metrics(spark, sf).groupBy("question_id").pivot("condition", ["current_only", "mixed", "stale_only"]).agg(F.first("accuracy"))


@query(f"WITH {_BASE}, l AS (SELECT condition, CASE WHEN condition = 'current_only' THEN 'baseline' WHEN shift_magnitude >= 1 THEN 'shift' ELSE 'none' END AS label FROM m) SELECT condition, label, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY CUBE (condition, label)")
def label_cube(spark, sf):
    """Counts by condition and label with all subtotals."""
    d = dr.drift_frame(question_metrics(spark, sf))
    label = F.when(F.col("condition") == "current_only", "baseline").when(F.col("shift_magnitude") >= 1, "shift").otherwise("none")
    return d.select("condition", label.alias("label")).cube("condition", "label").count().withColumnRenamed("count", "n")
