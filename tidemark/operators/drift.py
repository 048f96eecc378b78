"""Outcome states, drift labels and summaries over question-level metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome(old: Column, new: Column, change: Column, drop: float = 0.1, failure: float = 0.5, success: float = 0.5) -> Column:
    """persistent_failure before new_degradation before recovery_or_adaptive_success before normal; a difference counts to nine digits."""
    return (
        F.when((old < failure) & (new < failure), "persistent_failure")
        .when(F.round(old - new, 9) >= drop, "new_degradation")
        .when((F.round(new - old, 9) >= drop) | ((change == "changed") & (new >= success)), "recovery_or_adaptive_success")
        .otherwise("normal")
    )


def with_zscores(rows: DataFrame, columns: list[str]) -> DataFrame:
    """z_<column> for each column: population z-scores over all rows (no variance gives zero).

    Mean and deviation are one aggregated row, broadcast back, and not an unpartitioned window.
    """
    stats = rows.agg(*(F.struct(F.avg(F.coalesce(c, F.lit(0.0))).alias("m"), F.stddev_pop(F.coalesce(c, F.lit(0.0))).alias("s")).alias(f"_{c}") for c in columns))
    out = rows.crossJoin(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(f"z_{c}", F.when(F.col(f"_{c}.s") == 0, 0.0).otherwise((F.coalesce(c, F.lit(0.0)) - F.col(f"_{c}.m")) / F.col(f"_{c}.s"))).drop(f"_{c}")
    return out


def with_baseline(rows: DataFrame, key: str, columns: list[str], baseline: str) -> DataFrame:
    """<column>_base of the baseline condition's row on every row of its key (one window, no self-joins)."""
    w = Window.partitionBy(key)
    return rows.select("*", *(F.max(F.when(F.col("condition") == baseline, F.col(c))).over(w).alias(f"{c}_base") for c in columns))


def drift_frame(metrics: DataFrame, baseline: str = "current_only", tau_shift: float = 1.0, tau_q: float = 0.05) -> DataFrame:
    """Deltas to the baseline, shift magnitude (0.4 volume, 0.4 entropy, 0.2 centroid) and the drift label."""
    m = metrics.withColumn("quality_score", F.col("accuracy") - 0.5 * F.col("contradiction_rate") - 0.5 * F.col("stale_answer_rate"))
    m = with_baseline(m, "question_id", ["semantic_entropy", "semantic_volume", "quality_score"], baseline)
    m = m.select(
        "*", (F.col("quality_score") - F.col("quality_score_base")).alias("delta_quality"),
        F.abs(F.col("semantic_entropy") - F.col("semantic_entropy_base")).alias("d_entropy"), F.abs(F.col("semantic_volume") - F.col("semantic_volume_base")).alias("d_volume"),
    )
    m = with_zscores(m, ["d_entropy", "d_volume", "centroid_shift"])
    m = m.withColumn("shift_magnitude", F.round(0.4 * F.col("z_d_volume") + 0.4 * F.col("z_d_entropy") + 0.2 * F.col("z_centroid_shift"), 9))
    s, q = F.col("shift_magnitude"), F.round("delta_quality", 9)
    label = (
        F.when(F.col("condition") == baseline, "baseline").when((s < tau_shift) & (F.abs(q) < tau_q), "inert_change")
        .when((s >= tau_shift) & (q >= tau_q), "adaptive_shift").when((s >= tau_shift) & (q <= -tau_q), "harmful_drift").otherwise("benign_shift")
    )
    return m.withColumn("drift_label", label)


def benchmark_label(condition: Column, drop: Column, shift: Column, baseline: str = "current_only", tau_shift: float = 1.0, tau_q: float = 0.05) -> Column:
    return (
        F.when(condition == baseline, "baseline").when((drop > tau_q) & (shift >= tau_shift), "benchmark_regression_with_semantic_shift")
        .when(drop > tau_q, "benchmark_regression_without_semantic_shift").when(shift >= tau_shift, "semantic_shift_without_benchmark_regression").otherwise("no_benchmark_drift")
    )


def of_role(metrics: DataFrame, role: str = "primary", column: str = "embedding_model_role") -> DataFrame:
    """Metrics of one role of embedding model; summaries and drift are taken from the primary one, and tables without roles are that."""
    return metrics.filter(F.col(column) == role) if column in metrics.columns else metrics


def condition_summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Per condition: questions, and mean, sample deviation (0 for one) and standard error of each metric."""
    aggs = [F.countDistinct("question_id").alias("n_questions")]
    for c in columns:
        sd = F.coalesce(F.stddev_samp(c), F.lit(0.0))
        aggs += [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(sd, 6).alias(f"{c}_std"), F.round(sd / F.sqrt(F.greatest(F.count(c), F.lit(1))), 6).alias(f"{c}_se")]
    return metrics.groupBy("condition").agg(*aggs)


def pivot_strict(rows: DataFrame, key: str, by: str, value: str, names: list[str]) -> DataFrame:
    """Values of each key by name, side by side; two rows of one key and name fail."""
    one = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("more than one row of "), F.first(F.col(key).cast("string"))))).otherwise(F.first(value))
    return rows.groupBy(key, by).agg(one.alias("_v")).groupBy(key).pivot(by, names).agg(F.first("_v"))


def run_frame(metrics: DataFrame, distances: DataFrame, metadata: DataFrame, comparison: str = "current_only__vs__stale_only", drop: float = 0.1, failure: float = 0.5) -> DataFrame:
    """One row a question of a run: its distances of a comparison, the metrics of both snapshots, deltas, the target and its metadata.

    Questions without distances or metrics are left out; those without metadata stay.
    """
    of = lambda c, name: F.first(F.when(F.col("condition") == name, F.col(c)), ignorenulls=True)
    wide = metrics.groupBy("question_id").agg(
        of("accuracy", "stale_only").alias("accuracy_stale"), of("accuracy", "current_only").alias("accuracy_current"),
        (of("semantic_entropy", "current_only") - of("semantic_entropy", "stale_only")).alias("delta_entropy"), (of("semantic_volume", "current_only") - of("semantic_volume", "stale_only")).alias("delta_volume"),
    )
    lost = F.col("accuracy_stale") - F.col("accuracy_current")
    target = ~((F.col("accuracy_stale") < failure) & (F.col("accuracy_current") < failure)) & (F.round(lost, 9) >= drop)
    frame = distances.filter(F.col("comparison") == comparison).join(wide, "question_id").withColumns({"accuracy_drop": lost, "target": target.cast("int")})
    return frame.join(metadata, "question_id", "left")


def shift_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows, mean, median and population deviation of a value in each group; the median over counts of distinct values."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_c"))
    return counts.groupBy(key).agg(
        F.sum("_c").alias("n"), (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("mean"), F.percentile(value, F.lit(0.5), F.col("_c")).alias("median"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col(value) * F.col(value) * F.col("_c")) / F.sum("_c") - F.pow(F.sum(F.col(value) * F.col("_c")) / F.sum("_c"), F.lit(2)))).alias("sd"),
    )
