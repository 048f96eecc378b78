"""Evidence-intervention probe: contexts, recovery stages, matched controls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The stages of the probe, in order; also the names of mechanisms below.
STAGES = ("p1_natural", "p2_support_presence", "p3_support_first", "p4_evidence_only", "p5_fact_card")


#: Parts that controls are ranked in before their best are ranked together.
SALTS = 64


def interleave(current: Column, stale: Column) -> Column:
    """Alternating elements, the longer array first (current at equal length); what is left over at the end."""
    first, second = F.when(F.size(current) >= F.size(stale), current).otherwise(stale), F.when(F.size(current) >= F.size(stale), stale).otherwise(current)
    n = F.greatest(F.size(current), F.size(stale))
    both = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array(F.get(first, i), F.get(second, i))))
    return F.array_compact(both)


def ratio_counts(percent: Column, total: int, n_current: Column, n_stale: Column) -> Column:
    """(stale, current) counts of a mix: the stale share rounded half to even, scaled down in its own ratio if documents are short.

    Where they do not suffice for one unit of the ratio, each side gives what it has of its share.
    """
    stale = F.bround(F.lit(total) * percent / 100).cast("int")
    current = F.lit(total) - stale
    # gcd of the two counts, by Euclid's steps
    g = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.struct(stale.alias("a"), current.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], s["b"]).alias("b"))))["a"]
    us, uc = (stale / g).cast("int"), (current / g).cast("int")
    fit = F.least(g, F.when(us > 0, F.floor(n_stale / us).cast("int")).otherwise(g), F.when(uc > 0, F.floor(n_current / uc).cast("int")).otherwise(g))
    some = fit > 0
    return F.struct(F.when(some, us * fit).otherwise(F.least(stale, n_stale.cast("int"))).alias("stale"), F.when(some, uc * fit).otherwise(F.least(current, n_current.cast("int"))).alias("current"))


def labelled(docs: Column, source: str) -> Column:
    """Each document under a ``[source doc n]`` line."""
    return F.transform(docs, lambda d, i: F.concat(F.lit(f"[{source} doc "), (i + 1).cast("string"), F.lit("]\n"), d))


def rewrite_ranks(docs: Column) -> Column:
    """Retrieved-rank headers numbered anew in array order."""
    return F.transform(docs, lambda d, i: F.when(d.rlike(r"^\[retrieved rank \d+\]"), F.concat(F.lit("[retrieved rank "), (i + 1).cast("string"), F.lit("]"), F.regexp_replace(d, r"^\[retrieved rank \d+\]", ""))).otherwise(d))


def evidence_ladder(docs: Column, support: Column, fact: Column) -> Column:
    """The five contexts: as retrieved; with the support present; with it first; the support alone; the fact alone."""
    present = F.array_contains(docs, support)
    with_support = F.when(present, docs).otherwise(F.concat(F.slice(docs, 1, F.greatest(F.size(docs) - 1, F.lit(0))), F.array(support)))
    first = F.concat(F.array(support), F.filter(with_support, lambda d: d != support))
    return F.struct(docs.alias(STAGES[0]), with_support.alias(STAGES[1]), first.alias(STAGES[2]), F.array(support).alias(STAGES[3]), F.array(fact).alias(STAGES[4]))


def linked_recovery(old: Column, p: list[Column], injected: Column, moved: Column, drop: float = 0.1, gain: float = 0.1, tolerance: float = 1 / 16) -> Column:
    """(stage, mechanism) where the old accuracy must be lost again first and then come back within a tolerance."""
    back = [(F.round(x - p[0], 9) >= gain) & (x >= F.greatest(F.lit(0.0), F.round(old - tolerance, 9))) for x in p[1:]]
    say = lambda stage, mechanism: F.struct(F.lit(stage).alias("stage"), F.lit(mechanism).alias("mechanism"))
    chance = "stochastic_recovery_without_context_change"
    return (
        F.when(F.round(old - p[0], 9) < drop, say(STAGES[0], "no_degradation_on_probe_rerun"))
        .when(back[0] & injected, say(STAGES[1], "retrieval_coverage_failure")).when(back[0], say(STAGES[1], chance))
        .when(back[1] & moved, say(STAGES[2], "ranking_or_position_sensitivity")).when(back[1], say(STAGES[2], chance))
        .when(back[2], say(STAGES[3], "evidence_extraction_or_context_complexity_failure"))
        .when(back[3], say(STAGES[4], "evidence_utilization_or_answer_realization_failure"))
        .otherwise(say("none", "persistent_after_explicit_fact"))
    )


def historical_recovery(p: list[Column], injected: Column, moved: Column, gain: float | Column = 0.25, least: float | Column = 0.5) -> Column:
    """(stage, mechanism) by a fixed gain and accuracy; a recovery without a change of context falls through."""
    back = [(F.round(x - p[0], 9) >= gain) & (x >= least) for x in p[1:]]
    say = lambda stage, mechanism: F.struct(F.lit(stage).alias("stage"), F.lit(mechanism).alias("mechanism"))
    return (
        F.when(p[0] >= 0.5, say(STAGES[0], "no_failure_on_rerun"))
        .when(back[0] & injected, say(STAGES[1], "retrieval_coverage_failure")).when(back[1] & moved, say(STAGES[2], "ranking_or_position_sensitivity"))
        .when(back[2], say(STAGES[3], "evidence_extraction_or_context_complexity_failure")).when(back[3], say(STAGES[4], "evidence_utilization_or_answer_realization_failure"))
        .when(back[0] | back[1], say("none", "stochastic_recovery_without_context_change")).otherwise(say("none", "persistent_after_explicit_fact"))
    )


def cohort(target: Column, alarm: Column) -> Column:
    return F.when(target & alarm, "TP").when(~target & alarm, "FP").when(target & ~alarm, "FN").otherwise("TN")


def match_controls(cases: DataFrame, controls: DataFrame, limit: int) -> DataFrame:
    """Greedy nearest controls without replacement: 10 for another transition, 3 for another relation, 1 for another style, plus the risk difference.

    What is left of ``limit`` goes to the riskiest other controls; these have no case and no cost.

    Only the first ``limit`` cases by id can take a control, so these are the query set that is broadcast, whatever the
    size of both tables.  Each case keeps its ``limit`` nearest controls, first in ``SALTS`` parts of the controls and then
    of what they keep, which is enough for any greedy choice; the sequential choice then sees those rows only, and the
    ``2 * limit`` riskiest controls, which are enough to fill up with.
    """
    first = cases.orderBy("id").limit(limit).select(*(F.col(c).alias(f"c_{c}") for c in ("id", "transition", "relation", "style", "risk")))
    d = controls.join(F.broadcast(first), F.lit(True))
    cost = F.when(F.col("c_transition") != F.col("transition"), 10).otherwise(0) + F.when(F.col("c_relation") != F.col("relation"), 3).otherwise(0) + F.when(F.col("c_style") != F.col("style"), 1).otherwise(0) + F.abs(F.col("c_risk") - F.col("risk"))
    ranked = lambda rows, *keys: rows.withColumn("n", F.row_number().over(Window.partitionBy("case_id", *keys).orderBy("cost", "id"))).filter(F.col("n") <= limit)
    parts = d.select(F.col("c_id").alias("case_id"), "id", F.round(cost, 9).alias("cost"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("part"))
    near = ranked(ranked(parts, "part").drop("part", "n"))
    # a row of the fill has n = 0 and its risk, falling, in place of a cost
    fill = controls.orderBy(F.desc("risk"), "id").limit(2 * limit).select(F.lit(0).alias("case_id"), "id", (-F.col("risk")).cast("double").alias("cost"), F.lit(0).alias("n"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for case, rows in pdf[pdf["n"] > 0].sort_values(["case_id", "cost", "id"]).groupby("case_id"):
            free = rows[~rows["id"].isin(used)]
            if len(free) and len(out) < limit:
                used.add(free["id"].iloc[0])
                out.append((case, free["id"].iloc[0], free["cost"].iloc[0]))
        rest = pdf[(pdf["n"] == 0) & ~pdf["id"].isin(used)].sort_values(["cost", "id"])
        out += [(None, i, None) for i in rest["id"].head(limit - len(out))]
        return pd.DataFrame(out, columns=["case_id", "control_id", "cost"]).astype({"case_id": "Int64", "control_id": "int64", "cost": "Float64"})

    return near.unionByName(fill).groupBy(F.lit(1).alias("all")).applyInPandas(lambda pdf: choose(pdf), "case_id long, control_id long, cost double")


def quota_controls(targets: DataFrame, controls: DataFrame, exact: list[str], coarse: list[str]) -> DataFrame:
    """As many rows of controls as there are targets, the riskiest first in each tier.

    First as many of each stratum (``exact``) as it has targets; then, while rows are missing, controls that
    share ``coarse`` with targets, the commonest values first; then any.
    """
    quota = targets.groupBy(*exact).agg(F.count("*").alias("quota"))
    ranked = controls.withColumn("n", F.row_number().over(Window.partitionBy(*exact).orderBy(F.desc("risk"), "id"))).join(quota, exact, "left")
    first = ranked.filter("n <= quota").select(*controls.columns)
    short = targets.count() - first.count()
    if short <= 0:
        return first
    common = targets.groupBy(*coarse).agg(F.count("*").alias("common"))
    rest = ranked.filter("quota is null or n > quota").select(*controls.columns).join(common, coarse, "left")
    keys = [F.when(F.col("common").isNotNull(), F.col(c)) for c in coarse]
    return first.unionByName(rest.orderBy(F.desc_nulls_last("common"), *keys, F.desc("risk"), "id").limit(short).select(*controls.columns))


def annotated(rows: DataFrame, column: str = "metadata", **fields: str) -> DataFrame:
    """rows with constant fields in a struct column, in place of older ones of their names."""
    out = F.col(column)
    for k, v in fields.items():
        out = out.withField(k, F.lit(v))
    return rows.withColumn(column, out)


def flattened(rows: DataFrame, column: str, fields: list[str], nested: dict[str, str]) -> DataFrame:
    """rows with fields of a struct column, and fields further down, as columns."""
    rest = [c for c in rows.columns if c != column]
    return rows.select(*rest, *(F.col(f"{column}.{f}").alias(f) for f in fields), *(F.col(f"{column}.{p}").alias(n) for n, p in nested.items()))
