"""As-of and interval joins over answer validity, change labels and disjoint cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active(start: Column, end: Column, t: Column) -> Column:
    """start <= t < end, an open end holds for ever."""
    return (start <= t) & (end.isNull() | (t < end))


def as_of(spans: DataFrame, times: DataFrame, keys: list[str]) -> DataFrame:
    """The active span of each key at each time (column t of ``times``): latest start, then latest ord.

    ``times`` is a bounded list of snapshots, so it is broadcast; the best span is an aggregate of a struct,
    which combines before the exchange and never holds a key's history in one place.
    """
    rows = spans.join(F.broadcast(times), active(F.col("start_ts"), F.col("end_ts"), F.col("t")))
    rest = [c for c in spans.columns if c not in (*keys, "start_ts", "ord")]
    best = rows.groupBy(*keys, "t").agg(F.max(F.struct("start_ts", "ord", *rest)).alias("s"))
    return best.select(*keys, "t", "s.*")


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Half-open intervals share a moment; null bounds are open."""
    return (s1.isNull() | e2.isNull() | (s1 < e2)) & (s2.isNull() | e1.isNull() | (s2 < e1))


def match_score(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """2 for equal starts, 2 for equal ends (two nulls are equal), 1 for an overlap."""
    return F.when(s1.eqNullSafe(s2), 2).otherwise(0) + F.when(e1.eqNullSafe(e2), 2).otherwise(0) + F.when(overlap(s1, e1, s2, e2), 1).otherwise(0)


def best_matches(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """All rows with the largest score of their key."""
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(score)))).filter("_r = 1").drop("_r")


def first_eligible(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each key goes to the first group that may have it, so groups are disjoint."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def missing_jobs(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys without a finished row."""
    return wanted.join(done.select(*keys), keys, "left_anti")


def rolling_all(rows: DataFrame, at: str, sums: dict[str, Column], width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """rows with sums over all rows (of their keys) in the ``width`` units of ``at`` (an integer) up to each, its start left out.

    Time is cut into spans of that width; each row also counts in the span after its own, so a window never leaves a
    span's rows and no task sees more than two widths of time, however long a key's history.
    """
    dealt = rows.withColumns({f"_{k}": v for k, v in sums.items()}).withColumn("_span", F.floor(F.col(at) / F.lit(width)))
    twice = dealt.withColumn("_next", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_span", F.col("_span") + F.col("_next"))
    w = Window.partitionBy(*keys, "_span").orderBy(at).rangeBetween(-(width - 1), 0)
    kept = [c for c in rows.columns if c not in sums]
    return twice.select(*kept, "_next", *(F.sum(f"_{k}").over(w).alias(k) for k in sums)).filter("_next = 0").drop("_next")
