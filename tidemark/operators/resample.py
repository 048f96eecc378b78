"""Resampling by hashes: draw number ``slot`` of ``round`` is md5(seed|round|slot), the same in any engine and task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Draws of a round that are made at once.
SLOTS = 4096


def draw(seed: str, round_: Column, slot: Column, n: Column) -> Column:
    """An index 0 .. n - 1."""
    h = F.md5(F.concat_ws("|", F.lit(seed), round_.cast("string"), slot.cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), n)


def rounds_of(rows: DataFrame, key: str, rounds: int, seed: str) -> DataFrame:
    """(key, round, pick): as many draws in each round as the key has rows (pick counts from 0)."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    # slots come in blocks, so that no array grows with the rows of a key
    blocks = n.select(key, "n", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLOTS))).alias("block"))
    last = F.least(F.col("n"), (F.col("block") + 1) * SLOTS) - 1
    slots = blocks.select(key, "n", "round", F.explode(F.sequence(F.col("block") * SLOTS, last)).alias("slot"))
    return slots.select(key, "round", draw(seed, F.col("round"), F.col("slot"), F.col("n")).alias("pick"))


def bootstrap_mean(rows: DataFrame, key: str, value: str, rounds: int, seed: str) -> DataFrame:
    """(key, mean, low, high): the mean and its 95 % interval; rows carry ``pos`` 0 .. n - 1 in each key."""
    picks = rounds_of(rows, key, rounds, seed).join(rows.select(key, F.col("pos").alias("pick"), value), [key, "pick"])
    means = picks.groupBy(key, "round").agg(F.avg(value).alias("m")).groupBy(key).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return rows.groupBy(key).agg(F.avg(value).alias("mean")).join(means, key).select(key, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def sign_flip(rows: DataFrame, key: str, value: str, rounds: int, seed: str) -> DataFrame:
    """(key, p): share of sign flips at least as extreme as the observed mean, counting the observed one."""
    observed = rows.groupBy(key).agg(F.abs(F.round(F.avg(value), 12)).alias("observed"))
    each = rows.select(key, "pos", value, F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    sign = F.when(draw(seed, F.col("round"), F.col("pos"), F.lit(2)) == 0, -1.0).otherwise(1.0)
    stats = each.groupBy(key, "round").agg(F.abs(F.round(F.avg(F.col(value) * sign), 12)).alias("s")).join(observed, key)
    hits = stats.groupBy(key).agg(F.sum((F.col("s") >= F.col("observed")).cast("int")).alias("hits"), F.first("observed").alias("observed"))
    return hits.select(key, F.when(F.col("observed") == 0, 1.0).otherwise((F.col("hits") + 1) / F.lit(rounds + 1)).alias("p"))
