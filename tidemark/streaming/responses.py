"""Streams of sampled answers: live metrics, budgets over sliding windows, and resumable appends."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import shared_dir

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def budget(stream: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """Requests and spend of each user in sliding windows; rows later than the watermark are left out."""
    w = F.window("ts", window, slide)
    return stream.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("requests"), F.round(F.sum("value"), 6).alias("spent")).select("window.start", "window.end", "user_id", "requests", "spent")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events without a longer gap."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events")).select("session_window.start", "session_window.end", "user_id", "events")


def first_answers(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, however often the log repeats it within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_end(stream: DataFrame, checkpoint: str, out: str, mode: str = "append"):
    """Work off what is there, with the progress kept in ``checkpoint``, so that a second run resumes."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


REQUEST = "event_id long, ts timestamp, tokens long"
SPAN_S = 3600


def rolling_totals(stream: DataFrame, width_s: int = 60, late: str = "0 seconds", span_s: int = SPAN_S) -> DataFrame:
    """(event_id, requests, tokens): what everybody asked for in the ``width_s`` seconds up to each request, itself included.

    Time is cut into spans.  A span's state has its own requests and the last ``width_s`` seconds of the span before; its timer
    goes off when the watermark passes its end, and then its rows come out and the state is gone.  Requests of a span that is closed are too
    late and are left out; all others may come in any order.
    """
    width, span = width_s * 1_000_000, span_s * 1_000_000
    t = F.unix_micros("ts")
    own = F.struct(F.floor(t / span).alias("span"), F.lit(True).alias("own"))
    after = F.struct((F.floor(t / span) + 1).alias("span"), F.lit(False).alias("own"))
    in_ = F.when(t % span >= span - width, F.array(own, after)).otherwise(F.array(own))
    rows = stream.withWatermark("ts", late).select("event_id", "ts", "tokens", t.alias("t"), F.explode(in_).alias("x")).select("event_id", "ts", "tokens", "t", "x.span", "x.own")

    def keep(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = pd.DataFrame(dict(zip(("event_id", "t", "tokens", "own"), state.get, strict=True))).sort_values("t", kind="stable")
            state.remove()
            at = held["t"].to_numpy()
            first, last = np.searchsorted(at, at - width, "right"), np.searchsorted(at, at, "right")
            total = np.concatenate([[0], np.cumsum(held["tokens"].to_numpy())])
            out = pd.DataFrame({"event_id": held["event_id"].to_numpy(), "requests": last - first, "tokens": total[last] - total[first]})
            yield out[held["own"].to_numpy(bool) & (held["event_id"].to_numpy() >= 0)]
            return
        end = (key[0] + 1) * span_s * 1000
        if end <= state.getCurrentWatermarkMs():
            return
        held = [list(x) for x in state.get] if state.exists else [[], [], [], []]
        for f in frames:
            for x, column in zip(held, ("event_id", "t", "tokens", "own"), strict=True):
                x += f[column].tolist()
        state.update(tuple(held))
        state.setTimeoutTimestamp(int(end))

    return rows.groupBy("span").applyInPandasWithState(keep, "event_id long, requests long, tokens long", "event_id array<long>, t array<long>, tokens array<long>, own array<boolean>", "append", "EventTimeTimeout")


def replayed(requests: DataFrame, slices: int = 4) -> tuple[DataFrame, str]:
    """(a table (event_id, ts, tokens) as a stream, the watermark's delay): slices of time one after another, and marks behind the end that let the last timers go off."""
    spark, folder = requests.sparkSession, f"{shared_dir(requests.sparkSession)}/replay-{uuid.uuid4().hex}"
    ends = requests.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    if ends["a"] is None:
        ends = {"a": 0, "b": 0}
    step = (ends["b"] - ends["a"]) // slices + 1
    for k in range(slices):
        part = requests.filter(F.floor((F.unix_micros("ts") - ends["a"]) / step) == k)
        part.select("event_id", "ts", "tokens").write.mode("append").parquet(folder)
    # files of a slice come in any order, so the watermark stays a slice behind
    for k in (1, 2):
        mark = ends["b"] + k * (step + 4 * SPAN_S * 1_000_000)
        spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.timestamp_micros(F.lit(mark)).alias("ts"), F.lit(0).cast("long").alias("tokens")).write.mode("append").parquet(folder)
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 8).parquet(folder), f"{step // 1_000_000 + 1} seconds"
