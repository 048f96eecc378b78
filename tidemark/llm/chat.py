"""Multi-party perspective rotation of conversations (operator 2), in DataFrame operations only.

For every participant of a conversation (each distinct role but ``system``) the whole dialogue is rendered
once with that speaker as the assistant, every other speaker as a named user and system messages as they
are.  Loss masks are the character ranges of the assistant's texts with their end marks.

A rendering comes in parts of at most ``PART`` messages, so that no group of a task grows with the length
of a conversation: messages are dealt by conversation and turn // PART, ordered there, and numbered
off in further parts if many share their turns.  ``char_start`` is where a part begins in the whole rendering, and
the parts in order are the whole rendering.  Ordinary conversations have one part.

Defined cases: a null text is empty; a null role is the speaker ``unknown``; messages are ordered by turn
(null turns last), role and text, and repeated rows are kept; a null conv_id is a conversation of its
own; a conversation of system messages alone has one rendering with a null perspective and no mask;
extra columns are ignored.  Messages that share a turn (or have none) are one block, which one task puts in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import materialise

PART = 256
SYSTEM = "system"
END = "<|end|>\n"


def _head(role: Column, own: Column) -> Column:
    return F.when(own, F.lit("<|assistant|>\n")).when(role == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))


def _body(text: Column) -> Column:
    return F.concat(text, F.lit(END))


def _parts(conversations: DataFrame, part: int) -> DataFrame:
    """(conv_id, block, piece, messages, size, roles): the messages of each part, its length if all of them were
    users or the system, and how many each role has."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    block = F.coalesce(F.floor(F.col("turn") / part), F.lit((1 << 62) // part)).alias("block")
    place = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order))
    parts = (
        rows.select("*", block).withColumn("place", place)
        .groupBy("conv_id", "block", F.floor((F.col("place") - 1) / part).alias("piece"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("messages"))
    )
    length = lambda m: (F.length(_head(m["role"], F.lit(False))) + F.length(_body(m["text"]))).cast("long")
    size = F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + length(m))
    count = lambda r: F.size(F.filter("messages", lambda m: m["role"] == r)).cast("long")
    roles = F.transform(F.array_distinct(F.transform("messages", lambda m: m["role"])), lambda r: F.struct(r.alias("role"), count(r).alias("n")))
    return parts.select("conv_id", "block", "piece", "messages", size.alias("size"), roles.alias("roles"))


def _places(parts: DataFrame) -> DataFrame:
    """(conv, perspective, b, p, part, char_start) of every rendered part, from lengths alone: no text is read, joined or sorted."""
    roles = parts.select("conv_id", F.explode("roles.role").alias("perspective")).filter(F.col("perspective") != SYSTEM)
    speakers = roles.groupBy("conv_id", "perspective").agg(F.lit(1).alias("one")).select(F.col("conv_id").alias("conv"), "perspective")
    faced = parts.select("conv_id", "block", "piece", "size", "roles").join(speakers, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    own = F.aggregate("roles", F.lit(0).cast("long"), lambda n, r: n + F.when(r["role"].eqNullSafe(F.col("perspective")), r["n"]).otherwise(0))
    saved = F.length(_head(F.col("perspective"), F.lit(False))) - F.length(_head(F.col("perspective"), F.lit(True)))
    at = F.col("size") - F.coalesce(own * saved, F.lit(0))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block", "piece")
    return faced.withColumn("at", at).select(
        F.col("conv_id").alias("conv"), "perspective", F.col("block").alias("b"), F.col("piece").alias("p"), (F.row_number().over(before) - 1).cast("long").alias("part"),
        F.coalesce(F.sum("at").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("char_start"),
    )


def rotate(conversations: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, perspective, part, n_messages, n_trained, char_start, text, mask) of every part.

    The parts are written once; where each of them begins is found from lengths, and the texts then meet
    their perspectives by part, so that no task holds the texts of a conversation.
    """
    parts = materialise(_parts(conversations, part), "parts")
    faced = parts.drop("size", "roles").join(_places(parts), F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("block") == F.col("b")) & (F.col("piece") == F.col("p")))

    def render(m):
        own = m["role"].eqNullSafe(F.col("perspective"))
        head, body = _head(m["role"], own), _body(m["text"])
        return F.struct(F.concat(head, body).alias("text"), F.length(head).cast("long").alias("skip"), F.length(body).cast("long").alias("length"), own.alias("own"))

    def walk(state, s):
        begin = state["at"] + s["skip"]
        span = F.concat(F.when(state["mask"] == "", "").otherwise(","), begin.cast("string"), F.lit(":"), (begin + s["length"]).cast("string"))
        return F.struct((begin + s["length"]).alias("at"), F.concat(state["mask"], F.when(s["own"], span).otherwise("")).alias("mask"))

    lines = faced.select("conv_id", "perspective", "part", "char_start", F.transform("messages", render).alias("lines"))
    walked = F.aggregate("lines", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("mask")), walk)
    return lines.select(
        "conv_id", "perspective", "part", F.size("lines").cast("long").alias("n_messages"), F.size(F.filter("lines", lambda s: s["own"])).cast("long").alias("n_trained"),
        "char_start", F.array_join(F.transform("lines", lambda s: s["text"]), "").alias("text"), walked["mask"].alias("mask"),
    )


SQL = """
WITH m AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, turn,
    coalesce(CAST(floor(turn / 256.0) AS BIGINT), 18014398509481984) AS block FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS LAST, role, text) AS place FROM m),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role <> 'system'),
f AS (
  SELECT n.conv_id, s.perspective, n.block, (n.place - 1) // 256 AS piece, n.place, n.role IS NOT DISTINCT FROM s.perspective AS own,
    CASE WHEN n.role IS NOT DISTINCT FROM s.perspective THEN '<|assistant|>' || chr(10) WHEN n.role = 'system' THEN '<|system|>' || chr(10) ELSE '<|user name=' || n.role || '|>' || chr(10) END AS head,
    n.text || '<|end|>' || chr(10) AS body
  FROM n LEFT JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (
  SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, block, piece ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop FROM f),
g AS (
  SELECT conv_id, perspective, block, piece, count(*) AS n_messages, count(*) FILTER (WHERE own) AS n_trained, string_agg(head || body, '' ORDER BY place) AS text,
    coalesce(string_agg(CAST(stop - length(body) AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY place) FILTER (WHERE own), '') AS mask, max(stop) AS size
  FROM p GROUP BY ALL)
SELECT conv_id, perspective, CAST(row_number() OVER w - 1 AS BIGINT) AS part, CAST(n_messages AS BIGINT) AS n_messages, CAST(n_trained AS BIGINT) AS n_trained,
  CAST(coalesce(sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY block, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start, text, mask
FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY block, piece)
"""
