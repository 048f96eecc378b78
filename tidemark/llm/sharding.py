"""Two-pass external shuffle of records into shards (operator 3).

Law ``key``: the shard depends on doc_id and the number of shards alone, as the largest of one seeded
hash for each shard (rendezvous hashing), so one more shard takes rows only into itself.

Pass 1 scatters records uniformly into buckets: the shard, and within it one of as many buckets as keep
a bucket near ``bucket_bytes``, by a seeded hash of the whole record.  Equal records are numbered off, and
the number is part of the hash, so that they are scattered as well.  The exchange has a task a bucket, up to
``MOST_TASKS``; which task a bucket is in changes nothing.  Pass 2 takes each bucket into
memory in a fixed base order, shuffles it by Fisher-Yates with a seed of its own and writes it.  Bucket
by bucket that is a uniformly random order of the shard, and it is the same in every attempt and on any
cluster.  A shard's slots run through its buckets without a gap.

Defined cases: a null text counts as empty; null doc_ids are one key; rows with one doc_id share a
shard (the law) but are scattered by all they hold; an empty table gives no rows.  All columns are written,
under names of their own: the columns that the shuffle adds begin with two underscores.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.neardup import groups
from tidemark.llm.storage import bounded, materialise, new_path, reducer

SHARDS = 24
SEED = 20240131
BUCKET_BYTES = 8 << 20
#: Tasks of the exchange. Beyond that many buckets a task sorts and shuffles several, one after another.
MOST_TASKS = 20_000
#: Equal records that a task counts out.
TWINS = 1000


def size_of(text: Column) -> Column:
    """UTF-8 bytes and 8 for the id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash of the id is largest (ties: the larger shard)."""
    marks = [F.struct(F.xxhash64(doc_id, F.lit(seed), F.lit(k)).alias("h"), F.lit(k).alias("shard")) for k in range(shards)]
    return F.array_max(F.array(*marks))["shard"]


def fisher_yates(n: int, seed: str) -> np.ndarray:
    """A uniformly random order of 0 .. n - 1."""
    rng, order = random.Random(seed), list(range(n))
    for i in range(n - 1, 0, -1):
        j = rng.randrange(i + 1)
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with __twin: 0 for a record that is there once, 0 .. n - 1 for equal ones.

    Equal records are found by two hashes of the whole record.  Only they are grouped, which combines them before
    the exchange, and each group is counted out again; all others stay where they are.
    """
    whole = [F.col(f"`{c}`") for c in docs.columns]
    marks = docs.select(F.xxhash64(*whole).alias("__h1"), F.xxhash64(F.lit(SEED), *whole).alias("__h2"))
    again = materialise(marks.groupBy("__h1", "__h2").count().filter("count > 1").select("__h1"), "twins")
    if again.isEmpty():
        return docs.withColumn("__twin", F.lit(0).cast("long"))
    seen = reducer(again, "__h1").marked(docs.withColumn("__h1", F.xxhash64(*whole)), "__h1", "__near")
    grouped = seen.filter("__near").groupBy(*whole).agg(F.count("*").alias("__n"))
    # a record of n copies is counted out by n / TWINS tasks
    spans = grouped.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(TWINS).cast("long"))).alias("__from"))
    spread = spans.repartition(F.xxhash64(*whole), "__from")
    upto = F.least(F.col("__n"), F.col("__from") + TWINS) - 1
    counted = spread.select(*whole, F.explode(F.sequence("__from", upto)).alias("__twin"))
    return seen.filter("not __near").select(*whole, F.lit(0).cast("long").alias("__twin")).unionByName(counted)


def external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, out: str | None = None) -> str:
    """Write docs to ``__shard=k`` folders under ``out`` and return it; rows get __bucket and __place columns."""
    spark = docs.sparkSession
    out = out or new_path(spark, "shards")
    total = docs.agg(F.sum(size_of(F.col("text")))).first()[0] or 0
    buckets = max(1, math.ceil(total / (shards * bucket_bytes)))
    whole = [F.col(f"`{c}`") for c in docs.columns]
    rows = (
        _numbered(bounded(docs)).withColumn("__order", F.xxhash64(*whole)).withColumn("__shard", shard_of(F.col("doc_id"), shards, seed))
        .withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "__order", "__twin"), F.lit(buckets)).cast("int"))
        .repartition(min(shards * buckets, MOST_TASKS), "__shard", "__bucket")
        .sortWithinPartitions("__shard", "__bucket", "doc_id", "__order", "__twin")
        .drop("__order", "__twin")
    )
    schema = T.StructType(list(rows.schema.fields)).add("__place", "long")

    def shuffle(batches):
        for g in groups(batches, ["__shard", "__bucket"]):
            order = fisher_yates(g.num_rows, f"{seed}:{g['__shard'][0].as_py()}:{g['__bucket'][0].as_py()}")
            fields = [pa.field(f.name, pa.large_string()) if pa.types.is_string(f.type) else f for f in g.schema]
            mixed = g.cast(pa.schema(fields)).take(pa.array(order)).cast(g.schema)
            for b in mixed.append_column("__place", pa.array(np.arange(g.num_rows))).combine_chunks().to_batches(max_chunksize=2000):
                yield b

    rows.mapInArrow(shuffle, schema).sortWithinPartitions("__shard", "__bucket", "__place").write.partitionBy("__shard").parquet(out)
    return out


def slots(spark, out: str, columns: list[str]) -> DataFrame:
    """The rows read back from the shards, with __shard and __slot: their place in the shard."""
    rows = spark.read.parquet(out)
    counts = rows.groupBy("__shard", "__bucket").count()
    before = Window.partitionBy("__shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__shard", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    placed = rows.select("__shard", "__bucket", "__place", *columns).join(bases, ["__shard", "__bucket"])
    return placed.withColumn("__slot", F.col("__base") + F.col("__place")).drop("__base")
