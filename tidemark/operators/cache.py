"""A cache of what an encoder makes of texts, kept between runs in a folder and addressed by content.

A text's key is the SHA-256 of the encoder's name and the text.  A run looks its keys up, encodes the texts that are not there, each once,
and appends them; it also notes which keys it used, so that the least recently used can be dropped.  Files are only ever added
or replaced as a whole table, so that a repeated task leaves the same table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import written


class Cache:
    """Vectors by content.  ``encode`` takes a table (key, text) and returns (key, v) for each of its rows."""

    def __init__(self, spark: SparkSession, folder: str, encoder: str, encode: Callable[[DataFrame], DataFrame]):
        self.spark, self.folder, self.encoder, self.encode = spark, folder.rstrip("/"), encoder, encode

    def _table(self, name: str, schema: str) -> DataFrame:
        """All that runs have written of a table; none yet is an empty table."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def vectors(self) -> DataFrame:
        """(key, v): a key that two runs added at the same time is there once."""
        return self._table("vectors", "key binary, v array<double>").groupBy("key").agg(F.first("v").alias("v"))

    def used(self) -> DataFrame:
        """(key, run): the last run that used a key."""
        return self._table("used", "key binary, run long").groupBy("key").agg(F.max("run").alias("run"))

    def key(self, text: str) -> F.Column:
        return F.unhex(F.sha2(F.concat(F.lit(f"{self.encoder}\n"), F.coalesce(text, F.lit(""))), 256))

    def encoded(self, rows: DataFrame, text: str) -> tuple[DataFrame, int]:
        """(rows with ``v`` and whether it was in the cache before (``cached``), how many texts were encoded)."""
        keyed = written(rows.withColumn("_key", self.key(text)))
        asked = keyed.groupBy(F.col("_key").alias("key")).agg(F.first(F.coalesce(text, F.lit(""))).alias("text"))
        known = written(asked.select("key").join(self.vectors(), "key"))
        new = written(self.encode(asked.join(known.select("key"), "key", "left_anti")).select("key", "v"))
        count, run = new.count(), (self.used().agg(F.max("run")).first()[0] or 0) + 1
        if count:
            new.write.parquet(f"{self.folder}/vectors/{uuid.uuid4().hex}")
        asked.select("key", F.lit(run).cast("long").alias("run")).write.parquet(f"{self.folder}/used/{uuid.uuid4().hex}")
        both = known.withColumn("cached", F.lit(True)).unionByName(new.withColumn("cached", F.lit(False))).withColumnRenamed("key", "_key")
        return keyed.join(both, "_key", "left").drop("_key"), count

    def evict(self, keep: int) -> int:
        """Drop all but about the ``keep`` keys that were used last; how many are left.  Runs are kept or dropped as a whole, beginning with the last."""
        sizes = self.used().groupBy("run").count().orderBy(F.desc("run"))
        total, oldest = 0, None
        for r in sizes.toLocalIterator():  # a row a run
            if oldest is not None and total + r["count"] > keep:
                break
            total, oldest = total + r["count"], r["run"]
        recent = written(self.used().filter(F.col("run") >= F.lit(oldest)))
        left = written(self.vectors().join(recent.select("key"), "key", "left_semi"))
        left.write.mode("overwrite").parquet(f"{self.folder}/vectors")
        recent.write.mode("overwrite").parquet(f"{self.folder}/used")
        return left.count()


def hashed(texts: DataFrame, bins: int = 64) -> DataFrame:
    """(key, v): dense unit vectors of signed token counts; a text without tokens has zeros."""
    from tidemark.operators.distances import hashed_embedding

    sparse = hashed_embedding(texts, "key", F.col("text"), bins).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bin", "value"))).alias("m"))
    return texts.select("key").join(sparse, "key", "left").select("key", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0.0))).alias("v"))
