"""The corpus pipeline: five stages over ``documents``, each written as a table before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontam import decontaminate
from tidemark.llm.langid import fit, identified
from tidemark.llm.neardup import keep_representatives
from tidemark.llm.packing import pack
from tidemark.llm.pii import redact
from tidemark.llm.storage import materialise
from tidemark.llm.toxicity import held_out
from tidemark.session import ship

#: A document whose language is less sure than this is rejected.
MIN_LANGUAGE_SCORE = 0.5


# All stages: columns of docs other than doc_id and text are carried as they are, whatever their names; rows are
# judged one by one, so repeated rows fare alike; an empty table stays empty.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letter, or a posterior below ``MIN_LANGUAGE_SCORE``.

    A null or empty text has no language and goes; a null doc_id is judged by its text and not learned from; with
    nothing to learn from (no row with a language) every document goes.  Ties go to the first language by name.
    """
    return identified(docs, fit(docs, ~held_out(F.col("doc_id"), 4, 2)), MIN_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near duplicates.

    Null or wordless texts and rows with a null doc_id are in no group and stay; repeated rows of the doc_id that
    stays all stay.
    """
    return keep_representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of documents; drop documents of which they are half of the words or more.

    Null and empty texts stay; benchmark rows with a null item_id or no words count for nothing.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, plain or disguised, by its kind; null and empty texts stay as they are."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokenised documents into sequences of 2048 tokens.

    A null or empty text is its end id alone; a null doc_id and repeated rows are packed like others.
    """
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("packing", packing),
]
#: SQL can express neither the trained model, the transducers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
