"""Every query of the library by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; ``oracle`` is DuckDB SQL over the same tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["retrieval_rrf_fusion"](spark, sf_dir)


from tidemark.plans import answers, audit, cohort, detection, drift, evidence, models, probe, quality, records, retrieval, statistics, vectors  # noqa: E402, F401
