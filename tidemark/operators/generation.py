"""Answers from text generators: backends behind one function, request fields, and batches with retries.

A backend is a function of (question, context, seed) that gives a text.  It is made once in each worker and called for
every row of an Arrow batch; network backends are plugged in by the caller.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as tx

Backend = Callable[[str, str, int | None], str]
_BACKENDS: dict[str, Callable[[dict], Backend]] = {}


class Permanent(Exception):
    """A failure that another attempt would not mend."""


def backend(name: str) -> Callable[[Callable[[dict], Backend]], Callable[[dict], Backend]]:
    """Register a maker of a backend from its settings."""

    def add(make: Callable[[dict], Backend]) -> Callable[[dict], Backend]:
        _BACKENDS[name] = make
        return make

    return add


def build(name: str, settings: dict | None = None) -> Backend:
    if name.lower() not in _BACKENDS:
        raise ValueError(f"unknown backend: {name}")
    return _BACKENDS[name.lower()](settings or {})


@backend("mock")
def _mock(settings: dict) -> Backend:
    def answer(question: str, context: str, seed: int | None = None) -> str:
        lines = context.strip().splitlines()
        return f"Mock answer for: {question} | {(lines[-1] if lines else 'insufficient context')[:160]}"

    return answer


def mock_answer(question: Column, context: Column) -> Column:
    """What the mock backend says, as an expression."""
    last = F.element_at(F.split(F.regexp_replace(context, r"(?U)^\s+|\s+$", ""), "\n"), -1)
    return F.concat(F.lit("Mock answer for: "), question, F.lit(" | "), F.left(F.coalesce(F.nullif(last, F.lit("")), F.lit("insufficient context")), F.lit(160)))


def request_fields(model: str, messages: list[dict], seed: int, tokens: int, temperature: float = 0.8, top_p: float = 0.95, extra: dict | None = None) -> dict:
    """The fields of a chat request: sampling settings and a seed unless they are to be left out, and the limit under the name that the model takes."""
    extra = extra or {}
    out = {"model": model, "messages": messages}
    if not extra.get("omit_sampling_parameters"):
        out |= {"temperature": temperature, "top_p": top_p} | ({} if extra.get("omit_seed") else {"seed": seed})
    out["max_completion_tokens" if extra.get("use_max_completion_tokens") else "max_tokens"] = tokens
    return out | ({"reasoning_effort": str(extra["reasoning_effort"])} if extra.get("reasoning_effort") else {})


def generate(jobs: DataFrame, name: str, settings: dict | None = None, attempts: int = 3, wait: float = 1.0, make: Callable[[dict], Backend] | None = None) -> DataFrame:
    """jobs (question, context, sample_seed, ...) with answer, error and attempts.

    A failure is tried again with waits that double, a ``Permanent`` one is not; what fails in the end has an
    empty answer and its error, so one bad row costs no batch.
    """
    make = make or _BACKENDS[name.lower()]
    schema = T.StructType(list(jobs.schema.fields)).add("answer", "string").add("error", "string").add("attempts", "integer")
    settings = settings or {}

    def run(batches):
        answer = make(settings)

        def one(question, context, seed) -> tuple[str, str | None, int]:
            for k in range(1, attempts + 1):
                try:
                    return answer(question or "", context or "", None if seed is None or pd.isna(seed) else int(seed)).strip(), None, k
                except Permanent as e:
                    return "", str(e), k
                except Exception as e:  # noqa: BLE001 - any other failure may pass
                    last = str(e)
                    time.sleep(wait * 2 ** (k - 1) if k < attempts else 0)
            return "", last, attempts

        for b in batches:
            rows = [one(*r) for r in zip(b["question"], b["context"], b["sample_seed"])]
            yield b.assign(answer=[r[0] for r in rows], error=[r[1] for r in rows], attempts=pd.array([r[2] for r in rows], "int32"))

    return jobs.mapInPandas(run, schema)


def scored_pairs(rows: DataFrame, premise: str, hypothesis: str, scorer: Callable[[pd.Series, pd.Series], pd.DataFrame]) -> DataFrame:
    """rows with ``scores`` (entailment, contradiction, neutral) of a model: each distinct pair is scored once."""
    udf = F.pandas_udf(scorer, "entailment double, contradiction double, neutral double")
    pairs = rows.select(premise, hypothesis).distinct()
    return rows.join(pairs.withColumn("scores", udf(premise, hypothesis)), [premise, hypothesis], "left")


def waits(rows: DataFrame, at: str, tokens: str, requests: int, budget: int) -> DataFrame:
    """rows over their budget: those at which more than ``requests`` or ``budget`` tokens fall into the last 60 seconds."""
    from tidemark.operators.temporal import rolling_all

    micros = rows.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    rolled = rolling_all(micros, "_t", {"_requests": F.lit(1).cast("long"), "_tokens": F.col(tokens).cast("long")}, 60_000_000)
    return rolled.filter((F.col("_requests") > requests) | (F.col("_tokens") > budget)).drop("_t")


def job_seed(base: int, *parts: Column) -> Column:
    return tx.derived_seed(base, *parts)
