"""Table functions for SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_WORD = re.compile(r"\S+", re.ASCII)


@udtf(returnType="chunk_index int, chunk string", useArrow=True)
class WordPassages:
    """``word_passages(text, size, shared, least)``: windows of words of a text, those of fewer than ``least`` characters left out."""

    def eval(self, text: str, size: int, shared: int, least: int) -> Iterator[tuple[int, str]]:
        words = _WORD.findall(text or "")
        step, number = max(1, size - shared), 0
        last = max(0, -((size - len(words)) // step)) if words else -1
        for k in range(last + 1):
            chunk = " ".join(words[k * step : k * step + size])
            if len(chunk) >= least:
                yield number, chunk
                number += 1


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session's SQL."""
    spark.udtf.register("word_passages", WordPassages)
