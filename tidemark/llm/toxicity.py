"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios (operator 6).

Features are the character n-grams (three to five characters of the lowered text) that a document has, hashed
to 2**18 buckets.  A bucket's value is its log-count ratio: how much likelier a toxic document has it
than a clean one, with add-one counts.  Buckets in fewer than ``MIN_DOCS`` documents or with a ratio
below ``MIN_RATIO`` either way say nothing and are left out.  Logistic regression weighs the scaled
features; it is fitted on a bounded sample of labelled rows (``rows``, ``size``).

Defined cases: a null or empty text has the score of the bias; labels that are null or belong to no
document are left out; with labels of one class only, or none, every score is the share of label 1
(0 without labels).  Null doc_ids are never learned from.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.linear import Rows, fit_logistic, labelled_sample, sigmoid
from tidemark.llm.storage import bounded
from tidemark.llm.textcore import Chunk, chunks, distinct

_U = np.uint64
BITS = 18
SIZES = (3, 4, 5)
SAMPLE_ROWS, SAMPLE_BYTES, SEED = 3000, 12 << 20, 6
MIN_DOCS, MIN_RATIO = 8, 2.0


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def grams(c: Chunk, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the n-grams each document has, each pair once."""
    c = c.lowered()
    pair = np.zeros(0, np.int64)
    for n in SIZES:
        found = [pair]
        for doc, h in c.grams(n):
            k = (h >> _U(64 - BITS)).astype(np.int64)
            if wanted is not None:
                hit = wanted[k]
                doc, k = doc[hit], k[hit]
            # at most one of each bucket stays, however long the text
            found.append(distinct(doc << BITS | k))
        pair = distinct(np.concatenate(found))
    return pair >> BITS, pair & ((1 << BITS) - 1)


class ToxicityModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.wanted = weights != 0

    @classmethod
    def fit(cls, sample: list[tuple[str, int]], l2: float = 3e-4) -> "ToxicityModel":
        y = np.array([int(v) for _, v in sample], float)
        if len(set(y.tolist())) < 2:
            return cls(np.zeros(1 << BITS, np.float32), 30.0 if y.sum() else -30.0)
        texts = pa.array([t for t, _ in sample], pa.large_string())
        toxic, clean = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for c in chunks(texts):
            d, k = grams(c)
            bad = y[c.lo + d] > 0
            toxic += np.bincount(k[bad], minlength=1 << BITS)
            clean += np.bincount(k[~bad], minlength=1 << BITS)
        ratio = np.log((toxic + 1) / (y.sum() + 2)) - np.log((clean + 1) / (len(y) - y.sum() + 2))
        ratio[(toxic + clean < MIN_DOCS) | (np.abs(ratio) < MIN_RATIO)] = 0
        # a second pass keeps only the buckets that say something
        docs, buckets = [], []
        for c in chunks(texts):
            d, k = grams(c, ratio != 0)
            docs.append((c.lo + d).astype(np.int32))
            buckets.append(k.astype(np.int32))
        doc, bucket = np.concatenate(docs), np.concatenate(buckets)
        begin = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(y)))])
        weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        w, bias = fit_logistic(Rows(begin, bucket, ratio[bucket].astype(np.float32), 1 << BITS), y, l2, weight=weight)
        return cls((w * ratio).astype(np.float32), bias)

    def score(self, c: Chunk) -> np.ndarray:
        d, k = grams(c, self.wanted)
        return sigmoid(self.bias + np.bincount(d, self.weights[k], minlength=c.n))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> ToxicityModel:
    """Learns from rows of docs with a label where ``learn`` holds."""
    return ToxicityModel.fit(labelled_sample(docs.select("doc_id", "text").filter(learn), labels, "toxic", rows, size, SEED))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row of docs: the model's probability of label 1, for a null text that of an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for c in chunks(b["text"]):
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(c.lo, c.n), pa.array(shared.value.score(c))], names=["doc_id", "score"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
