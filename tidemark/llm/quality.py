"""Quality rules and a calibrated hashed n-gram classifier (operator 1).

Rules on whole texts: too few words, or too many words inside three-word windows that occur again.

Classifier: logistic regression on hashed words, word pairs and character trigrams, each
kind as relative frequencies in its own third of the weights, so that length plays no part; buckets in
fewer than ``MIN_DOCS`` documents of the sample have no weight.  It is
fitted on a bounded sample of rows with a quality label (``rows``, ``size``), four fifths for the
weights and one fifth for Platt's calibration.  Documents are scored in Arrow batches; a document that
passes the rules is kept if its calibrated probability reaches the fixed threshold.

Defined cases: a null or wordless text has no words, fails the rules and is not kept (probability of
the bias alone); labels that are null or belong to no document are left out; with labels of one class
only, or none, the classifier keeps everything that passes the rules.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.linear import Rows, fit_logistic, fit_platt, labelled_sample, sigmoid
from tidemark.llm.storage import bounded
from tidemark.llm.textcore import NONSPACE, Chunk, Words, chunks, per_doc

_U = np.uint64
BITS = 18
#: Bounds of the labelled sample.
SAMPLE_ROWS, SAMPLE_BYTES, SEED = 2000, 8 << 20, 11
#: Buckets in fewer documents of the sample have no weight.
MIN_DOCS = 5
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEATED = 50, 50
#: Relative frequencies are scaled so that a feature that is everywhere has this value.
SCALE = 20.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _kinds(c: Chunk, w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, document, bucket) of every word, word pair and character trigram; trigrams come in blocks."""
    shift = _U(64 - BITS)
    pairs, h2 = w.windows(2)
    yield 0, w.doc, (w.hash >> shift).astype(np.int64)
    yield 1, w.doc[pairs], (h2 >> shift).astype(np.int64) + (1 << BITS)
    for d, h in c.grams(3):
        yield 2, d, (h >> shift).astype(np.int64) + (2 << BITS)


class QualityModel:
    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    @classmethod
    def constant(cls) -> "QualityModel":
        return cls(np.zeros(3 << BITS, np.float32), 0.0, 0.0, 20.0)

    @classmethod
    def fit(cls, sample: list[tuple[str, int]], l2: float = 1e-6) -> "QualityModel":
        y = np.array([int(v) for _, v in sample], float)
        if len(set(y.tolist())) < 2:
            return cls.constant()
        texts = pa.array([t for t, _ in sample], pa.large_string())
        dim, seen = 3 << BITS, np.zeros(3 << BITS, np.int64)
        # the first pass counts documents of buckets, the second keeps the common ones
        docs, buckets, values = [], [], []
        for keep in (False, True):
            for c in chunks(texts):
                for pair, n in _counted(c, dim):
                    d, k = pair // dim, pair % dim
                    if not keep:
                        seen += np.bincount(k, minlength=dim)
                        continue
                    share = SCALE * n / np.bincount(d, n, minlength=c.n)[d]
                    common = seen[k] >= MIN_DOCS
                    docs.append((c.lo + d[common]).astype(np.int32))
                    buckets.append(k[common].astype(np.int32))
                    values.append(share[common].astype(np.float32))
        doc, bucket, value = np.concatenate(docs), np.concatenate(buckets), np.concatenate(values)
        del docs, buckets, values
        order = np.argsort(doc, kind="stable")
        doc, bucket, value = doc[order], bucket[order], value[order]
        held = np.arange(len(y)) % 5 == 4
        held = held if 0 < y[held].sum() < held.sum() else np.zeros(len(y), bool)
        part = lambda m: Rows(np.concatenate([[0], np.cumsum(np.bincount(doc[m[doc]], minlength=len(y))[m])]), bucket[m[doc]], value[m[doc]], 3 << BITS)
        w, bias = fit_logistic(part(~held), y[~held], l2)
        check = held if held.any() else ~held
        a, b = fit_platt(part(check).dot(w) + bias, y[check])
        return cls(w.astype(np.float32), bias, a, b)

    def score(self, c: Chunk, w: Words) -> np.ndarray:
        count, weight = np.zeros((3, c.n)), np.zeros((3, c.n))
        for kind, d, k in _kinds(c, w):
            count[kind] += np.bincount(d, minlength=c.n)
            weight[kind] += np.bincount(d, self.weights[k], minlength=c.n)
        total = self.bias + SCALE * (weight / np.maximum(count, 1)).sum(0)
        return sigmoid(self.a * total + self.b)


def _counted(c: Chunk, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind: its distinct (document * dim + bucket) and how often each comes."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for kind, d, k in _kinds(c, c.words(NONSPACE)):
        held.setdefault(kind, []).append(np.unique(d * dim + k, return_counts=True))
    for parts in held.values():
        pair, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        yield pair, np.bincount(back, np.concatenate([n for _, n in parts]), minlength=len(pair)).astype(np.int64)


def repeat_words(w: Words, size: int = 3) -> np.ndarray:
    """Words of each document inside windows that occur twice or more in it."""
    at, h = w.windows(size)
    doc = w.doc[at]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(w.hash) + 1, np.int64)
    begin = at[order[twice]]
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + size, -1)
    return per_doc(np.cumsum(edge[:-1]) > 0, w.first, w.count)


def duplicate_lines(c: Chunk, w: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    starts, ends = c.runs(c.buf != 0x0A)
    h = c.hashes(starts, ends)
    wordy = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, h = starts[wordy], h[wordy]
    doc = np.searchsorted(c.off, starts, "right") - 1
    order = np.lexsort((h, doc))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][again], minlength=c.n)


def measure(c: Chunk, w: Words) -> dict[str, np.ndarray]:
    heads = np.concatenate([[0], np.cumsum((c.buf & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[c.buf])])
    return {
        "n_words": w.count.astype(np.int64),
        "word_chars": per_doc(heads[w.ends] - heads[w.starts], w.first, w.count),
        "n_symbols": np.diff(symbols[c.off]),
        "n_dup_lines": duplicate_lines(c, w),
        "n_repeat_words": repeat_words(w),
    }


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> QualityModel:
    return QualityModel.fit(labelled_sample(docs.select("doc_id", "text"), labels, "quality", rows, size, SEED))


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the measures of the rules, base_failed, probability and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            for c in chunks(b["text"]):
                w = c.words(NONSPACE)
                m = measure(c, w)
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])
                p = shared.value.score(c, w)
                columns = [b["doc_id"].slice(c.lo, c.n), *(pa.array(m[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "base_failed", "probability", "kept"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {', '.join(f'{n} long' for n in names)}, base_failed boolean, probability double, kept boolean")
