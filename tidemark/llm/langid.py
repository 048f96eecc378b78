"""Language identification by words first, with backoff to shorter character n-grams (operator 5).

A word is a run of letters (a-z and all beyond ASCII) of the lowered text.  A word that was learned adds
its log frequency in each language.  An unseen word is scored by its character 5-grams; if none of them
was learned by its 4-grams, then 3-, 2- and 1-grams, each time by the mean over the learned ones.  Words
carry a blank on either side, so n-grams know where a word begins and ends.  A document's language is
that with the largest sum; its score is the posterior of the mean evidence of a word, taken for as many
words as there are, 30 at most.

The tables are counts over a bounded sample of labelled rows (``rows``, ``size``).

Defined cases: ``und`` with score 0 if the text is null or has no letter, and for all texts if nothing was
learned; a text none of whose words or n-grams was learned gets the language with the most learned words
and an even score; ties go to the first language in alphabetical order.  Rows with a null language or doc_id
are never learned from.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.linear import labelled_sample
from tidemark.llm.storage import bounded, privately
from tidemark.llm.textcore import LETTERS, Chunk, chunks, mix

_U = np.uint64
SAMPLE_ROWS, SAMPLE_BYTES, SEED = 3000, 12 << 20, 5
LONGEST = 5
EVIDENCE = 30
UNDETERMINED = "und"


def _padded(texts: pa.Array) -> Iterator[Chunk]:
    """Chunks of the lowered texts."""
    for c in chunks(pc.utf8_lower(texts)):
        yield Chunk(*_with_blanks(c), c.lo, c.hi)


def _with_blanks(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """A blank before each document and one after the last, so that every word has both neighbours."""
    off = c.off + np.arange(c.n + 1)
    buf = np.full(len(c.buf) + c.n + 1, 0x20, np.uint8)
    inside = np.ones(len(buf), bool)
    inside[off] = False
    buf[inside] = np.where(LETTERS[c.buf], c.buf, 0x20)
    off = off.copy()
    off[-1] = len(buf)
    return buf, off


def ngrams(c: Chunk, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, hash) of the n-grams of words with a blank on either side."""
    heads = c.heads()
    first, last = np.searchsorted(heads, starts - 1), np.searchsorted(heads, ends)
    count = np.maximum(last - first + 2 - n, 0)
    word = np.repeat(np.arange(len(starts)), count)
    at = np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)
    edge = np.append(heads, len(c.buf))
    return word, c.hashes(edge[at], edge[at + n])


class Table:
    """Counts of keys in each language, and their log frequencies with add-half counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts

    def plus(self, keys: np.ndarray, langs: np.ndarray, weights: np.ndarray) -> "Table":
        n = self.counts.shape[1]
        new, back = np.unique(keys, return_inverse=True)
        more = np.bincount(back * n + langs, weights, minlength=len(new) * n).reshape(len(new), n)
        all_keys = np.union1d(self.keys, new)
        counts = np.zeros((len(all_keys), n))
        counts[np.searchsorted(all_keys, self.keys)] += self.counts
        counts[np.searchsorted(all_keys, new)] += more
        return Table(all_keys, counts)

    def frozen(self) -> "Table":
        """With log frequencies instead of counts."""
        self.logs = np.log((self.counts + 0.5) / (self.counts.sum(0) + 0.5 * max(len(self.keys), 1))).astype(np.float32)
        self.counts = None
        return self

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == h, at, -1)


class LanguageModel:
    def __init__(self, langs: list[str], words: Table | None, grams: dict[int, Table], default: int):
        self.langs, self.words, self.grams, self.default = langs, words, grams, default

    @classmethod
    def fit(cls, sample: list[tuple[str, str]]) -> "LanguageModel":
        """sample: texts and their languages."""
        langs = sorted({lang for _, lang in sample})
        if not langs:
            return cls([], None, {}, 0)
        number, n = {lang: i for i, lang in enumerate(langs)}, len(langs)
        label = np.array([number[lang] for _, lang in sample])
        # merged after each chunk, so that memory holds the tables and one chunk
        tables = {k: Table(np.zeros(0, _U), np.zeros((0, n))) for k in range(LONGEST + 1)}
        for c in _padded(pa.array([t for t, _ in sample], pa.large_string())):
            w = c.words(LETTERS)
            lang = label[c.lo + w.doc]
            # one of each word and language, weighed by how often it comes
            _, one, times = np.unique(mix(w.hash ^ mix(lang.astype(_U) + _U(1))), return_index=True, return_counts=True)
            tables[0] = tables[0].plus(w.hash[one], lang[one], times)
            for k in range(1, LONGEST + 1):
                word, h = ngrams(c, w.starts[one], w.ends[one], k)
                tables[k] = tables[k].plus(h, lang[one][word], times[word])
        words = tables.pop(0)
        default = int(words.counts.sum(0).argmax())
        return cls(langs, words.frozen(), {k: t.frozen() for k, t in tables.items()}, default)

    def score(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score) of each document of a padded chunk."""
        w, n = c.words(LETTERS), len(self.langs)
        logs = np.zeros((len(w.hash), n), np.float32)
        row = self.words.find(w.hash)
        logs[row >= 0] = self.words.logs[row[row >= 0]]
        rest = np.flatnonzero(row < 0)
        if len(rest):
            # each unseen word once
            _, one, back = np.unique(w.hash[rest], return_index=True, return_inverse=True)
            known = np.zeros((len(one), n), np.float32)
            open_ = np.arange(len(one))
            for k in range(LONGEST, 0, -1):
                word, h = ngrams(c, w.starts[rest[one[open_]]], w.ends[rest[one[open_]]], k)
                at = self.grams[k].find(h)
                word, at = word[at >= 0], at[at >= 0]
                count = np.bincount(word, minlength=len(open_))
                for lang in range(n):
                    known[open_, lang] = np.bincount(word, self.grams[k].logs[at, lang], minlength=len(open_)) / np.maximum(count, 1)
                open_ = open_[count == 0]
                if not len(open_):
                    break
            logs[rest] = known[back]
        total = np.stack([np.bincount(w.doc, logs[:, lang], minlength=c.n) for lang in range(n)], 1)
        best = total.argmax(1)
        flat = total.max(1) == total.min(1)
        best[flat] = self.default
        mean = total / np.maximum(w.count, 1)[:, None]
        z = (mean - mean.max(1, keepdims=True)) * np.minimum(w.count, EVIDENCE)[:, None]
        p = np.exp(z)
        return best, p[np.arange(c.n), best] / p.sum(1)


def fit(docs: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> LanguageModel:
    """Learns from text and lang of the rows where ``learn`` holds."""
    known = docs.select("doc_id", "text", "lang").filter(learn)
    return LanguageModel.fit(labelled_sample(known, None, "lang", rows, size, SEED))


def identified(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The rows of docs, in their own columns, whose language is known with a score of ``least`` or more."""
    hidden, own = privately(docs)
    return predict(hidden, model, hidden.columns).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(own)


def predict(docs: DataFrame, model: LanguageModel, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (doc_id by default) with lang_pred and score."""
    carry = carry or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    # a text that is carried goes to the workers once
    at_text = carry.index("text") if "text" in carry else len(carry)
    rows = bounded(docs).select(*carry, *([] if "text" in carry else ["text"]), lettered.alias("__lettered"))
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in carry]).add("lang_pred", "string").add("score", "double")

    def run(batches):
        model = shared.value
        for b in batches:
            text, lettered = b.column(at_text), b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            for c in _padded(text) if model.langs else [Chunk(np.zeros(0, np.uint8), np.zeros(b.num_rows + 1, np.int64), 0, b.num_rows)]:
                ok = lettered[c.lo : c.hi]
                if model.langs:
                    best, score = model.score(c)
                    lang, score = np.where(ok, np.array(model.langs, object)[best], UNDETERMINED), np.where(ok, score, 0.0)
                else:
                    lang, score = np.full(c.n, UNDETERMINED, object), np.zeros(c.n)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(c.lo, c.n) for i in range(len(carry))), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*carry, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
