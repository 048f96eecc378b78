"""Benchmark decontamination by a broadcast hash set of normalised test n-grams (operator 4).

The words of a text are the runs of digits, letters a-z and characters beyond ASCII, A-Z lowered.  A
window is ten consecutive words of a benchmark item; an item of 1 to 9 words is one window of its own
length.  One scan hashes the token windows of every document, looks them up in the broadcast set,
verifies each hit on the words themselves and marks all words that lie inside an occurrence.

The set is broadcast only within ``block_bytes`` of benchmark text.  A larger benchmark is dealt to
blocks of that size (long items in overlapping pieces, equal rows once); the blocks are scanned one after
another, each with a broadcast of its own that is dropped again, and their hits are written and united by
doc_id and text.  So no size of either table changes the result, and one block is in memory at a time.

Defined cases: null or wordless texts have no words and no hits; an item with null item_id or no words
is left out; equal item_ids count once; a null doc_id is kept as it is; rows with one doc_id are
separate rows.  Extra columns stay untouched in ``decontaminate``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.storage import bounded, materialise, privately, reducer
from tidemark.llm.textcore import ALNUM, LONG, Chunk, Words, bitmap, chunks, distinct, in_sorted

WINDOW = 10
#: Benchmark text behind one broadcast: at most 14 bytes of memory a byte (``tests/llm`` measures it), so about 110 MB in a worker.
BLOCK_BYTES = 8 << 20
#: Longer items are cut into pieces that share a window less one word.
PIECE_BYTES = 1 << 20
#: Pairs of a document and an item that are gathered at a time.
OWNED = 1 << 20
_SPANS = "array<struct<start:long,end:long,first:long,last:long>>"
_SPAN = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "first", "last")]))


class Place:
    """Where the words of all benchmark items stand, in one run of bytes."""

    def __init__(self, words: list[Words]):
        base = np.cumsum([0, *(len(w.chunk.buf) for w in words)])
        raw = np.concatenate([w.chunk.buf for w in words] or [np.zeros(0, np.uint8)])
        self.chunk = Chunk(raw, np.array([0, len(raw)]), 0, 1)
        self.starts, self.ends = (np.concatenate([(x + o).astype(np.int32) for x, o in zip(at, base)] or [np.zeros(0, np.int32)]) for at in ([w.starts for w in words], [w.ends for w in words]))


def alike(a: Words | Place, i: np.ndarray, b: Words | Place, j: np.ndarray, n: int) -> np.ndarray:
    """Whether the ``n`` words of a from each word i are those of b from the word j beside it, byte for byte."""
    same = np.ones(len(i), bool)
    for k in range(n):
        s, t = a.starts[i + k].astype(np.int64), b.starts[j + k].astype(np.int64)
        size = a.ends[i + k] - s
        same &= size == b.ends[j + k] - t
        left = np.flatnonzero(same)
        for step in range(0, min(int(size[left].max(initial=0)), LONG), 8):
            left = left[size[left] > step]
            now = left[a.chunk.eights(s[left] + step, size[left] - step) != b.chunk.eights(t[left] + step, size[left] - step)]
            same[now] = False
        for x in np.flatnonzero(same & (size > LONG)).tolist():
            same[x] = np.array_equal(a.chunk.buf[s[x] : s[x] + size[x]], b.chunk.buf[t[x] : t[x] + size[x]])
    return same


class WindowSet:
    """The windows of some benchmark items, by length: sorted hashes, where each stands in the items, and its items."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        self.size, self.ids = size, [i for i, _ in items]
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        parts, words = [], 0
        for c in chunks(pa.array([t for _, t in items], pa.large_string())):
            w = c.lowered().words(ALNUM)
            length = np.minimum(w.count, size)
            for n in np.unique(length[length > 0]).tolist():
                at, h = w.windows(n)
                ok = length[w.doc[at]] == n
                at = at[ok]
                found.setdefault(n, []).append((h[ok], (words + at).astype(np.int32), (c.lo + w.doc[at]).astype(np.int32)))
            parts.append(w)
            words += len(w.starts)
        self.place, self.by_length = Place(parts), {}
        for n, columns in found.items():
            h, at, owner = (np.concatenate(x) for x in zip(*columns))
            order = np.lexsort((owner, h))
            h, at, owner = h[order], at[order], owner[order]
            first = np.append(True, h[1:] != h[:-1])
            head = np.flatnonzero(first)[np.cumsum(first) - 1]
            # windows of one hash that differ in their words stay apart, next to each other
            again = np.flatnonzero(~first)
            first[again] = ~alike(self.place, at[again], self.place, at[head[again]], n)
            begin = np.flatnonzero(first)
            self.by_length[n] = (h[begin], bitmap(h[begin]), at[begin], np.append(begin, len(h)), owner)
        self.place.chunk.forget()

    def scan(self, words: Words) -> tuple[np.ndarray, dict[int, set]]:
        """(which words of the chunk lie in an occurrence, items of each document that has one).

        Every hit is verified on its words, all hits of a length at once; the items are looked up for the distinct
        windows of a document, however often each occurs.
        """
        edge, pairs = np.zeros(len(words.hash) + 1, np.int64), np.zeros(0, np.int64)
        for n, (keys, bits, place, begin, owner) in self.by_length.items():
            at, h = words.windows(n)
            near = in_sorted(keys, h, bits)
            at, h = at[near], h[near]
            window = np.searchsorted(keys, h)
            while len(at):
                good = alike(self.place, place[window], words, at, n)
                edge += np.bincount(at[good], minlength=len(edge)) - np.bincount(at[good] + n, minlength=len(edge))
                pairs = self._owned(pairs, distinct(words.doc[at[good]] * len(keys) + window[good]), len(keys), begin, owner)
                # another window of that hash
                window = window + 1
                more = np.flatnonzero(keys[np.minimum(window, len(keys) - 1)] == h)
                more = more[window[more] < len(keys)]
                at, h, window = at[more], h[more], window[more]
        items: dict[int, set] = {}
        for d, o in zip((pairs // max(1, len(self.ids))).tolist(), (pairs % max(1, len(self.ids))).tolist()):
            items.setdefault(d, set()).add(self.ids[o])
        return np.cumsum(edge[:-1]) > 0, items

    def _owned(self, pairs: np.ndarray, hits: np.ndarray, n_keys: int, begin: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """``pairs`` of documents and items (as one number) with those of the hits, which are documents and windows."""
        doc, window = hits // n_keys, hits % n_keys
        count = begin[window + 1] - begin[window]
        upto, lo = np.cumsum(count), 0
        while lo < len(hits):
            # about OWNED pairs at a time, so that windows with very many items take no more memory than others
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - count[lo] + OWNED, "right")))
            c = count[lo:hi]
            at = np.repeat(begin[window[lo:hi]] - np.cumsum(c) + c, c) + np.arange(c.sum())
            pairs = distinct(np.concatenate([pairs, np.repeat(doc[lo:hi], c) * len(self.ids) + owner[at]]))
            lo = hi
        return pairs


def pieces(text: str, size: int, limit: int) -> list[str]:
    """A text in pieces of about ``limit`` bytes that have all its windows between them, and no others."""
    raw = text.encode()
    if len(raw) <= limit:
        return [text]
    (c,) = chunks(pa.array([text], pa.large_string()))
    w = c.lowered().words(ALNUM)
    n, out, i = len(w.starts), [], 0
    while i < n:
        j = n if n <= size else min(n, max(i + size, int(np.searchsorted(w.starts, w.starts[i] + limit))))
        out.append(raw[w.starts[i] : w.ends[j - 1]].decode())
        i = n if j == n else min(j - size + 1, n - size)
    return out


def _blocks(benchmark: DataFrame, size: int, block_bytes: int, piece_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= block_bytes:
        return [items]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b["item_id"].to_pylist(), b["text"].to_pylist()):
                for p in pieces(t, size, piece_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([p])], names=["item_id", "text"])

    small = materialise(bounded(items.distinct()).mapInArrow(cut, "item_id string, text string"), "items")
    n = max(1, math.ceil((small.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    return [small.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _windows(block: DataFrame, size: int) -> WindowSet:
    got = block.toArrow()
    return WindowSet(list(zip(got["item_id"].to_pylist(), got["text"].to_pylist())), size)


def _without(text: str, spans: list[dict]) -> str:
    """The text with a blank in place of each span of bytes."""
    raw, at, parts = text.encode(), 0, []
    for s in spans:
        parts += [raw[at : s["start"]], b" "]
        at = s["end"]
    return b"".join([*parts, raw[at:]]).decode()


def _schema(docs: DataFrame, carry: list[str]) -> T.StructType:
    schema = T.StructType([docs.schema[c] for c in carry])
    for name, kind in (("n_words", "long"), ("items", "array<string>"), ("spans", _SPANS)):
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return schema


def _spans_of(w: Words, hit: np.ndarray) -> list[list[dict]]:
    """The runs of hit words of each document, in bytes and words."""
    c, spans, where = w.chunk, [[] for _ in range(w.chunk.n)], np.flatnonzero(hit)
    if len(where):
        new = np.append(True, (np.diff(where) > 1) | (w.doc[where[1:]] != w.doc[where[:-1]]))
        first = where[new]
        last = where[np.append(np.flatnonzero(new)[1:], len(where)) - 1]
        for i, j in zip(first.tolist(), last.tolist()):
            d = int(w.doc[i])
            o, f = int(c.off[d]), int(w.first[d])
            spans[d].append({"start": int(w.starts[i]) - o, "end": int(w.ends[j]) - o, "first": i - f, "last": j - f})
    return spans


def _scan(docs: DataFrame, shared, carry: list[str], drop_percent: int | None = None) -> DataFrame:
    """Per row: the carried columns, n_words, items, spans (byte offsets of runs of hit words) and their words.

    With ``drop_percent`` (and text among the carried): the carried columns alone, the spans cut out of text,
    without rows of which that share of the words or more is hit.
    """
    at_text = carry.index("text") if "text" in carry else len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(at_text)):
                w = c.lowered().words(ALNUM)
                hit, items = shared.value.scan(w)
                spans = _spans_of(w, hit)
                out = [b.column(k).slice(c.lo, c.n) for k in range(len(carry))]
                if drop_percent is None:
                    out += [pa.array(w.count.astype(np.int64)), pa.array([sorted(items.get(d, ())) for d in range(c.n)], pa.list_(pa.string())), pa.array(spans, _SPAN)]
                    yield pa.RecordBatch.from_arrays(out, names=[*carry, "n_words", "items", "spans"])
                else:
                    yield _cut(pa.RecordBatch.from_arrays(out, names=carry), spans, w.count, drop_percent)

    rows = bounded(docs).select(*carry, *(["text"] if "text" not in carry else []))
    return rows.mapInArrow(run, _schema(docs, carry) if drop_percent is None else docs.select(*carry).schema)


def _cut(b: pa.RecordBatch, spans: list[list[dict]], n_words: np.ndarray, drop_percent: int) -> pa.RecordBatch:
    if not any(spans):
        return b
    n_hit = np.array([sum(s["last"] - s["first"] + 1 for s in ss) for ss in spans])
    k = b.schema.names.index("text")
    texts = b.column(k).to_pylist()
    columns = list(b.columns)
    columns[k] = pa.array([_without(t, ss) if ss else t for t, ss in zip(texts, spans)], b.schema.types[k])
    keep = (n_hit == 0) | (100 * n_hit < drop_percent * n_words)
    return pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(pa.array(keep))


def _merged(spans: list[dict]) -> list[dict]:
    """Spans of several blocks as disjoint runs of words."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda x: x["first"]):
        if out and s["first"] <= out[-1]["last"] + 1:
            if s["last"] > out[-1]["last"]:
                out[-1] = out[-1] | {"end": s["end"], "last": s["last"]}
        else:
            out.append(s)
    return out


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        items = [sorted({i for x in ii for i in x}) for ii in b["items"].to_pylist()]
        spans = [_merged([s for x in ss for s in x]) for ss in b["spans"].to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPAN)], schema=pa.schema([*list(b.schema)[:-2], pa.field("items", pa.list_(pa.string())), pa.field("spans", _SPAN)]))


def _hits_of_blocks(docs: DataFrame, blocks: list[DataFrame], size: int) -> DataFrame:
    """(__mark, items, spans) of each doc_id and text that any block hits; docs carry __mark, which tells them apart."""
    spark, found = docs.sparkSession, None
    for block in blocks:
        shared = spark.sparkContext.broadcast(_windows(block, size))
        # equal rows have equal hits
        hits = materialise(_scan(docs, shared, ["__mark"]).filter(F.size("items") > 0).dropDuplicates(["__mark"]), "hits")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    both = found.groupBy("__mark").agg(F.collect_list("items").alias("items"), F.collect_list("spans").alias("spans"))
    return materialise(both.mapInArrow(_unite, f"__mark string, items array<string>, spans {_SPANS}"), "hits")


def _with_hits(docs: DataFrame, benchmark: DataFrame, carry: list[str], size: int, block_bytes: int, piece_bytes: int, drop_percent: int | None) -> DataFrame:
    spark, blocks = docs.sparkSession, _blocks(benchmark, size, block_bytes, piece_bytes)
    if len(blocks) == 1:
        return _scan(docs, spark.sparkContext.broadcast(_windows(blocks[0], size)), carry, drop_percent)
    mark = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit(""))))
    marked = docs.select(*dict.fromkeys([*carry, "doc_id", "text"])).withColumn("__mark", mark)
    hits = _hits_of_blocks(marked, blocks, size)
    # texts of rows that no block hits are not shuffled
    seen = reducer(hits, "__mark").marked(marked, "__mark", "__near")
    near = seen.filter("__near").join(hits, "__mark", "left").select(*carry, *([] if "text" in carry else ["text"]), "items", "spans")
    clean, none = seen.filter("not __near"), spark.sparkContext.broadcast(WindowSet([], size))
    if drop_percent is not None:
        return clean.select(*carry).unionByName(near.mapInArrow(_finish(carry, drop_percent), docs.select(*carry).schema))
    return _scan(clean, none, carry).unionByName(near.mapInArrow(_finish(carry, None), _schema(docs, carry)))


def _finish(carry: list[str], drop_percent: int | None) -> Callable:
    """From rows with their hits to those of ``_scan``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.names.index("text")
            spans = [x or [] for x in b["spans"].to_pylist()]
            for c in chunks(b.column(k)):
                n = c.lowered().words(ALNUM).count.astype(np.int64)
                rows = b.select(carry).slice(c.lo, c.n)
                if drop_percent is not None:
                    yield _cut(rows, spans[c.lo : c.hi], n, drop_percent)
                    continue
                items = pa.array([x or [] for x in b["items"].slice(c.lo, c.n).to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(n), items, pa.array(spans[c.lo : c.hi], _SPAN)], names=[*carry, "n_words", "items", "spans"])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The rows of docs (all of ``carry``, by default doc_id) with n_words, n_hit, items and spans."""
    out = _with_hits(docs, benchmark, carry or ["doc_id"], size, block_bytes, piece_bytes, None)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return out.withColumn("n_hit", n_hit)


def decontaminate(docs: DataFrame, benchmark: DataFrame, drop_percent: int = 50, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """docs without contamination, in their own columns.

    A document of which ``drop_percent`` of the words or more are hit goes; from the others the hit runs
    are cut out (a blank stands in their place), and clean documents stay byte for byte.
    """
    hidden, own = privately(docs, ("text", "doc_id"))
    return _with_hits(hidden, benchmark, hidden.columns, size, block_bytes, piece_bytes, drop_percent).select(own)
