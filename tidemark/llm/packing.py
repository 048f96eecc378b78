"""Harmonic packing of tokenised documents into sequences of at most ``capacity`` tokens (operator 8).

A piece of length n belongs to class j = capacity // n, the pieces of which j fill a sequence; a class's
sequences take exactly j pieces, whatever they are, so workers fill their classes independently and
without looking back.  A document first gives off whole sequences.  What remains is one piece if j of
its like waste at most a ``1 / slack`` part of a sequence; otherwise the largest reciprocal below it,
capacity // (j + 1), is cut off and the rest goes the same way, so every class is filled closely.  At the
end of a partition its few unfinished sequences are emptied and their pieces packed by decreasing
length, each into the first sequence with room.

No exchange is needed: each partition of the input packs its own documents.  A lost task is repeated
from its input split and gives the same pieces and sequence ids.  Memory: the open sequences (at most
one a class, about 90 classes) and one chunk of text.

Defined cases: a null or empty text is its end id alone; a null doc_id is packed like any other; rows
are packed one by one, so repeated ids or rows each get pieces of their own; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import Encoder, default_path
from tidemark.llm.storage import bounded

CAPACITY = 2048
SLACK = 64
END_ID = 1
#: Bytes of ids that a task gathers before it passes them on.
FLUSH = 1 << 20
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=1 << 16)
def cuts(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> tuple[int, ...]:
    """The lengths of the pieces of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        j = capacity // n
        piece = n if (capacity - j * n) * slack <= capacity else capacity // (j + 1)
        out.append(piece)
        n -= piece
    return tuple(out)


class Packer:
    """Takes pieces (length, payload) and gives whole sequences: lists of pieces."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.open: dict[int, list] = {}

    def add(self, length: int, piece) -> list | None:
        j = self.capacity // length
        bin_ = self.open.setdefault(j, [])
        bin_.append((length, piece))
        if len(bin_) == j:
            del self.open[j]
            return bin_
        return None

    def rest(self) -> list[list]:
        pieces = sorted((p for b in self.open.values() for p in b), key=lambda p: -p[0])
        bins: list[list] = []
        room: list[int] = []
        for p in pieces:
            k = next((i for i, r in enumerate(room) if r >= p[0]), len(bins))
            if k == len(bins):
                bins.append([])
                room.append(self.capacity)
            bins[k].append(p)
            room[k] -= p[0]
        self.open = {}
        return bins


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """Every piece with its ids (little-endian unsigned 32-bit) and its place in a sequence."""
    path = path or default_path()

    def run(batches):
        from pyspark import TaskContext

        encoder, packer = Encoder.shared(path), Packer(capacity)
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held = 0

        def flush():
            nonlocal rows, held
            if rows:
                out, rows, held = rows, [], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)

        def place(bin_):
            nonlocal sequence, held
            at = 0
            for length, (doc_id, start, ids, total) in bin_:
                rows.append((doc_id, start, length, ids, total, sequence, at))
                at += length
                held += len(ids)
            sequence += 1

        for b in batches:
            for doc_id, ids in zip(b["doc_id"].to_pylist(), encoder.encode(b["text"])):
                ids = np.append(ids, encoder.dtype(end_id)).astype("<u4")
                at = 0
                for length in cuts(len(ids), capacity, slack):
                    whole = packer.add(length, (doc_id, at, ids[at : at + length].tobytes(), len(ids)))
                    at += length
                    if whole:
                        place(whole)
                if held >= FLUSH:
                    yield from flush()
        for bin_ in packer.rest():
            place(bin_)
        yield from flush()

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
