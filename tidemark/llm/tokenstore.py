"""Binary token shards with a minimal perfect hash index (operator 7).

Shards: documents in ascending doc_id order (ties by a hash of the text, null ids first) are dealt to
ranges.  A task tokenises its range and streams it to files: a fixed header, the raw ids (16-bit if the
vocabulary allows, else 32-bit, little-endian), where each document ends, and a fixed tail.  A file is
closed at ``shard_bytes`` of ids, so no file and no task's memory grows with a range of long or equal rows.

Index: keys (64-bit hashes of doc_ids) are dealt to segments by their value.  A segment file holds a
minimal perfect hash of its distinct keys (levels of bit arrays: a key is settled on the first level
where it alone maps to its bit, and its slot is the rank of that bit), sampled ranks, and for each slot a
32-bit fingerprint from another hash and the runs of that key: shard, offset of its first id, ids, first
document, documents.  ``get`` computes segment, bit, rank and slot from the key alone and reads only those
bytes of the index and of the shard, so one keyed access touches a constant number of small ranges; the
fingerprint turns away keys that are not in the store.

Files are written under a temporary name and moved into place, so repeated and speculative attempts
leave one whole file each.  A manifest says how many keys each segment has and how many files each range;
a file that is lost is an error and never a missing row.  Only shard totals, one row a shard, are summed in order.

Defined cases: a null text is empty (its end id alone); rows with one doc_id are one key with several
documents; a null doc_id is a key as well; an empty table gives a store without shards; other columns
are ignored.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import Encoder, default_path
from tidemark.llm.neardup import groups
from tidemark.llm.storage import Publisher, bounded, fetch, materialise, new_path, publish
from tidemark.llm.textcore import mix

MAGIC = b"TIDETOK2"
END_ID = 2
SHARD_BYTES = 16 << 20
#: Keys of an index segment.
SEGMENT_KEYS = 1 << 18
#: Bytes of shard that a bulk read takes at once, and files that a range may have.
READ_BYTES, FILES = 4 << 20, 1 << 20
#: Ranges of keys; beyond that many shards a task writes several, one after another.
MOST_TASKS = 20_000
HEADER = 16
_U = np.uint64
_RUN = ("shard", "at", "ids", "ordinal", "count")


class PerfectHash:
    """Keys to 0 .. n - 1 without collisions or gaps."""

    GAMMA = 2.0
    LEVELS = 64

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        """The bit of each key on a level."""
        return (mix(keys + _U((level + 1) * 0xD1342543DE82EF95 % (1 << 64))) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> list[np.ndarray]:
        """The levels for distinct unsigned 64-bit integers."""
        levels = []
        while len(keys):
            if len(levels) == cls.LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, math.ceil(cls.GAMMA * len(keys)))
            at = cls.place(keys, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            keys = keys[~bits[at]]
        return levels


class Segment:
    """One file of the index, read through ``read(start, length)``: whole, or a few bytes at a time."""

    #: Bits between two sampled ranks.
    SAMPLE = 512
    KINDS = {"levels": "<u1", "ranks": "<i8", "mark": "<u4", "begin": "<i8", **dict.fromkeys(_RUN, "<i8")}

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        size = int.from_bytes(read(0, 8), "little")
        head = json.loads(read(8, size))
        self.level_sizes, self.n, self.places = head["levels"], head["keys"], head["places"]

    @classmethod
    def whole(cls, data: bytes) -> "Segment":
        return cls(lambda start, length: data[start : start + length])

    @classmethod
    def dump(cls, key: np.ndarray, mark: np.ndarray, runs: dict[str, np.ndarray]) -> tuple[bytes, int]:
        """(file, number of keys) of runs; a key may have several, in order."""
        keys = np.unique(key)
        levels = PerfectHash.build(keys)
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros(-(-len(bits) // cls.SAMPLE) * cls.SAMPLE, np.int64)
        padded[: len(bits)] = bits
        sums = padded.reshape(-1, cls.SAMPLE).sum(1)
        arrays = {"levels": packed, "ranks": np.cumsum(sums) - sums}
        slot = cls._slots(key, [len(x) for x in levels], lambda at: bits[at], lambda at: np.cumsum(bits)[at] - 1)
        order = np.lexsort((runs["ordinal"], runs["shard"], slot))
        marks = np.zeros(len(keys), np.uint32)
        marks[slot] = mark
        arrays |= {"mark": marks, "begin": np.searchsorted(slot[order], np.arange(len(keys) + 1)), **{k: runs[k][order] for k in _RUN}}
        raw = {k: np.ascontiguousarray(a, cls.KINDS[k]).tobytes() for k, a in arrays.items()}
        at, places = 0, {}
        for k, r in raw.items():
            places[k] = [at, len(arrays[k])]
            at += len(r)
        head = json.dumps({"levels": [len(x) for x in levels], "keys": len(keys), "places": places}).encode()
        return b"".join([len(head).to_bytes(8, "little"), head, *raw.values()]), len(keys)

    @staticmethod
    def _slots(keys: np.ndarray, sizes: list[int], bit: Callable, rank: Callable) -> np.ndarray:
        """The slot of each key; a key that was not given may get any slot, or -1."""
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(sizes):
            if not len(open_):
                break
            at = base + PerfectHash.place(keys[open_], level, size)
            hit = bit(at)
            if hit.any():
                out[open_[hit]] = rank(at[hit])
            open_, base = open_[~hit], base + size
        return out

    def array(self, name: str, start: int = 0, length: int | None = None) -> np.ndarray:
        """Some values of an array of the file."""
        at, n = self.places[name]
        kind = np.dtype(self.KINDS[name])
        length = n - start if length is None else length
        # the arrays begin behind the head
        base = 8 + int.from_bytes(self.read(0, 8), "little")
        return np.frombuffer(self.read(base + at + start * kind.itemsize, length * kind.itemsize), kind)

    def find(self, key: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(index of the key, its runs) for all runs of the keys that are in the store; reads the arrays whole."""
        bits = np.unpackbits(self.array("levels"), bitorder="little").astype(bool)
        ranks = np.cumsum(bits) - 1
        slot = self._slots(key, self.level_sizes, lambda at: bits[at], lambda at: ranks[at])
        ok = np.flatnonzero(slot >= 0)
        ok = ok[self.array("mark")[slot[ok]] == mark[ok]] if len(ok) else ok
        begin = self.array("begin") if self.n else np.zeros(1, np.int64)
        first, n = begin[slot[ok]], begin[slot[ok] + 1] - begin[slot[ok]] if len(ok) else np.zeros(0, np.int64)
        which = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
        return np.repeat(ok, n), {k: self.array(k)[which] for k in _RUN}

    def get(self, key: int, mark: int) -> list[dict[str, int]]:
        """The runs of one key, from a few bytes of each array."""

        def bit(at: np.ndarray) -> np.ndarray:
            return np.array([self.array("levels", i >> 3, 1)[0] >> (i & 7) & 1 for i in at.tolist()], bool)

        def rank(at: np.ndarray) -> np.ndarray:
            (i,) = at.tolist()
            block = i // self.SAMPLE
            ones = np.unpackbits(self.array("levels", block * self.SAMPLE >> 3, (i >> 3) - (block * self.SAMPLE >> 3) + 1), bitorder="little")
            return np.array([self.array("ranks", block, 1)[0] + int(ones[: i - block * self.SAMPLE].sum())])

        (slot,) = self._slots(np.array([key], _U), self.level_sizes, bit, rank).tolist()
        if slot < 0 or self.array("mark", slot, 1)[0] != mark:
            return []
        lo, hi = self.array("begin", slot, 2).tolist()
        columns = [self.array(k, lo, hi - lo).tolist() for k in _RUN]
        return [dict(zip(_RUN, r)) for r in zip(*columns)]


def _shard_file(root: str, shard: int) -> str:
    return f"{root}/shard-{shard:016d}.bin"


def _segment_file(root: str, segment: int) -> str:
    return f"{root}/index-{segment:08d}.bin"


class ShardWriter:
    """Streams documents to one shard file."""

    def __init__(self, uri: str, dtype: np.dtype):
        self.file, self.kind = Publisher(uri), np.dtype(dtype).newbyteorder("<")
        self.file.write(MAGIC + self.kind.itemsize.to_bytes(8, "little"))
        self.ends: list[int] = []
        self.ids = 0

    def add(self, ids: np.ndarray) -> tuple[int, int]:
        """(offset of the first id, number of the document)."""
        at = self.ids
        self.file.write(ids.astype(self.kind).tobytes())
        self.ids += len(ids)
        self.ends.append(self.ids)
        return at, len(self.ends) - 1

    def close(self) -> None:
        self.file.write(np.array(self.ends, "<i8").tobytes())
        self.file.write(self.ids.to_bytes(8, "little") + len(self.ends).to_bytes(8, "little"))
        self.file.close()


class Shard:
    """A shard file, of which only what is asked for is read."""

    def __init__(self, uri: str):
        self.uri = uri
        head = fetch(uri, 0, HEADER)
        if head[:8] != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        self.kind = np.dtype(f"<u{int.from_bytes(head[8:], 'little')}")

    def ids(self, at: int, n: int) -> np.ndarray:
        return np.frombuffer(fetch(self.uri, HEADER + at * self.kind.itemsize, n * self.kind.itemsize), self.kind)

    def lengths(self, ordinal: int, count: int, at: int) -> np.ndarray:
        """Ids of ``count`` documents from one on, whose first id is at ``at``."""
        tail = fetch(self.uri, -16, 16)
        ids = int.from_bytes(tail[:8], "little")
        ends = np.frombuffer(fetch(self.uri, HEADER + ids * self.kind.itemsize + ordinal * 8, count * 8), "<i8")
        return np.diff(ends, prepend=at)


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.xxhash64("doc_id")).withColumn("mark", F.xxhash64("doc_id", F.lit(1)))


class TokenStore:
    """A written store: its folder, the keys of each index segment and the first id of each shard."""

    def __init__(self, spark: SparkSession, root: str, keys: list[int]):
        self.spark, self.root, self.keys = spark, root, keys
        self.bases = spark.read.schema("shard long, base long").parquet(f"{root}/bases")

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "TokenStore":
        return cls(spark, root, json.loads(fetch(f"{root}/manifest.json"))["keys"])

    @classmethod
    def write(cls, docs: DataFrame, root: str | None = None, path: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, segment_keys: int = SEGMENT_KEYS) -> "TokenStore":
        """Tokenise docs (doc_id, text) into a store under ``root``, a shared folder; shards of about ``shard_bytes`` of ids."""
        spark = docs.sparkSession
        root, path = root or new_path(spark, "tokens"), path or default_path()
        docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        ranges, segments = min(MOST_TASKS, max(1, math.ceil((size or 0) / shard_bytes))), max(1, math.ceil(rows / segment_keys))
        tie = F.xxhash64("text")
        ranged = docs.withColumn("tie", tie).repartitionByRange(ranges, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            encoder, shard = Encoder.shared(path), TaskContext.get().partitionId() * FILES
            end, out = np.array([end_id], encoder.dtype), None
            for b in batches:
                placed = []
                for x in encoder.encode(b["text"]):
                    if out is None:
                        out = ShardWriter(_shard_file(root, shard), encoder.dtype)
                    placed.append((shard, *out.add(np.concatenate([x, end])), len(x) + 1))
                    if out.ids * out.kind.itemsize >= shard_bytes:
                        out.close()
                        out, shard = None, shard + 1
                columns = [pa.array(c, pa.int64()) for c in (zip(*placed) if placed else [[]] * 4)]
                yield pa.RecordBatch.from_arrays([b["doc_id"], *columns], names=["doc_id", "shard", "at", "ordinal", "ids"])
            if out is not None:
                out.close()

        entries = materialise(ranged.select("doc_id", "text").mapInArrow(write, "doc_id long, shard long, at long, ordinal long, ids long"), "entries")
        totals = entries.groupBy("shard").agg(F.sum("ids").alias("ids"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")).write.parquet(f"{root}/bases")
        # the documents of a key stand next to each other in a shard
        runs = _keyed(entries.groupBy("doc_id", "shard").agg(F.min("at").alias("at"), F.sum("ids").alias("ids"), F.min("ordinal").alias("ordinal"), F.count("*").alias("count")))

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in groups(batches, ["segment"]):
                data, n = Segment.dump(g["key"].to_numpy().view(_U), g["mark"].to_numpy().astype(np.uint32), {k: g[k].to_numpy() for k in _RUN})
                segment = g["segment"][0].as_py()
                publish(_segment_file(root, segment), data)
                yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([n])], names=["segment", "keys"])

        dealt = _dealt(runs.select("key", "mark", *_RUN), segments).mapInArrow(index, "segment long, keys long")
        # one row a segment
        counts = {r["segment"]: r["keys"] for r in dealt.collect()}
        keys = [counts.get(k, 0) for k in range(segments)]
        publish(f"{root}/manifest.json", json.dumps({"keys": keys, "end_id": end_id}).encode())
        return cls(spark, root, keys)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of one key, with a constant number of small reads."""
        key, mark = (int(x) for x in _keyed(self.spark.createDataFrame([(doc_id,)], "doc_id long")).select("key", "mark").first())
        segment = key % len(self.keys)
        if not self.keys[segment]:
            return []
        uri = _segment_file(self.root, segment)
        out = []
        for r in Segment(lambda start, length: fetch(uri, start, length)).get(key % (1 << 64), mark % (1 << 32)):
            shard = Shard(_shard_file(self.root, r["shard"]))
            lengths = [r["ids"]] if r["count"] == 1 else shard.lengths(r["ordinal"], r["count"], r["at"]).tolist()
            at = r["at"]
            for n in lengths:
                out.append(shard.ids(at, n))
                at += n
        return out

    def lookup(self, ids: DataFrame) -> DataFrame:
        """(doc_id, shard, at, ids, ordinal, count): the runs of each doc_id of ``ids`` that is in the store."""
        root, keys = self.root, self.keys

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in groups(batches, ["segment"]):
                segment = g["segment"][0].as_py()
                if not keys[segment]:
                    continue
                s = Segment.whole(fetch(_segment_file(root, segment)))
                if s.n != keys[segment]:
                    raise ValueError(f"index segment {segment} has {s.n} keys, not {keys[segment]}")
                who, runs = s.find(g["key"].to_numpy().view(_U), g["mark"].to_numpy().astype(np.uint32))
                yield pa.RecordBatch.from_arrays([g["doc_id"].combine_chunks().take(pa.array(who)), *(pa.array(runs[k]) for k in _RUN)], names=["doc_id", *_RUN])

        wanted = _keyed(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
        return _dealt(wanted, len(keys)).select("segment", "doc_id", "key", "mark").mapInArrow(find, "doc_id long, shard long, at long, ids long, ordinal long, count long")

    def read(self, runs: DataFrame, payload: bool = True) -> DataFrame:
        """(doc_id, start, n_tokens, ids, ids_crc32): the documents of the runs, from those ranges of the shard files."""
        root = self.root

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in groups(batches, ["shard"]):
                shard = g["shard"][0].as_py()
                s, out, held = Shard(_shard_file(root, shard)), [], 0
                for doc_id, at, ids in _documents(s, g):
                    raw = ids.astype("<u4").tobytes()
                    out.append((doc_id, shard, at, len(ids), raw if payload else None, zlib.crc32(raw)))
                    held += len(raw) if payload else 0
                    if held > READ_BYTES or len(out) >= 10000:
                        yield _rows(out)
                        out, held = [], 0
                if out:
                    yield _rows(out)

        found = runs.repartition("shard").sortWithinPartitions("shard", "at").mapInArrow(load, "doc_id long, shard long, at long, n_tokens long, ids binary, crc32 long")
        return found.join(self.bases, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", *(["ids"] if payload else []), F.col("crc32").alias("ids_crc32"))


def _dealt(df: DataFrame, segments: int) -> DataFrame:
    return df.withColumn("segment", F.pmod("key", F.lit(segments))).repartition(segments, "segment").sortWithinPartitions("segment")


def _documents(s: Shard, runs: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, offset, ids) of the documents of runs in order of offset; runs that touch are read together."""
    rows = list(zip(*(runs[c].to_pylist() for c in ("doc_id", "at", "ids", "ordinal", "count"))))
    lo = 0
    while lo < len(rows):
        hi, end = lo + 1, rows[lo][1] + rows[lo][2]
        while hi < len(rows) and rows[hi][1] == end and (end + rows[hi][2] - rows[lo][1]) * s.kind.itemsize <= READ_BYTES:
            end += rows[hi][2]
            hi += 1
        # a run beyond READ_BYTES has many documents or one long one: it is read document by document
        block = s.ids(rows[lo][1], end - rows[lo][1]) if hi > lo + 1 or rows[lo][4] == 1 else None
        for doc_id, at, n, ordinal, count in rows[lo:hi]:
            for k in [n] if count == 1 else s.lengths(ordinal, count, at).tolist():
                yield doc_id, at, s.ids(at, k) if block is None else block[at - rows[lo][1] : at - rows[lo][1] + k]
                at += k
        lo = hi


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "shard", "at", "n_tokens", "ids", "crc32"])
