"""The members of one large JSON list or map, read by many tasks.

A file is cut into blocks of bytes.  A first pass tells of each block how many quotes it has and by how much it
changes the depth of brackets, both if it begins inside a string and if it does not.  Running sums over one small
row a block then say how each block really begins, and a second pass gives the members that begin in each block;
it reads on past the block's end only to the end of its last member.  So memory is bounded by a block and the
longest member, whatever the size of the file, and a lost task reads its blocks again.

Defined cases: an empty list or map, a blank file and a bare value have no members; a byte order mark is skipped;
equal keys of a map stay separate members; a file that ends within a member fails the read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a block, and of the blocks of a task.
BLOCK, TASK = 1 << 20, 32 << 20
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_BLANK = b" \t\r\n"
#: A byte order mark.
_MARK = b"\xef\xbb\xbf"


def _open(uri: str):
    from pyarrow import fs

    files, where = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return files.open_input_file(where)


def _bytes(f, start: int, size: int) -> np.ndarray:
    f.seek(start)
    return np.frombuffer(f.read(size), np.uint8)


def _escaped(f, start: int) -> bool:
    """Whether an odd number of backslashes stands right before a place of the file."""
    n, reach = 0, 64
    while start - n > 0:
        lo = max(0, start - n - reach)
        before = _bytes(f, lo, start - n - lo).tobytes()
        n += len(before) - len(before.rstrip(b"\\"))
        if before.rstrip(b"\\"):
            break
        reach *= 2
    return n % 2 == 1


class _Scan:
    """Strings and depth along some bytes, from how they begin."""

    def __init__(self, raw: np.ndarray, inside: bool, depth: int, escaped: bool):
        place = np.arange(len(raw))
        other = np.maximum.accumulate(np.where(raw == ord("\\"), -1, place))
        slashes = np.append(0, place - other)
        slashes[1:][other < 0] += escaped
        slashes[0] = escaped
        quote = (raw == ord('"')) & (slashes[:-1] % 2 == 0)
        self.quotes = int(quote.sum())
        outside = (np.cumsum(quote) + inside) % 2 == 0
        step = np.where(outside, _STEP[raw], 0)
        at = depth + np.cumsum(step)
        close = (step < 0) & (at == 0)
        self.cuts = np.flatnonzero(close | outside & (at == 1) & ((raw == ord(",")) | (step > 0)))
        self.closes = close[self.cuts]
        self.change = int(step.sum())
        self.inside, self.depth, self.escaped = bool((self.quotes + inside) % 2), depth + self.change, bool(slashes[-1] % 2)


def _members(f, start: int, block: int, inside: bool, depth: int, escaped: bool, path: str) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the members that begin in a block."""
    raw = _bytes(f, start, block)
    s = _Scan(raw, inside, depth, escaped)
    for cut, end, closes in zip(s.cuts[:-1].tolist(), s.cuts[1:].tolist(), s.closes[:-1].tolist()):
        if not closes:
            yield start + cut + 1, raw[cut + 1 : end].tobytes()
    if not len(s.cuts) or s.closes[-1]:
        return
    at = start + int(s.cuts[-1]) + 1
    parts, read = [raw[s.cuts[-1] + 1 :].tobytes()], start + len(raw)
    while True:
        raw = _bytes(f, read, block)
        if not len(raw):
            raise ValueError(f"{path} ends within a member that begins at byte {at}")
        s = _Scan(raw, s.inside, s.depth, s.escaped)
        if len(s.cuts):
            parts.append(raw[: s.cuts[0]].tobytes())
            break
        parts.append(raw.tobytes())
        read += len(raw)
    yield at, b"".join(parts)


def split_json(spark: SparkSession, path: str, block: int = BLOCK, task: int = TASK) -> DataFrame:
    """(path, at, kind, item): the members of the list (kind ``[``) or map (``{``) of each file, and their bytes' place.

    A list's member is its JSON text, a map's one an object of its one key.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    tasks = max(1, math.ceil((files.agg(F.sum("length")).first()[0] or 0) / task))
    blocks = files.filter("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long"))).alias("start"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for uri, start in zip(b["path"].to_pylist(), b["start"].to_pylist()):
                with _open(uri) as f:
                    raw, escaped = _bytes(f, start, block), _escaped(f, start)
                plain, within = (_Scan(raw, x, 0, escaped) for x in (False, True))
                head = raw.tobytes().lstrip(_BLANK + (_MARK if start < len(_MARK) else b""))[:1].decode("latin-1")
                out.append((uri, start, escaped, plain.quotes, plain.change, within.change, head or None))
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            names = ["path", "start", "escaped", "quotes", "plain", "within", "head"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    seen = blocks.repartition(tasks, "path", "start").mapInArrow(first, "path string, start long, escaped boolean, quotes long, plain long, within long, head string")
    # one small row a block
    of_file = Window.partitionBy("path").orderBy("start")
    before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    upto = of_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    known = seen.withColumn("inside", inside).withColumn("kind", F.first("head", ignorenulls=True).over(upto))
    known = known.withColumn("change", F.when(F.col("inside"), F.col("within")).otherwise(F.col("plain"))).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "at", "kind", "item"])

        for b in batches:
            for r in b.to_pylist():
                out, held = [], 0
                with _open(r["path"]) as f:
                    for at, raw in _members(f, r["start"], block, r["inside"], r["depth"], r["escaped"], r["path"]):
                        text = raw.strip(_BLANK).decode()
                        if text:
                            out.append((r["path"], at, r["kind"], text if r["kind"] == "[" else "{" + text + "}"))
                            held += len(raw)
                        if held > block:
                            yield rows(out)
                            out, held = [], 0
                if out:
                    yield rows(out)

    cut = known.filter(F.col("kind").isin("[", "{")).select("path", "start", "kind", "inside", "depth", "escaped")
    return cut.repartition(tasks, "path", "start").mapInArrow(second, "path string, at long, kind string, item string")
