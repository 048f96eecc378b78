"""Near-duplicate components by a chosen-path set similarity join (operator 10).

A document's set holds its distinct five-word shingles; documents with a Jaccard similarity of 0.75
or more are linked, and every link is confirmed on the full sets.

* ``sketches``: one scan hashes the shingles and keeps a digest and 64 minwise tokens of each set.
* ``classes``: equal sets become one class, named by a hash of its digest; copies are never paired.
* ``paths``: each of 14 independent trees sends a class down from its root.  A node picks one of the
  64 tokens (with probability 1/3 a second one, so 4/3 on average, the reciprocal of the threshold)
  and a class follows the branches of its own token values.  Nodes depend on the path alone, so this
  needs no exchange.  A pair of similarity 0.75 still shares a node after three levels with
  probability 0.6 in one tree (offspring law: none 3/16, one 5/8, two 3/16).  All trees draw from the
  same 64 tokens, so it misses all 14 with probability 5.5e-5; likelier pairs miss far more rarely.
* Nodes that hold one class are dropped.  Each other class is compared with the smallest class of the
  node it shares most paths with (a star, so a large group of near copies costs one comparison each),
  and the links found join components.  Two classes of one component need no further comparison.
  A leader that many follow is dealt to salted copies of it, so its followers meet it in many tasks.
* Nodes whose classes lie in several components are searched exhaustively, whatever their size: every
  two classes of different components are compared in the task that holds the node.  Nodes with more
  than ``block`` classes are dealt to one task for each pair of blocks.  In nodes with more than ``leaf``
  classes, blocks hold sets of like size, and pairs of blocks that cannot hold a link (by size, or as they
  lie in one component) are left out.  Only links that join components leave a task.
* Components are found by hooking and pointer jumping on tables in the shared folder.

Defined cases: null or wordless text has no set and no link; null doc_id likewise (component null,
kept).  Rows with one doc_id are one vertex.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shingles import SHINGLE, TOKENS, sets, sketch
from tidemark.llm.storage import bounded, hot_join, materialise, privately, reducer, release
from tidemark.llm.textcore import mix

_U = np.uint64
THRESHOLD = 75
TREES = 14
DEPTH = 3
LEAF = 4096
BLOCK = 1024
#: Followers that share one copy of a leader's set.
FOLLOWERS = 512

_SKETCH = "doc_id long, n long, d1 long, d2 long, tokens binary"


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, d1, d2, tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, n in sets(b["text"]):
                d1, d2, tokens = sketch(h, n)
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), _fixed(tokens)],
                    names=["doc_id", "n", "d1", "d2", "tokens"],
                )

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SKETCH)


def _step(row: np.ndarray, node: np.ndarray, tokens: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes: (row, node) pairs one level down."""
    t = tokens.shape[1]
    r = mix(node ^ _U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    one = (r % _U(t)).astype(np.int64)
    second = np.flatnonzero((r >> _U(32)) % _U(3) == 0)
    two = (one[second] + 1 + ((r[second] >> _U(40)) % _U(t - 1)).astype(np.int64)) % t
    row, node, at = np.concatenate([row, row[second]]), np.concatenate([node, node[second]]), np.concatenate([one, two])
    return row, mix(node * _U(0x9E3779B97F4A7C15) + at.astype(_U) * _U(0x100000001B3) + tokens[row, at].astype(_U))


def _tokens(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(len(col), TOKENS)


def _paths(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(node, rep): the nodes of each class after ``depth`` levels of every tree."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                tokens, reps = _tokens(b["tokens"]), b["rep"].to_numpy()
                for tree in range(trees):
                    row = np.arange(len(reps))
                    node = np.full(len(reps), mix(np.array([tree + 1], _U))[0])
                    for level in range(depth):
                        row, node = _step(row, node, tokens, level)
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(reps[row])], names=["node", "rep"])

    return classes.select("rep", "tokens").mapInArrow(run, "node long, rep long")


def similar(common, n, m, percent: int = THRESHOLD):
    """Exact test of Jaccard >= percent / 100 in integers."""
    return 100 * common >= percent * (n + m - common)


def _set_blobs(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles): the sets of the classes in ``wanted`` (rep, first), from the text of a member each."""
    marked = reducer(wanted, "first").marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "near").filter("near")

    def run(batches):
        for b in batches:
            for lo, hi, h, n in sets(b["text"]):
                d1, d2, _ = sketch(h, n, False)
                ends = np.cumsum(n)
                blobs = [h[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(blobs, pa.binary())],
                    names=["doc_id", "n", "d1", "d2", "shingles"],
                )

    found = marked.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, shingles binary")
    return (
        found.select(F.col("doc_id").alias("first"), F.xxhash64("n", "d1", "d2").alias("rep"), "shingles")
        .join(wanted, ["first", "rep"], "left_semi").select("rep", "shingles").dropDuplicates(["rep"])
    )


def _star_links(pairs: DataFrame, blobs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links; each a has one b, and a b with many pairs is dealt to salted copies."""
    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(FOLLOWERS)).alias("copies"))
    leaders = blobs.select(F.col("rep").alias("b"), F.col("shingles").alias("right")).join(copies, "b")
    leaders = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1))).drop("copies")
    salted = hot_join(pairs, copies, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("copies"))).drop("copies")
    both = (
        salted.join(blobs.select(F.col("rep").alias("a"), F.col("shingles").alias("left")), "a")
        .join(leaders, ["b", "salt"])
        .select("a", "b", "left", "right")
    )

    def run(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b["left"].to_pylist(), b["right"].to_pylist())):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    if similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                        keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(run, "a long, b long")


def exhaustive(reps: np.ndarray, comps: np.ndarray, side: np.ndarray, shingles: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between classes of different components (of two sides, if there are two), enough to join all that can be joined."""
    k = len(reps)
    n = np.array([len(s) for s in shingles])
    flat, inverse = np.unique(np.concatenate(shingles), return_inverse=True)
    owner = np.repeat(np.arange(k), n)
    order = np.argsort(inverse, kind="stable")
    lists, begin = owner[order], np.searchsorted(inverse[order], np.arange(len(flat) + 1))
    ends, labels, found = np.cumsum(n), np.unique(comps, return_inverse=True)[1], []
    two = side.any() and not side.all()
    for i in range(k):
        open_ = (labels != labels[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        open_[: i + 1] = False
        if two:
            open_ &= side != side[i]
        if not open_.any():
            continue
        terms = inverse[ends[i] - n[i] : ends[i]]
        length = begin[terms + 1] - begin[terms]
        total = int(length.sum())
        at = np.arange(total) + np.repeat(begin[terms] - (np.cumsum(length) - length), length)
        common = np.bincount(lists[at], minlength=k)
        for j in np.flatnonzero(open_ & similar(common, n[i], n, percent)).tolist():
            if labels[j] != labels[i]:
                found.append((int(reps[i]), int(reps[j])))
                labels[labels == labels[j]] = labels[i]
    return found


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            v = b[k].to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        if held and any(held[-1][k][-1].as_py() != b[k][0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        cut = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for s, e in zip(cut[:-1], cut[1:]):
            if s:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _blocks(nodes: DataFrame, block: int) -> DataFrame:
    """(node, x, y, rep, comp, side): the pairs of blocks of each node."""
    parts = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("parts"))
    return (
        nodes.withColumn("parts", parts).withColumn("own", own)
        .select("node", "rep", "comp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("other"))
        .select("node", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "rep", "comp", (F.col("own") > F.col("other")).alias("side"))
    )


def _banded(nodes: DataFrame, sizes: DataFrame, percent: int, block: int) -> DataFrame:
    """The same for large nodes, without pairs of blocks that cannot hold a link.

    Sets are banded by the logarithm of their size, so that links lie in one band or in two adjacent ones.
    """
    band = F.floor(F.log("n") / F.lit(math.log(100 / percent) * (1 + 1e-9)))
    rows = nodes.join(sizes, "rep").withColumn("band", band)
    of = rows.groupBy("node", "band").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    near = of
    for side, step in (("below", 1), ("above", -1)):
        near = near.join(of.select("node", (F.col("band") + step).alias("band"), *(F.col(c).alias(f"{side}_{c}") for c in ("size", "lo", "hi"))), ["node", "band"], "left")
    blocks = lambda c: F.ceil(F.col(c) / F.lit(block))
    others = lambda several, c: F.when(several & F.col(c).isNotNull(), F.sequence(F.lit(0).cast("long"), blocks(c) - 1)).otherwise(F.array().cast("array<bigint>"))
    several = lambda side: F.least("lo", f"{side}_lo") != F.greatest("hi", f"{side}_hi")
    near = near.select("node", "band", blocks("size").alias("parts"), others(F.col("lo") != F.col("hi"), "size").alias("same"), *(others(several(s), f"{s}_size").alias(s) for s in ("below", "above")))
    name = lambda shift, i: (F.col("band") + shift) * F.lit(1 << 32) + i
    own = F.pmod(F.xxhash64("rep"), F.col("parts"))
    pair = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), side.alias("side"))
    pairs = F.concat(
        F.transform("same", lambda o: pair(name(0, F.least("own", o)), name(0, F.greatest("own", o)), F.col("own") > o)),
        F.transform("below", lambda o: pair(name(-1, o), name(0, F.col("own")), F.lit(True))),
        F.transform("above", lambda o: pair(name(0, F.col("own")), name(1, o), F.lit(False))),
    )
    dealt = rows.drop("size").join(near, ["node", "band"]).withColumn("own", own).select("node", "rep", "comp", F.explode(pairs).alias("p"))
    return dealt.select("node", "p.x", "p.y", "rep", "comp", "p.side")


def _search(tasks: DataFrame, blobs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) from pairs of blocks (node, x, y, rep, comp, side)."""
    rows = tasks.join(blobs, "rep").repartition("node", "x", "y").sortWithinPartitions("node", "x", "y")

    def run(batches):
        for g in groups(batches, ["node", "x", "y"]):
            found = exhaustive(g["rep"].to_numpy(), g["comp"].to_numpy(), g["side"].to_numpy(zero_copy_only=False), [np.frombuffer(s, _U) for s in g["shingles"].to_pylist()], percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(vertex, label): the smallest vertex that each vertex of the links can reach.

    Each vertex points at its smallest neighbour below it, pointers are doubled until they end at roots,
    the links are redrawn between roots, and so on until none is left.
    """
    spark = links.sparkSession
    norm = lambda e: e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(norm(links), "edges")
    labels = materialise(edges.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().withColumn("label", F.col("vertex")), "labels")
    while not edges.isEmpty():
        point = materialise(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")), "pointers")
        while True:
            up = point.select(F.col("v").alias("p"), F.col("p").alias("q"))
            jumped = materialise(hot_join(point, up, "p").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "pointers")
            release(spark, point)
            point = jumped.select("v", "p")
            point.tidemark_path = jumped.tidemark_path
            if jumped.filter("moved").isEmpty():
                break
        up = point.select(F.col("v").alias("label"), F.col("p").alias("q"))
        relabelled = materialise(hot_join(labels, up, "label").select("vertex", F.coalesce("q", "label").alias("label")), "labels")
        redrawn = edges
        for side in ("a", "b"):
            redrawn = hot_join(redrawn, point.select(F.col("v").alias(side), F.col("p").alias(f"{side}_root")), side).withColumn(side, F.coalesce(f"{side}_root", side)).drop(f"{side}_root")
        redrawn = materialise(norm(redrawn), "edges")
        release(spark, labels, edges, point)
        labels, edges = relabelled, redrawn
    release(spark, edges)
    return labels


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text)."""
    drawn = materialise(sketches(docs).withColumn("cls", F.xxhash64("n", "d1", "d2")), "sketches")
    usable = drawn.filter("n > 0 and doc_id is not null")
    classes = materialise(usable.groupBy("cls").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("n").alias("n"), F.max("tokens").alias("tokens")), "classes")
    links = _links(docs, classes.withColumnRenamed("cls", "rep"), percent, trees, depth, leaf, block)
    # where one doc_id stands for several sets, it links their classes
    doubled = usable.groupBy("doc_id").agg(F.min("cls").alias("b"), F.max("cls").alias("c")).filter("b <> c").select("doc_id", "b")
    if not doubled.isEmpty():
        links = links.unionByName(usable.join(doubled, "doc_id").select(F.col("cls").alias("a"), "b"))
    labelled = materialise(classes.select("cls", "first", "last").join(components(links).withColumnRenamed("vertex", "cls"), "cls", "left"), "classes")
    smallest = labelled.filter("label is not null").groupBy("label").agg(F.min("first").alias("found"))
    joined = hot_join(labelled, smallest, "label").filter("label is not null or first <> last").select("cls", F.coalesce("found", "first").alias("found"))
    member = F.when(F.col("n") > 0, F.col("cls"))
    return (
        hot_join(drawn.select("doc_id", "n", member.alias("cls")), joined, "cls")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")))
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def keep_representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, in their own columns, whose doc_id stands for its component.

    The ids that go mark a small fixed-size filter; only rows that it may hold meet the exact anti-join, so
    the texts of all others are neither shuffled nor written.
    """
    spark = docs.sparkSession
    gone = materialise(near_duplicates(docs.select("doc_id", "text"), **options).filter("not kept").select("doc_id").distinct(), "gone")
    hidden, own = privately(docs, ("doc_id",))
    marked = reducer(gone, "doc_id").marked(hidden, "doc_id", "__near")
    doubtful = marked.filter("__near").join(gone, "doc_id", "left_anti").select(hidden.columns)
    return marked.filter("not __near").select(hidden.columns).unionByName(doubtful).select(own)


def _links(docs, classes, percent, trees, depth, leaf, block) -> DataFrame:
    """Links (a, b) between classes that join all that lie in one component."""
    spark = docs.sparkSession
    nodes = _paths(classes, trees, depth)
    shared = nodes.groupBy("node").agg(F.count("*").alias("size"), F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader <> last").drop("last")
    members = materialise(nodes.join(shared, "node").distinct(), "members")
    wanted = members.select("rep").distinct().join(classes.select("rep", "first"), "rep")
    blobs = materialise(_set_blobs(docs, wanted), "sets")
    best = materialise((
        members.filter("rep <> leader").groupBy("rep", "leader").count()
        .groupBy("rep").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("b"))
        .select(F.col("rep").alias("a"), "b")
    ), "pairs")
    stars = materialise(_star_links(best, blobs, percent), "stars")
    labels = components(stars)
    placed = members.join(labels.withColumnRenamed("vertex", "rep"), "rep", "left").select("node", "rep", F.coalesce("label", "rep").alias("comp"))
    mixed = materialise(_once(_mixed(placed)), "nodes")
    small, large = _blocks(mixed.filter(F.col("size") <= leaf), block), _banded(mixed.filter(F.col("size") > leaf), classes.select("rep", "n"), percent, block)
    links = stars.unionByName(_search(small.unionByName(large), blobs, percent))
    links = materialise(links, "links")
    release(spark, members, blobs, labels, mixed, best)
    return links


def _mixed(rows: DataFrame) -> DataFrame:
    """(node, rep, comp, size, mark) of the nodes that hold several components; equal marks mean equal members."""
    of = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor(F.xxhash64("rep")).alias("m1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("m2")).filter("lo <> hi")
    return rows.join(of.drop("lo", "hi"), "node")


def _once(rows: DataFrame) -> DataFrame:
    """One of the nodes that have the same members."""
    first = rows.groupBy("size", "m1", "m2").agg(F.min("node").alias("node")).select("node")
    return rows.join(first, "node", "left_semi").select("node", "rep", "comp", "size")
