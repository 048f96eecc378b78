"""Conversation structure repair (operator 13): the cheapest edits that make roles read ``(s?(ua)+)?``.

A conversation is a path through layers of four states (nothing yet, after system, after user, after assistant).  A message is
kept (K), reroled (R) or deleted (D), which leads to the next layer; an inserted message (I) stays in its layer.  Forward minimum
costs and backward minimum costs tell which arcs lie on a cheapest path: those where both and the arc's own cost add up to the
total.  These tight arcs are a DAG, as all inserts cost something.  The frontier, a set of states, starts at the first layer and
takes the least letter that any tight arc offers, so that the audit is the least of all cheapest ones.

Messages are dealt by ranges of (conversation, turn, role, start and digest of the text, row), so that a conversation of any length is
spread over tasks, and repeated rows too.  A task cuts its messages, in order, into pieces of at most ``ROWS`` messages and ``CHARS``
characters.  A piece that is a whole conversation is repaired on the spot.  For the others, which are those at the edges of tasks and long
conversations:

* rows seen earlier are found by an aggregate over role and digest that keeps the first place;
* a piece is a 4 x 4 matrix of minimum costs; matrices multiply, within a task's share of a conversation and then over its shares,
  so that each piece gets the forward costs before it and the backward costs behind it;
* each piece is walked from every state that a cheapest path may enter it with, and chaining these walks picks one.

The repaired pieces are the result.  No task holds more of a conversation than a piece, but for matrices and letters of one task's share.

Defined cases: null roles and texts are one space; messages without a turn come first; messages of one turn are in the order of role, the text's first
64 characters and its SHA-256; repeated rows are messages of their own (and duplicates); a null conv_id is a conversation; a role that does not
begin with s, u or a (or is empty) cannot be kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import bounded, materialise

ROWS, CHARS = 1024, 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
#: From each state: where a message of an initial leads, and where one of our own does.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
OWN = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
FINAL = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 60
START = [0, NEVER, NEVER, NEVER]
LEGAL = {"su", "ua", "au"}
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_FACTS = ", ".join(f"{f} long" for f in FACTS)
PIECE = f"conv_id long, part int, start long, piece long, whole boolean, turns array<long>, marks string, roles array<string>, texts array<string>, audit string, {_FACTS}"


def mark(role: str, text: str, seen: bool) -> str:
    """A message as two letters: its role's initial and its first fault (blank, duplicate, truncated or none)."""
    initial, bare = role[:1], text.rstrip(BLANKS)
    fault = "b" if not bare else "d" if seen else "." if bare[-1] in ".!?" else "t"
    return (initial if initial and initial in "sua" else "-") + fault


def edits(m: str) -> list[tuple[str, int, tuple]]:
    """(letter, cost, where it leads from each state or None) of a message, by letter."""
    out = [("D", DELETE, (0, 1, 2, 3))]
    if m[1] in ".t":
        more = TRUNCATED if m[1] == "t" else 0
        out += [("K", more, tuple(k.get(m[0]) for k in KEPT)), ("R", REROLE + more, OWN)]
    return out


def inserted(cost: list[int]) -> list[int]:
    """Forward costs after inserts in the layer."""
    cost = list(cost)
    for _ in range(3):
        for q, to in enumerate(OWN):
            cost[to] = min(cost[to], cost[q] + INSERT)
    return cost


def ending(cost: list[int]) -> list[int]:
    """Backward costs with inserts in the layer."""
    cost = list(cost)
    for _ in range(3):
        for q, to in enumerate(OWN):
            cost[q] = min(cost[q], INSERT + cost[to])
    return cost


END = ending([0 if q in FINAL else NEVER for q in range(4)])


def forward(marks: list[str], cost: list[int]) -> list[list[int]]:
    """Minimum costs before each message, with inserts there, and after the last one without."""
    layers = [cost]
    for m in marks:
        layers[-1] = now = inserted(layers[-1])
        after = [NEVER] * 4
        for _, c, to in edits(m):
            for q, t in enumerate(to):
                if t is not None:
                    after[t] = min(after[t], now[q] + c)
        layers.append(after)
    return layers


def backward(marks: list[str], cost: list[int]) -> list[list[int]]:
    """Minimum costs to the end from before each message, and from after the last one."""
    layers = [cost]
    for m in reversed(marks):
        now = [NEVER] * 4
        for _, c, to in edits(m):
            for q, t in enumerate(to):
                if t is not None:
                    now[q] = min(now[q], c + layers[-1][t])
        layers.append(ending(now))
    return layers[::-1]


def walk(marks: list[str], f: list[int], b: list[int], total: int, entry: set[int], last: bool) -> tuple[str, set[int]]:
    """The least letters of a cheapest path through the piece and the frontier behind it; f and b are the costs at its ends.

    Inserts behind the last message belong to the next piece, or to this one if it is the last.
    """
    ahead, behind = forward(marks, f), backward(marks, b)
    if last:
        ahead[-1] = inserted(ahead[-1])
    made = [edits(m) for m in marks] + [[]]
    frontier, i, letters = set(entry), 0, []
    while i < len(marks) or last and not any(q in FINAL and ahead[i][q] == total for q in frontier):
        offers = [(letter, t) for letter, c, to in made[i] for q in frontier if (t := to[q]) is not None and ahead[i][q] + c + behind[i + 1][t] == total]
        offers += [("I", OWN[q]) for q in frontier if ahead[i][q] + INSERT + behind[i][OWN[q]] == total]
        least = min(letter for letter, _ in offers)
        frontier = {t for letter, t in offers if letter == least}
        letters.append(least)
        i += least != "I"
    return "".join(letters), frontier


def rewritten(audit: str, entry: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits of a piece entered in a state."""
    out_roles, out_texts, q, i = [], [], entry, 0
    for letter in audit:
        if letter != "D":
            q = KEPT[q][roles[i][0]] if letter == "K" else OWN[q]
            out_roles.append(roles[i] if letter == "K" else ROLE[q])
            out_texts.append("" if letter == "I" else texts[i])
        i += letter != "I"
    return out_roles, out_texts


# A piece's summary is (matrix of 16 costs, first and last initial, span of turns [lowest, highest, how many] or [], counts); summaries multiply.
SUMMARY = "m array<long>, ends string, span array<long>, counts array<long>"


def summary(marks: list[str], turns: list[int | None]) -> tuple:
    m = [c for p in range(4) for c in forward(marks, [0 if q == p else NEVER for q in range(4)])[-1]]
    some = [t for t in turns if t is not None]
    illegal = sum(x[0] + y[0] not in LEGAL for x, y in zip(marks, marks[1:], strict=False))
    counts = [sum(x[1] == f for x in marks) for f in "bdt"]
    return m, marks[0][0] + marks[-1][0], [some[0], some[-1], len(set(some))] if some else [], [*counts, illegal]


def times(f: list[int], m: list[int]) -> list[int]:
    return [min(min(f[p] + m[4 * p + q] for p in range(4)), NEVER) for q in range(4)]


def before(m: list[int], b: list[int]) -> list[int]:
    return [min(min(m[4 * p + q] + b[q] for q in range(4)), NEVER) for p in range(4)]


def product(x: tuple, y: tuple) -> tuple:
    m = [c for p in range(4) for c in times(x[0][4 * p : 4 * p + 4], y[0])]
    span = [x[2][0], y[2][1], x[2][2] + y[2][2] - (x[2][1] == y[2][0])] if x[2] and y[2] else x[2] or y[2]
    counts = [a + b for a, b in zip(x[3], y[3], strict=True)]
    counts[3] += x[1][1] + y[1][0] not in LEGAL
    return m, x[1][0] + y[1][1], span, counts


def facts(s: tuple) -> dict[str, int]:
    """Of a whole conversation."""
    gaps = s[2][1] - s[2][0] + 1 - s[2][2] if s[2] else 0
    return {"gaps": gaps, "blank": s[3][0], "duplicate": s[3][1], "truncated": s[3][2], "illegal": s[3][3], "cost": before(s[0], END)[0]}


def _repaired(turns: list, roles: list[str], texts: list[str]) -> dict:
    """A whole conversation."""
    seen, marks = set(), []
    for row in zip(roles, texts, strict=True):
        marks.append(mark(*row, row in seen))
        seen.add(row)
    own = facts(summary(marks, turns))
    audit, _ = walk(marks, START, END, own["cost"], {0}, True)
    out_roles, out_texts = rewritten(audit, 0, roles, texts)
    return {"whole": True, "turns": [], "marks": "", "roles": out_roles, "texts": out_texts, "audit": audit, **own}


def _cut(rows: int, chars: int):
    """Sorted messages of a task as pieces; those of a conversation that may go on in another task stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECE.split(", ")]
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), ("turns", pa.list_(pa.int64())), ("marks", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("audit", pa.string()), *((f, pa.int64()) for f in FACTS)])
        held: list[list] = []
        out: list[dict] = []
        size = pieces = start = 0
        key, part, edge = None, 0, True  # edge: the conversation may have begun in the task before

        def flush(more: bool, ends: bool):
            """What is held becomes a piece; more: its conversation goes on here; ends: the task has no rows left."""
            nonlocal size, pieces, start
            if held:
                turns, roles, texts = map(list, zip(*held, strict=True))
                if more or edge or ends or start < pieces:
                    own = {"whole": False, "turns": turns, "marks": "".join(mark(r, t, False) for r, t in zip(roles, texts, strict=True)), "roles": roles, "texts": texts, "audit": None, **dict.fromkeys(FACTS)}
                else:
                    own = _repaired(turns, roles, texts)
                out.append({"conv_id": key, "part": part, "start": start, "piece": pieces, **own})
                pieces += 1
            held.clear()
            size = 0
            if not more:
                start = pieces

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_pylist([{n: x[n] for n in names} for x in out], schema)
            out.clear()
            return done

        first = True
        for b in batches:
            for conv, turn, role, text, p in zip(*(b[n].to_pylist() for n in ("conv_id", "turn", "role", "text", "part")), strict=True):
                if first or conv != key:
                    flush(False, False)
                    key, part, edge, first = conv, p, first, False
                elif len(held) >= rows or size >= chars:
                    flush(True, False)
                held.append([turn, role, text])
                size += len(text)
            if out:
                yield batch()
        flush(False, True)
        if out:
            yield batch()

    return run


def _ordered(g: pd.DataFrame, by: str) -> list[tuple]:
    g = g.sort_values(by)
    whole = lambda x: [int(v) for v in x]
    return [(whole(m), e, whole(s), whole(c)) for m, e, s, c in zip(g["m"], g["ends"], g["span"], g["counts"], strict=True)]


def _share(g: pd.DataFrame) -> pd.DataFrame:
    """Of a task's share of a conversation: the product of its pieces."""
    all_, first = _ordered(g, "piece"), g.iloc[0]
    total = all_[0]
    for s in all_[1:]:
        total = product(total, s)
    return pd.DataFrame([[first["part"], first["start"], *total]], columns=["part", "start", "m", "ends", "span", "counts"])


def _costs(all_: list[tuple], f: list[int], b: list[int]) -> tuple[list, list]:
    """Forward costs before each, backward costs behind each."""
    fs, bs = [f], [b]
    for s in all_[:-1]:
        fs.append(times(fs[-1], s[0]))
    for s in reversed(all_[1:]):
        bs.append(before(s[0], bs[-1]))
    return fs, bs[::-1]


def _shares(g: pd.DataFrame) -> pd.DataFrame:
    """Of a conversation: what lies before and behind each share, and the facts of all."""
    all_ = _ordered(g, "part")
    total = all_[0]
    for s in all_[1:]:
        total = product(total, s)
    fs, bs = _costs(all_, START, END)
    g = g.sort_values("part")
    last = [False] * (len(g) - 1) + [True]
    return pd.DataFrame({"part": g["part"].to_numpy(), "start": g["start"].to_numpy(), "f": fs, "b": bs, "closes": last, **facts(total)})


def _walks(g: pd.DataFrame) -> pd.DataFrame:
    """Of a share: the walks of each piece from the states that a cheapest path may enter it with."""
    all_, g = _ordered(g, "piece"), g.sort_values("piece")
    one, out = g.iloc[0], []
    fs, bs = _costs(all_, [int(x) for x in one["f"]], [int(x) for x in one["b"]])
    total = int(one["cost"])
    for k, (piece, marks) in enumerate(zip(g["piece"], g["marks"], strict=True)):
        marks = [marks[i : i + 2] for i in range(0, len(marks), 2)]
        last = bool(one["closes"]) and k == len(g) - 1
        ahead = backward(marks, bs[k])[0]
        for q in range(4):
            if fs[k][q] + ahead[q] == total:
                audit, (leaves,) = walk(marks, fs[k], bs[k], total, {q}, last)  # a letter leads from a state to one state
                out.append([one["part"], one["start"], piece, q, leaves, audit, *(one[f] for f in FACTS)])
    return pd.DataFrame(out, columns=["part", "start", "piece", "enters", "leaves", "audit", *FACTS])


def _through(g: pd.DataFrame) -> pd.DataFrame:
    """Of a share: where each state that may enter it leaves it."""
    at: dict[int, int] | None = None
    for _, p in g.sort_values("piece").groupby("piece", sort=True):
        step = dict(zip(p["enters"], p["leaves"], strict=True))
        at = step if at is None else {q: step[t] for q, t in at.items() if t in step}
    one = g.iloc[0]
    return pd.DataFrame([[one["part"], one["start"], [at.get(q, -1) for q in range(4)]]], columns=["part", "start", "leads"])


def _entries(g: pd.DataFrame) -> pd.DataFrame:
    """Of a conversation: the state that each share is entered with."""
    g, q, out = g.sort_values("part"), 0, []
    for leads in g["leads"]:
        out.append(q)
        q = int(leads[q])
    return pd.DataFrame({"part": g["part"].to_numpy(), "start": g["start"].to_numpy(), "q": out})


def _chosen(g: pd.DataFrame) -> pd.DataFrame:
    """Of a share: the walk of each piece that the chain comes through."""
    g = g.sort_values(["piece", "enters"])
    q, rows = int(g.iloc[0]["q"]), []
    for _, p in g.groupby("piece", sort=True):
        one = p[p["enters"] == q].iloc[0]
        rows.append([one["part"], one["piece"], q, one["audit"], *(one[f] for f in FACTS)])
        q = int(one["leaves"])
    return pd.DataFrame(rows, columns=["part", "piece", "enters", "audit", *FACTS])


def _marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks of pieces with the rows seen earlier, and their summaries."""
    for b in batches:
        out = []
        for part, start, piece, marks, turns, firsts in zip(b["part"], b["start"], b["piece"], b["marks"], b["turns"], b["firsts"], strict=True):
            new = set(firsts)
            each = [marks[2 * i] + (marks[2 * i + 1] if i in new or marks[2 * i + 1] == "b" else "d") for i in range(len(marks) // 2)]
            out.append([part, start, piece, "".join(each), *summary(each, [None if t is None or t != t else int(t) for t in turns])])
        yield pd.DataFrame(out, columns=["part", "start", "piece", "marks", "m", "ends", "span", "counts"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = [rewritten(*x) for x in zip(*(b[n].to_pylist() for n in ("audit", "enters", "roles", "texts")), strict=True)]
        arrays = {n: b[n] for n in ("conv_id", "part", "piece", "audit", *FACTS)} | {"roles": pa.array([r for r, _ in pairs], pa.list_(pa.string())), "texts": pa.array([t for _, t in pairs], pa.list_(pa.string()))}
        yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def _chained(pieces: DataFrame) -> DataFrame:
    """Pieces of conversations that are not whole, repaired; pieces is a written table."""
    share = ["part", "start"]
    rows = pieces.select("conv_id", "part", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "x"))
    places = rows.groupBy("conv_id", "x.roles", F.unhex(F.sha2(F.col("x.texts"), 256)).alias("digest")).agg(F.min(F.struct("part", "piece", "i")).alias("at"))
    firsts = places.groupBy("at.part", "at.piece").agg(F.collect_list("at.i").alias("firsts"))
    narrow = pieces.select("part", "start", "piece", "marks", "turns").join(firsts, ["part", "piece"], "left")
    narrow = narrow.withColumn("firsts", F.coalesce("firsts", F.array().cast("array<int>")))
    marked = materialise(narrow.mapInPandas(_marked, f"part int, start long, piece long, marks string, {SUMMARY}"), "marks")
    # the conversation of a share
    of = pieces.filter(F.col("piece") == F.col("start")).select("conv_id", *share)
    shares = marked.groupBy(*share).applyInPandas(_share, f"part int, start long, {SUMMARY}").join(of, share)
    costs = shares.groupBy("conv_id").applyInPandas(_shares, f"part int, start long, f array<long>, b array<long>, closes boolean, {_FACTS}")
    walks = materialise(marked.join(costs, share).groupBy(*share).applyInPandas(_walks, f"part int, start long, piece long, enters int, leaves int, audit string, {_FACTS}"), "walks")
    through = walks.groupBy(*share).applyInPandas(_through, "part int, start long, leads array<int>").join(of, share)
    entries = through.groupBy("conv_id").applyInPandas(_entries, "part int, start long, q int")
    chosen = walks.join(entries, share).groupBy(*share).applyInPandas(_chosen, f"part int, piece long, enters int, audit string, {_FACTS}")
    wide = pieces.select("conv_id", "part", "piece", "roles", "texts").join(chosen, ["part", "piece"])
    return wide.mapInArrow(_rewrite, f"conv_id long, part int, piece long, audit string, {_FACTS}, roles array<string>, texts array<string>")


def repair(conversations: DataFrame, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """(conv_id, part, piece, whole, audit, gaps, blank, duplicate, truncated, illegal, cost, roles, texts).

    A row is a piece of a repaired conversation, in the order of part and piece; ``whole`` if it is all of it.  ``audit`` has a letter
    for each edit of the piece, roles and texts are what they leave, and the counts and the cost are those of the whole conversation.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    own = bounded(conversations).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    keyed = own.select("*", F.substring("text", 1, 64).alias("opening"), F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role", "opening", "digest", "row"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part"))
    pieces = materialise(dealt.mapInArrow(_cut(rows, chars), PIECE), "pieces")
    out = ["conv_id", "part", "piece", "whole", "audit", *FACTS, "roles", "texts"]
    return pieces.filter("whole").select(*out).unionByName(_chained(pieces.filter(~F.col("whole"))).withColumn("whole", F.lit(False)).select(*out))


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with known faults, by a checksum of conversation and turn: a row of 20 each is dropped, emptied, stripped of its ends, repeated or made a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


DIGEST = f"conv_id long, audit string, repaired_sha256 string, {_FACTS}"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order: a row for each conversation; one batch is held, and of the conversation its letters and the state of its hash."""
    import hashlib

    held: dict | None = None

    def done() -> pa.RecordBatch:
        x = held | {"audit": "".join(held["audit"]), "repaired_sha256": held["hash"].hexdigest()}
        schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), *((f, pa.int64()) for f in FACTS)])
        return pa.RecordBatch.from_pylist([{n: x[n] for n in schema.names}], schema)

    for b in batches:
        for row in zip(*(b[n].to_pylist() for n in ("conv_id", "audit", "roles", "texts", *FACTS)), strict=True):
            conv, audit, roles, texts, *own = row
            if held is None or held["conv_id"] != conv:
                if held is not None:
                    yield done()
                held = {"conv_id": conv, "audit": [], "hash": hashlib.sha256(), "lines": 0, **dict(zip(FACTS, own, strict=True))}
            held["audit"].append(audit)
            for r, t in zip(roles, texts, strict=True):
                held["hash"].update((("\n" if held["lines"] else "") + f"{r}:{t}").encode())
                held["lines"] += 1
    if held is not None:
        yield done()


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256, gaps, blank, duplicate, truncated, illegal, cost) of each conversation.

    Whole conversations are hashed where they are.  Pieces of the others go to one task in order and stream through it: SHA-256 of a
    text can only be taken from its start to its end.
    """
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"])), "\n")
    whole = pieces.filter("whole").select("conv_id", "audit", F.sha2(lines, 256).alias("repaired_sha256"), *FACTS)
    parts = pieces.filter(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return whole.unionByName(parts.mapInArrow(_digested, DIGEST))


def with_all(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """digests of found, and empty ones for the conversations that have no row left."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("own")).distinct()
    joined = ids.join(found, F.col("own").eqNullSafe(F.col("conv_id")), "left")
    nothing: dict[str, Column] = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)} | {f: F.lit(0).cast("long") for f in FACTS}
    return joined.select(F.col("own").alias("conv_id"), *(F.coalesce(n, c).alias(n) for n, c in nothing.items()))


SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS c FROM conversations),
m AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM (SELECT *, xor(c, 4294967295) % 20 AS f FROM k) WHERE f <> 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text)) AS i FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copies FROM o),
r AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS x, CASE WHEN bare = '' THEN 'b' WHEN copies > 1 THEN 'd' WHEN bare[-1] IN ('.', '!', '?') THEN '.' ELSE 't' END AS fault, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS nx
  FROM (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM n)),
-- the best (cost, audit, text) of each state before message i + 1, without inserts there: 0 nothing, 1 system, 2 user, 3 assistant
w(conv_id, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {'c': 0::BIGINT, 'a': '', 't': ''}, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR), NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR), NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) FROM r
  UNION ALL
  SELECT conv_id, i,
    list_min([d0]), list_min(list_filter([d1, CASE WHEN keep AND x = 's' THEN k0 END], lambda z: z IS NOT NULL)),
    list_min(list_filter([d2, CASE WHEN keep AND x = 'u' THEN k0 END, CASE WHEN keep AND x = 'u' THEN k1 END, CASE WHEN keep AND x = 'u' THEN k3 END, CASE WHEN keep THEN u0 END, CASE WHEN keep THEN u1 END, CASE WHEN keep THEN u3 END], lambda z: z IS NOT NULL)),
    list_min(list_filter([d3, CASE WHEN keep AND x = 'a' THEN k2 END, CASE WHEN keep THEN u2 END], lambda z: z IS NOT NULL))
  FROM (
    SELECT conv_id, i, x, keep,
      CASE WHEN s0 IS NOT NULL THEN {'c': s0.c + 2, 'a': s0.a || 'D', 't': s0.t} END AS d0, CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 2, 'a': s1.a || 'D', 't': s1.t} END AS d1,
      CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 2, 'a': s2.a || 'D', 't': s2.t} END AS d2, CASE WHEN s3 IS NOT NULL THEN {'c': s3.c + 2, 'a': s3.a || 'D', 't': s3.t} END AS d3,
      CASE WHEN s0 IS NOT NULL THEN {'c': s0.c + p, 'a': s0.a || 'K', 't': s0.t || line} END AS k0, CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + p, 'a': s1.a || 'K', 't': s1.t || line} END AS k1,
      CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + p, 'a': s2.a || 'K', 't': s2.t || line} END AS k2, CASE WHEN s3 IS NOT NULL THEN {'c': s3.c + p, 'a': s3.a || 'K', 't': s3.t || line} END AS k3,
      CASE WHEN s0 IS NOT NULL THEN {'c': s0.c + p + 1, 'a': s0.a || 'R', 't': s0.t || chr(10) || 'user:' || text} END AS u0, CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + p + 1, 'a': s1.a || 'R', 't': s1.t || chr(10) || 'user:' || text} END AS u1,
      CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + p + 1, 'a': s2.a || 'R', 't': s2.t || chr(10) || 'assistant:' || text} END AS u2, CASE WHEN s3 IS NOT NULL THEN {'c': s3.c + p + 1, 'a': s3.a || 'R', 't': s3.t || chr(10) || 'user:' || text} END AS u3
    FROM (
      -- inserts: user after 0, 1 and 3, then assistant after 2, then user again
      SELECT conv_id, i, x, text, keep, p, line, s0, s1, y2 AS s2, list_min(list_filter([s3, CASE WHEN y2 IS NOT NULL THEN {'c': y2.c + 5, 'a': y2.a || 'I', 't': y2.t || chr(10) || 'assistant:'} END], lambda z: z IS NOT NULL)) AS s3
      FROM (
        SELECT w.conv_id, r.i, r.x, r.text, r.fault IN ('.', 't') AS keep, CASE WHEN r.fault = 't' THEN 5 ELSE 0 END AS p, chr(10) || r.role || ':' || r.text AS line, w.s0, w.s1, w.s3,
          list_min(list_filter([w.s2, CASE WHEN w.s0 IS NOT NULL THEN {'c': w.s0.c + 5, 'a': w.s0.a || 'I', 't': w.s0.t || chr(10) || 'user:'} END, CASE WHEN w.s1 IS NOT NULL THEN {'c': w.s1.c + 5, 'a': w.s1.a || 'I', 't': w.s1.t || chr(10) || 'user:'} END,
            CASE WHEN w.s3 IS NOT NULL THEN {'c': w.s3.c + 5, 'a': w.s3.a || 'I', 't': w.s3.t || chr(10) || 'user:'} END], lambda z: z IS NOT NULL)) AS y2
        FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)))),
e AS (
  SELECT conv_id, list_min(list_filter([s0, s3, CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 5, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'} END, CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 10, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'} END], lambda z: z IS NOT NULL)) AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS z FROM w) WHERE z = 1),
q AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (nx IS NOT NULL AND x || nx NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(q.gaps, 0)::BIGINT AS gaps, coalesce(q.blank, 0)::BIGINT AS blank, coalesce(q.duplicate, 0)::BIGINT AS duplicate, coalesce(q.truncated, 0)::BIGINT AS truncated, coalesce(q.illegal, 0)::BIGINT AS illegal,
  coalesce(e.best.c, 0)::BIGINT AS cost, coalesce(e.best.a, '') AS audit, sha256(coalesce(e.best.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
