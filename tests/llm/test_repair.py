"""Conversation repair (operator 13) against an exhaustive search and over many pieces."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = {"", "s", "u", "a"}


def cheapest(rows):
    """(cost, audit, lines) by a search over whole audits: cost first, then the letters."""
    faults, seen = [], set()
    for r, t in rows:
        bare = t.rstrip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (r, t) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((r, t))
    heap = [(0, "", 0, ())]
    while heap:
        cost, audit, i, lines = heapq.heappop(heap)
        made = "".join(x[0] for x, _ in lines)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            return cost, audit, [f"{r}:{t}" for r, t in lines]
        moves = [("I", 5, i, ((r, ""),)) for r in ("user", "assistant")]
        if i < len(rows):
            (r, t), f = rows[i], faults[i]
            moves.append(("D", 2, i + 1, ()))
            if f not in ("b", "d"):
                more = 5 if f else 0
                moves += [("K", more, i + 1, ((r, t),))] * bool(r) + [("R", 1 + more, i + 1, ((x, t),)) for x in ("user", "assistant")]
        for letter, c, j, new in moves:
            text = made + "".join(x[0] for x, _ in new)
            if re.match("(s?(ua)*u?)?$", text):
                heapq.heappush(heap, (cost + c, audit + letter, j, lines + new))


def random_rows(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", " "]
    texts = ["One.", "Two!", "Three?", "no end", " ", "", "x.\n", "Four.", "Five.", "Six.", "Seven."]
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_audits_equal_an_exhaustive_search():
    rng = random.Random(4)
    for n in itertools.chain([0, 1, 1, 2, 2], (rng.randrange(3, 8) for _ in range(150))):
        rows = random_rows(rng, n)
        if not rows:
            continue
        got = repair._repaired([None] * n, *map(list, zip(*rows, strict=True)))
        cost, audit, lines = cheapest(rows)
        assert (got["cost"], got["audit"], [f"{r}:{t}" for r, t in zip(got["roles"], got["texts"], strict=True)]) == (cost, audit, lines)


def test_matrices_are_the_costs_of_paths():
    rng = random.Random(5)
    for _ in range(50):
        rows = random_rows(rng, 9)
        marks = [repair.mark(r, t, False) for r, t in rows]
        turns = sorted(rng.choice([1, 2, 3, 9]) for _ in rows)
        whole, cut = repair.summary(marks, turns), rng.randrange(1, 9)
        assert repair.product(repair.summary(marks[:cut], turns[:cut]), repair.summary(marks[cut:], turns[cut:])) == whole


def by_conversation(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["part"], r["piece"])):
        x = out.setdefault(r["conv_id"], {"audit": "", "lines": [], "facts": tuple(r[f] for f in repair.FACTS)})
        assert x["facts"] == tuple(r[f] for f in repair.FACTS)
        x["audit"] += r["audit"]
        x["lines"] += [f"{a}:{b}" for a, b in zip(r["roles"], r["texts"], strict=True)]
    return out


@pytest.mark.parametrize("rows", [1, 3, 1024])
def test_pieces_of_any_size_equal_whole_conversations(spark, rows):
    rng = random.Random(6)
    table = []
    for conv in [*range(12), None]:
        n = 150 if conv == 5 else rng.randrange(1, 12)
        each = random_rows(rng, n) if conv != 7 else [("user", "The same.")] * n
        table += [(conv, t // 2 if conv == 3 else t, r, x) for t, (r, x) in enumerate(each)]
    order = lambda r: (r[1], r[2], r[3][:64], hashlib.sha256(r[3].encode()).hexdigest())
    want = {}
    for conv in {r[0] for r in table}:
        own = sorted((r for r in table if r[0] == conv), key=order)
        got = repair._repaired([r[1] for r in own], [r[2] for r in own], [r[3] for r in own])
        want[conv] = {"audit": got["audit"], "lines": [f"{a}:{b}" for a, b in zip(got["roles"], got["texts"], strict=True)], "facts": tuple(got[f] for f in repair.FACTS)}
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    out = repair.repair(df, rows=rows)
    assert by_conversation(out) == want
    digests = {r["conv_id"]: (r["audit"], r["repaired_sha256"]) for r in repair.digests(out).collect()}
    assert digests == {c: (w["audit"], hashlib.sha256("\n".join(w["lines"]).encode()).hexdigest()) for c, w in want.items()}


def test_damage_and_all_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c} {t}.") for c in range(30) for t in range(6)] + [(900 + c, None, None, None) for c in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in repair.damage(df).fillna(-1).collect())
    want = []
    for c, t, r, x in rows:
        f = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        r, x, t = r or " ", x or " ", -1 if t is None else t
        row = (c, t, "user" if f == 4 else r, "" if f == 1 else re.sub("[.!?]", "", x) if f == 2 else x)
        want += [] if f == 0 else [row, row] if f == 3 else [row]
    assert got == sorted(want)
    out = repair.with_all(df, repair.digests(repair.repair(repair.damage(df)))).collect()
    assert {r["conv_id"] for r in out} == {r[0] for r in rows} and len(out) == 70
    gone = {c for c, t, *_ in rows if t is None and zlib.crc32(f"{c}: ".encode()) % 20 == 0}
    empty = hashlib.sha256(b"").hexdigest()
    assert gone and all((r["audit"], r["repaired_sha256"], r["cost"]) == ("", empty, 0) for r in out if r["conv_id"] in gone)


def test_odd_rows(spark):
    rows = [(1, 5, "user", "Same."), (1, 5, "user", "Same."), (1, None, None, None), (1, 1 << 62, "", "Odd."), (2, None, "system", "x" * 200_000 + "."), (None, 0, "user", "Hi."), (None, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"part": F.lit(1), "piece": F.lit(2), "digest": F.lit("d"), "row": F.lit(3), "audit": F.lit("a")})
    got = by_conversation(repair.repair(df))
    assert got[None]["audit"] == "KK" and got[None]["lines"] == ["user:Hi.", "assistant:Ho."] and got[2]["audit"] == "D"
    assert dict(zip(repair.FACTS, got[1]["facts"], strict=True)) == {"gaps": (1 << 62) - 5 - 1, "blank": 1, "duplicate": 1, "truncated": 0, "illegal": 3, "cost": 5}
    assert repair.repair(df.limit(0)).count() == 0
    assert repair.digests(repair.repair(df.limit(0))).count() == 0
