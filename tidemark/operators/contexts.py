"""Contexts and prompts of records under a condition, and the fields that records carry.

A record has id, question, gold_answer, stale_answer, current_docs, stale_docs and metadata (see ``sources.records``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import probe as pb

#: What generators are told.
SYSTEM = {
    "grounded": "Answer the question using the provided retrieved context. If the context is insufficient or contradictory, "
    "answer as best as possible without inventing unsupported facts. "
    "Return only the shortest final answer needed to answer the question. For a yes/no question, return only Yes or No. "
    "Do not explain your reasoning, cite documents, restate the question, or add qualifications.",
    "hybrid": "Answer the question using the provided retrieved context as your primary evidence. If the context is incomplete or contradictory, "
    "you may also rely on your own knowledge to give the best answer you can, but do not fabricate facts and prefer context-supported information when possible. "
    "Return only the shortest final answer needed to answer the question. For a yes/no question, return only Yes or No. "
    "Do not explain your reasoning, cite documents, restate the question, or add qualifications.",
}
MODES = {"grounded": "grounded", "default": "grounded", "hybrid": "hybrid", "parametric_hybrid": "hybrid", "hybrid_answer": "hybrid"}
RATIO = r"^stale_(\d{1,3})(?:_(interleave|current_first|stale_first))?$"
_STRINGS = "array<string>"


def tagged(docs: Column, source: str) -> Column:
    return F.transform(docs, lambda d: F.struct(F.lit(source).alias("source"), d.alias("doc")))


def numbered(docs: Column) -> Column:
    """Tagged documents under ``[source doc n]`` lines, counted for each source."""
    nth = lambda d, i: F.size(F.filter(F.slice(docs, 1, i + 1), lambda e: e["source"] == d["source"]))
    return F.transform(docs, lambda d, i: F.concat(F.lit("["), d["source"], F.lit(" doc "), nth(d, i).cast("string"), F.lit("]\n"), d["doc"]))


def context(
    condition: Column, current: Column, stale: Column, given: Column | None = None, mixed: Column | None = None, total: int = 8, order: str = "interleave", mixed_order: str = "concat",
    shuffle_key: Column | None = None, labels: bool = True, separator: str = "\n\n",
) -> Column:
    """The context of a condition.

    In this order: documents given for it; a ratio mix ``stale_NN`` (with an order of its own, if named); the documents
    of one side; mixed documents as they are given, shuffled by a hash of ``shuffle_key``, or one side after the
    other.  Another condition fails.
    """
    c, s = tagged(current, "current"), tagged(stale, "stale")
    none = F.slice(c, 1, 0)
    share, named = F.regexp_extract(condition, RATIO, 1), F.regexp_extract(condition, RATIO, 2)
    counts = pb.ratio_counts(F.coalesce(F.try_to_number(F.nullif(share, F.lit("")), F.lit("999")).cast("int"), F.lit(0)), total, F.size(current), F.size(stale))

    def mix(k: Column) -> Column:
        few, old = F.slice(c, 1, k["current"]), F.slice(s, 1, k["stale"])
        how = F.when(named == "", order).otherwise(named)
        return F.when(how == "current_first", F.concat(few, old)).when(how == "stale_first", F.concat(old, few)).otherwise(pb.interleave(few, old))

    both = F.concat(s, c) if mixed_order == "stale_first" else F.concat(c, s)
    if shuffle_key is not None:
        keyed = F.transform(both, lambda d, i: F.struct(F.md5(F.concat_ws("|", shuffle_key, i.cast("string"), d["doc"])).alias("k"), d.alias("d")))
        both = F.transform(F.array_sort(keyed), lambda x: x["d"])
    if mixed is not None:
        both = F.when(mixed.isNotNull(), tagged(mixed, "mixed")).otherwise(both)
    bad = F.raise_error(F.concat(F.lit("no such condition: "), condition)).cast("string")
    known = F.when(share != "", tx.let(lambda x: mix(x["k"]), k=counts)).when(condition == "current_only", c).when(condition == "stale_only", s).when(condition == "mixed", both)
    docs = known if given is None else F.when(given.isNotNull(), tagged(given, "retrieved")).otherwise(known)
    shown = lambda d: numbered(d) if labels else F.transform(d, lambda x: x["doc"])
    ok = condition.isin("current_only", "stale_only", "mixed") | (share != "") | (F.lit(False) if given is None else given.isNotNull())
    return F.when(ok, F.array_join(tx.let(lambda x: shown(x["d"]), d=F.coalesce(docs, none)), separator)).otherwise(bad)


def system_prompt(mode: str = "grounded", override: str | None = None) -> str:
    if not override and mode.strip().lower() not in MODES:
        raise ValueError(f"unknown prompt mode: {mode}")
    return override or SYSTEM[MODES[mode.strip().lower()]]


def user_prompt(question: Column, text: Column) -> Column:
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nRetrieved Context:\n"), text, F.lit("\n\nReturn only the final answer:\n"))


def chat_messages(question: Column, text: Column, mode: str = "grounded", override: str | None = None) -> Column:
    """array<struct<role, content>> of a system and a user message."""
    of = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(of("system", F.lit(system_prompt(mode, override))), of("user", user_prompt(question, text)))


def plain_prompt(question: Column, text: Column, mode: str = "grounded", override: str | None = None) -> Column:
    return F.concat(F.lit(f"System:\n{system_prompt(mode, override)}\n\nUser:\n"), user_prompt(question, text), F.lit("\n"))


def timed_question(question: Column, condition: Column, own: Column, old: list[Column], new: list[Column], template: str = "As of {time}, answer the following question: {question}") -> Column:
    """The question with the date of its condition: its own, the old snapshot for stale_only, the new one for current_only and mixed.

    ``old`` and ``new`` are looked through for the first that is there and not empty; without a time the question stays as it is.
    """
    first = lambda cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))
    time = F.coalesce(own, F.when(condition == "stale_only", first(old)).when(condition.isin("current_only", "mixed"), first(new)))
    shown = F.split_part(F.trim(time), F.lit("T"), F.lit(1))
    text = F.replace(F.replace(F.lit(template), F.lit("{time}"), shown), F.lit("{question}"), question)
    return F.when(time.isNull(), question).otherwise(text)


def requested_samples(n: Column, sizes: Column) -> Column:
    """As many as the largest of a list of sample sizes asks for, and n at least."""
    return F.greatest(n, F.coalesce(F.array_max(sizes), n))


def baseline(condition: Column) -> Column:
    """Aggregate: the condition that others are compared with: current_only, else stale_0, else the first by name."""
    has = lambda v: F.max((condition == v).cast("int")) == 1
    return F.when(has("current_only"), "current_only").when(has("stale_0"), "stale_0").otherwise(F.min(condition))


def comparisons(conditions: list[str], configured: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """Pairs to compare: the configured ones; the three of the usual conditions; stale_0 with each other share; the first with each other."""
    pairs = [(str(a), str(b)) for a, b in configured or []]
    have = sorted(set(conditions))
    if pairs:
        return pairs
    if {"current_only", "stale_only", "mixed"} <= set(have):
        return [("current_only", "stale_only"), ("current_only", "mixed"), ("mixed", "stale_only")]
    if "stale_0" in have:
        share = lambda c: int(c.split("_", 1)[1]) if c.split("_", 1)[1].isdigit() else 10_000
        return [("stale_0", c) for c in sorted((c for c in have if c.startswith("stale_")), key=share) if c != "stale_0"]
    return [(have[0], c) for c in have[1:]]


def truth(c: Column) -> Column:
    """Whether a text field says 1, true or yes."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def require_classes(rows: DataFrame, label: str, least: int) -> DataFrame:
    """rows, failing when either class of a 0/1 label has fewer than ``least``."""
    n = rows.agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n")).first()
    if min(n["p"] or 0, n["n"] or 0) < least:
        raise ValueError(f"{label} has {n['p'] or 0} positive and {n['n'] or 0} negative rows, not {least} of each")
    return rows


def question_id(x: Column, y: Column, question: Column) -> Column:
    """``q_<x>_<y>_<hash>`` of a question between two snapshots."""
    day = lambda t: F.date_format(t, "yyyyMMdd")
    return F.concat_ws("_", F.lit("q"), day(x), day(y), tx.text_hash(F.concat_ws("|", question, day(x), day(y))))


def id_parts(id_: Column) -> Column:
    """(transition, group) of such an id: the later snapshot, and what stands after the last underscore."""
    return F.struct(F.nullif(F.regexp_extract(id_, r"_(\d{8})_(\d{8})", 2), F.lit("")).alias("transition"), F.element_at(F.split(id_, "_"), -1).alias("group"))


def binary_style(gold: Column) -> Column:
    return F.when(F.lower(F.trim(gold)).isin("yes", "no"), "binary").otherwise("open")


def stratum(x: Column, y: Column, relation: Column, gold: Column) -> Column:
    """(transition, relation, style) of a record."""
    day = lambda t: F.coalesce(F.left(t, F.lit(10)), F.lit(""))
    return F.struct(F.concat(day(x), F.lit("_to_"), day(y)).alias("transition"), F.lower(F.trim(F.coalesce(relation, F.lit("unknown")))).alias("relation"), binary_style(gold).alias("style"))


def richest(rows: DataFrame, key: str, sizes: list[Column], source: str) -> DataFrame:
    """One row of each key: that with the largest sizes, compared in order; ties go to the earliest source."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*sizes, -F.col(source))).alias("_r"))
    return best.select("_r.*")


def merge_partitions(parts: list[DataFrame], wanted: DataFrame, key: str) -> DataFrame:
    """The wanted keys of all parts together; fails if parts share a key or a wanted key is in none."""
    out = None
    for p in parts:
        p = p.join(wanted.select(key).distinct(), key, "left_semi")
        out = p if out is None else out.unionByName(p)
    twice = out.groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"partitions overlap: {twice[0][key]}")
    lost = wanted.select(key).distinct().join(out, key, "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no partition has {lost[0][key]}")
    return out
