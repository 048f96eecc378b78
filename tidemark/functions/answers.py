"""Answers judged against lists of references: patterns, matches, status labels and quality classes.

A longest common subsequence is a common sub-multiset, so the larger of token F1 and ROUGE-L is the token
F1; matches therefore need no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as tx

#: What introduces an answer in a document.
ANSWER_PATTERNS = (r"(?i)(?:stale|old|previous|prior)?\s*answer\s*[:\-]\s*([^\n.;]+)", r"(?i)(?:was|were|is|are)\s+formerly\s+([^\n.;]+)")
#: Modes of a dataset whose answers name a status, the second without a fallback.
STATUS_MODES = ("canonical_relation_grounded", "official_annotation_aligned_exact_status_v4")
#: The reference that counts in each condition; others count by the current one.
TARGETS = {"current_only": "current", "stale_only": "stale", "mixed": "current"}
_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def distinct_references(refs: Column) -> Column:
    """References in order, the first of each normal form, without empty ones."""
    given = F.transform(F.filter(refs, lambda r: r.isNotNull()), lambda r: F.struct(r.alias("text"), tx.normalize(r).alias("normal")))

    def first(s: Column) -> Column:
        normals = F.transform(s["given"], lambda r: r["normal"])
        kept = F.filter(s["given"], lambda r, i: (r["normal"] != "") & (F.array_position(normals, r["normal"]) == i + 1))
        return F.transform(kept, lambda r: r["text"])

    return tx.let(first, given=given)


def answer_patterns(docs: Column) -> Column:
    """Answers of 1 to 20 words that documents introduce as such, in order of document and pattern."""
    found = F.flatten(F.transform(docs, lambda d: F.concat(*(F.regexp_extract_all(d, F.lit(p), 1) for p in ANSWER_PATTERNS))))
    words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: words(t).between(1, 20))


def current_references(gold: Column, aliases: Column) -> Column:
    return distinct_references(F.concat(F.array(gold), F.coalesce(aliases, _none())))


def stale_references(stale: Column, olds: Column, docs: Column) -> Column:
    """The stale answer, other old answers, and what stale documents say; the stale answer alone if that leaves none."""
    return distinct_references(F.concat(F.array(stale), F.coalesce(olds, _none()), answer_patterns(F.coalesce(docs, _none()))))


def _match(answer: Column, ref: Column) -> Column:
    """(substring, f1) of two normalised texts."""
    tokens = lambda n: F.when(n == "", _none()).otherwise(F.split(n, " "))
    inside = (answer != "") & (ref != "") & (answer.contains(ref) | ref.contains(answer))
    return F.struct(inside.alias("inside"), tx.let(lambda t: tx.token_f1(t["p"], t["q"]), p=tokens(answer), q=tokens(ref)).alias("f1"))


def reference_match(answer: Column, refs: Column, threshold: float = 0.75) -> Column:
    """Struct of hit (a substring match, or a score of ``threshold``) and the best token F1; nothing matches no references."""

    def judge(s: Column) -> Column:
        best = F.coalesce(F.array_max(F.transform(s["m"], lambda m: m["f1"])), F.lit(0.0))
        return F.struct((F.exists(s["m"], lambda m: m["inside"]) | (best >= threshold) & (F.size(s["m"]) > 0)).cast("int").alias("hit"), best.alias("best"))

    matches = tx.let(lambda s: F.transform(s["r"], lambda r: _match(s["a"], tx.normalize(r))), a=tx.normalize(answer), r=refs)
    return tx.let(judge, m=matches)


def status_label(answer: Column, mode: Column, space: Column) -> Column:
    """The normal form of the label after ``status:`` at the start of a line, if the dataset has such answers and lists it."""
    said = tx.normalize(F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?i)(?:^|\n)\s*status\s*:\s*([^\n]+)", 1))
    return tx.let(lambda s: F.when(mode.isin(*STATUS_MODES) & (s["said"] != "") & F.array_contains(F.transform(space, tx.normalize), s["said"]), s["said"]), said=said)


def target_of(condition: Column, targets: dict[str, str] = TARGETS) -> Column:
    """Which reference is the target in a condition."""
    return reduce(lambda c, kv: c.when(condition == kv[0], kv[1]), targets.items(), F.when(F.lit(False), "")).otherwise("current")


def reference_answer(kind: Column, gold: Column, stale: Column, old: Column) -> Column:
    """The answer of a named reference: gold, or stale and else the old one."""
    return F.when(kind == "stale", F.coalesce(F.nullif(stale, F.lit("")), old, F.lit(""))).otherwise(gold)


def classify(
    answer: Column, condition: Column, gold: Column, stale: Column, currents: Column, stales: Column, mode: Column | None = None, space: Column | None = None,
    symbols: tuple[Column, Column] | None = None, threshold: float = 0.75, patterns: tuple[str, ...] = tx.MISSING_PATTERNS,
) -> Column:
    """Struct of the label, flags and scores of an answer against the current and the stale references.

    missing goes before ambiguous (both match, and they differ), perfect_current, perfect_stale and harmful_other.
    Where ``mode`` asks for a status, the label is compared with ``symbols`` (current, stale) instead, and the
    strict mode takes no other sign for it.
    """
    mode, space = mode if mode is not None else F.lit(""), space if space is not None else _none()
    status = status_label(answer, mode, space)
    current_symbol, stale_symbol = (tx.normalize(s) for s in symbols or (F.lit(""), F.lit("")))
    strict = mode == STATUS_MODES[1]

    def sides(s: Column) -> Column:
        def side(match: Column, symbol: Column) -> Column:
            same = (s["status"] == symbol).cast("int")
            by_status = F.struct(same.alias("hit"), same.cast("double").alias("best"))
            no = F.struct(F.lit(0).alias("hit"), F.lit(0.0).alias("best"))
            return F.when(s["status"].isNotNull(), by_status).when(strict, no).otherwise(match)

        return F.struct(side(s["c"], current_symbol).alias("c"), side(s["s"], stale_symbol).alias("s"), s["missing"].alias("missing"), s["differ"].alias("differ"))

    def label(s: Column) -> Column:
        c, o = s["c"]["hit"] == 1, s["s"]["hit"] == 1
        name = F.when(s["missing"], "missing").when(c & o & s["differ"], "ambiguous").when(c, "perfect_current").when(o, "perfect_stale").otherwise("harmful_other")
        kind = target_of(condition)
        hit = lambda m: (~s["missing"] & m).cast("int")
        return F.struct(
            name.alias("quality_label"), s["missing"].cast("int").alias("is_missing"), kind.alias("target_reference"), reference_answer(kind, gold, stale, stale).alias("target_answer"),
            hit(F.when(kind == "stale", o).otherwise(c)).alias("target_correct"), hit(c).alias("current_answer_match"), hit(o).alias("stale_answer_match"),
            s["c"]["best"].alias("current_answer_score"), s["s"]["best"].alias("stale_answer_best_f1"), (name == "harmful_other").cast("int").alias("harmful_other"), (name == "ambiguous").cast("int").alias("ambiguous"),
        )

    differ = tx.normalize(F.coalesce(gold, F.lit(""))) != tx.normalize(F.coalesce(stale, F.lit("")))
    known = dict(c=reference_match(answer, currents, threshold), s=reference_match(answer, stales, threshold), missing=tx.is_missing(answer, patterns), differ=differ, status=status)
    return tx.let(lambda s: tx.let(lambda t: label(t["v"]), v=sides(s)), **known)


def current_alignment(answer: Column, gold: Column, docs: Column) -> Column:
    """The larger of the token F1 with the gold answer and the best one with a current document."""
    best = lambda refs: reference_match(answer, refs)["best"]
    return F.greatest(best(F.array(gold)), F.least(best(docs), F.lit(1.0)))


def entails(scores: Column, entailment: float = 0.5, contradiction: float = 0.5) -> Column:
    """Of a struct of scores: entailment reaches its threshold and contradiction does not."""
    return (scores["entailment"] >= entailment) & (scores["contradiction"] < contradiction)


def equivalent(question: Column, left: Column, right: Column, rule: str = "bidirectional", scorer: Callable[[Column, Column], Column] = tx.entailment) -> Column:
    """Lexically equal, or entailed as answers to the question: both ways, or (``non_defeating``) one way without a contradiction.

    ``scorer`` gives a struct of entailment and contradiction scores for premise and hypothesis; a model is a
    pandas UDF of that form.
    """
    if rule not in ("bidirectional", "non_defeating"):
        raise ValueError(f"unknown rule: {rule}")
    a, b = qa_text(question, left), qa_text(question, right)

    def judge(s: Column) -> Column:
        there, back = entails(s["there"]), entails(s["back"])
        clash = (s["there"]["contradiction"] >= 0.5) | (s["back"]["contradiction"] >= 0.5)
        return s["same"] | ((there & back) if rule == "bidirectional" else ((there | back) & ~clash))

    return tx.let(judge, there=scorer(a, b), back=scorer(b, a), same=tx.lexically_equal(left, right))


def qa_text(question: Column, answer: Column) -> Column:
    return F.trim(F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), answer))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the largest."""
    powers = lambda s: F.transform(s["x"], lambda v: F.exp(v - s["top"]))
    share = lambda s: F.transform(s["p"], lambda v: v / F.aggregate(s["p"], F.lit(0.0), lambda a, b: a + b))
    return tx.let(lambda s: tx.let(share, p=powers(s)), x=logits, top=F.array_max(logits))


def label_index(labels: dict[str, int], name: str, fallback: int, n: int) -> int:
    """The index of the first label whose name contains ``name``, or the fallback within n labels."""
    return next((i for k, i in labels.items() if name in k), min(fallback, n - 1))


def sample_metrics(rows, threshold: float = 0.75):
    """Classes and scores of every answer.

    rows have answer, condition, gold, stale, aliases, olds, current_docs and stale_docs; all their columns stay.
    """
    refs = rows.withColumns({"_currents": current_references(F.col("gold"), F.col("aliases")), "_stales": stale_references(F.col("stale"), F.col("olds"), F.col("stale_docs"))})
    answer, gold = F.col("answer"), F.col("gold")
    fallback = F.when(F.size("_stales") > 0, F.col("_stales")).when(F.coalesce(F.col("stale"), F.lit("")) != "", F.array("stale")).otherwise(_none())
    judged = refs.withColumn("_c", classify(answer, F.col("condition"), gold, F.col("stale"), F.col("_currents"), fallback, threshold=threshold))
    target, fuzzy = F.col("_c.target_answer"), reference_match(answer, F.col("_stales"), threshold)
    out = judged.withColumns({"_t": tx.accuracy(answer, target, threshold), "_g": tx.accuracy(answer, gold, threshold), "_f": fuzzy})
    pick = {
        "quality_label": "_c.quality_label", "target_reference": "_c.target_reference", "target_correct": "_c.target_correct", "target_exact_match": "_t.exact_match", "target_substring_match": "_t.substring_match",
        "target_token_f1": "_t.token_f1", "current_answer_match": "_c.current_answer_match", "current_exact_match": "_g.exact_match", "current_substring_match": "_g.substring_match",
        "current_token_f1": "_g.token_f1", "stale_answer_match": "_c.stale_answer_match", "fuzzy_stale_answer_match": "_f.hit", "missing": "_c.is_missing", "harmful_other": "_c.harmful_other", "ambiguous": "_c.ambiguous",
    }
    return out.select(
        *rows.columns, *(F.col(v).alias(k) for k, v in pick.items()), F.greatest("_c.stale_answer_best_f1", "_f.best").alias("stale_answer_best_f1"),
        tx.contradicts(answer, gold).cast("int").alias("contradiction_to_gold"), current_alignment(answer, gold, F.coalesce("current_docs", _none())).alias("current_alignment"), target.alias("target_answer"),
    )


def question_metrics(samples):
    """Means of the flags and scores of ``sample_metrics`` for each question and condition, and the larger contradiction rate.

    Pairs of answers are formed within a question and condition, whose size the sampling plan bounds.
    """
    keys = ["question_id", "condition"]
    mean = {
        "accuracy": "target_correct", "target_correct_rate": "target_correct", "current_answer_rate": "current_answer_match", "stale_answer_rate": "stale_answer_match", "missing_rate": "missing",
        "harmful_other_rate": "harmful_other", "ambiguous_rate": "ambiguous", "mean_target_token_f1": "target_token_f1", "gold_contradiction_rate": "contradiction_to_gold", "current_alignment": "current_alignment",
    }
    share = lambda v: F.avg((F.col("quality_label") == v).cast("double"))
    means = samples.groupBy(*keys).agg(
        F.count("*").alias("n_samples"), *(F.avg(v).alias(k) for k, v in mean.items()), share("perfect_current").alias("perfect_current_rate"), share("perfect_stale").alias("perfect_stale_rate")
    )
    left = samples.select(*keys, F.col("sample_idx").alias("_i"), F.col("answer").alias("_a"))
    right = samples.select(*keys, F.col("sample_idx").alias("_j"), F.col("answer").alias("_b"))
    rates = left.join(right, keys).filter("_i < _j").groupBy(*keys).agg(F.avg(tx.contradicts(F.col("_a"), F.col("_b")).cast("double")).alias("pairwise_contradiction_rate"))
    out = means.join(rates, keys, "left").withColumn("pairwise_contradiction_rate", F.coalesce("pairwise_contradiction_rate", F.lit(0.0)))
    return out.withColumn("contradiction_rate", F.greatest("pairwise_contradiction_rate", "gold_contradiction_rate"))
