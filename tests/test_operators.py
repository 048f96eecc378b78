import datetime as dt
import itertools
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import answers, text
from tidemark.operators import contexts, detector, drift, evidence, index, probe, retrieval, temporal


@pytest.mark.parametrize(
    "old, new, change, want",
    [
        (0.49, 0.49, "stable", "persistent_failure"), (0.49, 0.0, "changed", "persistent_failure"), (0.5, 0.49, "stable", "normal"), (0.75, 0.625, "changed", "new_degradation"),
        (0.5, 0.25, "stable", "new_degradation"), (0.25, 0.5, "stable", "recovery_or_adaptive_success"), (0.5625, 0.5, "changed", "recovery_or_adaptive_success"), (0.5625, 0.5, "stable", "normal"),
    ],
)
def test_outcomes(spark, old, new, change, want):
    df = spark.createDataFrame([(old, new, change)], "o double, n double, c string")
    assert df.select(drift.outcome(F.col("o"), F.col("n"), F.col("c"))).first()[0] == want


@pytest.mark.parametrize(
    "old, p, moved, stage, mechanism",
    [
        (0.875, (0.8125, 0.9, 0.9, 0.9, 0.9), True, "p1_natural", "no_degradation_on_probe_rerun"), (0.875, (0.25, 0.25, 0.25, 0.8125, 1.0), True, "p4_evidence_only", "evidence_extraction_or_context_complexity_failure"),
        (0.875, (0.25, 0.5, 0.875, 1.0, 1.0), True, "p3_support_first", "ranking_or_position_sensitivity"), (0.875, (0.25, 0.5, 0.875, 1.0, 1.0), False, "p3_support_first", "stochastic_recovery_without_context_change"),
        (0.75, (0.125, 0.6875, 0.0, 0.0, 0.0), True, "p2_support_presence", "retrieval_coverage_failure"), (0.75, (0.125, 0.625, 0.6, 0.6, 0.6), True, "none", "persistent_after_explicit_fact"),
    ],
)
def test_recovery_stages(spark, old, p, moved, stage, mechanism):
    df = spark.createDataFrame([(old, *p)], "old double, a double, b double, c double, d double, e double")
    r = df.select(probe.linked_recovery(F.col("old"), [F.col(c) for c in "abcde"], F.lit(True), F.lit(moved)).alias("r")).first()["r"]
    assert (r["stage"], r["mechanism"]) == (stage, mechanism)


@pytest.mark.parametrize("q, want", [(0.0, 1.0), (0.5, 4.0), (0.51, 5.0), (0.99, 7.0), (1.0, 7.0)])
def test_quantile_higher(spark, q, want):
    df = spark.createDataFrame([(float(x),) for x in range(1, 8)], "score double")
    assert detector.quantile_higher(df, "score", q).first()["threshold"] == want


def test_constant_reference_is_finite(spark):
    ref = spark.createDataFrame([(1.0,)] * 3, "score double")
    z = spark.createDataFrame([(4.0,), (-20.0,)], "score double").crossJoin(detector.robust_scale(ref, "score")).select(detector.robust_z(F.col("score")).alias("z")).collect()
    assert [r["z"] for r in z] == [3.0, -8.0]


def test_auroc_and_best_f1_match_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), int(rng.random() < 0.3), float(np.round(rng.random(), 1))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, y int, score double")
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)])
    assert detector.auroc_ap(df).first()["auroc"] == pytest.approx(auc)

    def at(t):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        return (2 * tp / max(tp + fp + len(pos), 1), tp / (tp + fp) if tp + fp else 0.0, t)

    best = max(at(t) for t in {0.0, 1.0, *pos, *neg})
    got = detector.best_f1(df).first()
    assert got["threshold"] == best[2] and got["f1"] == pytest.approx(best[0])


def test_as_of_prefers_the_latest_start(spark):
    d = lambda n: dt.datetime(2024, 1, n)
    spans = spark.createDataFrame([(1, "a", d(1), None, 0), (1, "b", d(3), d(9), 1), (1, "c", d(3), d(9), 2), (2, "z", d(8), None, 0)], "question_id int, answer string, start_ts timestamp, end_ts timestamp, ord int")
    times = spark.createDataFrame([(d(5),), (d(9),)], "t timestamp")
    got = {(r["question_id"], r["t"].day): r["answer"] for r in temporal.as_of(spans, times, ["question_id"]).collect()}
    assert got == {(1, 5): "c", (1, 9): "a", (2, 9): "z"}


def test_match_score_of_open_intervals(spark):
    df = spark.createDataFrame([(None, None, None, None)], "a timestamp, b timestamp, c timestamp, d timestamp")
    assert df.select(temporal.match_score(*map(F.col, "abcd"))).first()[0] == 5


def test_interleave_and_ratio(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["x"])], "c array<string>, s array<string>")
    assert df.select(probe.interleave(F.col("c"), F.col("s"))).first()[0] == ["a", "x", "b", "c"]
    assert df.select(probe.ratio_counts(F.lit(25), 10, F.lit(9), F.lit(9))).first()[0].asDict() == {"stale": 2, "current": 8}


def test_ratio_of_too_few_documents(spark):
    """The largest mix in the ratio that both sides can fill; where no unit of it fits, what each side has of its share."""
    rows = [(25, 8, 8, (2, 6)), (25, 8, 1, (1, 3)), (25, 5, 2, (1, 3)), (25, 2, 2, (2, 2)), (25, 6, 0, (0, 6)), (50, 3, 8, (3, 3)), (50, 0, 2, (2, 0)), (75, 1, 8, (3, 1)), (0, 5, 5, (0, 5)), (100, 5, 5, (5, 0)), (30, 8, 8, (2, 6))]
    df = spark.createDataFrame([r[:3] for r in rows], "p int, c int, s int")
    got = df.select("p", "c", "s", probe.ratio_counts(F.col("p"), 8, F.col("c"), F.col("s")).alias("r")).collect()
    assert [(r["p"], r["c"], r["s"], tuple(r["r"])) for r in got] == rows


_PEOPLE = "id long, transition int, relation int, style int, risk double"


@pytest.mark.parametrize("limit, want", [(1, [(1, 13)]), (3, [(1, 13), (2, 12), (None, 10)]), (4, [(1, 13), (2, 12), (None, 10), (None, 11)]), (9, [(1, 13), (2, 12), (None, 10), (None, 11), (None, 14)])])
def test_matched_controls_are_filled_up(spark, limit, want):
    """One control a case, then the riskiest others, by id where equal."""
    cases = spark.createDataFrame([(1, 0, 0, 0, 0.9), (2, 0, 0, 1, 0.9)], _PEOPLE)
    controls = spark.createDataFrame([(10, 1, 1, 1, 0.7), (11, 1, 1, 1, 0.7), (12, 0, 1, 1, 0.1), (13, 0, 0, 0, 0.2), (14, 2, 2, 0, 0.3)], _PEOPLE)
    got = probe.match_controls(cases, controls, limit).collect()
    assert sorted(((r["case_id"], r["control_id"]) for r in got), key=lambda x: (x[0] is None, x[1])) == sorted(want, key=lambda x: (x[0] is None, x[1]))
    assert all((r["cost"] is None) == (r["case_id"] is None) for r in got)


def test_matched_controls_without_cases(spark):
    controls = spark.createDataFrame([(10, 1, 1, 1, 0.7), (11, 1, 1, 1, 0.8)], _PEOPLE)
    assert [(r["case_id"], r["control_id"]) for r in probe.match_controls(controls.limit(0), controls, 1).collect()] == [(None, 11)]


def test_stratum_controls_fall_back(spark):
    """Exact strata up to their quota, then (relation, style) of the targets, the commonest first, then any."""
    exact, coarse = ["transition", "relation", "style"], ["relation", "style"]
    strata = [(0, 0, 0)] * 3 + [(0, 1, 1)] * 2
    targets = spark.createDataFrame([(i, *s, 1.0) for i, s in enumerate(strata)], _PEOPLE)
    rows = [(10, 0, 0, 0, 0.5), (20, 5, 1, 1, 0.9), (21, 6, 1, 1, 0.9), (22, 5, 0, 0, 0.1), (30, 7, 8, 0, 0.8), (31, 7, 8, 1, 0.95)]
    chosen = lambda some: sorted(r["id"] for r in probe.quota_controls(targets, spark.createDataFrame(some, _PEOPLE), exact, coarse).collect())
    assert chosen(rows) == [10, 20, 21, 22, 31]
    # a row less in the second tier, and one more of the any tier
    assert chosen(rows[:1] + rows[2:]) == [10, 21, 22, 30, 31]
    # enough in every stratum: the quota alone
    assert chosen(rows + [(40 + i, *s, 0.1 * i) for i, s in enumerate(strata)]) == [10, 41, 42, 43, 44]


def one(spark, column, schema="x int", *row):
    return spark.createDataFrame([row or (1,)], schema).select(column.alias("v")).first()["v"]


def test_reference_lists(spark):
    a = lambda *xs: F.array(*map(F.lit, xs))
    assert one(spark, answers.distinct_references(F.array(F.lit("The  Cat"), F.lit(None), F.lit("the cat!"), F.lit(" "), F.lit("dog")))) == ["The  Cat", "dog"]
    docs = a("Old answer: Paris. He was formerly mayor of Lyon; PRIOR ANSWER - x", "answer: " + "w " * 21)
    assert one(spark, answers.answer_patterns(docs)) == ["Paris", "x", "mayor of Lyon"]
    assert one(spark, answers.reference_match(F.lit("in Paris today"), a("Rome", "paris"))).asDict() == {"hit": 1, "best": 0.5}
    assert one(spark, answers.reference_match(F.lit("x"), F.array().cast("array<string>"))).asDict() == {"hit": 0, "best": 0.0}


@pytest.mark.parametrize(
    "answer, mode, want",
    [
        ("note\n Status :  Open.", 0, ("perfect_current", 1)), ("status: CLOSED", 1, ("perfect_stale", 0)), ("it is open", 1, ("harmful_other", 0)), ("it is open", 0, ("perfect_current", 1)), ("status: unheard", 0, ("harmful_other", 0)),
        ("I don't know", 0, ("missing", 0)), ("open or closed", 0, ("ambiguous", 1)),
    ],
)
def test_classes_with_and_without_a_status(spark, answer, mode, want):
    a = lambda x: F.array(F.lit(x))
    c = answers.classify(F.lit(answer), F.lit("current_only"), F.lit("open"), F.lit("closed"), a("open"), a("closed"), F.lit(answers.STATUS_MODES[mode]), F.array(F.lit("Open"), F.lit("closed")), (F.lit("Open"), F.lit("Closed")))
    got = one(spark, c)
    assert (got["quality_label"], got["target_correct"]) == want


def test_rouge_never_beats_token_f1(spark):
    import random

    rng = random.Random(0)
    for _ in range(200):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(1, 9))] for _ in range(2))
        common = sum(min(x.count(t), y.count(t)) for t in set(x))
        assert text.lcs_length(x, y) <= common


@pytest.mark.parametrize("a, b", [("a b a c a", "a a d"), ("x", "x x x"), ("a a b b", "b b b a"), ("", "a")])
def test_overlap_counts_what_comes_again(spark, a, b):
    x, y = a.split(), b.split()
    want = sum(min(x.count(t), y.count(t)) for t in set(x))
    got = spark.createDataFrame([(x, y)], "x array<string>, y array<string>").select(text.overlap(F.col("x"), F.col("y"))).first()[0]
    assert got == want


def test_contexts_of_conditions(spark):
    cur, old = F.array(F.lit("c1"), F.lit("c2"), F.lit("c3")), F.array(F.lit("s1"))
    ctx = lambda c, **k: one(spark, contexts.context(F.lit(c), cur, old, **k))
    assert ctx("stale_only") == "[stale doc 1]\ns1" and ctx("mixed", labels=False, separator="|") == "c1|c2|c3|s1"
    assert ctx("mixed", mixed_order="stale_first", labels=False, separator="|") == "s1|c1|c2|c3"
    assert ctx("stale_25", labels=False, separator="|") == "c1|s1|c2|c3" and ctx("stale_25_stale_first", labels=False, separator="|") == "s1|c1|c2|c3"
    assert ctx("anything", given=F.array(F.lit("g"))) == "[retrieved doc 1]\ng" and ctx("mixed", mixed=F.array(F.lit("m"))) == "[mixed doc 1]\nm"
    assert sorted(ctx("mixed", shuffle_key=F.lit("7"), labels=False, separator="|").split("|")) == ["c1", "c2", "c3", "s1"]
    with pytest.raises(Exception, match="no such condition"):
        ctx("nothing")


def test_prompts(spark):
    q = lambda cond, own=None: one(spark, contexts.timed_question(F.lit("Who?"), F.lit(cond), F.lit(own).cast("string"), [F.lit(""), F.lit("2021-01-02T00")], [F.lit("2022-03-04")]))
    assert q("stale_only") == "As of 2021-01-02, answer the following question: Who?" and q("mixed").startswith("As of 2022-03-04,") and q("other") == "Who?" and q("other", "2020-05-06T07").startswith("As of 2020-05-06,")
    roles = one(spark, contexts.chat_messages(F.lit("Who?"), F.lit("ctx"), override="Be brief."))
    assert [(m["role"], m["content"]) for m in roles] == [("system", "Be brief."), ("user", "Question:\nWho?\n\nRetrieved Context:\nctx\n\nReturn only the final answer:\n")]
    with pytest.raises(ValueError):
        contexts.system_prompt("odd")


def test_partitions_must_be_disjoint_and_whole(spark):
    df = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    assert contexts.merge_partitions([df(1, 2, 8), df(3)], df(1, 2, 3), "id").count() == 3
    with pytest.raises(ValueError, match="overlap"):
        contexts.merge_partitions([df(1, 2), df(2)], df(1, 2), "id")
    with pytest.raises(ValueError, match="no partition"):
        contexts.merge_partitions([df(1)], df(1, 2), "id")


def test_strict_pivot_fails_on_two_rows(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.6)], "q int, c string, v double")
    with pytest.raises(Exception, match="more than one row"):
        drift.pivot_strict(df, "q", "c", "v", ["a"]).collect()


def test_support_is_found_by_rank_or_url(spark):
    docs = F.array(F.lit("one"), F.lit("see WWW.Site.org/a/b here"), F.lit("three"))
    at = lambda rank, *urls: one(spark, evidence.support_index(docs, F.lit(rank).cast("int"), F.array(*map(F.lit, urls)).cast("array<string>")))
    assert at(3) == 2 and at(9, "http://site.org/a/b/") == 1 and at(None, "https://other.org/x") is None and at(None, "") is None


def test_a_support_that_is_there_is_not_injected(spark):
    fact = "struct<fact_id:string,row:int,subject:string,property:string,object:string,valid_start:string,source_date:string,source_url:string,evidence_span:string>"
    row = (["a", "b", "c"], [("f", 1, "S", "p", "O", None, None, "http://x.org/y", "quote"), ("g", 2, "S", "p", "O", None, None, "", "")])
    df = spark.createDataFrame([row], f"docs array<string>, facts array<{fact}>")
    build = lambda rank: df.select(evidence.probe_documents(F.col("docs"), F.col("facts"), F.lit(rank).cast("int"), F.array().cast("array<string>"), F.lit("2024-01-01"), F.lit("rel"), F.lit("Gold")).alias("d")).first()["d"]
    d = build(2)
    assert d["p1_natural"] == d["p2_support_presence"] and not d["injected"] and d["natural_support_rank"] == 2 and d["moved"]
    assert [x.split("\n")[1] for x in d["p3_support_first"]] == ["b", "a", "c"] and d["n_facts"] == 1 and len(d["p4_evidence_only"]) == 1
    d = build(None)
    assert d["injected"] and len(d["p2_support_presence"]) == 4 and d["p3_support_first"][0].endswith("quote") and "Verified answer to the question: Gold" in d["p5_fact_card"][0]


def test_ladder_with_a_title(spark):
    q = spark.createDataFrame([(1, "who leads the Alpha Beta council", 'The "Alpha" office'), (2, "who", "")], "item_id int, question string, title string")
    steps = {(r["item_id"], r["step"]): r["q"] for r in retrieval.ladder(q, title="title").collect()}
    assert steps[1, 0] == '"The ""Alpha"" office"' and steps[1, 1] == '"alpha" AND "office"' and not any(i == 2 for i, _ in steps)
    last = max(s for i, s in steps if i == 1)
    assert steps[1, last].startswith('"alpha" OR "office" OR "leads"')
    assert one(spark, text.any_query(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c")))) == '"b" OR "a" OR "c"'


def test_cutoff_and_document_scope(spark, tmp_path):
    """Later versions stay hidden, and a document comes once where its versions count as one."""
    body = lambda n: f"The river council of Alden met in {n}. " + "Alden river council news and more of it. " * 12
    rows = [(i, f"art{i % 2}", f"u{i}", f"2024-01-0{i + 1}", body(i)) for i in range(5)]
    art = spark.createDataFrame(rows, "doc_id long, article_id string, url string, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    q = spark.createDataFrame([(1, "What did the Alden river council do")], "item_id long, question string")
    ranked = retrieval.fused(index.build(retrieval.passages(art), str(tmp_path)), q, "2024-01-03")
    both = retrieval.first_per(ranked, ["ts", "article_id"], 10).collect()
    assert {str(r["ts"])[:10] for r in both} == {"2024-01-01", "2024-01-02", "2024-01-03"}
    assert sorted(r["article_id"] for r in retrieval.first_per(ranked, ["article_id"], 10).collect()) == ["art0", "art1"]


def small_index(spark, folder, texts, **size):
    rows = [(i, f"2024-01-{1 + i % 28:02d}", t, b) for i, (t, b) in enumerate(texts)]
    p = spark.createDataFrame(rows, "pid long, ts string, title string, chunk string").withColumn("ts", F.to_timestamp("ts"))
    return index.build(p, str(folder), **size)


def test_postings_have_positions_and_files_follow_the_data(spark, tmp_path):
    texts = [("The river", "river Alden the river"), ("", "hill town"), ("of", "...")]
    x = small_index(spark, tmp_path, texts)
    got = {(r["term"], r["pid"]): (r["size"], r["title"], r["body"], r["positions"]) for r in x.table("postings").collect()}
    assert got["river", 0] == (6, 1, 2, [1, 3, 6]) and got["the", 0] == (6, 1, 1, [0, 5]) and got["hill", 1] == (2, 0, 1, [1]) and got["of", 2] == (1, 1, 0, [0])
    many = [(f"title {i}", f"common words w{i} and more of them " * 8) for i in range(600)]
    parts = small_index(spark, tmp_path / "many", many, file_bytes=40_000).table("postings")
    files = {r[0] for r in parts.select(F.input_file_name()).distinct().collect()}
    assert len(files) > 5 and len({r[0] for r in parts.filter("term = 'common'").select(F.input_file_name()).distinct().collect()}) >= 1
    assert parts.groupBy("term", "block").count().agg(F.max("count")).first()[0] <= index.BLOCK
    blocks = small_index(spark, tmp_path / "again", many, file_bytes=40_000).table("blocks").filter("term = 'common'")
    assert blocks.count() >= 600 // index.BLOCK and blocks.agg(F.sum("n")).first()[0] == 600


def test_postings_are_dealt_in_slices(spark, tmp_path, monkeypatch):
    """An index dealt in many slices of terms has the postings of one dealt at once, and leaves nothing beside its tables."""
    from tidemark import shared

    many = [(f"title {i}", f"common words w{i} and more of them " * 8) for i in range(120)]
    kept = Path(shared.shared_dir(spark).removeprefix("file://"))
    before = set(kept.glob("*"))
    one = small_index(spark, tmp_path / "one", many)
    jobs, first = [], index.dropped
    monkeypatch.setattr(index, "dropped", lambda s, path: jobs.append(path) or first(s, path))
    more = small_index(spark, tmp_path / "more", many, file_bytes=2_000)
    assert len(jobs) > 5 and set(kept.glob("*")) == before
    columns = ["term", "pid", "ts", "size", "title", "body", "positions"]
    a, b = (sorted(map(tuple, x.table("postings").select(*columns).collect())) for x in (one, more))
    assert a == b and sorted(map(tuple, one.terms.collect())) == sorted(map(tuple, more.terms.collect()))
    assert {p.name for p in Path(str(more.folder).removeprefix("file://")).glob("*")} == {"passages", "postings", "blocks", "terms", "totals"}


def test_phrases_stand_within_one_field(spark, tmp_path):
    texts = [("a b", "c a b c"), ("x", "a b c a b c a"), ("a", "b c"), ("", "b a c"), ("", "a a a b"), ("q", "A-B, c")]
    x = small_index(spark, tmp_path, texts)
    phrases = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "a"]), (3, ["a", "b"]), (4, []), (5, ["a", "zz"]), (6, ["c", "a", "b", "c"])], "item int, phrase array<string>")
    got = sorted((r["item"], r["pid"], r["places"]) for r in index.phrase_hits(x, phrases, "item").collect())
    assert got == [(1, 0, 1), (1, 1, 2), (1, 5, 1), (2, 4, 2), (3, 0, 2), (3, 1, 2), (3, 4, 1), (3, 5, 1), (6, 0, 1), (6, 1, 1)]
    assert sorted(r["pid"] for r in index.phrase_hits(x, phrases.filter("item = 3"), "item", "2024-01-02").collect()) == [0, 1]


def test_no_best_passage_is_lost_to_block_bounds(spark, tmp_path):
    rng = random.Random(1)
    texts = [("", " ".join(rng.choices(["one", "two", "three", "four", "rare", "scarce", "filler", "more"], [300, 200, 100, 50, 3, 1, 200, 100], k=rng.randrange(5, 60)))) for _ in range(700)]
    x = small_index(spark, tmp_path, texts)
    wanted = spark.createDataFrame([(q, t) for q, ts in enumerate([["one", "rare"], ["one", "two", "three"], ["scarce", "rare", "four", "one"], ["absent"], ["absent", "two"]]) for t in ts], "item int, term string")
    every = index.postings_scores(x, wanted, "item").collect()
    best = {}
    for q in range(5):
        best[q] = sorted(((round(r["score"], 9), -r["pid"]) for r in every if r["item"] == q), reverse=True)[:10]
    pruned = index.top_passages(x, wanted, "item", 10).collect()
    for q in range(5):
        assert sorted(((round(r["score"], 9), -r["pid"]) for r in pruned if r["item"] == q), reverse=True)[:10] == best[q]
    # a common term proposes nothing beside a rare one that enough passages have
    count = lambda rows, q: sum(r["item"] == q for r in rows)
    assert count(pruned, 0) < count(every, 0) / 2 and count(pruned, 3) == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_are_added_up_where_the_postings_are(spark, tmp_path):
    """Common terms of many questions are not dealt: what is grouped by question and passage is read from buckets of passages."""
    x = small_index(spark, tmp_path, [(f"title {i}", f"common words w{i % 7} of them " * 8) for i in range(200)], file_bytes=20_000)
    assert x.totals["buckets"] > 5 and x.totals["n"] == 200
    wanted = spark.createDataFrame([(q, t) for q in range(9) for t in ("common", "words", f"w{q}")], "item_id int, term string")
    phrases = spark.createDataFrame([(q, ["common", "words", f"w{q}"]) for q in range(9)], "item_id int, phrase array<string>")
    steps = wanted.select("item_id", F.lit(0).alias("step"), F.lit(True).alias("broad"), "term", F.lit(1).alias("need"))
    q = spark.createDataFrame([(i, f"common words w{i}") for i in range(9)], "item_id int, question string")
    found = [
        index.postings_scores(x, wanted, "item_id"), index.top_passages(x, wanted, "item_id", 10), index.phrase_hits(x, phrases, "item_id"),
        index.ladder_hits(x, steps, "item_id"), retrieval.lexical_scores(x, q),
    ]
    assert [bool(re.search(r"hashpartitioning\(item_id#\d+L?, pid", plan_of(f))) for f in found] == [False] * 5
    assert [found[i].count() for i in (0, 3, 4)] == [9 * 200] * 3
    assert found[2].agg(F.sum("places")).first()[0] == 200 * 8


def test_no_hit_is_lost_to_the_floor(spark, tmp_path):
    rng = random.Random(2)
    texts = [("", " ".join(rng.choices([f"w{i}" for i in range(40)] + ["rare"], [1] * 40 + [0.02], k=rng.randrange(5, 20)))) for _ in range(900)]
    x = small_index(spark, tmp_path, texts, file_bytes=10_000)
    wanted = spark.createDataFrame([(q, t) for q, ts in enumerate([["w1", "rare"], ["w1", "w2", "w3", "w4", "w5"], ["rare"], ["absent"]]) for t in ts], "item int, term string")
    rows = index.postings_scores(x, wanted, "item")
    every, kept = rows.collect(), index.above_floor(x, rows, ["item"], 20).collect()
    best = lambda rs, q: sorted(((round(r["score"], 9), -r["pid"]) for r in rs if r["item"] == q), reverse=True)[:20]
    assert all(best(every, q) == best(kept, q) for q in range(4)) and len(kept) < len(every) / 4


def test_minmax_with_members_that_are_not_listed(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 3.0), (2, 5.0), (3, 0.0), (4, 7.0)], "item int, s double")
    got = {(r["item"], r["s"]): r["s_minmax"] for r in retrieval.minmax(rows, "item", ["s"], 2).collect()}
    assert got == {(1, 2.0): 0.0, (1, 4.0): 1.0, (2, 3.0): 0.0, (2, 5.0): 1.0, (3, 0.0): 0.0, (4, 7.0): 1.0}
    assert {r["s_minmax"] for r in retrieval.minmax(rows.filter("item = 1"), "item", ["s"], 3).collect()} == {0.5, 1.0}


def test_queries_of_the_index_are_compiled(spark, tmp_path, capfd):
    texts = [("Some title of it", "The runners were running and studies of tested things " * 5)] * 3
    p = spark.createDataFrame([(i, None, t, b) for i, (t, b) in enumerate(texts)], "pid long, ts timestamp, title string, chunk string")
    x = index.build(p, str(tmp_path), "stemmed")
    q = spark.createDataFrame([(1, "tested runner of studies")], "item_id long, question string")
    assert retrieval.lexical_scores(x, q).count() == 3
    assert "Whole-stage codegen disabled" not in capfd.readouterr().err


def test_columns_by_first_name(spark):
    df = spark.createDataFrame([(1, "t")], "page_id int, snapshot string")
    assert df.select(retrieval.column_of(df, "timestamp", "snapshot").alias("a"), retrieval.column_of(df, "title").alias("b")).first() == ("t", "")


def test_linkage_of_many_alike(spark):
    """Rows that ask the same are looked up once, and facts that a question may be about are not met by each peer one by one."""
    from tidemark.operators import evidence

    day = "timestamp'2024-01-01'"
    fact = lambda i, o: f"(bigint({i}), 'f{i}', 'X', 'chair', '{o}', {day}, cast(null as timestamp))"
    facts = [fact(i, "") for i in range(40)] + [fact(i, f"P {i % 3}") for i in range(40, 61)]
    f = spark.sql(f"SELECT * FROM VALUES {', '.join(facts)} AS t(row, fact_id, subject, property, object, start_ts, end_ts)")
    made = evidence.entries(f, {"chair": {"binary": ("Is {object} chair of {subject}?", "yes")}}, {"chair": [("absence", "Has {subject} no chair?", "no")]})
    ask = lambda i, q, a, end="cast(null as timestamp)": f"(bigint({i}), '{q}', '{a}', {day}, {end})"
    asked = [ask(i, "has X no  chair?", "Yes.") for i in range(50)] + [ask(i, "Is P 1 chair of X?", "No") for i in range(50, 55)] + [ask(60, "?", "a")] * 3 + [ask(61, "Is P 9 chair of X?", "no")]
    asked += [ask(70, "Has X no chair?", "no"), ask(70, "?", "a"), ask(71, "Has X no chair?", "yes", "timestamp'2023-01-01'")]
    q = spark.sql(f"SELECT * FROM VALUES {', '.join(asked)} AS t(row, question, answer, start_ts, end_ts)")
    got = [tuple(r) for r in evidence.link(q, made, f).collect()]
    want = [(i, "absence_yes_competing", f"f{k}", "competing_present_fact") for i in range(50) for k in range(40, 61)]
    want += [(i, "binary_no_competing", f"f{k}", "competing_current_fact") for i in range(50, 55) for k in [*range(40), *(k for k in range(40, 61) if k % 3 != 1)]]
    want += [(60, "unmapped", None, None)] * 3 + [(61, "unmapped", None, None)] + [(70, "direct", f"f{k}", "direct") for k in range(40)] + [(71, "absence_yes_unmapped", None, None)]
    key = lambda rows: sorted(rows, key=str)
    assert key(got) == key(want)
    counts = {r["status"]: (r["questions"], r["facts"]) for r in evidence.coverage(q, made, f).collect()}
    assert counts == {s: (len({r[0] for r in got if r[1] == s}), sum(r[1] == s and r[2] is not None for r in got)) for s in {r[1] for r in got}}
    assert evidence.asked_once(q)[0].select("row").distinct().count() == 6
