"""Operators without SQL against brute force: matching, detectors, clusters, generators, reports."""

import math
import random
from collections import Counter
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import contexts, detector, distances, families, generation, probe, reports, temporal

SF = "/root/testdata/sf0.001"
_PEOPLE = "id long, transition int, relation int, style int, risk double"


def greedy(cases, controls, limit):
    """The nearest free control of each case in order of id, then the riskiest of the rest."""
    free, out = {c[0]: c for c in controls}, []
    for case in sorted(cases):
        if len(out) == limit or not free:
            break
        cost = lambda c: (round(10 * (c[1] != case[1]) + 3 * (c[2] != case[2]) + (c[3] != case[3]) + abs(c[4] - case[4]), 9), c[0])  # noqa: B023, E731
        best = min(free.values(), key=cost)
        out.append((case[0], best[0]))
        del free[best[0]]
    rest = sorted(free.values(), key=lambda c: (-c[4], c[0]))[: limit - len(out)]
    return out + [(None, c[0]) for c in rest]


@pytest.mark.parametrize("n_cases, n_controls, limit", [(5, 40, 5), (12, 10, 12), (12, 40, 7), (3, 30, 20), (4, 2, 9)])
def test_matching_is_greedy(spark, n_cases, n_controls, limit):
    rng = random.Random(n_cases * 100 + limit)
    row = lambda i: (i, rng.randrange(3), rng.randrange(3), rng.randrange(2), round(rng.random(), 1))
    cases, controls = [row(i) for i in range(n_cases)], [row(100 + i) for i in range(n_controls)]
    got = probe.match_controls(spark.createDataFrame(cases, _PEOPLE), spark.createDataFrame(controls, _PEOPLE), limit).collect()
    assert sorted(((r["case_id"], r["control_id"]) for r in got), key=str) == sorted(greedy(cases, controls, limit), key=str)


def test_matched_controls_query(spark):
    s = pd.read_parquet(f"{SF}/supplier.parquet")
    people = [(int(k), int(n % 4), int(k % 5), int(k % 2), round(b / 10000, 4)) for k, n, b in zip(s.s_suppkey, s.s_nationkey, s.s_acctbal)]
    want = greedy([p for p in people if p[4] > 0.8], [p for p in people if p[4] <= 0.8], 200)
    got = [(r["case_id"], r["control_id"]) for r in catalog.QUERIES["matched_controls"](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rank_gaussian_query(spark):
    rows = detector_rows(spark)
    ref = sorted(s for _, _, s, split in rows if split == "t0")
    want = {i: NormalDist().inv_cdf(min(max((sum(x <= s for x in ref) - 0.5) / len(ref), 1e-4), 1 - 1e-4)) for i, _, s, split in rows if split == "future"}
    got = {r["doc_id"]: r["rank_gaussian"] for r in catalog.QUERIES["rank_gaussian"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def detector_rows(spark):
    from tidemark.plans.views import scored_labels

    return [(r["doc_id"], r["y"], r["score"], r["split"]) for r in scored_labels(spark, SF).collect()]


def logistic(x, y, ridge, weight=None, steps=200):
    """Newton's fit of a logistic model with an unpenalised bias, features as they are."""
    a = np.column_stack([x, np.ones(len(x))])
    w, weight = np.zeros(a.shape[1]), np.ones(len(y)) if weight is None else weight
    weight = weight / weight.sum()
    pen = np.diag([ridge] * x.shape[1] + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + pen + 1e-12 * np.eye(len(w)), a.T @ (weight * (p - y)) + pen @ w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return lambda z: 1 / (1 + np.exp(-np.column_stack([z, np.ones(len(z))]) @ w))


def test_logistic_detector_query(spark):
    rows = detector_rows(spark)
    got = {r["doc_id"]: r for r in catalog.QUERIES["logistic_detector"](spark, SF).collect()}
    assert set(got) == {i for i, *_ in rows}
    fold = lambda i: got[i]["fold"]
    for k in range(3):
        train, test = ([r for r in rows if (fold(r[0]) == k) == held] for held in (False, True))
        x = lambda rs: np.array([[10 * s, 100 * s * s] for _, _, s, _ in rs])
        p = logistic(x(train), np.array([y for _, y, _, _ in train], float), 0.001)(x(test))
        assert [got[r[0]]["probability"] for r in test] == pytest.approx(p.tolist(), abs=0.01)
    assert max(Counter((r["y"], r["fold"]) for r in got.values()).values()) - min(Counter((r["y"], r["fold"]) for r in got.values()).values()) < len(rows)


def linkage(x, similarity):
    """Average linkage by merging the closest pair of sets, distances from single rows."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    sets = [[i] for i in range(len(x))]
    while len(sets) > 1:
        far, i, j = min((np.mean([d[p, q] for p in sets[i] for q in sets[j]]), i, j) for i in range(len(sets)) for j in range(i))
        if far >= 1 - similarity:
            break
        sets[j] += sets.pop(i)
    return {frozenset(s) for s in sets}


def test_cluster_queries(spark):
    """Average linkage of every question, and the divergence of its clusters' shares."""
    rows = catalog.QUERIES["agglomerative_clusters"](spark, SF).collect()
    vecs = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    js = {r["question_id"]: r["cluster_js"] for r in catalog.QUERIES["cluster_js"](spark, SF).collect()}
    for q in {r["question_id"] for r in rows}:
        mine = sorted((r for r in rows if r["question_id"] == q), key=lambda r: r["vec_id"])
        sets = linkage(np.stack([vecs[r["vec_id"]] for r in mine]), 0.3)
        by = {}
        for i, r in enumerate(mine):
            by.setdefault(r["cluster"], set()).add(i)
        assert {frozenset(s) for s in by.values()} == sets
        p, n = ([sum(mine[i]["condition"] == c for i in s) / max(sum(r["condition"] == c for r in mine), 1e-12) for s in sets] for c in ("stale_only", "current_only"))
        m = [(a + b) / 2 for a, b in zip(p, n)]
        half = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0) / 2  # noqa: B023, E731
        assert js[q] == pytest.approx(half(p) + half(n), abs=1e-5)


def test_density_clusters_find_groups_and_noise():
    rng = np.random.default_rng(4)
    centres = np.eye(8)[:3] * 5
    x = np.concatenate([c + rng.normal(scale=0.15, size=(15, 8)) for c in centres] + [rng.normal(size=(4, 8))])
    labels = distances.density_clusters(x, 5)
    for g in range(3):
        assert len(set(labels[15 * g : 15 * g + 15]) - {-1}) == 1
    assert len({labels[0], labels[15], labels[30]}) == 3 and (labels[45:] == -1).any()
    apart = distances.noise_apart(labels)
    assert (apart >= 0).all() and len(set(apart)) == 3 + (labels < 0).sum()
    assert (distances.density_clusters(x[:6], 5) == -1).all()


def test_equivalence_is_closed_over_chains(spark):
    rows = [(1, i, t) for i, t in enumerate(["a", "ab", "b", "z"])] + [(2, 0, "a")]
    df = spark.createDataFrame(rows, "q int, i long, t string")
    got = distances.equivalence_clusters(df, ["q"], "i", "t", lambda x, y: x.contains(y) | y.contains(x)).collect()
    assert sorted((r["q"], r["i"], r["component"]) for r in got) == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 3), (2, 0, 0)]


def test_positions_quantiles_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v long")
    assert [r["id"] for r in detector.numbered(df, "id").orderBy("pos").collect()] == list(range(400))
    q = detector.quantiles(df, "v", [0.1, 0.25, 0.5, 0.99]).first()
    assert list(q) == pytest.approx(np.quantile([v for _, v in rows], [0.1, 0.25, 0.5, 0.99]).tolist())


def test_rolling_sums_of_everybody(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(1000), rng.randrange(9)) for i in range(200)]
    got = temporal.rolling_all(spark.createDataFrame(rows, "id long, t long, n long"), "t", {"s": F.col("n")}, 60).collect()
    assert {r["id"]: r["s"] for r in got} == {i: sum(n for _, u, n in rows if t - 60 < u <= t) for i, t, _ in rows}


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(160, 2))
    y = (x[:, 0] ** 2 + x[:, 1] ** 2 > 1.4).astype(int)
    return spark.createDataFrame([(i, int(v), float(a), float(b)) for i, (v, (a, b)) in enumerate(zip(y, x))], "doc_id long, y int, f1 double, f2 double").cache()


def test_families_learn_what_they_can(separable):
    """A circle is beyond a line and within reach of all that bend."""
    aucs = {}
    for name, f in families.families(["f1", "f2"], 160).items():
        scored = families.predict(f, families.fit(f, separable, **f.settings()[-1]), separable)
        assert scored.filter("score < 0 or score > 1").count() == 0
        aucs[name] = detector.metrics_by(scored.withColumn("one", F.lit(1)), ["one"]).first()["auroc"]
    assert len(aucs) == 10 and aucs["l2_logistic"] < 0.75
    assert all(aucs[n] > 0.9 for n in ("quadratic_logistic", "additive_gam", "rbf_svm", "gaussian_process", "hist_gradient_boosting", "xgboost"))


def test_nested_scores_and_frozen_models(spark, separable, tmp_path):
    f = families.families(["f1", "f2"], 160)["quadratic_logistic"]
    scores, chosen = families.nested_oof(f, separable, folds=2, inner=2)
    rows = scores.collect()
    assert len(rows) == 160 == len({r["doc_id"] for r in rows}) and len(chosen) == 2 and all(c["c"] in f.grid["c"] for c in chosen)
    model = families.fit(f, separable, c=1.0)
    families.freeze(spark, model, 0.4, {"f1": [0.0, 1.0]}, str(tmp_path))
    again, threshold, refs = families.thaw(spark, str(tmp_path))
    key = lambda m: [round(r["score"], 9) for r in families.predict(f, m, separable).orderBy("doc_id").collect()]
    assert key(again) == key(model) and (threshold, refs) == (0.4, {"f1": [0.0, 1.0]})
    (tmp_path / "detector.json").write_text("{}")
    with pytest.raises(ValueError, match="detector.json"):
        families.thaw(spark, str(tmp_path))


def test_metrics_of_groups(spark):
    rng = random.Random(3)
    rows = [(g, int(rng.random() < 0.4), round(rng.random(), 2)) for g in range(2) for _ in range(60)]
    got = {r["g"]: r for r in detector.metrics_by(spark.createDataFrame(rows, "g int, y int, score double"), ["g"]).collect()}
    for g in range(2):
        mine = [(y, s) for h, y, s in rows if h == g]
        pos, neg = [s for y, s in mine if y], [s for y, s in mine if not y]
        assert got[g]["auroc"] == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))
        f1 = {t: 2 * sum(y for y, s in mine if s >= t) / (sum(s >= t for _, s in mine) + len(pos)) for _, t in mine}
        assert got[g]["f1"] == pytest.approx(max(f1.values()))


def test_class_guard_and_comparisons(spark):
    rows = spark.createDataFrame([(1,), (0,), (0,)], "y int")
    assert contexts.require_classes(rows, "y", 1) is rows
    with pytest.raises(ValueError, match="1 positive"):
        contexts.require_classes(rows, "y", 2)
    assert contexts.comparisons(["mixed", "current_only", "stale_only", "other"])[0] == ("current_only", "stale_only")
    assert contexts.comparisons(["stale_100", "stale_0", "stale_25"]) == [("stale_0", "stale_25"), ("stale_0", "stale_100")]
    assert contexts.comparisons(["b", "a"]) == [("a", "b")] and contexts.comparisons(["a"], [("x", "y")]) == [("x", "y")]


def test_generators(spark):
    jobs = spark.createDataFrame([(1, "q?", "line\nlast line ", 5), (2, "bad", None, None), (3, "slow", " ", 7)], "id int, question string, context string, sample_seed long")
    assert [r["answer"] for r in generation.generate(jobs, "mock").orderBy("id").collect()][0] == "Mock answer for: q? | last line"
    same = jobs.select("id", generation.mock_answer(F.col("question"), F.coalesce("context", F.lit(""))).alias("a")).orderBy("id").collect()
    assert [r["a"] for r in same] == [r["answer"] for r in generation.generate(jobs, "mock").orderBy("id").collect()]

    def flaky(settings):
        calls = Counter()

        def answer(question, context, seed):
            from tidemark.operators.generation import Permanent

            calls[question] += 1
            if question == "bad":
                raise Permanent("no such model")
            if question == "slow" and calls[question] < 3:
                raise OSError("busy")
            return f"{question} {seed}"

        return answer

    got = {r["id"]: (r["answer"], r["error"], r["attempts"]) for r in generation.generate(jobs.coalesce(1), "", wait=0.0, make=flaky).collect()}
    assert got == {1: ("q? 5", None, 1), 2: ("", "no such model", 1), 3: ("slow 7", None, 3)}
    with pytest.raises(ValueError):
        generation.build("nothing")
    fields = generation.request_fields("m", [], 3, 50, extra={"use_max_completion_tokens": True, "omit_seed": True, "reasoning_effort": "low"})
    assert fields["max_completion_tokens"] == 50 and "seed" not in fields and "max_tokens" not in fields and fields["reasoning_effort"] == "low"


def test_pairs_are_scored_once(spark):
    import os
    import tempfile

    log = os.path.join(tempfile.mkdtemp(), "log")

    def scorer(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        with open(log, "a") as f:
            f.write("x" * len(a))
        return pd.DataFrame({"entailment": (a == b).astype(float), "contradiction": 0.0, "neutral": 0.0})

    rows = spark.createDataFrame([("a", "a")] * 5 + [("a", "b")] * 3, "p string, h string")
    got = Counter(r["scores"]["entailment"] for r in generation.scored_pairs(rows, "p", "h", scorer).collect())
    assert got == {1.0: 5, 0.0: 3} and len(open(log).read()) == 2


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.0, 0.1), ("a", 1.0, None)], "name string, v double, e double")
    text = reports.write_report(tmp_path / "r.md", "Title", [("Part", df, ["name"])])
    assert text.splitlines()[4:8] == ["| name | v | e |", "|-|-|-|", "| a | 1.0000 |  |", "| b | 2.0000 | 0.1000 |"]
    assert reports.bars(df, "name", "v", "e").count("<rect") == 2
    with pytest.raises(ValueError):
        reports.markdown_table(spark.range(1001), ["id"])


def vectors_of(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    return {(q, side): np.array([r["embedding"] for r in sorted(rows, key=lambda r: r["vec_id"]) if r["label"] == q and (r["vec_id"] % 2 == 0) == (side == "stale_only")], float) for q in {r["label"] for r in rows} for side in ("stale_only", "current_only")}


def test_volume_and_sliced_distance_queries(spark):
    """Volumes from eigenvalues of the Gram matrix; sliced distances from quantile functions of each projection."""
    cells = vectors_of(spark)
    for r in catalog.QUERIES["semantic_volume"](spark, SF).collect():
        x = cells[r["question_id"], r["condition"]]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        c = u - u.mean(0)
        w = np.sort(np.linalg.eigvalsh(c @ c.T))[::-1][: min(10, len(x) - 1, x.shape[1])]
        assert r["volume"] == pytest.approx(np.log(np.maximum(w, 0) + 1e-10).sum(), abs=1e-3)
    for r in catalog.QUERIES["sliced_wasserstein"](spark, SF).collect():
        a, b = cells[r["question_id"], "stale_only"], cells[r["question_id"], "current_only"]
        rng = np.random.default_rng(42)
        total = []
        for d in rng.normal(size=(128, a.shape[1])):
            d = d / (np.linalg.norm(d) + 1e-12)
            n = max(len(a), len(b))
            total.append(np.mean([abs(np.quantile(a @ d, k / (n - 1)) - np.quantile(b @ d, k / (n - 1))) for k in range(n)]))
        assert r["swd"] == pytest.approx(np.mean(total), abs=1e-5)


def test_projection_query(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r["vec_id"])
    x = np.array([r["embedding"] for r in rows], float)
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = {r["vec_id"]: (r["x"], r["y"]) for r in catalog.QUERIES["projection_2d"](spark, SF).collect()}
    for k in (0, 1):
        want = x @ (v[k] * np.sign(v[k][abs(v[k]).argmax()]))
        assert [got[r["vec_id"]][k] for r in rows] == pytest.approx(want.tolist(), abs=1e-3)


def test_rouge_query(spark):
    import re
    import string

    c = pd.read_parquet(f"{SF}/conversations.parquet")
    text = {(a, b): t for a, b, t in zip(c.conv_id, c.turn, c.text)}
    tokens = lambda t: re.sub(f"[{re.escape(string.punctuation)}]", "", t.lower()).split()

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            row, old = [0], row
            for j, b in enumerate(y):
                row.append(old[j] + 1 if a == b else max(old[j + 1], row[j]))
        return row[-1]

    got = {(r["conv_id"], r["turn"]): r["rouge_l"] for r in catalog.QUERIES["rouge_l_pairs"](spark, SF).collect()}
    assert len(got) > 10
    for (conv, turn), score in got.items():
        x, y = tokens(text[conv, turn + 1]), tokens(text[conv, turn])
        assert score == pytest.approx(2 * lcs(x, y) / (len(x) + len(y)) if x and y else 0.0, abs=1e-5)


def test_accuracy_fields_query(spark):
    """All fields of the whole query, from tokens and a table of common subsequences."""
    from tidemark.functions import text
    from tidemark.plans.views import answer_pairs

    pairs = answer_pairs(spark, SF).select("conv_id", "turn", text.normalize(F.col("answer")).alias("a"), text.normalize(F.col("reference")).alias("r")).collect()
    got = {(r["conv_id"], r["turn"]): r for r in catalog.QUERIES["accuracy_fields"](spark, SF).collect()}
    assert len(got) == len(pairs) > 20
    for p in pairs:
        x, y = p["a"].split(), p["r"].split()
        row = [0] * (len(y) + 1)
        for t in x:
            before = row[:]
            for j, u in enumerate(y):
                row[j + 1] = before[j] + 1 if t == u else max(before[j + 1], row[j])
        common = sum(min(x.count(t), y.count(t)) for t in set(x))
        size = len(x) + len(y)
        f1, rouge = (2 * n / size if size and x and y else 0.0 for n in (common, row[-1]))
        exact = bool(p["r"]) and p["a"] == p["r"]
        sub = bool(p["a"]) and bool(p["r"]) and (p["a"] in p["r"] or p["r"] in p["a"])
        g = got[p["conv_id"], p["turn"]]
        assert (g["exact_match"], g["substring_match"], g["correct"]) == (int(exact), int(sub), int(exact or sub or f1 >= 0.75))
        assert (g["token_f1"], g["rouge_l"]) == (pytest.approx(f1, abs=1e-6), pytest.approx(rouge, abs=1e-6))


def test_families_of_null_texts_and_labels(spark, tmp_path):
    """A null text is an empty one, and a document without a label is left out; a family needs its scores only once."""
    docs = [(i, None if i % 9 == 0 else f"{'a1 ' * (i % 7)} words {i}", "en", "s", 1) for i in range(80)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, None if i % 10 == 7 else int(i % 7 > 2), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = catalog.QUERIES["detector_families"](spark, str(tmp_path)).collect()
    assert len(rows) == 10 and all(0 <= r["auroc"] <= 1 for r in rows)
