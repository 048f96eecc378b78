"""Queries of detector families and of run frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import detector as dt
from tidemark.operators import drift as dr
from tidemark.operators import families as fm
from tidemark.plans.detection import _AUC, _METRIC, _OUT, _rounded
from tidemark.plans.views import QUESTION_METRICS, SCORED_LABELS, question_metrics, scored_labels, table
from tidemark.shared import written

_DISTANCES = """distances AS (SELECT l_suppkey AS question_id, CASE l_linenumber % 3 WHEN 0 THEN 'current_only__vs__mixed' WHEN 1 THEN 'current_only__vs__stale_only' ELSE 'mixed__vs__stale_only' END AS comparison, round(avg(l_tax) * 10, 6) AS energy, round(avg(l_discount) * 10, 6) AS mmd FROM lineitem GROUP BY 1, 2)"""


def _distances(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    n = F.col("l_linenumber") % 3
    c = F.when(n == 0, "current_only__vs__mixed").when(n == 1, "current_only__vs__stale_only").otherwise("mixed__vs__stale_only")
    return l.groupBy(F.col("l_suppkey").alias("question_id"), c.alias("comparison")).agg(F.round(F.avg("l_tax") * 10, 6).alias("energy"), F.round(F.avg("l_discount") * 10, 6).alias("mmd"))


@query(f"""WITH {QUESTION_METRICS}, {_DISTANCES}, w AS (SELECT question_id, first(accuracy) FILTER (WHERE condition = 'stale_only') AS a_old, first(accuracy) FILTER (WHERE condition = 'current_only') AS a_new, first(semantic_entropy) FILTER (WHERE condition = 'stale_only') AS e_old, first(semantic_entropy) FILTER (WHERE condition = 'current_only') AS e_new,
    first(semantic_volume) FILTER (WHERE condition = 'stale_only') AS v_old, first(semantic_volume) FILTER (WHERE condition = 'current_only') AS v_new FROM question_metrics GROUP BY 1), m AS (SELECT s_suppkey AS question_id, CASE WHEN s_acctbal < 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'changed' ELSE 'stable' END AS change_label FROM supplier)
  SELECT w.question_id, energy, mmd, a_old AS accuracy_stale, a_new AS accuracy_current, round(a_old - a_new, 6) AS accuracy_drop, round(e_new - e_old, 6) AS delta_entropy, round(v_new - v_old, 6) AS delta_volume, CAST(NOT (a_old < 0.32 AND a_new < 0.32) AND round(a_old - a_new, 9) >= 0.02 AS INTEGER) AS target, coalesce(change_label, 'none') AS change_label
  FROM distances d JOIN w ON w.question_id = d.question_id LEFT JOIN m ON m.question_id = w.question_id WHERE comparison = 'current_only__vs__stale_only'""")
def run_frame(spark, sf):
    """Distances, metrics of both snapshots side by side, metadata and the target of each question of a run."""
    meta = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("question_id"), F.when(F.col("s_acctbal") < 0, None).when(F.col("s_suppkey") % 3 == 0, "changed").otherwise("stable").alias("change_label"))
    f = dr.run_frame(question_metrics(spark, sf), _distances(spark, sf), meta, drop=0.02, failure=0.32)
    r = lambda c: F.round(c, 6).alias(c)
    return f.select("question_id", "energy", "mmd", "accuracy_stale", "accuracy_current", r("accuracy_drop"), r("delta_entropy"), r("delta_volume"), "target", F.coalesce("change_label", F.lit("none")).alias("change_label"))


@query(f"""WITH {_DISTANCES}, a AS (SELECT question_id, energy AS e FROM distances WHERE comparison = 'current_only__vs__mixed'), b AS (SELECT question_id, energy AS e FROM distances WHERE comparison = 'current_only__vs__stale_only'), c AS (SELECT question_id, energy AS e FROM distances WHERE comparison = 'mixed__vs__stale_only')
  SELECT coalesce(a.question_id, b.question_id, c.question_id) AS question_id, coalesce(a.e, -1.0) AS energy_current_mixed, coalesce(b.e, -1.0) AS energy_current_stale, coalesce(c.e, -1.0) AS energy_mixed_stale FROM a FULL JOIN b ON a.question_id = b.question_id FULL JOIN c ON c.question_id = coalesce(a.question_id, b.question_id)""")
def distances_wide(spark, sf):
    """The distances of all comparisons side by side (-1 where one is missing): one pivot in place of a chain of outer joins."""
    names = {"current_only__vs__mixed": "energy_current_mixed", "current_only__vs__stale_only": "energy_current_stale", "mixed__vs__stale_only": "energy_mixed_stale"}
    d = _distances(spark, sf).groupBy("question_id").pivot("comparison", list(names)).agg(F.first("energy"))
    return d.select("question_id", *(F.coalesce(c, F.lit(-1.0)).alias(n) for c, n in names.items()))


@query(f"""WITH {QUESTION_METRICS} SELECT question_id, max(accuracy) FILTER (WHERE condition = 'current_only') AS current_only, max(accuracy) FILTER (WHERE condition = 'mixed') AS mixed, max(accuracy) FILTER (WHERE condition = 'stale_only') AS stale_only FROM question_metrics GROUP BY 1""")
def pivot_strict(spark, sf):
    """Metrics by condition side by side; a question with two rows of one condition fails."""
    return dr.pivot_strict(question_metrics(spark, sf), "question_id", "condition", "accuracy", ["current_only", "mixed", "stale_only"])


@query(f"""WITH {_DISTANCES} SELECT comparison, CAST(count(*) AS BIGINT) AS n, round(avg(energy), 6) AS mean, round(quantile_cont(energy, 0.5), 6) AS median, round(stddev_pop(energy), 6) AS sd FROM distances GROUP BY 1""")
def shift_summary(spark, sf):
    """Mean, median and population deviation of each comparison's distances."""
    return dr.shift_summary(_distances(spark, sf), "comparison", "energy").select("comparison", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "sd")))


_TRANS = f"""{SCORED_LABELS}, scored2 AS (SELECT doc_id, y, score, doc_id % 4 AS transition, CASE WHEN doc_id % 2 = 0 THEN 'seen' ELSE 'new' END AS cohort FROM scored)"""


@query(f"""WITH {_TRANS}, h AS (SELECT *, score >= 0.03 AS hit FROM scored2), c AS ({_METRIC.format(k='cohort, transition,', t='h', g='GROUP BY cohort, transition')}),
  s AS (SELECT cohort, transition, score, sum(y) AS p, sum(1 - y) AS m FROM scored2 GROUP BY 1, 2, 3), u AS (SELECT *, sum(p) OVER w AS tp, sum(m) OVER w AS fp, sum(p) OVER (PARTITION BY cohort, transition) AS pos, sum(m) OVER (PARTITION BY cohort, transition) AS negs FROM s WINDOW w AS (PARTITION BY cohort, transition ORDER BY score DESC)),
  a AS (SELECT cohort, transition, round(sum(m * (tp - p) + 0.5 * m * p) / nullif(any_value(pos) * any_value(negs), 0), 6) AS auroc FROM u GROUP BY 1, 2)
  SELECT c.cohort, c.transition, {_OUT}, auroc FROM c JOIN a ON a.cohort = c.cohort AND a.transition = c.transition""")
def transition_metrics(spark, sf):
    """Confusion metrics and AUROC of each cohort and transition."""
    rows = scored_labels(spark, sf).select("doc_id", "y", "score", (F.col("doc_id") % 4).alias("transition"), F.when(F.col("doc_id") % 2 == 0, "seen").otherwise("new").alias("cohort"))
    keys = ["cohort", "transition"]
    c = dt.confusion(rows, 0.03, keys).join(dt.auroc_by(rows, keys), keys)
    return c.select(*keys, "tp", "fp", "fn", "tn", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "risk_lift", "auroc")))


@query(f"""WITH {SCORED_LABELS.replace('score,', 'score,')}, t0 AS (SELECT * FROM scored WHERE split = 't0'), cand AS (SELECT DISTINCT t FROM (SELECT score AS t FROM t0 UNION ALL SELECT 0.0 UNION ALL SELECT 1.0)), e AS (SELECT t, sum(CASE WHEN score >= t THEN y ELSE 0 END) AS tp, sum(CASE WHEN score >= t THEN 1 - y ELSE 0 END) AS fp, sum(y) AS pos FROM cand, t0 GROUP BY 1),
  best AS (SELECT t FROM e ORDER BY round(coalesce(2.0 * tp / nullif(tp + fp + pos, 0), 0.0), 12) DESC, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 12) DESC, t DESC LIMIT 1), h AS (SELECT s.*, score >= t AS hit, 1 AS one FROM scored s, best WHERE split = 'future'), k AS ({_METRIC.format(k='', t='h', g='')}),
  {_AUC.replace('scored', "(SELECT * FROM scored WHERE split = 'future')")} SELECT 'score' AS baseline, {_OUT}, (SELECT round(sum(m * (tp - p) + 0.5 * m * p) / (any_value(pos) * any_value(negs)), 6) FROM u) AS auroc FROM k""")
def score_baseline(spark, sf):
    """A single score as detector: its threshold from the first update, its metrics on later ones."""
    s = scored_labels(spark, sf)
    t0, future = s.filter("split = 't0'"), s.filter("split = 'future'")
    cut = dt.best_f1(t0).select(F.col("threshold").alias("cut"))
    c = dt.confusion(future.crossJoin(F.broadcast(cut)), F.col("cut"))
    return _rounded(c.crossJoin(F.broadcast(dt.auroc_ap(future).select("auroc"))).withColumns({"baseline": F.lit("score"), "auroc": F.round("auroc", 6)}), ["baseline", "auroc"])


_FEATURES = ["f1", "f2", "f3", "f4"]


def _core(spark, sf):
    """Four scores of a document in robust units (null text: empty), its label and its update; documents without a label are left out."""
    d = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    n = F.greatest(F.length("text"), F.lit(1))
    share = lambda p: F.length(F.regexp_replace("text", p, "")) / n
    f = d.select("doc_id", *(F.round(x, 6).alias(f"f{i + 1}") for i, x in enumerate((share("[a-z ]") * 20 - 1, share("[^0-9]") * 50, F.log(n) - 6, share("[^aeiou]") * 10 - 3))))
    lab = table(spark, sf, "labels").filter("quality is not null").select("doc_id", (1 - F.col("quality")).cast("int").alias("y"))
    return lab.join(f, "doc_id").withColumn("split", F.when(F.col("doc_id") % 2 == 0, "t0").otherwise("future"))


@query()
def detector_families(spark, sf):
    """Every family fitted on the first update with its first settings, its threshold chosen there, and its metrics on later updates."""
    rows = written(_core(spark, sf))
    t0, future = rows.filter("split = 't0'"), rows.filter("split = 'future'")
    seen = unseen = None
    for name, family in fm.families(_FEATURES, t0.count()).items():
        model = fm.fit(family, t0, **family.settings()[0])
        a, b = (fm.predict(family, model, part).select(F.lit(name).alias("model"), "y", F.round("score", 4).alias("score")) for part in (t0, future))
        seen, unseen = (a, b) if seen is None else (seen.unionByName(a), unseen.unionByName(b))
    # each family scores once, and what reads the scores does not carry the plans of all of them
    seen, unseen = written(seen), written(unseen)
    cuts = dt.metrics_by(seen, ["model"]).select("model", F.col("threshold").alias("cut"))
    at_cut = dt.confusion(unseen.join(F.broadcast(cuts), "model"), F.col("cut"), ["model"])
    ranks = dt.metrics_by(unseen, ["model"]).select("model", "auroc", "auprc")
    return at_cut.join(ranks, "model").select("model", *(F.round(c, 6).alias(c) for c in ("auroc", "auprc", "precision", "recall", "f1")))


@query()
def detector_oof(spark, sf):
    """Out-of-fold risk of the quadratic family, its settings chosen inside each training part."""
    rows = _core(spark, sf).filter("split = 't0'").select("doc_id", "y", *_FEATURES).cache()
    family = fm.families(_FEATURES, 200)["quadratic_logistic"]
    scores, _ = fm.nested_oof(family, rows, folds=2, inner=2)
    return scores.select("doc_id", "y", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT conv_id, turn, role, text FROM conversations), g AS (SELECT *, CASE WHEN turn % 5 = 0 THEN '  ' ELSE role || chr(10) || text || chr(10) END AS x FROM c), l AS (SELECT *, string_split(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), chr(10))[-1] AS last FROM g)
  SELECT conv_id, turn, md5('Mock answer for: ' || role || ' | ' || left(coalesce(nullif(last, ''), 'insufficient context'), 160)) AS answer_md5 FROM l""")
def mock_answers(spark, sf):
    """What the mock generator says to every question and context."""
    from tidemark.operators import generation as gn

    c = table(spark, sf, "conversations")
    context = F.when(F.col("turn") % 5 == 0, "  ").otherwise(F.concat("role", F.lit("\n"), "text", F.lit("\n")))
    return c.select("conv_id", "turn", F.md5(gn.mock_answer(F.col("role"), context)).alias("answer_md5"))


@query("""WITH l AS (SELECT CAST(l_quantity AS DOUBLE) AS v FROM lineitem), e AS (SELECT min(v) AS lo, max(v) AS hi FROM l), b AS (SELECT least(floor((v - lo) / ((hi - lo) / 20)), 19) AS bin, lo, hi FROM l, e) SELECT CAST(bin AS INTEGER) AS bin, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 20, 6) AS low, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY bin""")
def chart_data(spark, sf):
    """The counts behind a distribution chart."""
    from tidemark.operators import reports as rp

    h = rp.histogram(table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("v")), "v")
    return h.select("bin", F.round("low", 6).alias("low"), "n")
