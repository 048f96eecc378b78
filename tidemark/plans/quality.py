"""Queries that judge answers against reference lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import answers as an
from tidemark.functions import text as tx
from tidemark.plans.answers import _MISSING, _SUB, _contradiction_sql
from tidemark.plans.views import ANSWER_PAIRS, answer_pairs, f1, norm, table, toks

_PATTERNS = [p.removeprefix("(?i)") for p in an.ANSWER_PATTERNS]


def _found_sql(text: str) -> str:
    all_ = " || ".join(f"regexp_extract_all({text}, '{p}', 1, 'i')" for p in _PATTERNS)
    return f"list_filter(list_transform({all_}, lambda t: trim(t)), lambda t: len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) BETWEEN 1 AND 20)"


@query(f"""WITH d AS (SELECT doc_id, 'Old answer: ' || source || '. It ' || text || chr(10) || 'which was formerly ' || lang || ' or ' || CAST(doc_id AS VARCHAR) AS t FROM documents), f AS (SELECT doc_id, {_found_sql('t')} AS a FROM d)
  SELECT doc_id, CAST(len(a) AS BIGINT) AS n_found, md5(array_to_string(a, '|')) AS found_md5 FROM f""")
def answer_patterns(spark, sf):
    """Answers that whole documents introduce as such."""
    t = F.concat(F.lit("Old answer: "), "source", F.lit(". It "), "text", F.lit("\nwhich was formerly "), "lang", F.lit(" or "), F.col("doc_id").cast("string"))
    d = table(spark, sf, "documents").select("doc_id", an.answer_patterns(F.array(t)).alias("a"))
    return d.select("doc_id", F.size("a").cast("long").alias("n_found"), F.md5(F.array_join("a", "|")).alias("found_md5"))


#: Answers of the turns of a conversation: turn 1 is the gold answer, turn 2 the stale one, turns 3 and 4 an alias of each.
_TURNS = f"""c AS (SELECT * FROM conversations WHERE role <> 'system'), r AS (SELECT x.conv_id, any_value(x.text) FILTER (WHERE turn = 1) AS gold, any_value(x.text) FILTER (WHERE turn = 2) AS stale, any_value(x.text) FILTER (WHERE turn = 3) AS alias, any_value(x.text) FILTER (WHERE turn = 4) AS old FROM c x GROUP BY 1 HAVING gold IS NOT NULL AND stale IS NOT NULL),
  j AS (SELECT c.conv_id, c.turn, CASE c.role WHEN 'user' THEN 'stale_only' ELSE 'current_only' END AS condition, c.text AS answer, gold, stale, alias, old, 'Previous answer: ' || stale AS doc FROM c JOIN r ON c.conv_id = r.conv_id)"""


def _turns(spark, sf):
    c = table(spark, sf, "conversations").filter("role <> 'system'")
    of = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    r = c.groupBy("conv_id").agg(of(1).alias("gold"), of(2).alias("stale"), of(3).alias("alias"), of(4).alias("old")).filter("gold is not null and stale is not null")
    condition = F.when(F.col("role") == "user", "stale_only").otherwise("current_only")
    doc = F.concat(F.lit("Previous answer: "), F.col("stale"))
    rows = c.select("conv_id", "turn", condition.alias("condition"), F.col("text").alias("answer")).join(r, "conv_id")
    some = lambda x: F.when(F.col(x).isNull(), F.array().cast("array<string>")).otherwise(F.array(x))
    return rows.select(
        F.col("conv_id").alias("question_id"), "condition", F.col("turn").alias("sample_idx"), "answer", "gold", "stale", some("alias").alias("aliases"), some("old").alias("olds"), F.array(doc).alias("stale_docs"), F.array("gold").alias("current_docs")
    )


def _best(refs: str) -> tuple[str, str]:
    """(substring match, best F1) of na, ta against a list of normalised references."""
    hit = f"len(list_filter({refs}, lambda r: na <> '' AND (contains(na, r) OR contains(r, na)))) > 0"
    best = f"coalesce(list_max(list_transform({refs}, lambda r: {f1('ta', 'string_split(r, chr(32))')})), 0.0)"
    return hit, best


_REFS = f"""{_TURNS}, n AS (SELECT *, {norm('answer')} AS na, {norm('gold')} AS ng, {norm('stale')} AS ns FROM j), o AS (SELECT *, na AS a, {toks('na')} AS ta, {toks('ng')} AS tg, {toks('ns')} AS ts,
  list_filter([ng, {norm("coalesce(alias, '')")}], lambda x: x <> '') AS cur, list_filter([ns, {norm("coalesce(old, '')")}] || list_transform({_found_sql('doc')}, lambda t: {norm('t')}), lambda x: x <> '') AS sta FROM n),
  m AS (SELECT *, {_best('cur')[0]} AS c_in, {_best('cur')[1]} AS c_best, {_best('sta')[0]} AS s_in, {_best('sta')[1]} AS s_best FROM o)"""
_LABEL = f"""k AS (SELECT *, c_in OR c_best >= 0.75 AS c_hit, s_in OR s_best >= 0.75 AS s_hit, {_MISSING} AS missing FROM m),
  l AS (SELECT *, CASE WHEN missing THEN 'missing' WHEN c_hit AND s_hit AND ng <> ns THEN 'ambiguous' WHEN c_hit THEN 'perfect_current' WHEN s_hit THEN 'perfect_stale' ELSE 'harmful_other' END AS quality_label FROM k)"""


@query(f"WITH {_REFS} SELECT conv_id AS question_id, turn AS sample_idx, CAST(c_in OR c_best >= 0.75 AS INTEGER) AS hit, round(c_best, 6) AS best FROM m")
def reference_match(spark, sf):
    """Answers against the gold answer and its alias."""
    r = _turns(spark, sf).withColumn("m", an.reference_match(F.col("answer"), an.current_references(F.col("gold"), F.col("aliases"))))
    return r.select("question_id", "sample_idx", "m.hit", F.round("m.best", 6).alias("best"))


_SAID = norm("regexp_extract(a, '(?:^|\\n)\\s*status\\s*:\\s*([^\\n]+)', 1, 'i')")


@query(f"""WITH s AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'note' || chr(10) || 'STATUS :  ' || role || '.' WHEN 1 THEN 'Status: ' || role ELSE 'the status: ' || role END || chr(10) || text AS a, CASE WHEN conv_id % 2 = 0 THEN '{an.STATUS_MODES[0]}' WHEN conv_id % 3 = 0 THEN '{an.STATUS_MODES[1]}' ELSE 'free' END AS mode FROM conversations),
  t AS (SELECT *, {_SAID} AS said FROM s) SELECT conv_id, turn, CASE WHEN mode <> 'free' AND said <> '' AND list_contains(['user', 'assistant'], said) THEN said END AS label FROM t""")
def status_label(spark, sf):
    """The status that an answer states, where the dataset asks for one."""
    turn, role, conv = F.col("turn"), F.col("role"), F.col("conv_id")
    said = F.when(turn % 3 == 0, F.concat(F.lit("note\nSTATUS :  "), role, F.lit("."))).when(turn % 3 == 1, F.concat(F.lit("Status: "), role)).otherwise(F.concat(F.lit("the status: "), role))
    mode = F.when(conv % 2 == 0, an.STATUS_MODES[0]).when(conv % 3 == 0, an.STATUS_MODES[1]).otherwise("free")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(said, F.lit("\n"), "text").alias("a"), mode.alias("mode"))
    return c.select("conv_id", "turn", an.status_label(F.col("a"), F.col("mode"), F.array(F.lit("User"), F.lit("assistant!"))).alias("label"))


@query(f"""WITH {_REFS}, {_LABEL} SELECT conv_id AS question_id, condition, turn AS sample_idx, quality_label, CASE condition WHEN 'stale_only' THEN 'stale' ELSE 'current' END AS target_reference, CAST(NOT missing AND CASE condition WHEN 'stale_only' THEN s_hit ELSE c_hit END AS INTEGER) AS target_correct,
  CAST(NOT missing AND c_hit AS INTEGER) AS current_answer_match, CAST(NOT missing AND s_hit AS INTEGER) AS stale_answer_match, round(c_best, 6) AS current_answer_score, round(s_best, 6) AS stale_answer_best_f1 FROM l""")
def answer_classes(spark, sf):
    """Quality classes by current references with aliases and stale references with document patterns."""
    r = _turns(spark, sf)
    currents, stales = an.current_references(F.col("gold"), F.col("aliases")), an.stale_references(F.col("stale"), F.col("olds"), F.col("stale_docs"))
    c = r.withColumn("c", an.classify(F.col("answer"), F.col("condition"), F.col("gold"), F.col("stale"), currents, stales))
    return c.select(
        "question_id", "condition", "sample_idx", "c.quality_label", "c.target_reference", "c.target_correct", "c.current_answer_match", "c.stale_answer_match",
        F.round("c.current_answer_score", 6).alias("current_answer_score"), F.round("c.stale_answer_best_f1", 6).alias("stale_answer_best_f1"),
    )


_FG, _FS = f1("ta", "tg"), f1("ta", "ts")
_SAMPLES = f"""{_REFS}, {_LABEL}, f AS (SELECT *, {_FG} AS fg, {_FS} AS fs, {_contradiction_sql('na', 'ng', 'ta', 'tg')} AS clash FROM l),
  s AS (SELECT *, CASE condition WHEN 'stale_only' THEN s_hit ELSE c_hit END AND NOT missing AS correct, CASE condition WHEN 'stale_only' THEN fs ELSE fg END AS target_f1 FROM f)"""


@query(f"""WITH {_SAMPLES} SELECT conv_id AS question_id, condition, turn AS sample_idx, quality_label, CAST(correct AS INTEGER) AS target_correct, round(target_f1, 6) AS target_token_f1, round(fg, 6) AS current_token_f1, CAST(s_hit AS INTEGER) AS fuzzy_stale_answer_match,
  CAST(missing AS INTEGER) AS missing, CAST(clash AS INTEGER) AS contradiction_to_gold, round(fg, 6) AS current_alignment FROM s""")
def sample_metrics(spark, sf):
    """Flags and scores of every sampled answer."""
    s = an.sample_metrics(_turns(spark, sf))
    r = lambda c: F.round(c, 6).alias(c)
    return s.select("question_id", "condition", "sample_idx", "quality_label", "target_correct", r("target_token_f1"), r("current_token_f1"), "fuzzy_stale_answer_match", "missing", "contradiction_to_gold", r("current_alignment"))


_RATES = {"accuracy": "CAST(correct AS DOUBLE)", "current_answer_rate": "CAST(NOT missing AND c_hit AS DOUBLE)", "stale_answer_rate": "CAST(NOT missing AND s_hit AS DOUBLE)", "missing_rate": "CAST(missing AS DOUBLE)", "harmful_other_rate": "CAST(quality_label = 'harmful_other' AS DOUBLE)",
  "ambiguous_rate": "CAST(quality_label = 'ambiguous' AS DOUBLE)", "perfect_current_rate": "CAST(quality_label = 'perfect_current' AS DOUBLE)", "perfect_stale_rate": "CAST(quality_label = 'perfect_stale' AS DOUBLE)", "mean_target_token_f1": "target_f1", "gold_contradiction_rate": "CAST(clash AS DOUBLE)", "current_alignment": "fg"}


@query(f"""WITH {_SAMPLES}, g AS (SELECT conv_id, condition, count(*) AS n_samples, {', '.join(f'avg({v}) AS {k}' for k, v in _RATES.items())} FROM s GROUP BY 1, 2),
  p AS (SELECT x.conv_id, x.condition, avg(CAST({_contradiction_sql('x.na', 'y.na', 'x.ta', 'y.ta')} AS DOUBLE)) AS rate FROM s x JOIN s y ON x.conv_id = y.conv_id AND x.condition = y.condition AND x.turn < y.turn GROUP BY 1, 2)
  SELECT g.conv_id AS question_id, g.condition, n_samples, {', '.join(f'round({k}, 6) AS {k}' for k in _RATES)}, round(coalesce(rate, 0.0), 6) AS pairwise_contradiction_rate, round(greatest(coalesce(rate, 0.0), gold_contradiction_rate), 6) AS contradiction_rate FROM g LEFT JOIN p ON p.conv_id = g.conv_id AND p.condition = g.condition""")
def question_metrics(spark, sf):
    """Metrics of every question and condition."""
    q = an.question_metrics(an.sample_metrics(_turns(spark, sf)))
    return q.select("question_id", "condition", "n_samples", *(F.round(k, 6).alias(k) for k in (*_RATES, "pairwise_contradiction_rate", "contradiction_rate")))


_ENT = "least(0.99, greatest(0.01, CASE WHEN {s} THEN greatest({f}, 0.95) ELSE {f} END))"
_QA = """{ap}, q AS (SELECT *, trim('Question: ' || CAST(conv_id AS VARCHAR) || chr(10) || 'Answer: ' || answer) AS qa, trim('Question: ' || CAST(conv_id AS VARCHAR) || chr(10) || 'Answer: ' || reference) AS qb FROM pairs)"""


@query(f"""WITH {_QA.format(ap=ANSWER_PAIRS)}, n AS (SELECT *, {norm('qa')} AS na, {norm('qb')} AS nr, {norm('answer')} AS la, {norm('reference')} AS lb FROM q), t AS (SELECT *, {toks('na')} AS ta, {toks('nr')} AS tr, {toks('la')} AS tla, {toks('lb')} AS tlb FROM n),
  s AS (SELECT *, {f1('ta', 'tr')} AS f, {f1('tla', 'tlb')} AS lf FROM t), e AS (SELECT *, {_ENT.format(s=_SUB, f='f')} AS ent, (la <> '' AND lb <> '' AND (contains(la, lb) OR contains(lb, la) OR lf >= 0.92)) AS same FROM s)
  SELECT conv_id, turn, CAST(ent >= 0.5 AS INTEGER) AS entails, CAST(same OR ent >= 0.5 AS INTEGER) AS both_ways, CAST(same OR ent >= 0.5 AS INTEGER) AS one_way FROM e""")
def answer_equivalence(spark, sf):
    """Entailment of answers to one question, and both rules of equivalence."""
    p, q = answer_pairs(spark, sf), F.col("conv_id").cast("string")
    a, b = F.col("answer"), F.col("reference")
    return p.select("conv_id", "turn", an.entails(tx.entailment(an.qa_text(q, a), an.qa_text(q, b))).cast("int").alias("entails"), an.equivalent(q, a, b).cast("int").alias("both_ways"), an.equivalent(q, a, b, "non_defeating").cast("int").alias("one_way"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1:3] AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT vec_id, list_transform(x, lambda v: exp(v - list_max(x))) AS p FROM e) SELECT vec_id, round(p[1] / list_sum(p), 6) AS contradiction, round(p[2] / list_sum(p), 6) AS neutral, round(p[3] / list_sum(p), 6) AS entailment FROM p""")
def softmax_scores(spark, sf):
    """Label probabilities of three logits."""
    s = table(spark, sf, "embeddings").select("vec_id", an.softmax(F.slice("embedding", 1, 3).cast("array<double>")).alias("p"))
    at = lambda n, k: an.label_index({"CONTRADICTION".lower(): 0, "neutral": 1, "entailment": 2}, n, k, 3)
    return s.select("vec_id", *(F.round(F.col("p")[at(n, k)], 6).alias(n) for n, k in (("contradiction", 0), ("neutral", 1), ("entailment", 2))))
