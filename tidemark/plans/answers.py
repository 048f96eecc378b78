"""Queries over answer texts: normal forms, overlap scores, contradiction and quality labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import text as tx
from tidemark.operators.detector import numbered
from tidemark.operators.retrieval import ladder
from tidemark.plans.views import ANSWER_PAIRS, RESPONSES, answer_pairs, f1, norm, responses, table, toks

_PAIRS = f"""{ANSWER_PAIRS}, n AS (SELECT *, {norm('answer')} AS na, {norm('reference')} AS nr FROM pairs), t AS (SELECT *, {toks('na')} AS ta, {toks('nr')} AS tr FROM n)"""
_SUB = "(na <> '' AND nr <> '' AND (contains(na, nr) OR contains(nr, na)))"


@query(f"WITH r AS (SELECT conv_id, turn, {norm('text')} AS normal FROM conversations) SELECT conv_id, turn, normal, CAST(len({toks('normal')}) AS BIGINT) AS n_tokens FROM r")
def normalize_tokens(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tx.normalize("text").alias("normal"), F.size(tx.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, round({f1('ta', 'tr')}, 6) AS token_f1 FROM t")
def token_f1_pairs(spark, sf):
    return answer_pairs(spark, sf).select("conv_id", "turn", F.round(tx.text_f1(F.col("answer"), F.col("reference")), 6).alias("token_f1"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, CAST({_SUB} AS INTEGER) AS hit FROM t")
def substring_pairs(spark, sf):
    return answer_pairs(spark, sf).select("conv_id", "turn", tx.substring_match(F.col("answer"), F.col("reference")).cast("int").alias("hit"))


@query(f"""WITH {_PAIRS} SELECT conv_id, turn, CAST(na = nr AND nr <> '' AS INTEGER) AS exact_match, CAST({_SUB} AS INTEGER) AS substring_match, round({f1('ta', 'tr')}, 6) AS token_f1,
  CAST((na = nr AND nr <> '') OR {_SUB} OR {f1('ta', 'tr')} >= 0.75 AS INTEGER) AS correct FROM t""")
def accuracy_scores(spark, sf):
    a = answer_pairs(spark, sf).select("conv_id", "turn", tx.accuracy(F.col("answer"), F.col("reference")).alias("s"))
    return a.select("conv_id", "turn", "s.exact_match", "s.substring_match", F.round("s.token_f1", 6).alias("token_f1"), "s.correct")


@query()
def rouge_l_pairs(spark, sf):
    return answer_pairs(spark, sf).select("conv_id", "turn", F.round(tx.rouge_l(tx.tokens(F.col("answer")), tx.tokens(F.col("reference"))), 6).alias("rouge_l"))


@query()
def accuracy_fields(spark, sf):
    """All fields of the score of an answer against its reference."""
    a = tx.accuracy_of(answer_pairs(spark, sf), "answer", "reference")
    return a.select("conv_id", "turn", "correct", "exact_match", "substring_match", *(F.round(c, 6).alias(c) for c in ("token_f1", "rouge_l")))


def _contradiction_sql(a: str, b: str, ta: str, tb: str) -> str:
    yes, no = "['yes','true','correct','supported']", "['no','false','incorrect','unsupported']"
    pol = lambda t: f"CASE WHEN list_has_any({t}, {yes}) AND NOT list_has_any({t}, {no}) THEN 1 WHEN list_has_any({t}, {no}) AND NOT list_has_any({t}, {yes}) THEN 2 END"
    pairs = " OR ".join(f"(contains({a}, '{s}') AND contains({b}, '{t}')) OR (contains({a}, '{t}') AND contains({b}, '{s}'))" for s, t in tx.OPPOSITES)
    nums = lambda c: f"regexp_extract_all({c}, '\\b(\\d+(?:\\.\\d+)?)\\b', 1)"
    return f"({a} <> '' AND {b} <> '' AND (coalesce(({pol(ta)}) <> ({pol(tb)}), false) OR {pairs} OR (len({nums(a)}) > 0 AND len({nums(b)}) > 0 AND NOT list_has_any({nums(a)}, {nums(b)}) AND {f1(ta, tb)} >= 0.35)))"


@query(f"""WITH {RESPONSES}, n AS (SELECT *, {norm('answer')} AS a FROM responses), t AS (SELECT *, {toks('a')} AS ta FROM n),
  p AS (SELECT x.question_id, {_contradiction_sql('x.a', 'y.a', 'x.ta', 'y.ta')} AS hit FROM t x JOIN t y ON x.question_id = y.question_id AND x.sample_idx < y.sample_idx)
  SELECT q.question_id, CAST(count(p.hit) AS BIGINT) AS n_pairs, round(coalesce(avg(CAST(p.hit AS DOUBLE)), 0.0), 6) AS contradiction_rate
  FROM (SELECT DISTINCT question_id FROM responses) q LEFT JOIN p ON p.question_id = q.question_id GROUP BY 1""")
def contradiction_rate(spark, sf):
    r = responses(spark, sf)
    x, y = r.select("question_id", F.col("sample_idx").alias("i"), F.col("answer").alias("a")), r.select("question_id", F.col("sample_idx").alias("j"), F.col("answer").alias("b"))
    p = x.join(y, "question_id").filter("i < j").select("question_id", tx.contradicts(F.col("a"), F.col("b")).cast("double").alias("hit"))
    rates = p.groupBy("question_id").agg(F.count("*").alias("n_pairs"), F.avg("hit").alias("rate"))
    return r.select("question_id").distinct().join(rates, "question_id", "left").select("question_id", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("contradiction_rate"))


_MISSING = "(a = '' OR " + " OR ".join(f"contains(a, '{p.replace(chr(39), '')}')" for p in tx.MISSING_PATTERNS) + ")"


@query(f"""WITH {RESPONSES}, n AS (SELECT *, {norm('answer')} AS a FROM responses)
  SELECT condition, CAST(count(*) AS BIGINT) AS n, round(avg(CAST({_MISSING} AS DOUBLE)), 6) AS missing_rate FROM n GROUP BY 1""")
def missing_rate(spark, sf):
    return responses(spark, sf).groupBy("condition").agg(F.count("*").alias("n"), F.round(F.avg(tx.is_missing(F.col("answer")).cast("double")), 6).alias("missing_rate"))


_NUM = "list_distinct(list_transform(list_transform(regexp_extract_all(lower({0}), '(?:^|[^\\pL\\pN_])([+-]?\\d[\\d,]*(?:\\.\\d+)?(?:%|st|nd|rd|th)?)', 1), lambda t: regexp_replace(regexp_replace(t, '%+$', ''), '(st|nd|rd|th)$', '')), lambda t: replace(t, ',', '')))"


@query(f"""WITH d AS (SELECT item_id, text AS a, lead(text) OVER (ORDER BY item_id) AS b FROM benchmark), x AS (SELECT item_id, 'in ' || a || ' 1,5' || CAST(item_id AS VARCHAR) || '% of ' || CAST(item_id % 7 AS VARCHAR) || 'th' AS a, 'at ' || b || ' ' || CAST(item_id % 7 AS VARCHAR) || ' or ' || CAST(item_id % 5 AS VARCHAR) || '.5' AS b FROM d WHERE b IS NOT NULL),
  n AS (SELECT item_id, {_NUM.format('a')} AS p, {_NUM.format('b')} AS q FROM x)
  SELECT item_id, CAST(len(list_filter(p, lambda e: NOT list_contains(q, e))) > 0 AND len(list_filter(q, lambda e: NOT list_contains(p, e))) > 0 AS INTEGER) AS mismatch, CAST(len(p) AS BIGINT) AS n_left FROM n""")
def numbers_mismatch(spark, sf):
    d = numbered(table(spark, sf, "benchmark"), "item_id")
    after = d.select((F.col("pos") - 1).alias("pos"), F.col("text").alias("b"))
    d = d.join(after, "pos").select("item_id", F.col("text").alias("a"), "b")
    item = F.col("item_id")
    a = F.concat(F.lit("in "), "a", F.lit(" 1,5"), item.cast("string"), F.lit("% of "), (item % 7).cast("string"), F.lit("th"))
    b = F.concat(F.lit("at "), "b", F.lit(" "), (item % 7).cast("string"), F.lit(" or "), (item % 5).cast("string"), F.lit(".5"))
    return d.select("item_id", a.alias("a"), b.alias("b")).select("item_id", tx.numbers_disagree(F.col("a"), F.col("b")).cast("int").alias("mismatch"), F.size(tx.numbers(F.col("a"))).cast("long").alias("n_left"))


_EQ = "(na <> '' AND {r} <> '' AND (na = {r} OR contains(na, {r}) OR contains({r}, na) OR {f} >= 0.75))"


def _labels(spark, sf):
    c = table(spark, sf, "conversations").filter("role <> 'system'")
    pick = lambda k, n: c.filter(F.col("turn") == k).select("conv_id", F.col("text").alias(n))
    refs = pick(1, "current").join(pick(2, "stale"), "conv_id")
    return c.select("conv_id", "turn", F.col("text").alias("answer")).join(refs, "conv_id")


@query(f"""WITH c AS (SELECT * FROM conversations WHERE role <> 'system'), j AS (SELECT c.conv_id, c.turn, {norm('c.text')} AS na, {norm('x.text')} AS nx, {norm('y.text')} AS ny
  FROM c JOIN c x ON x.conv_id = c.conv_id AND x.turn = 1 JOIN c y ON y.conv_id = c.conv_id AND y.turn = 2), t AS (SELECT *, na AS a, {toks('na')} AS ta, {toks('nx')} AS tx, {toks('ny')} AS ty FROM j),
  m AS (SELECT *, {_EQ.format(r='nx', f=f1('ta', 'tx'))} AS on_current, {_EQ.format(r='ny', f=f1('ta', 'ty'))} AS on_stale FROM t)
  SELECT conv_id, turn, CASE WHEN {_MISSING} THEN 'missing' WHEN on_current AND on_stale AND nx <> ny THEN 'ambiguous' WHEN on_current THEN 'perfect_current' WHEN on_stale THEN 'perfect_stale' ELSE 'harmful_other' END AS quality_label FROM m""")
def classify_labels(spark, sf):
    return _labels(spark, sf).select("conv_id", "turn", tx.quality_label(F.col("answer"), F.col("current"), F.col("stale")).alias("quality_label"))


@query(f"""WITH c AS (SELECT * FROM conversations WHERE role <> 'system'), j AS (SELECT c.conv_id, c.turn, {norm('c.text')} AS na, {norm('x.text')} AS nx, {norm('y.text')} AS ny
  FROM c JOIN c x ON x.conv_id = c.conv_id AND x.turn = 1 JOIN c y ON y.conv_id = c.conv_id AND y.turn = 2), t AS (SELECT *, na AS a, {toks('na')} AS ta, {toks('nx')} AS tx, {toks('ny')} AS ty FROM j),
  m AS (SELECT *, {_EQ.format(r='nx', f=f1('ta', 'tx'))} AS on_current, {_EQ.format(r='ny', f=f1('ta', 'ty'))} AS on_stale FROM t),
  l AS (SELECT conv_id, CASE WHEN {_MISSING} THEN 'missing' WHEN on_current AND on_stale AND nx <> ny THEN 'ambiguous' WHEN on_current THEN 'perfect_current' WHEN on_stale THEN 'perfect_stale' ELSE 'harmful_other' END AS q FROM m)
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(q = 'perfect_current' AS DOUBLE)), 6) AS perfect_current_rate, round(avg(CAST(q = 'perfect_stale' AS DOUBLE)), 6) AS perfect_stale_rate FROM l GROUP BY 1""")
def label_shares(spark, sf):
    q = _labels(spark, sf).select("conv_id", tx.quality_label(F.col("answer"), F.col("current"), F.col("stale")).alias("q"))
    share = lambda v: F.round(F.avg((F.col("q") == v).cast("double")), 6)
    return q.groupBy("conv_id").agg(F.count("*").alias("n"), share("perfect_current").alias("perfect_current_rate"), share("perfect_stale").alias("perfect_stale_rate"))


@query(f"""WITH {_PAIRS}, s AS (SELECT *, {f1('ta', 'tr')} AS f FROM t), e AS (SELECT conv_id, turn, f, least(0.99, greatest(0.01, CASE WHEN {_SUB} THEN greatest(f, 0.95) ELSE f END)) AS ent,
  (na <> '' AND nr <> '' AND (na = nr OR contains(na, nr) OR contains(nr, na) OR f >= 0.92)) AS lexical FROM s)
  SELECT conv_id, turn, round(ent, 6) AS entailment, round(greatest(0.0, 1.0 - ent - 0.05), 6) AS neutral, CAST(lexical OR ent >= 0.5 AS INTEGER) AS equivalent FROM e""")
def nli_heuristic(spark, sf):
    """Heuristic entailment; equivalent when lexically equal or entailed without contradiction."""
    p = answer_pairs(spark, sf)
    a, b = F.col("answer"), F.col("reference")
    p = p.select("conv_id", "turn", tx.entailment(a, b).alias("e"), tx.lexically_equal(a, b).alias("lexical"))
    return p.select("conv_id", "turn", F.round("e.entailment", 6).alias("entailment"), F.round("e.neutral", 6).alias("neutral"), (F.col("lexical") | (F.col("e.entailment") >= 0.5)).cast("int").alias("equivalent"))


@query("""SELECT conv_id, turn, left(sha256(text), 16) AS text_hash FROM conversations""")
def text_hashes(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.text_hash(F.col("text")).alias("text_hash"))


@query("""SELECT conv_id, turn, list_reduce(list_prepend(CAST(17 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR) || role || CAST(turn AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda v, c: (v * 33 + c) % 4294967296) AS seed FROM conversations""")
def derived_seeds(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.derived_seed(17, F.col("conv_id").cast("string"), F.col("role"), F.col("turn").cast("string")).alias("seed"))


_STOP = "[" + ",".join(f"'{w}'" for w in tx.STOPWORDS) + "]"
_RAW = "regexp_extract_all({0}, '([A-Za-z0-9][A-Za-z0-9_''-]*)', 1)"
_BARE = "regexp_replace({0}, '^[''_-]+|[''_-]+$', '', 'g')"


@query(f"""WITH r AS (SELECT item_id, text, list_transform({_RAW.format('lower(text)')}, lambda t: {_BARE.format('t')}) AS b, {_RAW.format('text')} AS raw FROM benchmark),
  i AS (SELECT *, list_filter(b, lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t)) AS k, list_position(list_transform(raw, lambda t: NOT list_contains({_STOP}, {_BARE.format('lower(t)')}) AND regexp_matches(t, '^[A-Z]')), true) AS p FROM r),
  u AS (SELECT item_id, list_filter(k, lambda t, j: list_position(k, t) = j)[1:24] AS terms, CASE WHEN coalesce(p, 0) > 0 THEN list_filter(list_transform(raw[p:], lambda t: {_BARE.format('lower(t)')}), lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))[1:6] ELSE [] END AS focus FROM i)
  SELECT item_id, array_to_string(terms, ' ') AS terms, array_to_string(focus, ' ') AS focus FROM u""")
def query_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(tx.query_terms(F.col("text")), " ").alias("terms"), F.array_join(tx.focus_terms(F.col("text")), " ").alias("focus"))


@query(f"""WITH r AS (SELECT item_id, list_transform({_RAW.format('lower(text)')}, lambda t: {_BARE.format('t')}) AS b, {_RAW.format('text')} AS raw FROM benchmark),
  i AS (SELECT *, list_filter(b, lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t)) AS k, list_position(list_transform(raw, lambda t: NOT list_contains({_STOP}, {_BARE.format('lower(t)')}) AND regexp_matches(t, '^[A-Z]')), true) AS p FROM r),
  u AS (SELECT item_id, list_transform(list_filter(k, lambda t, j: list_position(k, t) = j)[1:24], lambda t: '"' || t || '"') AS q, CASE WHEN coalesce(p, 0) > 0 THEN list_transform(list_filter(list_transform(raw[p:], lambda t: {_BARE.format('lower(t)')}), lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))[1:6], lambda t: '"' || t || '"') ELSE [] END AS f FROM i),
  s AS (SELECT item_id, n, v FROM (SELECT item_id, unnest(range(1, 10)) AS n, unnest([CASE WHEN len(f) >= 6 THEN array_to_string(f[1:6], ' AND ') END, CASE WHEN len(f) >= 5 THEN array_to_string(f[1:5], ' AND ') END, CASE WHEN len(f) >= 4 THEN array_to_string(f[1:4], ' AND ') END, CASE WHEN len(f) >= 3 THEN array_to_string(f[1:3], ' AND ') END,
    CASE WHEN len(q) >= 8 THEN array_to_string(q[1:8], ' AND ') END, CASE WHEN len(q) >= 6 THEN array_to_string(q[1:6], ' AND ') END, CASE WHEN len(q) >= 4 THEN array_to_string(q[1:4], ' AND ') END, CASE WHEN len(q) >= 3 THEN array_to_string(q[1:3], ' AND ') END, CASE WHEN len(q) > 0 THEN array_to_string(q[1:12], ' OR ') END]) AS v FROM u) WHERE v IS NOT NULL),
  d AS (SELECT item_id, v, min(n) AS n FROM s GROUP BY 1, 2)
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY n) - 1 AS INTEGER) AS step, v AS match_query FROM d""")
def query_ladder(spark, sf):
    return ladder(table(spark, sf, "benchmark").withColumnRenamed("text", "question")).withColumnRenamed("q", "match_query")


@query(f"""WITH {RESPONSES} SELECT condition, CAST(sum(CAST(ceil(length(answer) / 3.6) AS BIGINT) + 16) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN rn = 1 THEN CAST(ceil(length(answer) / 3.6) AS BIGINT) + 16 ELSE 0 END) AS BIGINT) AS first_prompt_tokens,
  CAST(count(*) AS BIGINT) AS requests, round(sum(CAST(ceil(length(answer) / 3.6) AS BIGINT) + 16) * 0.25 / 1000000 + count(*) * 120 * 2.0 / 1000000, 6) AS cost
  FROM (SELECT *, row_number() OVER (PARTITION BY question_id, condition ORDER BY sample_idx) AS rn FROM responses) GROUP BY 1""")
def cost_plan(spark, sf):
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("question_id", "condition").orderBy("sample_idx")) == 1
    r = responses(spark, sf).select("condition", tx.token_estimate(F.col("answer")).alias("n"), first.alias("is_first"))
    return r.groupBy("condition").agg(
        F.sum("n").alias("input_tokens"), F.sum(F.when(F.col("is_first"), F.col("n")).otherwise(0)).alias("first_prompt_tokens"), F.count("*").alias("requests"),
        F.round(F.sum("n") * 0.25 / 1000000 + F.count("*") * 120 * 2.0 / 1000000, 6).alias("cost"),
    )


_SECRET_TEXT = """text || CASE doc_id % 6 WHEN 0 THEN ' sk-' || repeat('aB3_', 6) || ' ' WHEN 1 THEN ' hf_' || repeat('x9', 11) WHEN 2 THEN ' bearer ' || repeat('t.', 14) || 'z' WHEN 3 THEN chr(10) || '-----BEGIN EC PRIVATE KEY-----' WHEN 4 THEN ' C:\\Users\\me\\x' ELSE ' sk-short' END"""


@query(f"""WITH t AS (SELECT doc_id, {_SECRET_TEXT} AS t FROM documents) SELECT doc_id, {', '.join(f"regexp_matches(t, '{p}') AS {k}" for k, p in tx.SECRETS.items())} FROM t""")
def secret_scan(spark, sf):
    """Secrets in whole texts, to each of which one of the forms was added."""
    i = F.col("doc_id") % 6
    more = F.when(i == 0, " sk-" + "aB3_" * 6 + " ").when(i == 1, " hf_" + "x9" * 11).when(i == 2, " bearer " + "t." * 14 + "z").when(i == 3, "\n-----BEGIN EC PRIVATE KEY-----").when(i == 4, " C:\\Users\\me\\x").otherwise(" sk-short")
    return table(spark, sf, "documents").select("doc_id", tx.secrets(F.concat("text", more)).alias("s")).select("doc_id", "s.*")
