"""Queries that build cohorts: as-of answers, changes, intervals, disjoint splits, resumes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions.text import normalize
from tidemark.operators import temporal as tp
from tidemark.plans.views import CHECKPOINTS, RESPONSES, SPANS, norm, responses, spans, table

_TIMES = "times AS (SELECT unnest([" + ", ".join(f"TIMESTAMP '{t}'" for t in CHECKPOINTS) + "]) AS t)"
_ASOF = f"""{SPANS}, {_TIMES}, live AS (SELECT s.*, t, row_number() OVER (PARTITION BY question_id, t ORDER BY start_ts DESC, ord DESC) AS rn FROM spans s JOIN times ON start_ts <= t AND (end_ts IS NULL OR t < end_ts)),
  known AS (SELECT question_id, t, answer, start_ts FROM live WHERE rn = 1)"""


def _times(spark, values=CHECKPOINTS):
    return spark.createDataFrame([(t,) for t in values], "t string").select(F.col("t").cast("timestamp").alias("t"))


def _as_of(spark, sf):
    return tp.as_of(spans(spark, sf), _times(spark), ["question_id"])


@query(f"WITH {_ASOF} SELECT question_id, t, answer, start_ts FROM known")
def asof_answer(spark, sf):
    return _as_of(spark, sf).select("question_id", "t", "answer", "start_ts")


def _pairs(spark, sf):
    a = _as_of(spark, sf).select("question_id", "t", "answer")
    steps = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(CHECKPOINTS, CHECKPOINTS[1:]))], "transition int, x string, y string").select("transition", F.col("x").cast("timestamp").alias("x"), F.col("y").cast("timestamp").alias("y"))
    old, new = a.select("question_id", F.col("t").alias("x"), F.col("answer").alias("old")), a.select("question_id", F.col("t").alias("y"), F.col("answer").alias("new"))
    label = F.when(normalize(F.col("old")) == normalize(F.col("new")), "stable").otherwise("changed")
    return old.join(F.broadcast(steps), "x").join(new, ["question_id", "y"]).select("question_id", "transition", "old", "new", label.alias("change_label"))


_STEPS = "steps AS (SELECT row_number() OVER (ORDER BY t) - 1 AS transition, t AS x, lead(t) OVER (ORDER BY t) AS y FROM times)"
_CHANGED = f"""{_ASOF}, {_STEPS}, moved AS (SELECT a.question_id, CAST(transition AS INTEGER) AS transition, a.answer AS old, b.answer AS new, CASE WHEN {norm('a.answer')} = {norm('b.answer')} THEN 'stable' ELSE 'changed' END AS change_label
  FROM steps JOIN known a ON a.t = x JOIN known b ON b.t = y AND a.question_id = b.question_id)"""


@query(f"WITH {_CHANGED} SELECT * FROM moved")
def changed_stable_label(spark, sf):
    return _pairs(spark, sf)


@query(f"WITH {_CHANGED} SELECT question_id, CAST(min(transition) AS INTEGER) AS transition FROM moved WHERE change_label = 'changed' GROUP BY 1")
def transition_first_seen(spark, sf):
    return tp.first_eligible(_pairs(spark, sf).filter("change_label = 'changed'"), "question_id", "transition")


@query(f"WITH {_CHANGED}, f AS (SELECT question_id, min(transition) AS transition FROM moved WHERE change_label = 'changed' GROUP BY 1) SELECT m.question_id, m.transition, m.change_label FROM moved m WHERE m.transition > 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.question_id = m.question_id AND f.transition = 0)")
def future_without_t0(spark, sf):
    """Later events of questions that the first update did not use."""
    p = _pairs(spark, sf)
    t0 = tp.first_eligible(p.filter("change_label = 'changed'"), "question_id", "transition").filter("transition = 0").select("question_id")
    return p.filter("transition > 0").join(t0, "question_id", "left_anti").select("question_id", "transition", "change_label")


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-10'), b AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND event_type = 'purchase')
  SELECT user_id, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT user_id, 'only_old' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def checkpoint_intersect(spark, sf):
    e = table(spark, sf, "events")
    old = e.filter("ts < timestamp'2024-01-10'").select("user_id").distinct()
    new = e.filter("ts >= timestamp'2024-01-20' and event_type = 'purchase'").select("user_id").distinct()
    return old.intersect(new).withColumn("side", F.lit("both")).unionByName(old.subtract(new).withColumn("side", F.lit("only_old")))


@query(f"""WITH {SPANS}, s AS (SELECT * FROM spans), f AS (SELECT user_id AS question_id, event_type AS object, min(ts) AS fs, max(ts) AS fe FROM events GROUP BY 1, 2)
  SELECT s.question_id, s.ord, f.object, CAST((CASE WHEN s.start_ts IS NOT DISTINCT FROM f.fs THEN 2 ELSE 0 END) + (CASE WHEN s.end_ts IS NOT DISTINCT FROM f.fe THEN 2 ELSE 0 END) + (CASE WHEN s.start_ts < f.fe AND (s.end_ts IS NULL OR f.fs < s.end_ts) THEN 1 ELSE 0 END) AS INTEGER) AS score
  FROM s JOIN f ON s.question_id = f.question_id WHERE s.start_ts < f.fe AND (s.end_ts IS NULL OR f.fs < s.end_ts)""")
def interval_overlap_join(spark, sf):
    s = spans(spark, sf)
    f = table(spark, sf, "events").groupBy(F.col("user_id").alias("question_id"), F.col("event_type").alias("object")).agg(F.min("ts").alias("fs"), F.max("ts").alias("fe"))
    bounds = [F.col(c) for c in ("start_ts", "end_ts", "fs", "fe")]
    return s.join(f, "question_id").filter(tp.overlap(*bounds)).select("question_id", "ord", "object", tp.match_score(*bounds).alias("score"))


_FACTS = "facts AS (SELECT n_nationkey AS fact, n_regionkey AS subject, n_name AS object, c.c_mktsegment AS property, count(*) AS n FROM nation JOIN customer c ON c.c_nationkey = n_nationkey GROUP BY ALL)"


@query(f"WITH {_FACTS} SELECT DISTINCT a.fact, a.property, b.object AS competing FROM facts a JOIN facts b ON a.subject = b.subject AND a.property = b.property AND a.fact <> b.fact AND a.object <> b.object")
def competing_facts(spark, sf):
    """Other objects of a fact's subject and property."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    f = n.join(c, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("fact"), F.col("n_regionkey").alias("subject"), F.col("n_name").alias("object"), F.col("c_mktsegment").alias("property")).distinct()
    g = f.select("subject", "property", F.col("fact").alias("other"), F.col("object").alias("competing"))
    return f.join(g, ["subject", "property"]).filter("fact <> other and object <> competing").select("fact", "property", "competing").distinct()


@query(f"""WITH {_FACTS}, q AS (SELECT fact, 'What is the ' || property || ' of ' || object AS question, object AS answer, 'direct' AS kind FROM facts UNION ALL SELECT fact, 'Is ' || object || ' in ' || property, 'yes', 'binary' FROM facts),
  k AS (SELECT q.*, left(sha256(CAST(fact AS VARCHAR) || '|' || question), 16) AS fact_id FROM q), g AS (SELECT 'what is the ' || lower(c_mktsegment) || ' of ' || lower(n_name) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000)
  SELECT k.fact_id, k.kind, CAST(count(g.n) AS BIGINT) AS matches, CASE WHEN count(g.n) > 0 THEN 'mapped' ELSE 'unmapped' END AS status FROM k LEFT JOIN g ON {norm('k.question')} = g.n GROUP BY 1, 2""")
def fact_linkage(spark, sf):
    """Question templates filled from facts, joined to asked questions on their normal form."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    cn = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"))
    f = cn.select(F.col("n_nationkey").alias("fact"), F.col("n_name").alias("object"), F.col("c_mktsegment").alias("property")).distinct()
    made = f.select("fact", F.explode(F.array(
        F.struct(F.concat(F.lit("What is the "), "property", F.lit(" of "), "object").alias("question"), F.lit("direct").alias("kind")),
        F.struct(F.concat(F.lit("Is "), "object", F.lit(" in "), "property").alias("question"), F.lit("binary").alias("kind")),
    )).alias("e")).select("fact", "e.*").withColumn("fact_id", F.left(F.sha2(F.concat_ws("|", F.col("fact").cast("string"), "question"), 256), F.lit(16)))
    asked = cn.filter("c_acctbal > 5000").select(F.concat(F.lit("what is the "), F.lower("c_mktsegment"), F.lit(" of "), F.lower("n_name")).alias("n"))
    counted = made.withColumn("n", normalize(F.col("question"))).join(asked.groupBy("n").agg(F.count("*").alias("m")), "n", "left")
    return counted.select("fact_id", "kind", F.coalesce("m", F.lit(0)).alias("matches"), F.when(F.col("m") > 0, "mapped").otherwise("unmapped").alias("status"))


@query(f"WITH {RESPONSES}, j AS (SELECT question_id, condition, sample_idx FROM (SELECT DISTINCT question_id FROM responses), (SELECT unnest(['user', 'assistant']) AS condition), (SELECT unnest(range(0, 4)) AS sample_idx)) SELECT j.* FROM j WHERE NOT EXISTS (SELECT 1 FROM responses r WHERE r.question_id = j.question_id AND r.condition = j.condition AND r.sample_idx = j.sample_idx AND trim(r.answer) <> '')")
def resume_anti_join(spark, sf):
    """Sampling jobs (question x condition x sample) that have no finished answer yet."""
    r = responses(spark, sf)
    jobs = r.select("question_id").distinct().select("question_id", F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("condition")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("sample_idx")).withColumn("sample_idx", F.col("sample_idx").cast("long"))
    return tp.missing_jobs(jobs, r.filter(F.trim("answer") != ""), ["question_id", "condition", "sample_idx"])


@query("""SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS requests, round(sum(value) OVER w, 4) AS spent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW)""")
def rolling_rate(spark, sf):
    """Requests and spend of a user in the last hour, at each event."""
    e = table(spark, sf, "events").select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    rolled = tp.rolling_all(e, "t", {"requests": F.lit(1).cast("long"), "spent": F.col("value")}, 3_600_000_001, ("user_id",))
    return rolled.select("event_id", "requests", F.round("spent", 4).alias("spent"))


@query(f"""WITH {RESPONSES}, u AS (SELECT *, 0 AS run FROM responses UNION ALL SELECT question_id, condition, sample_idx, answer || '!', 1 FROM responses WHERE question_id % 2 = 0), f AS (SELECT *, row_number() OVER (PARTITION BY question_id, condition, sample_idx ORDER BY run) AS n FROM u)
  SELECT question_id, CAST(count(*) AS BIGINT) AS kept, CAST(sum(length(answer)) AS BIGINT) AS chars FROM f WHERE n = 1 GROUP BY 1 HAVING count(*) >= 6""")
def reuse_complete_groups(spark, sf):
    """Answers of several runs, the first run wins; only complete groups are reused."""
    r = responses(spark, sf)
    u = r.withColumn("run", F.lit(0)).unionByName(r.filter("question_id % 2 = 0").withColumn("answer", F.concat("answer", F.lit("!"))).withColumn("run", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("question_id", "condition", "sample_idx").orderBy("run")) == 1
    return u.withColumn("f", first).filter("f").groupBy("question_id").agg(F.count("*").alias("kept"), F.sum(F.length("answer")).alias("chars")).filter("kept >= 6")


@query(f"WITH {RESPONSES}, twice AS (SELECT * FROM responses UNION ALL SELECT * FROM responses WHERE question_id % 7 = 0) SELECT question_id, CAST(count(*) AS BIGINT) AS n FROM twice GROUP BY 1 HAVING count(*) > count(DISTINCT (condition, sample_idx))")
def duplicate_keys(spark, sf):
    """Questions with a repeated (condition, sample) key."""
    r = responses(spark, sf)
    r = r.unionByName(r.filter("question_id % 7 = 0")).groupBy("question_id").agg(F.count("*").alias("n"), F.countDistinct("condition", "sample_idx").alias("k"))
    return r.filter("n > k").select("question_id", "n")


@query(f"""WITH {SPANS} SELECT question_id, CAST(count(*) AS BIGINT) AS n_spans, md5(string_agg(answer, '|' ORDER BY start_ts, ord)) AS history_md5 FROM spans GROUP BY 1""")
def question_histories(spark, sf):
    s = spans(spark, sf).groupBy("question_id").agg(F.count("*").alias("n_spans"), F.array_sort(F.collect_list(F.struct("start_ts", "ord", "answer"))).alias("h"))
    return s.select("question_id", "n_spans", F.md5(F.array_join(F.transform("h", lambda x: x["answer"]), "|")).alias("history_md5"))


@query(f"""WITH {RESPONSES}, h AS (SELECT question_id, sample_idx, md5(answer) AS m FROM responses) SELECT a.question_id, CAST(count(*) AS BIGINT) AS compared, CAST(sum(CASE WHEN a.m <> b.m THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM h a JOIN h b ON a.question_id = b.question_id AND b.sample_idx = a.sample_idx + 2 GROUP BY 1""")
def context_hash_check(spark, sf):
    h = responses(spark, sf).select("question_id", "sample_idx", F.md5("answer").alias("m"))
    later = h.select("question_id", (F.col("sample_idx") - 2).alias("sample_idx"), F.col("m").alias("m2"))
    return h.join(later, ["question_id", "sample_idx"]).groupBy("question_id").agg(F.count("*").alias("compared"), F.sum((F.col("m") != F.col("m2")).cast("int")).alias("changed"))
