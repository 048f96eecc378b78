"""Queries of facts, linkage and probe preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import text as tx
from tidemark.operators import contexts as cx
from tidemark.operators import evidence as ev
from tidemark.plans.probe import _DOCS, _contexts
from tidemark.plans.views import norm, table
from tidemark.sources import records as rc

#: Questions that facts of a property answer, with and without an object.
_TEMPLATES = {
    "chairperson": {"subject_q": ("Who is the chairperson of {subject}?", "{object}"), "binary": ("Is {object} the chairperson of {subject}?", "yes")},
    "residence": {"subject_q": ("Who lives in {subject}?", "{object}"), "object_q": ("Where does {object} live?", "{subject}")},
}
_ABSENT = {"chairperson": [("subject_q", "Who is the chairperson of {subject}?", "no one"), ("absence", "Is there a chairperson of {subject}?", "no")]}

FACTS = """facts AS (SELECT s_suppkey AS row, 'Nation ' || CAST(s_nationkey AS VARCHAR) AS subject, CASE WHEN s_suppkey % 3 = 0 THEN 'residence' ELSE 'chairperson' END AS property, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'Person ' || CAST(s_suppkey % 60 AS VARCHAR) END AS object,
  CAST(DATE '2020-01-01' + CAST(s_suppkey * 37 % 900 AS INTEGER) AS TIMESTAMP) AS start_ts, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(DATE '2020-01-01' + CAST(s_suppkey * 37 % 900 + 200 AS INTEGER) AS TIMESTAMP) END AS end_ts, 'https://www.site' || CAST(s_suppkey % 40 AS VARCHAR) || '.org/a/' AS source_url FROM supplier),
  named AS (SELECT *, 'fact_' || left(sha256(CAST(row AS VARCHAR) || '|' || subject || '|' || property || '|' || object || '|' || source_url), 16) AS fact_id FROM facts)"""


def _facts(spark, sf):
    k = F.col("s_suppkey")
    day = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int")).cast("timestamp")
    s = table(spark, sf, "supplier").select(
        k.alias("row"), F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("subject"), F.when(k % 3 == 0, "residence").otherwise("chairperson").alias("property"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("Person "), (k % 60).cast("string"))).alias("object"), day(k * 37 % 900).alias("start_ts"), F.when(k % 5 != 0, day(k * 37 % 900 + 200)).alias("end_ts"),
        F.concat(F.lit("https://www.site"), (k % 40).cast("string"), F.lit(".org/a/")).alias("source_url"),
    )
    return s.withColumn("fact_id", ev.fact_id(*(F.col(c) for c in ("row", "subject", "property", "object", "source_url"))))


@query(f"WITH {FACTS} SELECT fact_id, row, subject, property, object, start_ts, end_ts FROM named")
def fact_scan(spark, sf):
    """Facts under names that their fields determine."""
    return _facts(spark, sf).select("fact_id", "row", "subject", "property", "object", "start_ts", "end_ts")


_MADE = f"""made AS (SELECT *, unnest(CASE WHEN property = 'chairperson' AND object = '' THEN [{{'k': 'subject_q', 'q': 'Who is the chairperson of ' || subject || '?', 'a': 'no one'}}, {{'k': 'absence', 'q': 'Is there a chairperson of ' || subject || '?', 'a': 'no'}}]
  WHEN property = 'chairperson' THEN [{{'k': 'subject_q', 'q': 'Who is the chairperson of ' || subject || '?', 'a': object}}, {{'k': 'binary', 'q': 'Is ' || object || ' the chairperson of ' || subject || '?', 'a': 'yes'}}]
  ELSE [{{'k': 'subject_q', 'q': 'Who lives in ' || subject || '?', 'a': object}}, {{'k': 'object_q', 'q': 'Where does ' || object || ' live?', 'a': subject}}] END) AS e FROM named),
  m AS (SELECT fact_id, subject, property, object, start_ts AS fs, end_ts AS fe, e.k AS kind, {norm('e.q')} AS q, {norm('e.a')} AS a FROM made)"""


@query(f"WITH {FACTS}, {_MADE} SELECT fact_id, kind, q, a FROM m")
def template_questions(spark, sf):
    """Questions that each fact answers."""
    return ev.entries(_facts(spark, sf), _TEMPLATES, _ABSENT).select("fact_id", "kind", "q", "a")


_ASKED = f"""asked AS (SELECT c_custkey AS row, CASE c_custkey % 4 WHEN 0 THEN 'Is Person ' || CAST(c_custkey % 60 AS VARCHAR) || ' the chairperson of Nation ' || CAST(c_nationkey AS VARCHAR) || '?' WHEN 1 THEN 'Is there a chairperson of Nation ' || CAST(c_nationkey AS VARCHAR) || '?'
    ELSE 'Who is the chairperson of Nation ' || CAST(c_nationkey AS VARCHAR) || '?' END AS question, CASE c_custkey % 4 WHEN 0 THEN 'No.' WHEN 1 THEN 'Yes' WHEN 2 THEN 'no one' ELSE 'Person ' || CAST(c_custkey % 60 AS VARCHAR) END AS answer,
    CAST(DATE '2020-03-01' + CAST(c_custkey % 700 AS INTEGER) AS TIMESTAMP) AS start_ts, CASE WHEN c_custkey % 3 <> 0 THEN CAST(DATE '2020-06-01' + CAST(c_custkey % 700 AS INTEGER) AS TIMESTAMP) END AS end_ts FROM customer),
  qq AS (SELECT *, {norm('question')} AS q, {norm('answer')} AS a FROM asked)"""


def _asked(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    person = F.concat(F.lit("Person "), (k % 60).cast("string"))
    text = F.when(k % 4 == 0, F.concat(F.lit("Is "), person, F.lit(" the chairperson of Nation "), n, F.lit("?"))).when(k % 4 == 1, F.concat(F.lit("Is there a chairperson of Nation "), n, F.lit("?"))).otherwise(F.concat(F.lit("Who is the chairperson of Nation "), n, F.lit("?")))
    day = lambda d: F.date_add(F.lit(d).cast("date"), (k % 700).cast("int")).cast("timestamp")
    answer = F.when(k % 4 == 0, "No.").when(k % 4 == 1, "Yes").when(k % 4 == 2, "no one").otherwise(person)
    return table(spark, sf, "customer").select(k.alias("row"), text.alias("question"), answer.alias("answer"), day("2020-03-01").alias("start_ts"), F.when(k % 3 != 0, day("2020-06-01")).alias("end_ts"))


_LIVE = "(x.start_ts IS NULL OR fe IS NULL OR x.start_ts < fe) AND (fs IS NULL OR x.end_ts IS NULL OR fs < x.end_ts)"
_PEER = "p.subject = t.subject AND p.property = t.property"
_LINKED = f"""{FACTS}, {_MADE}, {_ASKED}, ds AS (SELECT x.row, m.fact_id, (CASE WHEN x.start_ts IS NOT DISTINCT FROM fs THEN 2 ELSE 0 END) + (CASE WHEN x.end_ts IS NOT DISTINCT FROM fe THEN 2 ELSE 0 END) + (CASE WHEN {_LIVE} THEN 1 ELSE 0 END) AS score FROM qq x JOIN m ON m.q = x.q AND m.a = x.a),
  direct AS (SELECT DISTINCT row, fact_id FROM (SELECT *, max(score) OVER (PARTITION BY row) AS top FROM ds) WHERE score = top), un AS (SELECT * FROM qq WHERE row NOT IN (SELECT row FROM direct)), pf AS (SELECT subject, property, object, fact_id, start_ts AS fs, end_ts AS fe FROM named),
  nh AS (SELECT x.row, x.start_ts, x.end_ts, t.subject, t.property, t.fact_id AS target, t.object AS target_object FROM un x JOIN m t ON t.kind = 'binary' AND t.q = x.q WHERE x.a = 'no'), np AS (SELECT DISTINCT x.row, p.fact_id FROM nh x JOIN pf p ON p.subject = x.subject AND p.property = x.property AND p.fact_id <> target AND p.object <> target_object WHERE {_LIVE}),
  yh AS (SELECT x.row, x.start_ts, x.end_ts, t.subject, t.property FROM un x JOIN m t ON t.kind = 'absence' AND t.q = x.q WHERE x.a = 'yes'), yp AS (SELECT DISTINCT x.row, p.fact_id FROM yh x JOIN pf p ON p.subject = x.subject AND p.property = x.property AND p.object <> '' WHERE {_LIVE}),
  l AS (SELECT row, 'direct' AS status, fact_id, 'direct' AS support FROM direct UNION ALL SELECT row, 'binary_no_competing', fact_id, 'competing_current_fact' FROM np UNION ALL SELECT DISTINCT row, 'binary_no_unmapped', NULL, NULL FROM nh WHERE row NOT IN (SELECT row FROM np)
    UNION ALL SELECT row, 'absence_yes_competing', fact_id, 'competing_present_fact' FROM yp UNION ALL SELECT DISTINCT row, 'absence_yes_unmapped', NULL, NULL FROM yh WHERE row NOT IN (SELECT row FROM yp)),
  linked AS (SELECT * FROM l UNION ALL SELECT row, 'unmapped', NULL, NULL FROM qq WHERE row NOT IN (SELECT row FROM l))"""


def _linked(spark, sf):
    f = _facts(spark, sf)
    return ev.link(_asked(spark, sf), ev.entries(f, _TEMPLATES, _ABSENT), f)


@query(f"WITH {_LINKED} SELECT * FROM linked")
def linked_questions(spark, sf):
    """The facts behind each question: direct, by a competing fact, by a fact that is there at all, or none."""
    return _linked(spark, sf).select("row", "status", "fact_id", "support")


@query(f"WITH {_LINKED} SELECT status, CAST(count(DISTINCT row) AS BIGINT) AS questions, CAST(count(fact_id) AS BIGINT) AS facts FROM linked GROUP BY 1")
def linkage_coverage(spark, sf):
    """Questions and facts by the way they were linked."""
    f = _facts(spark, sf)
    return ev.coverage(_asked(spark, sf), ev.entries(f, _TEMPLATES, _ABSENT), f)


@query(f"""WITH {FACTS}, v AS (SELECT 'https://www.site' || CAST(page_id % 40 AS VARCHAR) || '.org/a/' AS u, '2023-0' || CAST(1 + page_id % 9 AS VARCHAR) || '-' || lpad(CAST(page_id AS VARCHAR), 6, '0') AS t, CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS a FROM pages),
  p AS (SELECT u, string_agg(t || ' ' || coalesce(nullif(a, ''), u), '|' ORDER BY t, a) AS s, count(*) AS n FROM v GROUP BY 1) SELECT fact_id, CAST(coalesce(n, 0) AS BIGINT) AS n_versions, md5(coalesce(s, '')) AS versions_md5 FROM named LEFT JOIN p ON u = source_url""")
def fact_payloads(spark, sf):
    """The archived versions of the page of each fact, in order of time."""
    i = F.col("page_id")
    site = F.concat(F.lit("https://www.site"), (i % 40).cast("string"), F.lit(".org/a/"))
    time = F.concat(F.lit("2023-0"), (1 + i % 9).cast("string"), F.lit("-"), F.lpad(i.cast("string"), 6, "0"))
    v = table(spark, sf, "pages").select(site.alias("source_url"), time.alias("timestamp"), F.when(i % 3 == 0, "").otherwise(F.col("url")).alias("archive_url"))
    p = ev.payloads(_facts(spark, sf), v)
    return p.select("fact_id", F.size("archive_versions").cast("long").alias("n_versions"), F.md5(F.array_join(F.transform("archive_versions", lambda x: F.concat_ws(" ", x["timestamp"], x["archive_url"])), "|")).alias("versions_md5"))


@query("""WITH v AS (SELECT doc_id, 'https://site' || CAST(doc_id // 4 AS VARCHAR) || '.org/x' AS u, '2024-01-0' || CAST(1 + doc_id % 3 AS VARCHAR) AS t, trim(text, ' ') AS x FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY u, t ORDER BY doc_id) AS n FROM v WHERE length(x) >= 80)
  SELECT u AS url, t AS timestamp, CAST(length(x) AS BIGINT) AS n_chars, md5(x) AS text_md5 FROM r WHERE n = 1""")
def version_maps(spark, sf):
    """Nested maps of URL to version read as one row a version; where an archived version comes twice, the first in the file's order counts."""
    i = F.col("doc_id")
    site, day = F.concat(F.lit("https://site"), F.floor(i / 4).cast("string"), F.lit(".org/x")), F.concat(F.lit("2024-01-0"), (1 + i % 3).cast("string"))
    # one map for each four documents; keys of a map are unique, so the version's own time and the archive's URL tell versions apart
    inner = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.lpad(i.cast("string"), 12, "0").alias("k"), F.struct(day.alias("source_timestamp"), F.col("text").alias("source_text"), F.col("site").alias("archive_url")).alias("v")))))
    d = table(spark, sf, "documents").select("doc_id", "text", site.alias("site")).groupBy("site").agg(inner.alias("m"))
    v = rc.versions(d.select(F.to_json(F.map_from_arrays(F.array("site"), F.array("m"))).alias("value")), "value")
    return v.select("url", "timestamp", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


_CARD = """'Evaluation date: 2024-05-01' || chr(10) || 'Question subject: Nation ' || CAST(q AS VARCHAR) || chr(10) || 'Question relation: chairperson' || chr(10) || 'Verified answer to the question: Person ' || CAST(q AS VARCHAR)"""
_FACT_LINES = """'Current fact: Nation ' || CAST(q AS VARCHAR) || ' | chairperson | Person ' || CAST(q AS VARCHAR) || chr(10) || 'Valid from: 2020-01-01' || chr(10) || 'Source date: ' || CASE WHEN q % 2 = 0 THEN '2023-02-03' ELSE 'unknown' END || chr(10) || 'Source URL: https://www.site' || CAST(q AS VARCHAR) || '.org/a'"""
_EVIDENCE = """chr(10) || 'Timestamp: ' || CASE WHEN q % 2 = 0 THEN '2023-02-03' ELSE '2020-01-01' END || chr(10) || 'Title: Evidence from site' || CAST(q AS VARCHAR) || '.org' || chr(10) || 'Source URL: https://www.site' || CAST(q AS VARCHAR) || '.org/a' || chr(10) || 'Document ID: f' || CAST(q AS VARCHAR) || chr(10) || 'Chunk: ' || CAST(q AS VARCHAR) || chr(10) || 'Quote ' || CAST(q AS VARCHAR)"""
_RANKED = "list_transform({0}, lambda d, i: '[retrieved rank ' || CAST(i AS VARCHAR) || ']' || chr(10) || d)"
_PREPARED = f"""{_DOCS}, n AS (SELECT q, CASE WHEN q % 4 = 3 AND len(cur) > 1 THEN list_concat(cur[1:1], ['see https://site' || CAST(q AS VARCHAR) || '.org/a now'], cur[2:]) ELSE cur END AS docs FROM a WHERE len(cur) > 0),
  w AS (SELECT *, CASE WHEN q % 4 = 1 AND len(docs) >= 2 THEN 2 WHEN q % 4 = 3 AND len(docs) > 1 THEN 2 END AS rank FROM n),
  e AS (SELECT *, rank IS NULL AS injected, CASE WHEN rank IS NULL THEN list_append(docs[1:9], substr({_EVIDENCE}, 2)) ELSE docs END AS p2, CASE WHEN rank IS NULL THEN least(len(docs), 9) + 1 ELSE rank END AS place FROM w),
  f AS (SELECT *, list_concat([p2[place]], list_filter(p2, lambda d, i: i <> place)) AS p3 FROM e)"""


def _prepared(spark, sf):
    """Records with natural documents, one fact, and a support document by rank, by URL or not at all."""
    q = F.col("q")
    s = q.cast("string")
    name = lambda a, b="": F.concat(F.lit(a), s, F.lit(b))
    link = name("see https://site", ".org/a now")
    docs = F.when((q % 4 == 3) & (F.size("cur") > 1), F.concat(F.slice("cur", 1, 1), F.array(link), F.slice("cur", 2, 99))).otherwise(F.col("cur"))
    fact = F.struct(
        name("f").alias("fact_id"), q.alias("row"), name("Nation ").alias("subject"), F.lit("chairperson").alias("property"), name("Person ").alias("object"), F.lit("2020-01-01").alias("valid_start"), F.when(q % 2 == 0, "2023-02-03").alias("source_date"),
        name("https://www.site", ".org/a").alias("source_url"), name("Quote ").alias("evidence_span"),
    )
    rows = _contexts(spark, sf).withColumn("docs", docs).withColumn("facts", F.array(fact, fact.withField("evidence_span", F.lit(""))))
    rows = rows.filter(ev.eligible(F.col("docs"), F.col("facts")))
    urls = F.when(q % 4 == 3, F.array(name("https://www.site", ".org/a"))).otherwise(F.array().cast("array<string>"))
    built = ev.probe_documents(F.col("docs"), F.col("facts"), F.when(q % 4 == 1, 2), urls, F.lit("2024-05-01T00:00"), F.lit("chairperson"), name("Person "))
    return rows.select(q.alias("id"), name("Person ").alias("gold_answer"), built.alias("docs"), F.array(F.lit("2024-05-01")).alias("times"))


@query(f"""WITH {_PREPARED} SELECT q AS id, md5(array_to_string({_RANKED.format('docs')}, '|')) AS p1, md5(array_to_string({_RANKED.format('p2')}, '|')) AS p2, md5(array_to_string({_RANKED.format('p3')}, '|')) AS p3, md5('[retrieved rank 1]' || {_EVIDENCE}) AS p4, md5({_CARD} || chr(10) || {_FACT_LINES}) AS p5,
  injected, CAST(coalesce(rank, 0) AS INTEGER) AS natural_support_rank, place <> 1 AS moved FROM f""")
def probe_documents(spark, sf):
    """The five stages' documents of every record that can be probed."""
    d = _prepared(spark, sf)
    joined = lambda c: F.md5(F.array_join(f"docs.{c}", "|"))
    return d.select("id", *(joined(c).alias(f"p{i + 1}") for i, c in enumerate(ev.STAGES)), "docs.injected", F.coalesce("docs.natural_support_rank", F.lit(0)).alias("natural_support_rank"), "docs.moved")


@query(f"""WITH {_PREPARED}, p AS (SELECT 'id comes twice' AS problem, q AS id FROM f WHERE q % 10 = 0 UNION ALL SELECT 'fact card without the answer', q FROM f WHERE q % 10 = 1 UNION ALL SELECT 'times differ', q FROM f WHERE q % 10 = 2 UNION ALL SELECT 'stage name in a context', q FROM f WHERE q % 10 = 3) SELECT * FROM p""")
def cohort_check(spark, sf):
    """What is wrong with prepared records, some of which were spoilt."""
    d, i = _prepared(spark, sf), F.col("id")
    d = d.withColumn("gold_answer", F.when(i % 10 == 1, "Somebody else").otherwise(F.col("gold_answer"))).withColumn("times", F.when(i % 10 == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.col("times")))
    spoilt = F.col("docs").withField(ev.STAGES[3], F.array(F.lit("see P4_EVIDENCE_only")))
    d = d.withColumn("docs", F.when(i % 10 == 3, spoilt).otherwise(F.col("docs")))
    return ev.check_cohort(d.unionByName(d.filter("id % 10 = 0")))


@query("""WITH e AS (SELECT event_id, event_type, value, 'https://x.org/2023/04/05/' || CAST(event_id AS VARCHAR) AS u, repeat('long enough text of an item ', 4) || event_type AS body FROM events)
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'T ' || event_type ELSE '' END AS title, md5(CASE event_id % 3 WHEN 2 THEN body || ' more' ELSE body END) AS text_md5, CASE WHEN event_id % 3 = 1 THEN '' ELSE u END AS url FROM e""")
def evidence_scan(spark, sf):
    """Title, text and URL of items without a schema: by the first path whose name says so, else the longest text."""
    e = table(spark, sf, "events")
    body = F.concat(F.repeat(F.lit("long enough text of an item "), 4), "event_type")
    url = F.concat(F.lit("https://x.org/2023/04/05/"), F.col("event_id").cast("string"))
    plain = F.to_json(F.struct(F.struct(F.concat(F.lit("T "), "event_type").alias("headline")).alias("head"), F.array(F.struct(body.alias("article_text"))).alias("parts"), url.alias("href")))
    bare = F.to_json(F.struct(F.lit("short").alias("a"), F.array(body).alias("b"), F.col("value").alias("c")))
    deep = F.to_json(F.struct(F.struct(F.struct(F.concat(body, F.lit(" more")).alias("x")).alias("body_of")).alias("z"), url.alias("link")))
    items = e.select("event_id", F.when(F.col("event_id") % 3 == 0, plain).when(F.col("event_id") % 3 == 1, bare).otherwise(deep).alias("item"))
    return rc.scan_items(items, "item", ["event_id"]).select("event_id", "title", F.md5("text").alias("text_md5"), "url")


@query(f"""WITH {FACTS} SELECT property, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE object = '') AS BIGINT) AS absent, md5(string_agg(fact_id, ',' ORDER BY fact_id)) AS ids_md5 FROM named GROUP BY 1""")
def fact_index(spark, sf):
    """Facts by property, with what they have no object for."""
    f = _facts(spark, sf).groupBy("property").agg(F.count("*").alias("n"), F.sum((F.col("object") == "").cast("long")).alias("absent"), F.array_join(F.array_sort(F.collect_list("fact_id")), ",").alias("ids"))
    return f.select("property", "n", "absent", F.md5("ids").alias("ids_md5"))


@query("""WITH o AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS x, o_orderstatus AS gold, o_orderpriority AS relation, CASE WHEN o_orderkey % 4 > 0 THEN 'quote ' || CAST(o_orderkey AS VARCHAR) END AS span FROM orders)
  SELECT id, gold AS current_answer, lower(trim(relation)) AS question_type, 'open' AS answer_style, span AS official_evidence, CASE WHEN span IS NOT NULL THEN 'https://a.org/' || CAST(id AS VARCHAR) END AS source_url FROM o""")
def audit_rows(spark, sf):
    """The audit row of each record: its fields and those of its first fact with evidence."""
    i = F.col("o_orderkey")
    fact = lambda s: F.struct(s.alias("evidence_span"), F.concat(F.lit("https://a.org/"), i.cast("string")).alias("source_url"))
    facts = F.when(i % 4 > 0, F.array(fact(F.lit("")), fact(F.concat(F.lit("quote "), i.cast("string"))))).otherwise(F.array(fact(F.lit(None).cast("string"))))
    o = table(spark, sf, "orders").select(i.alias("id"), F.col("o_orderstatus").alias("gold_answer"), F.col("o_orderpriority").alias("relation"), facts.alias("facts"))
    first = F.get(ev.with_support(F.col("facts")), F.lit(0))
    return o.select("id", F.col("gold_answer").alias("current_answer"), tx.squeeze(F.lower("relation")).alias("question_type"), cx.binary_style(F.col("gold_answer")).alias("answer_style"), first["evidence_span"].alias("official_evidence"), first["source_url"].alias("source_url"))
