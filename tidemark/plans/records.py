"""Queries of contexts, prompts and records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import text as tx
from tidemark.operators import contexts as cx
from tidemark.operators import retrieval as rt
from tidemark.operators import temporal as tp
from tidemark.plans.probe import _DOCS, _contexts
from tidemark.plans.views import RESPONSES, norm, responses, table
from tidemark.shared import new_path
from tidemark.sources.nested import split_json

_CONDITIONS = ("current_only", "stale_only", "mixed", "stale_25", "stale_50_current_first", "stale_75_stale_first")


def _tag(docs: str, source: str) -> str:
    return f"list_transform({docs}, lambda d: {{'s': '{source}', 'd': d}})"


_NUMBERED = "array_to_string(list_transform(l, lambda x, i: '[' || x.s || ' doc ' || CAST(len(list_filter(l[1:i], lambda e: e.s = x.s)) AS VARCHAR) || ']' || chr(10) || x.d), chr(10) || chr(10))"
_MIX = f"""{_DOCS}, t AS (SELECT q, {_tag('cur', 'current')} AS c, {_tag('old', 'stale')} AS s, {_tag('list_reverse(cur)', 'retrieved')} AS g FROM a),
  p AS (SELECT *, unnest([25, 50, 75]) AS pct FROM t), n AS (SELECT *, CAST(round_even(8 * pct / 100.0, 0) AS INTEGER) AS ws FROM p), u AS (SELECT *, gcd(ws, 8 - ws) AS k FROM n),
  f AS (SELECT *, least(k, len(s) // (ws // k), len(c) // ((8 - ws) // k)) AS m FROM u), r AS (SELECT q, pct, s[1:CASE WHEN m > 0 THEN ws // k * m ELSE least(ws, len(s)) END] AS s, c[1:CASE WHEN m > 0 THEN (8 - ws) // k * m ELSE least(8 - ws, len(c)) END] AS c FROM f),
  l AS (SELECT q, 'current_only' AS condition, c AS l FROM t UNION ALL SELECT q, 'stale_only', s FROM t UNION ALL SELECT q, 'mixed', CASE WHEN q % 5 = 0 THEN g ELSE c || s END FROM t UNION ALL SELECT q, 'stale_50_current_first', c || s FROM r WHERE pct = 50 UNION ALL SELECT q, 'stale_75_stale_first', s || c FROM r WHERE pct = 75
    UNION ALL SELECT q, 'stale_25', list_filter(flatten(list_transform(range(1, greatest(len(c), len(s)) + 1), lambda i: CASE WHEN len(c) >= len(s) THEN [c[i], s[i]] ELSE [s[i], c[i]] END)), lambda x: x IS NOT NULL) FROM r WHERE pct = 25)"""


@query(f"WITH {_MIX} SELECT q AS question_id, condition, md5({_NUMBERED}) AS context_md5 FROM l")
def context_assembly(spark, sf):
    """The context of every question under six conditions; every fifth question has documents given for one of them."""
    rows = _contexts(spark, sf).select("q", "cur", "old", F.explode(F.array(*map(F.lit, _CONDITIONS))).alias("condition"))
    given = F.when((F.col("q") % 5 == 0) & (F.col("condition") == "mixed"), F.reverse("cur"))
    return rows.select(F.col("q").alias("question_id"), "condition", F.md5(cx.context(F.col("condition"), F.col("cur"), F.col("old"), given)).alias("context_md5"))


_SYSTEM = cx.SYSTEM["hybrid"].replace("'", "''")


@query(f"""WITH q AS (SELECT conv_id, turn, role, text, CASE WHEN turn = 3 THEN '2024-02-01T10:00:00Z' END AS own, CASE WHEN conv_id % 2 = 0 THEN '2021-12-22T00:00:00' ELSE '' END AS x, '2022-08-31' AS y, CASE role WHEN 'user' THEN 'stale_only' WHEN 'assistant' THEN 'mixed' ELSE 'free' END AS c FROM conversations),
  t AS (SELECT *, coalesce(own, CASE WHEN c = 'stale_only' THEN coalesce(nullif(x, ''), '2021-11') WHEN c = 'mixed' THEN y END) AS t FROM q), p AS (SELECT *, CASE WHEN t IS NULL THEN text ELSE 'As of ' || split_part(t, 'T', 1) || ', answer the following question: ' || text END AS question FROM t)
  SELECT conv_id, turn, t IS NOT NULL AS dated, md5('System:' || chr(10) || '{_SYSTEM}' || chr(10) || chr(10) || 'User:' || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Retrieved Context:' || chr(10) || role || chr(10) || chr(10) || 'Return only the final answer:' || chr(10) || chr(10)) AS prompt_md5 FROM p""")
def prompt_messages(spark, sf):
    """Plain prompts with the question dated by its condition: its own time, the old snapshot or what stands in for it, or the new one."""
    c = table(spark, sf, "conversations")
    own, x = F.when(F.col("turn") == 3, "2024-02-01T10:00:00Z"), F.when(F.col("conv_id") % 2 == 0, "2021-12-22T00:00:00").otherwise("")
    cond = F.when(F.col("role") == "user", "stale_only").when(F.col("role") == "assistant", "mixed").otherwise("free")
    question = cx.timed_question(F.col("text"), cond, own, [x, F.lit("2021-11")], [F.lit("2022-08-31")])
    return c.select("conv_id", "turn", (own.isNotNull() | (cond != "free")).alias("dated"), F.md5(cx.plain_prompt(question, F.col("role"), "hybrid_answer")).alias("prompt_md5"))


@query(f"""WITH {RESPONSES}, k AS (SELECT question_id, sample_idx // 2 AS pair, CASE condition WHEN 'user' THEN 'current_only' WHEN 'assistant' THEN 'stale_0' ELSE condition END AS c FROM responses)
  SELECT question_id, pair, CASE WHEN bool_or(c = 'current_only') THEN 'current_only' WHEN bool_or(c = 'stale_0') THEN 'stale_0' ELSE min(c) END AS baseline FROM k GROUP BY 1, 2""")
def baseline_conditions(spark, sf):
    """The condition that each pair of answers to a question is compared with."""
    r = responses(spark, sf).withColumn("pair", F.expr("sample_idx div 2"))
    c = F.when(F.col("condition") == "user", "current_only").when(F.col("condition") == "assistant", "stale_0").otherwise(F.col("condition"))
    return r.select("question_id", "pair", c.alias("c")).groupBy("question_id", "pair").agg(cx.baseline(F.col("c")).alias("baseline"))


@query(f"""WITH {RESPONSES}, u AS (SELECT condition, CASE WHEN sample_idx % 4 = 0 THEN '  ' WHEN sample_idx % 7 = 0 THEN NULL ELSE answer END AS a, CASE WHEN sample_idx % 5 = 0 THEN 'timeout' END AS error FROM responses)
  SELECT condition, CAST(count(*) AS BIGINT) AS rows_all, CAST(count(*) FILTER (WHERE trim(coalesce(a, '')) <> '') AS BIGINT) AS usable, CAST(count(*) FILTER (WHERE a IS NOT NULL AND error IS NULL) AS BIGINT) AS answered, CAST(count(*) FILTER (WHERE trim(coalesce(a, '')) <> '' AND error IS NULL) AS BIGINT) AS complete FROM u GROUP BY 1""")
def usable_responses(spark, sf):
    """Rows that metrics use, and rows that a resumed run takes for finished, by its loose and its strict rule."""
    i = F.col("sample_idx")
    r = responses(spark, sf).select("condition", F.when(i % 4 == 0, "  ").when(i % 7 == 0, F.lit(None)).otherwise(F.col("answer")).alias("a"), F.when(i % 5 == 0, "timeout").alias("error"))
    text, clean, n = F.trim(F.coalesce("a", F.lit(""))) != "", F.col("error").isNull(), lambda c: F.sum(c.cast("long"))
    return r.groupBy("condition").agg(F.count("*").alias("rows_all"), n(text).alias("usable"), n(F.col("a").isNotNull() & clean).alias("answered"), n(text & clean).alias("complete"))


_ROLLING = """WITH e AS (SELECT event_id, epoch_us(ts) AS t, CAST(1 + event_id % 50 AS BIGINT) AS tokens FROM events)
  SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS requests, CAST(sum(tokens) OVER w AS BIGINT) AS tokens FROM e WINDOW w AS (ORDER BY t RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)"""


@query(_ROLLING)
def rolling_budget(spark, sf):
    """Requests and tokens of everybody in the last 60 seconds, at each request; no task sees more than two minutes of rows."""
    e = table(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (1 + F.col("event_id") % 50).cast("long").alias("tokens"))
    return tp.rolling_all(e, "t", {"requests": F.lit(1).cast("long"), "tokens": F.col("tokens")}, 60_000_000).select("event_id", "requests", "tokens")


@query(_ROLLING)
def streamed_budget(spark, sf):
    """The same from a stream: events are replayed, and state with timers gives each request its totals."""
    import uuid

    from tidemark.shared import shared_dir
    from tidemark.streaming import responses as live

    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (1 + F.col("event_id") % 50).cast("long").alias("tokens"))
    stream, late = live.replayed(e)
    out = f"{shared_dir(spark)}/budget-{uuid.uuid4().hex}"
    live.run_to_end(live.rolling_totals(stream, late=late), f"{out}/progress", f"{out}/rows")
    return spark.read.schema("event_id long, requests long, tokens long").parquet(f"{out}/rows")


@query(f"""WITH d AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN ' NaN ' WHEN 1 THEN NULL ELSE chr(9) || text END AS t FROM documents), s AS (SELECT doc_id, trim(regexp_replace(coalesce(t, ''), '\\s+', ' ', 'g')) AS t FROM d)
  SELECT doc_id, md5(CASE WHEN lower(t) = 'nan' THEN '' ELSE t END) AS clean_md5 FROM s""")
def clean_texts(spark, sf):
    """Texts without what stands for a missing one."""
    i = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.clean(F.when(i % 10 == 0, " NaN ").when(i % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("\t"), "text")))).alias("clean_md5"))


@query("""SELECT conv_id, left(sha256(string_agg('model-a' || chr(10) || text, chr(10) ORDER BY turn)), 16) AS fingerprint, left(sha256('question' || chr(0) || CAST(conv_id AS VARCHAR) || chr(0) || min(text)), 16) AS cache_key FROM conversations GROUP BY 1""")
def text_fingerprints(spark, sf):
    """A fingerprint of the texts of a group in order, and the key of a text in a cache."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"), F.min("text").alias("first"))
    texts = F.transform("t", lambda x: x["text"])
    return c.select("conv_id", tx.fingerprint("model-a", texts).alias("fingerprint"), tx.cache_key("question", F.col("conv_id").cast("string"), F.col("first")).alias("cache_key"))


_DATES = ["'5 March 2021'", "'Posted Sep 7, 2020 by'", "'on 2019-04-30 it'", "'2018/12/01'", "'45 Foo 2020, May 9, 2017'"]


@query(f"""WITH d AS (SELECT doc_id, CASE doc_id % 6 {' '.join(f'WHEN {i} THEN {d}' for i, d in enumerate(_DATES))} ELSE '' END || chr(10) || text AS t FROM documents), h AS (SELECT doc_id, left(array_to_string(string_split(t, chr(10))[1:25], chr(10)), 2500) AS h FROM d),
  m AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(h, '\\b\\d{{1,2}}\\s+[A-Za-z]{{3,9}}\\s+\\d{{4}}\\b'), lambda x: coalesce(try_strptime(x, '%d %B %Y'), try_strptime(x, '%d %b %Y'))), lambda x: x IS NOT NULL)[1] AS a, list_filter(list_transform(regexp_extract_all(h, '\\b[A-Za-z]{{3,9}}\\s+\\d{{1,2}},\\s+\\d{{4}}\\b'), lambda x: coalesce(try_strptime(x, '%B %d, %Y'), try_strptime(x, '%b %d, %Y'))), lambda x: x IS NOT NULL)[1] AS b,
    list_filter(list_transform(regexp_extract_all(h, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b'), lambda x: try_strptime(x, '%Y-%m-%d')), lambda x: x IS NOT NULL)[1] AS c, list_filter(list_transform(regexp_extract_all(h, '\\b\\d{{4}}/\\d{{2}}/\\d{{2}}\\b'), lambda x: try_strptime(x, '%Y/%m/%d')), lambda x: x IS NOT NULL)[1] AS e FROM h)
  SELECT doc_id, coalesce(a, b, c, e) AS day FROM m""")
def text_dates(spark, sf):
    """The date that the head of a text names."""
    i = F.col("doc_id") % 6
    said = F.lit("")
    for k, d in enumerate(_DATES):
        said = F.when(i == k, d.strip("'")).otherwise(said)
    return table(spark, sf, "documents").select("doc_id", tx.date_in_text(F.concat(said, F.lit("\n"), "text")).alias("day"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '2024-01-0' || CAST(1 + page_id % 9 AS VARCHAR) || 'T10:11:12Z' WHEN 1 THEN '2024-02-03 04:05:06' WHEN 2 THEN '20240506' WHEN 3 THEN 'nan' ELSE '7 Juneuary' END AS v FROM pages)
  SELECT page_id, coalesce(try_strptime(v, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(v, '%Y-%m-%d %H:%M:%S'), try_strptime(v, '%Y%m%d')) AS ts FROM p""")
def timestamp_parse(spark, sf):
    """Timestamps of several forms, or null."""
    i = F.col("page_id")
    v = F.when(i % 5 == 0, F.concat(F.lit("2024-01-0"), (1 + i % 9).cast("string"), F.lit("T10:11:12Z"))).when(i % 5 == 1, "2024-02-03 04:05:06").when(i % 5 == 2, "20240506").when(i % 5 == 3, "nan").otherwise("7 Juneuary")
    return table(spark, sf, "pages").select("page_id", tx.parse_time(v).alias("ts"))


@query("""WITH m AS (SELECT url, CAST(page_id % 3 AS VARCHAR) AS t, max(page_id) AS n FROM pages WHERE page_id % 2 = 0 GROUP BY 1, 2) SELECT p.page_id, coalesce('https://archive.example.org/' || CAST(m.n AS VARCHAR), p.url) AS archive_url FROM pages p LEFT JOIN m ON m.url = p.url AND m.t = CAST(p.page_id % 3 AS VARCHAR)""")
def archive_lookup(spark, sf):
    """The archive's URL of a page version, by URL and timestamp; the last of several entries counts."""
    p = table(spark, sf, "pages").select("page_id", "url", (F.col("page_id") % 3).cast("string").alias("timestamp"))
    known = p.filter("page_id % 2 = 0").withColumn("archive_url", F.concat(F.lit("https://archive.example.org/"), F.col("page_id").cast("string")))
    return rt.archived(p, rt.archive_map(known, "page_id")).select("page_id", "archive_url")


@query(f"""WITH {RESPONSES} SELECT question_id, CAST(greatest(4, max(CASE WHEN condition = 'user' THEN sample_idx END)) AS BIGINT) AS n_samples, lower(trim(CASE question_id % 4 WHEN 0 THEN ' TRUE' WHEN 1 THEN '1' WHEN 2 THEN 'no' ELSE 'Yes ' END)) IN ('1', 'true', 'yes') AS flag FROM responses GROUP BY 1""")
def requested_samples(spark, sf):
    """How many samples a question needs for its list of sizes, and a flag read from text."""
    i = F.col("question_id") % 4
    r = responses(spark, sf).groupBy("question_id").agg(F.array_sort(F.collect_list(F.when(F.col("condition") == "user", F.col("sample_idx")))).alias("sizes"))
    said = F.when(i == 0, " TRUE").when(i == 1, "1").when(i == 2, "no").otherwise("Yes ")
    return r.select("question_id", cx.requested_samples(F.lit(4).cast("long"), F.col("sizes")).alias("n_samples"), cx.truth(said).alias("flag"))


@query(f"""WITH c AS (SELECT DISTINCT 'stale_' || CAST(25 * (conv_id % 5) AS VARCHAR) AS c FROM conversations) SELECT 'stale_0' AS base, c AS other FROM c WHERE c <> 'stale_0'""")
def comparison_pairs(spark, sf):
    """The comparisons that the conditions of a run call for; conditions are few by design."""
    c = table(spark, sf, "conversations").select(F.concat(F.lit("stale_"), (25 * (F.col("conv_id") % 5)).cast("int").cast("string")).alias("c")).distinct()
    return spark.createDataFrame(cx.comparisons([r["c"] for r in c.collect()]), "base string, other string")


@query(f"""WITH e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS x FROM events), i AS (SELECT user_id, 'q_' || strftime(x, '%Y%m%d') || '_' || strftime(x + 7, '%Y%m%d') || '_' || left(sha256(CAST(user_id AS VARCHAR) || '|' || strftime(x, '%Y%m%d') || '|' || strftime(x + 7, '%Y%m%d')), 16) AS id FROM e)
  SELECT id, nullif(regexp_extract(id, '_(\\d{{8}})_(\\d{{8}})', 2), '') AS transition, string_split(id, '_')[-1] AS grp FROM i""")
def question_ids(spark, sf):
    """Names of questions between snapshots, and the snapshot and group read back from them."""
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("date").alias("x")).distinct()
    i = e.select(cx.question_id(F.col("x"), F.date_add("x", 7), F.col("user_id").cast("string")).alias("id"))
    return i.select("id", cx.id_parts(F.col("id")).alias("p")).select("id", "p.transition", F.col("p.group").alias("grp"))


@query("""WITH o AS (SELECT o_custkey AS id, o_orderkey AS ord, o_orderkey % 7 AS source, o_orderkey // 3 % 5 AS a, o_orderkey % 3 AS b FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY a DESC, b DESC, source, ord DESC) AS n FROM o) SELECT id, ord, source, a, b FROM r WHERE n = 1""")
def richest_records(spark, sf):
    """The fullest of the records of one id from several sources, the earliest source if they are alike."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 7).alias("source"), (F.floor(F.col("o_orderkey") / 3) % 5).alias("a"), (F.col("o_orderkey") % 3).alias("b"))
    # of one source the last record counts
    return cx.richest(o.groupBy("id", "source", "a", "b").agg(F.max("ord").alias("ord")).select("id", "ord", "source", "a", "b"), "id", [F.col("a"), F.col("b")], "source")


@query("""SELECT c_custkey AS id, c_nationkey % 3 AS part FROM customer WHERE c_acctbal > 0""")
def partition_merge(spark, sf):
    """The wanted rows of disjoint partitions, put together and checked."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).alias("part"), "c_acctbal")
    return cx.merge_partitions([c.filter(F.col("part") == k).select("id", "part") for k in range(3)], c.filter("c_acctbal > 0"), "id")


@query(f"""WITH o AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS x, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%dT00') AS y, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE ' ' || o_orderpriority END AS rel, CASE o_orderstatus WHEN 'F' THEN ' Yes' WHEN 'O' THEN 'no' ELSE o_orderstatus END AS gold FROM orders)
  SELECT left(x, 10) || '_to_' || left(y, 10) AS transition, lower(trim(coalesce(rel, 'unknown'))) AS relation, CASE WHEN lower(trim(gold)) IN ('yes', 'no') THEN 'binary' ELSE 'open' END AS style, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY 1, 2, 3""")
def record_strata(spark, sf):
    """Records by transition, relation and style of their answer."""
    o = table(spark, sf, "orders")
    gold = F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "no").otherwise(F.col("o_orderstatus"))
    day = lambda n, f: F.date_format(F.col("o_orderdate").cast("timestamp") + F.expr(f"interval {n} days"), f)
    s = cx.stratum(day(0, "yyyy-MM-dd"), day(30, "yyyy-MM-dd'T'00"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), "o_orderpriority")), gold)
    return o.select(s.alias("s")).groupBy("s.transition", "s.relation", "s.style").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS id, s_nationkey AS relation FROM supplier ORDER BY md5('plot|' || CAST(s_suppkey AS VARCHAR)), s_suppkey LIMIT 50""")
def seeded_sample(spark, sf):
    """Fifty rows by a seeded hash: a sampling operator."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("relation"))
    return s.orderBy(F.md5(F.concat(F.lit("plot|"), F.col("id").cast("string"))), "id").limit(50)


@query(f"""WITH q AS (SELECT item_id, text, CASE WHEN item_id % 3 = 0 THEN '' ELSE left(text, 30) END AS title FROM benchmark) SELECT item_id, CASE WHEN title <> '' THEN '"' || replace(title, '"', '""') || '"' END AS phrase FROM q""")
def title_phrases(spark, sf):
    """The first step of the query ladder where a title is known: the title as a phrase."""
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"), F.when(F.col("item_id") % 3 == 0, "").otherwise(F.left("text", F.lit(30))).alias("title"))
    first = rt.ladder(q, title="title").withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy("step"))).filter("n = 1")
    return q.join(first, "item_id").select("item_id", F.when(F.col("title") != "", F.col("q")).alias("phrase"))


@query(f"""WITH q AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS n, {norm('text')} AS answer FROM conversations) SELECT role, conv_id, turn, md5(answer) AS answer_md5 FROM q WHERE n = 1""")
def last_linkage(spark, sf):
    """The last row of each key of a linkage file."""
    from tidemark.sources.records import last_by_key

    c = table(spark, sf, "conversations").select("role", "conv_id", "turn", F.md5(tx.normalize(F.col("text"))).alias("answer_md5"))
    return last_by_key(c, "role", "conv_id", "turn")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM documents")
def split_lists(spark, sf):
    """Documents written as JSON lists, one list a file, and the lists' members read back by blocks of the files."""

    def listed(batches):
        import pyarrow as pa

        # a line a member; a comma ends the line before it
        mark = "["
        for b in batches:
            lines = []
            for item in b["value"].to_pylist():
                lines.append(mark + item)
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"])], names=["value"])

    path = new_path(spark, "lists")
    table(spark, sf, "documents").select(F.to_json(F.struct("doc_id", "text")).alias("value")).mapInArrow(listed, "value string").write.text(path)
    d = split_json(spark, path).select(F.from_json("item", "doc_id long, text string").alias("d")).select("d.*")
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))
