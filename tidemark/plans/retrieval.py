"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import tables, urls
from tidemark.functions import text as tx
from tidemark.operators import index as ix
from tidemark.operators import retrieval as rt
from tidemark.plans.answers import _BARE, _RAW, _STOP
from tidemark.plans.views import ARTICLES, QUESTIONS, articles, questions, table
from tidemark.shared import written

CUTOFF = "2023-06-30"
_SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_TITLE = f"left(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda s: {_SQUEEZE.format('s')}), lambda s: length(s) >= 8)[1], {_SQUEEZE.format('text')}), 180)"
PASSAGES = f"""{ARTICLES}, w AS (SELECT *, {_TITLE} AS title, list_filter(string_split({_SQUEEZE.format('text')}, ' '), lambda x: x <> '') AS words FROM articles),
k AS (SELECT *, unnest(range(0, CAST(greatest(ceil((len(words) - 180) / 140.0), 0) AS BIGINT) + 1)) AS step FROM w WHERE len(words) > 0),
h AS (SELECT *, array_to_string(words[step * 140 + 1 : step * 140 + 180], ' ') AS chunk FROM k),
passages AS (SELECT doc_id, article_id, url, ts, title, chunk, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INTEGER) AS chunk_index, doc_id * 16777216 + row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS pid FROM h WHERE length(chunk) >= 80)"""
_FOLD = f"regexp_extract_all(translate(lower({{0}}), '{ix.ACCENTED}', '{ix.PLAIN}'), '([a-z0-9ß]+)', 1)"
FTS = f"""{PASSAGES}, {QUESTIONS}, tok AS (SELECT pid, unnest({_FOLD.format('title')}) AS term, 3.0 AS w FROM passages UNION ALL SELECT pid, unnest({_FOLD.format('chunk')}) AS term, 1.0 AS w FROM passages),
sz AS (SELECT pid, count(*) AS size FROM tok GROUP BY 1), post AS (SELECT pid, term, CAST(sum(w) AS DOUBLE) AS f FROM tok GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), st AS (SELECT count(*) AS n, avg(size) AS mean FROM sz)"""
_IDF = "CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END"
_PART = f"({_IDF}) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))"
_TERMS = f"list_filter(list_transform({_RAW.format('lower(question)')}, lambda t: {_BARE.format('t')}), lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))"


def _passages(spark, sf):
    return rt.passages(articles(spark, sf))


@query(f"WITH {PASSAGES} SELECT pid, chunk_index, md5(chunk) AS chunk_md5, title FROM passages")
def chunk_words(spark, sf):
    return _passages(spark, sf).select("pid", "chunk_index", F.md5("chunk").alias("chunk_md5"), "title")


@query(f"WITH {PASSAGES} SELECT doc_id, chunk_index, md5(chunk) AS chunk_md5 FROM passages")
def passages_by_sql(spark, sf):
    """Word windows by a table function in SQL."""
    tables.register(table(spark, sf, "documents").sparkSession)
    return spark.sql("SELECT d.doc_id, p.chunk_index, md5(p.chunk) AS chunk_md5 FROM {docs} d, LATERAL word_passages(d.text, 180, 40, 80) p", docs=table(spark, sf, "documents"))


@query(f"""WITH s AS (SELECT doc_id, {_SQUEEZE.format('text')} AS t FROM documents), k AS (SELECT *, unnest(range(0, CAST(greatest(ceil((length(t) - 1200) / 1000.0), 0) AS BIGINT) + 1)) AS k FROM s WHERE t <> ''),
  r AS (SELECT *, substring(t, k * 1000 + 1, 1200) AS raw FROM k), c AS (SELECT doc_id, k, trim(CASE WHEN k * 1000 + 1200 < length(t) AND contains(raw, ' ') THEN regexp_replace(raw, ' [^ ]*$', '') ELSE raw END) AS chunk FROM r)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS chunk_index, md5(chunk) AS chunk_md5 FROM c WHERE chunk <> ''""")
def chunk_chars(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(tx.char_chunks(F.col("text"))).alias("c"))
    return d.select("doc_id", "c.chunk_index", F.md5("c.chunk").alias("chunk_md5"))


@query(f"SELECT doc_id, {_TITLE} AS title FROM documents")
def title_infer(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.title_of(F.col("text")).alias("title"))


@query(f"""WITH {FTS}, q AS (SELECT item_id, unnest(list_filter({_TERMS}, lambda t, j: list_position({_TERMS}, t) = j)[1:24]) AS term FROM questions),
  s AS (SELECT q.item_id, post.pid, round(sum({_PART}), 9) AS score FROM q JOIN df USING (term) JOIN post USING (term) JOIN sz ON sz.pid = post.pid, st GROUP BY 1, 2),
  r AS (SELECT s.*, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, s.pid) AS rank FROM s JOIN passages p ON p.pid = s.pid WHERE p.ts <= TIMESTAMP '{CUTOFF}')
  SELECT item_id, pid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def retrieval_fts_weighted(spark, sf):
    q = questions(spark, sf)
    index = rt.weighted_index(articles(spark, sf), questions=q)
    scores = ix.top_passages(index, rt.query_terms(q), "item_id", 10, CUTOFF).withColumn("score", F.round("score", 9))
    top = rt.top_k(scores, ["item_id"], [F.desc("score"), F.asc("pid")], 10)
    return top.select("item_id", "pid", F.round("score", 6).alias("score"), "rank")


_STEM = """list_transform(list_transform({0}, lambda t: CASE WHEN t LIKE '%ing' AND length(t) > 5 THEN left(t, length(t) - 3) WHEN NOT (t LIKE '%ing' AND length(t) > 5) AND t LIKE '%ed' AND length(t) > 4 THEN left(t, length(t) - 2) ELSE t END),
  lambda t: CASE WHEN t LIKE '%ies' AND length(t) > 5 THEN left(t, length(t) - 3) || 'y' WHEN t LIKE '%s' AND length(t) > 4 THEN left(t, length(t) - 1) ELSE t END)"""


def _search(c: str) -> str:
    bare = f"list_transform({_RAW.format(f'lower({c})')}, lambda t: {_BARE.format('t')})"
    return f"list_filter({_STEM.format(bare)}, lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))"


SCORES = f"""{PASSAGES}, {QUESTIONS}, body AS (SELECT pid, term, count(*) AS tf FROM (SELECT pid, unnest({_search('chunk')}) AS term FROM passages) GROUP BY 1, 2),
  sz AS (SELECT pid, len({_search('chunk')}) AS size FROM passages WHERE len({_search('chunk')}) > 0), ttl AS (SELECT DISTINCT pid, term FROM (SELECT pid, unnest({_search('title')}) AS term FROM passages)),
  post AS (SELECT coalesce(body.pid, ttl.pid) AS pid, coalesce(body.term, ttl.term) AS term, coalesce(tf, 0) AS tf, CASE WHEN ttl.pid IS NULL THEN 0 ELSE 1 END AS in_title FROM body FULL JOIN ttl ON body.pid = ttl.pid AND body.term = ttl.term),
  st AS (SELECT count(*) AS n, avg(size) AS mean FROM sz), df AS (SELECT term, count(*) AS df FROM body GROUP BY 1), qt AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_search('question')}) AS term FROM questions) GROUP BY 1, 2),
  j AS (SELECT qt.item_id, post.pid, times, tf, in_title, size, mean, coalesce(ln((n + 1) / (df + 1)) + 1, 1.0) AS smooth, coalesce(ln(1 + (n - df + 0.5) / (df + 0.5)), 0.0) AS okapi
    FROM qt JOIN post ON qt.term = post.term JOIN sz ON sz.pid = post.pid LEFT JOIN df ON df.term = qt.term, st),
  scores AS (SELECT item_id, pid, sum(times * (smooth * least(tf, 3) + in_title * 0.35 * smooth)) / sqrt(any_value(size)) AS lexical,
    sum(CASE WHEN tf > 0 THEN times * (okapi * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * size / mean)) + in_title * 0.35 * greatest(okapi, 0.1)) ELSE 0.0 END) AS bm25 FROM j GROUP BY 1, 2),
  live AS (SELECT s.*, p.ts FROM scores s JOIN passages p ON p.pid = s.pid WHERE p.ts <= TIMESTAMP '{CUTOFF}')"""


@query(f"WITH {FTS} SELECT df.term, df.df, round(max(f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS top FROM df JOIN post USING (term) JOIN sz USING (pid), st GROUP BY ALL")
def index_terms(spark, sf):
    """The terms of the written index: document frequencies and the largest weight of a posting.  The first query of an application writes it."""
    return rt.weighted_index(articles(spark, sf), positions=True).terms.select("term", "df", F.round("top", 6).alias("top"))


@query(f"WITH {SCORES} SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(count(*) FILTER (tf > 0) AS BIGINT) AS df_body FROM post JOIN sz USING (pid) GROUP BY ALL")
def search_terms(spark, sf):
    """The stemmed terms of the written search index."""
    return rt.search_index(articles(spark, sf)).terms.select("term", "df", "df_body")


_PHRASE = f"list_filter({_FOLD.format('question')}, lambda x: true)[1:5]"


@query(f"""WITH {PASSAGES}, {QUESTIONS}, q AS (SELECT item_id, {_PHRASE} AS w FROM questions), c AS (SELECT pid, {_FOLD.format('title')} AS t FROM passages WHERE ts <= TIMESTAMP '{CUTOFF}' UNION ALL SELECT pid, {_FOLD.format('chunk')} AS t FROM passages WHERE ts <= TIMESTAMP '{CUTOFF}'),
  n AS (SELECT pid, t[i : i + k - 1] AS w FROM (SELECT pid, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM c, (SELECT DISTINCT len(w) AS k FROM q) WHERE k > 0))
  SELECT item_id, pid, count(*) AS places FROM q JOIN n USING (w) GROUP BY ALL""")
def phrase_match(spark, sf):
    """Passages in which a question's first five terms stand as a phrase, by intersecting positions of the index."""
    phrases = questions(spark, sf).select("item_id", F.slice(ix.folded_terms(F.col("question")), 1, 5).alias("phrase"))
    return ix.phrase_hits(rt.weighted_index(articles(spark, sf), positions=True), phrases, "item_id", CUTOFF)


def _live_scores(spark, sf):
    q = questions(spark, sf)
    return rt.lexical_scores(rt.search_index(articles(spark, sf), q), q, CUTOFF)


def _top(rows, column):
    top = rt.top_k(rows.withColumn("score", F.round(column, 9)), ["item_id"], [F.desc("score"), F.desc("ts"), F.asc("pid")], 10)
    return top.select("item_id", "pid", F.round("score", 6).alias("score"), "rank")


def _top_sql(column: str) -> str:
    return f"""SELECT item_id, pid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ts DESC, pid) AS rank FROM (SELECT *, round({column}, 9) AS score FROM live)) WHERE rank <= 10"""


@query(f"WITH {SCORES} {_top_sql('lexical')}")
def lexical_score_topk(spark, sf):
    return _top(_live_scores(spark, sf), F.col("lexical"))


@query(f"WITH {SCORES} {_top_sql('bm25')}")
def retrieval_bm25_topk(spark, sf):
    return _top(_live_scores(spark, sf), F.col("bm25"))


def _minmax_sql(c: str) -> str:
    lo, hi = f"CASE WHEN others > 0 THEN least(min({c}) OVER i, 0.0) ELSE min({c}) OVER i END", f"max({c}) OVER i"
    return f"CASE WHEN abs({hi} - ({lo})) <= 1e-9 * greatest(abs({hi}), abs({lo})) THEN CASE WHEN {hi} = 0 THEN 0.0 ELSE 1.0 END ELSE ({c} - ({lo})) / ({hi} - ({lo})) END"


@query(f"""WITH {SCORES.replace('live AS', 'live0 AS')}, tot AS (SELECT count(*) AS total FROM passages WHERE ts <= TIMESTAMP '{CUTOFF}'), lo AS (SELECT *, total - count(*) OVER (PARTITION BY item_id) AS others FROM live0, tot),
  live AS (SELECT *, 0.5 * ({_minmax_sql('lexical')}) + 0.5 * ({_minmax_sql('bm25')}) AS hybrid FROM lo WINDOW i AS (PARTITION BY item_id)) {_top_sql('hybrid')}""")
def hybrid_minmax_topk(spark, sf):
    live = rt.search_index(articles(spark, sf), questions(spark, sf)).passages.filter(F.col("ts") <= F.lit(CUTOFF).cast("timestamp")).count()
    rows = rt.minmax(_live_scores(spark, sf), "item_id", ["lexical", "bm25"], live)
    return _top(rows, 0.5 * F.col("lexical_minmax") + 0.5 * F.col("bm25_minmax"))


def _ladder_sql() -> str:
    from tidemark.catalog import ORACLES

    inner = ORACLES["query_ladder"].removeprefix("WITH ")
    body, last = inner.rsplit("\n  SELECT", 1)
    return f"{body}, ladder AS (SELECT{last})"


_FUSED = f"""{FTS}, {_ladder_sql()}, lt AS (SELECT DISTINCT item_id, step, contains(match_query, ' OR ') AS broad, unnest(list_transform(string_split_regex(match_query, ' (?:AND|OR) '), lambda x: replace(x, '"', ''))) AS term FROM ladder),
  ln AS (SELECT *, CASE WHEN broad THEN 1 ELSE count(*) OVER (PARTITION BY item_id, step) END AS need FROM lt),
  hit AS (SELECT ln.item_id, ln.step, ln.broad, ln.need, post.pid, round(sum({_PART}), 9) AS score, count(*) AS matched FROM ln JOIN df USING (term) JOIN post USING (term) JOIN sz ON sz.pid = post.pid, st GROUP BY 1, 2, 3, 4, 5),
  rk AS (SELECT hit.*, p.ts, p.article_id, row_number() OVER (PARTITION BY item_id, step ORDER BY score DESC, hit.pid) AS query_rank FROM hit JOIN passages p ON p.pid = hit.pid WHERE matched >= need AND p.ts <= TIMESTAMP '{CUTOFF}'),
  rk2 AS (SELECT * FROM rk WHERE query_rank <= 100), pool AS (SELECT item_id, count(DISTINCT pid) AS pool FROM rk2 WHERE NOT broad GROUP BY 1),
  mg AS (SELECT rk2.item_id, pid, ts, article_id, round(sum(1.0 / (60 + query_rank)), 9) AS sparse_rrf, max(score) AS bm25 FROM rk2 LEFT JOIN pool ON pool.item_id = rk2.item_id WHERE NOT broad OR coalesce(pool, 0) < 40 GROUP BY 1, 2, 3, 4),
  sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sparse_rrf DESC, bm25 DESC, ts DESC, pid) AS sparse_rank FROM mg) WHERE sparse_rank <= 100),
  qc AS (SELECT item_id, term, CAST(count(*) AS DOUBLE) AS c FROM (SELECT item_id, unnest({_FOLD.format('question')}) AS term FROM questions) GROUP BY 1, 2), qn AS (SELECT item_id, sqrt(sum(c * c)) AS norm FROM qc GROUP BY 1),
  dc AS (SELECT pid, term, CAST(count(*) AS DOUBLE) AS c FROM (SELECT pid, unnest({_FOLD.format('chunk')}) AS term FROM passages) GROUP BY 1, 2), dn AS (SELECT pid, sqrt(sum(c * c)) AS norm FROM dc GROUP BY 1),
  ds AS (SELECT sp.item_id, sp.pid, sum(qc.c * dc.c) / (any_value(qn.norm) * any_value(dn.norm)) AS dense FROM sp JOIN qc ON qc.item_id = sp.item_id JOIN dc ON dc.pid = sp.pid AND dc.term = qc.term JOIN qn ON qn.item_id = sp.item_id JOIN dn ON dn.pid = sp.pid GROUP BY 1, 2),
  bo AS (SELECT sp.*, round(coalesce(ds.dense, 0.0), 9) AS dense FROM sp LEFT JOIN ds ON ds.item_id = sp.item_id AND ds.pid = sp.pid),
  dr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dense DESC, sparse_rank) AS dense_rank FROM bo),
  sc AS (SELECT *, round(1.0 / (60 + sparse_rank) + 1.0 / (60 + dense_rank), 9) AS rrf_score FROM dr),
  pl AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf_score DESC, dense DESC, sparse_rrf DESC, pid) AS place FROM sc)"""


def _first_sql(keys: str) -> str:
    return f"""SELECT item_id, pid, CAST(sparse_rank AS INTEGER) AS sparse_rank, CAST(dense_rank AS INTEGER) AS dense_rank, round(rrf_score, 6) AS rrf_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY place) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY item_id, {keys} ORDER BY place) AS nth FROM pl) WHERE nth = 1) WHERE rank <= 10"""


def _first(spark, sf, keys):
    q = questions(spark, sf)
    top = rt.first_per(rt.fused(rt.weighted_index(articles(spark, sf), questions=q), q, CUTOFF), keys, 10)
    return top.select("item_id", "pid", "sparse_rank", "dense_rank", F.round("rrf_score", 6).alias("rrf_score"), "rank")


@query(f"WITH {_FUSED} {_first_sql('ts, article_id')}")
def retrieval_rrf_fusion(spark, sf):
    return _first(spark, sf, ["ts", "article_id"])


@query(f"WITH {_FUSED} {_first_sql('article_id')}")
def retrieval_dedup_scope(spark, sf):
    return _first(spark, sf, ["article_id"])


@query(f"""WITH {_FUSED}, top AS ({_first_sql('ts, article_id')}) SELECT t.item_id, t.rank, md5('[retrieved rank ' || CAST(t.rank AS VARCHAR) || ']' || chr(10) || 'Title: ' || p.title || chr(10) || 'Source URL: ' || p.url || chr(10) || 'Document ID: ' || p.article_id || chr(10) || 'Chunk: ' || CAST(p.chunk_index AS VARCHAR)
  || chr(10) || 'RRF score: ' || printf('%.6f', t.rrf_score) || chr(10) || p.chunk) AS block_md5 FROM top t JOIN passages p ON p.pid = t.pid""")
def retrieved_blocks(spark, sf):
    """The header block and text that a retrieved passage is shown with."""
    # ten rows a question: they are sent to the passages, and no passage is dealt
    best = written(_first(spark, sf, ["ts", "article_id"]))
    top = rt.weighted_index(articles(spark, sf), questions=questions(spark, sf)).texts(best).join(ix.small(best), "pid")
    block = F.concat_ws(
        "\n", F.format_string("[retrieved rank %d]", "rank"), F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Source URL: "), "url"), F.concat(F.lit("Document ID: "), "article_id"),
        F.format_string("Chunk: %d", "chunk_index"), F.format_string("RRF score: %.6f", "rrf_score"), "chunk",
    )
    return top.select("item_id", "rank", F.md5(block).alias("block_md5"))


@query(f"WITH {ARTICLES}, r AS (SELECT article_id, url, ts, doc_id, row_number() OVER (PARTITION BY ts, {_TITLE}, md5(left(text, 400)) ORDER BY ts, doc_id) AS n FROM articles WHERE length(text) >= 80) SELECT article_id, url, ts, doc_id FROM r WHERE n = 1")
def version_dedup(spark, sf):
    """The first of the rows that agree in time, title and first 400 characters; the URL names the document here, so it cannot be in the key."""
    a = articles(spark, sf).filter(F.length("text") >= 80)
    return rt.top_k(a, ["ts", tx.title_of(F.col("text")), F.md5(F.left("text", F.lit(400)))], [F.asc("ts"), F.asc("doc_id")], 1).select("article_id", "url", "ts", "doc_id")


_HOSTP = "'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)'"
_NURL = """lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')
  || coalesce(nullif(regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') || CASE WHEN regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1) = '' THEN '' ELSE '?' || regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1) END"""


@query(f"SELECT page_id, {_NURL} AS normal FROM pages")
def url_normalize_v1(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normal"))


@query(f"""SELECT page_id, regexp_replace(lower(regexp_extract(trim(url), {_HOSTP}, 1)), '^www\\.', '') || regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS url_key FROM pages""")
def url_normalize_v2(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.url_key(F.col("url")).alias("url_key"))


@query("""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/web/20230' || CAST(1 + page_id % 9 AS VARCHAR) || '15120000/x' WHEN 1 THEN '/2022/1' || CAST(page_id % 3 AS VARCHAR) || '/09/a' WHEN 2 THEN '/n-2021-0' || CAST(1 + page_id % 9 AS VARCHAR) || '-11' WHEN 3 THEN '/d20240' || CAST(1 + page_id % 9 AS VARCHAR) || '28z' ELSE '/none' END AS p FROM pages)
  SELECT page_id, CASE WHEN regexp_extract(p, '/web/(\\d{14})/', 1) <> '' THEN try_strptime(regexp_extract(p, '/web/(\\d{14})/', 1), '%Y%m%d%H%M%S')
    ELSE try_strptime(coalesce(nullif(regexp_extract(p, '/(20\\d{2}/(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\\d|3[01]))/', 1), ''), replace(nullif(regexp_extract(p, '(20\\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\\d|3[01]))', 1), ''), '-', '/'),
      regexp_replace(nullif(regexp_extract(p, '(20\\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\\d|3[01]))', 1), ''), '(....)(..)(..)', '\\1/\\2/\\3')), '%Y/%m/%d') END AS ts FROM u""")
def url_timestamp(spark, sf):
    i = F.col("page_id")
    digit = (1 + i % 9).cast("string")
    path = F.when(i % 5 == 0, F.concat(F.lit("/web/20230"), digit, F.lit("15120000/x"))).when(i % 5 == 1, F.concat(F.lit("/2022/1"), (i % 3).cast("string"), F.lit("/09/a"))).when(i % 5 == 2, F.concat(F.lit("/n-2021-0"), digit, F.lit("-11"))).when(i % 5 == 3, F.concat(F.lit("/d20240"), digit, F.lit("28z"))).otherwise("/none")
    return table(spark, sf, "pages").select("page_id", urls.timestamp_of(path).alias("ts"))


@query(f"""WITH n AS (SELECT page_id, {_NURL} AS u FROM pages), s AS (SELECT page_id % 20 AS q, u FROM n WHERE page_id % 3 = 0), r AS (SELECT page_id % 20 AS q, u, row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id DESC) AS rank FROM n),
  x AS (SELECT r.q, r.rank FROM r WHERE EXISTS (SELECT 1 FROM s WHERE s.q = r.q AND s.u = r.u)) SELECT q AS question_id, CAST(count(*) AS BIGINT) AS hits, CAST(min(rank) AS INTEGER) AS best_rank FROM x GROUP BY 1""")
def support_hits(spark, sf):
    """Retrieved rows whose normal URL is among a question's support URLs: how many, and the best rank."""
    from pyspark.sql import Window

    n = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 20).alias("question_id"), urls.normalize_url(F.col("url")).alias("u"))
    support = n.filter("page_id % 3 = 0").select("question_id", "u")
    ranked = n.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("page_id"))))
    return ranked.join(support, ["question_id", "u"], "left_semi").groupBy("question_id").agg(F.count("*").alias("hits"), F.min("rank").alias("best_rank"))


@query(f"WITH {ARTICLES} SELECT article_id, CAST(count(*) AS BIGINT) AS versions, CAST(sum(length(text)) AS BIGINT) AS chars, max(ts) AS latest FROM articles GROUP BY 1")
def article_versions(spark, sf):
    return articles(spark, sf).groupBy("article_id").agg(F.count("*").alias("versions"), F.sum(F.length("text")).alias("chars"), F.max("ts").alias("latest"))
