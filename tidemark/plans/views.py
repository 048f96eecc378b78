"""The domain's tables as views of the synthetic tables, and the same views as SQL for the oracles.

The SQL fragments are common table expressions that oracles put after WITH.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamped documents; two doc_ids in a row are versions of one article."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.concat(F.lit("art"), (F.col("doc_id") / 2).cast("long")).alias("article_id"), F.concat(F.lit("https://www."), "source", F.lit(".example.org/news/"), F.col("doc_id").cast("string")).alias("url"),
        F.date_add(F.lit("2021-12-22").cast("date"), (F.col("doc_id") % 850).cast("int")).cast("timestamp").alias("ts"), "source", "lang", "text",
    )


ARTICLES = """articles AS (
  SELECT doc_id, 'art' || CAST(doc_id // 2 AS VARCHAR) AS article_id, 'https://www.' || source || '.example.org/news/' || CAST(doc_id AS VARCHAR) AS url,
    CAST(DATE '2021-12-22' + CAST(doc_id % 850 AS INTEGER) AS TIMESTAMP) AS ts, source, lang, text FROM documents)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))


QUESTIONS = "questions AS (SELECT item_id, text AS question FROM benchmark)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity of answers: a user's event type holds from its time to that of the user's next event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), F.col("event_type").alias("answer"), F.col("ts").alias("start_ts"), F.lead("ts").over(w).alias("end_ts"), F.col("event_id").alias("ord"))


SPANS = """spans AS (
  SELECT user_id AS question_id, event_type AS answer, ts AS start_ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_ts, event_id AS ord FROM events)"""

#: Snapshots over the events, in order.
CHECKPOINTS = ("2024-01-05", "2024-01-10", "2024-01-15", "2024-01-20", "2024-01-25", "2024-01-29")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id"), F.col("role").alias("condition"), F.col("turn").alias("sample_idx"), F.col("text").alias("answer"))


RESPONSES = "responses AS (SELECT conv_id AS question_id, role AS condition, turn AS sample_idx, text AS answer FROM conversations)"


def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two consecutive turns of a conversation, the later one as the answer to be judged by the earlier."""
    c = table(spark, sf_dir, "conversations")
    left = c.select("conv_id", "turn", F.col("text").alias("reference"))
    right = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return left.join(right, ["conv_id", "turn"])


ANSWER_PAIRS = """pairs AS (
  SELECT a.conv_id, a.turn, a.text AS reference, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer vectors: the label is the question, even ids come from the old snapshot."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("question_id"), F.when(F.col("vec_id") % 2 == 0, "stale_only").otherwise("current_only").alias("condition"), "vec_id", F.col("embedding").cast("array<double>").alias("v")
    )


VECTORS = """vectors AS (
  SELECT label AS question_id, CASE WHEN vec_id % 2 = 0 THEN 'stale_only' ELSE 'current_only' END AS condition, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def event_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of a supplier's lines before and after a date; a third are relabelled as changed."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    flag = (F.col("l_returnflag") == "N").cast("double")
    old = F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp")
    return l.groupBy(F.col("l_suppkey").alias("question_id")).agg(F.avg(F.when(old, flag)).alias("accuracy_stale"), F.avg(F.when(~old, flag)).alias("accuracy_current")).withColumn(
        "change_label", F.when(F.col("question_id") % 3 == 0, "changed").otherwise("stable")
    )


EVENT_QUALITY = """event_quality AS (
  SELECT l_suppkey AS question_id, avg(CASE WHEN l_shipdate < TIMESTAMP '1998-06-01' THEN CAST(l_returnflag = 'N' AS DOUBLE) END) AS accuracy_stale,
    avg(CASE WHEN l_shipdate >= TIMESTAMP '1998-06-01' THEN CAST(l_returnflag = 'N' AS DOUBLE) END) AS accuracy_current,
    CASE WHEN l_suppkey % 3 = 0 THEN 'changed' ELSE 'stable' END AS change_label FROM lineitem GROUP BY l_suppkey)"""


def question_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a question and condition with the metrics that drift labels need."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    cond = F.when(F.col("l_linenumber") % 3 == 0, "mixed").when(F.col("l_linenumber") % 3 == 1, "current_only").otherwise("stale_only")
    n = lambda c: F.round(c, 6)
    return l.groupBy(F.col("l_suppkey").alias("question_id"), cond.alias("condition")).agg(
        n(F.avg((F.col("l_returnflag") == "N").cast("double"))).alias("accuracy"), n(F.avg((F.col("l_returnflag") == "A").cast("double"))).alias("stale_answer_rate"),
        n(F.avg((F.col("l_linestatus") == "O").cast("double"))).alias("current_answer_rate"), n(F.avg((F.col("l_tax") > 0.04).cast("double"))).alias("contradiction_rate"),
        n(F.avg("l_discount") * 10).alias("semantic_entropy"), n(F.avg("l_quantity")).alias("semantic_volume"), n(F.avg("l_extendedprice") / 10000).alias("centroid_shift"), F.countDistinct("l_returnflag").alias("n_clusters"),
    )


QUESTION_METRICS = """question_metrics AS (
  SELECT l_suppkey AS question_id, CASE l_linenumber % 3 WHEN 0 THEN 'mixed' WHEN 1 THEN 'current_only' ELSE 'stale_only' END AS condition,
    round(avg(CAST(l_returnflag = 'N' AS DOUBLE)), 6) AS accuracy, round(avg(CAST(l_returnflag = 'A' AS DOUBLE)), 6) AS stale_answer_rate,
    round(avg(CAST(l_linestatus = 'O' AS DOUBLE)), 6) AS current_answer_rate, round(avg(CAST(l_tax > 0.04 AS DOUBLE)), 6) AS contradiction_rate,
    round(avg(l_discount) * 10, 6) AS semantic_entropy, round(avg(l_quantity), 6) AS semantic_volume, round(avg(l_extendedprice) / 10000, 6) AS centroid_shift,
    count(DISTINCT l_returnflag) AS n_clusters FROM lineitem GROUP BY 1, 2)"""


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y: a document of low quality; score: its share of upper-case letters and signs; split by id."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.round(F.length(F.regexp_replace("text", "[a-z ]", "")) / F.greatest(F.length("text"), F.lit(1)), 4).alias("score"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", (1 - F.col("quality")).cast("int").alias("y"), "score", F.when(F.col("doc_id") % 3 == 0, "t0").otherwise("future").alias("split"))


SCORED_LABELS = """scored AS (
  SELECT l.doc_id, CAST(1 - quality AS INTEGER) AS y, round(length(regexp_replace(text, '[a-z ]', '', 'g')) / greatest(length(text), 1), 4) AS score,
    CASE WHEN l.doc_id % 3 = 0 THEN 't0' ELSE 'future' END AS split FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

# SQL of the text functions, for the oracles
NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[[:punct:]]', '', 'g'), '\\s+', ' ', 'g'))"


def norm(c: str) -> str:
    return NORM.format(c)


def toks(c: str) -> str:
    """Tokens of a normalised text."""
    return f"CASE WHEN {c} = '' THEN [] ELSE string_split({c}, ' ') END"


def f1(a: str, b: str) -> str:
    """Token F1 of two token lists."""
    common = f"coalesce(list_sum(list_transform(list_distinct({a}), lambda t: least(len(list_filter({a}, lambda e: e = t)), len(list_filter({b}, lambda e: e = t))))), 0)"
    return f"CASE WHEN {common} = 0 THEN 0.0 ELSE 2.0 * {common} / (len({a}) + len({b})) END"
