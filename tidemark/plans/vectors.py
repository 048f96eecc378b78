"""Queries over answer vectors and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import cache as ch
from tidemark.operators import distances as ds
from tidemark.operators import tiles
from tidemark.functions import text as tx
from tidemark.shared import shared_dir
from tidemark.plans.views import SPANS, VECTORS, f1, norm, spans, table, toks, vectors

_PAIRS = f"""{VECTORS}, p AS (SELECT a.question_id, a.vec_id AS i, b.vec_id AS j, CASE WHEN a.condition = 'stale_only' AND b.condition = 'stale_only' THEN 'xx' WHEN a.condition = 'current_only' AND b.condition = 'current_only' THEN 'yy' WHEN a.condition = 'stale_only' THEN 'xy' END AS side,
  list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS sq FROM vectors a JOIN vectors b ON a.question_id = b.question_id)"""


@query(f"WITH {_PAIRS} SELECT question_id, round(greatest(0.0, 2 * avg(sqrt(sq)) FILTER (WHERE side = 'xy') - avg(sqrt(sq)) FILTER (WHERE side = 'xx') - avg(sqrt(sq)) FILTER (WHERE side = 'yy')), 6) AS energy FROM p GROUP BY 1")
def energy_by_pair(spark, sf):
    return tiles.energy(vectors(spark, sf)).select(F.col("question_id").cast("int").alias("question_id"), F.round("energy", 6).alias("energy"))


@query(f"""WITH {_PAIRS}, s AS (SELECT question_id, quantile_cont(sqrt(sq), 0.5) AS sigma FROM p WHERE i < j AND sq > 0 GROUP BY 1), k AS (SELECT p.*, exp(-sq / greatest(2 * sigma * sigma, 1e-12)) AS k FROM p JOIN s USING (question_id))
  SELECT question_id, round(greatest(0.0, coalesce(avg(k) FILTER (WHERE side = 'xx' AND i <> j), 0) + coalesce(avg(k) FILTER (WHERE side = 'yy' AND i <> j), 0) - 2 * coalesce(avg(k) FILTER (WHERE side = 'xy'), 0)), 6) AS mmd FROM k GROUP BY 1""")
def mmd_by_pair(spark, sf):
    return tiles.mmd(vectors(spark, sf)).select(F.col("question_id").cast("int").alias("question_id"), F.round("mmd", 6).alias("mmd"))


_CENT = "cen AS (SELECT question_id, condition, list(m ORDER BY i) AS c FROM (SELECT question_id, condition, i, avg(x) AS m FROM (SELECT question_id, condition, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM {t}) GROUP BY 1, 2, 3) GROUP BY 1, 2)"
_UNIT = "u AS (SELECT question_id, condition, vec_id, CASE WHEN list_dot_product(v, v) > 0 THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) ELSE v END AS v FROM vectors)"


@query(f"WITH {VECTORS}, {_CENT.format(t='vectors')} SELECT a.question_id, round(list_distance(a.c, b.c), 6) AS centroid_gap FROM cen a JOIN cen b ON a.question_id = b.question_id AND a.condition = 'stale_only' AND b.condition = 'current_only'")
def centroid_gap(spark, sf):
    return _gap(ds.centroids(vectors(spark, sf), ["question_id", "condition"]), "centroid_gap")


def _gap(c, name):
    a, b = (c.filter(F.col("condition") == k).select("question_id", F.col("centroid").alias(n)) for k, n in (("stale_only", "a"), ("current_only", "b")))
    return a.join(b, "question_id").select("question_id", F.round(F.sqrt(ds.squared(F.col("a"), F.col("b"))), 6).alias(name))


@query(f"WITH {VECTORS}, {_UNIT}, {_CENT.format(t='u')} SELECT a.question_id, round(list_distance(a.c, b.c), 6) AS centroid_shift FROM cen a JOIN cen b ON a.question_id = b.question_id AND a.condition = 'stale_only' AND b.condition = 'current_only'")
def centroid_shift(spark, sf):
    v = vectors(spark, sf).withColumn("v", ds.unit(F.col("v")))
    return _gap(ds.centroids(v, ["question_id", "condition"]), "centroid_shift")


@query(f"""WITH {VECTORS}, {_UNIT}, q AS (SELECT * FROM u WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, u.vec_id, round(list_dot_product(q.v, u.v), 6) AS cosine FROM q JOIN u ON q.question_id = u.question_id AND q.vec_id <> u.vec_id),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def cosine_topk(spark, sf):
    """The five vectors of a question most similar to each query vector."""
    u = vectors(spark, sf).withColumn("v", ds.unit(F.col("v")))
    q = u.filter("vec_id % 50 = 0").select("question_id", F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    s = q.join(u, "question_id").filter("query_id <> vec_id").select("query_id", "vec_id", F.round(ds.dot(F.col("qv"), F.col("v")), 6).alias("cosine"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))).filter("rank <= 5")


@query(f"WITH {SPANS}, c AS (SELECT question_id, answer, count(*) AS c FROM spans GROUP BY 1, 2), p AS (SELECT question_id, c / sum(c) OVER (PARTITION BY question_id) AS p FROM c) SELECT question_id, round(greatest(0.0, -sum(p * ln(p + 1e-12))), 6) AS entropy FROM p GROUP BY 1")
def entropy_by_cell(spark, sf):
    return ds.entropy(spans(spark, sf), ["question_id"], "answer").select("question_id", F.round("entropy", 6).alias("entropy"))


@query(f"""WITH {SPANS}, c AS (SELECT question_id, answer, sum(CASE WHEN start_ts < TIMESTAMP '2024-01-15' THEN 1.0::DOUBLE ELSE 0 END) AS l, sum(CASE WHEN start_ts >= TIMESTAMP '2024-01-15' THEN 1.0::DOUBLE ELSE 0 END) AS r FROM spans GROUP BY 1, 2),
  p AS (SELECT question_id, l / greatest(sum(l) OVER w, 1e-12) AS p, r / greatest(sum(r) OVER w, 1e-12) AS q FROM c WINDOW w AS (PARTITION BY question_id))
  SELECT question_id, round(0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END), 6) AS js FROM p GROUP BY 1""")
def js_by_pair(spark, sf):
    old = F.col("start_ts") < F.lit("2024-01-15").cast("timestamp")
    return ds.js(spans(spark, sf), "question_id", "answer", old, ~old).select("question_id", F.round("js", 6).alias("js"))


@query()
def semantic_volume(spark, sf):
    return tiles.volumes(vectors(spark, sf)).select(F.col("question_id").cast("int").alias("question_id"), "condition", F.round("volume", 6).alias("volume"))


@query()
def sliced_wasserstein(spark, sf):
    return tiles.sliced(vectors(spark, sf)).select(F.col("question_id").cast("int").alias("question_id"), F.round("swd", 6).alias("swd"))


@query()
def agglomerative_clusters(spark, sf):
    """Average-linkage clusters of a question's pooled answers, each named by its smallest vector."""
    v = vectors(spark, sf)
    return v.select("question_id", "vec_id", "condition").join(tiles.average_linkage(v, 0.3), ["question_id", "vec_id"])


@query()
def cluster_js(spark, sf):
    """Jensen-Shannon divergence of the pooled clusters' shares before and after."""
    c = agglomerative_clusters(spark, sf)
    old = F.col("condition") == "stale_only"
    return ds.js(c, "question_id", "cluster", old, ~old).select("question_id", F.round("js", 6).alias("cluster_js"))


_EDGES = "eq AS (SELECT c_custkey AS a, c_nationkey AS k1, CAST(floor(c_acctbal / 500) AS BIGINT) AS k2 FROM customer)"
_EQUAL = "(na <> '' AND nb <> '' AND (contains(na, nb) OR contains(nb, na) OR {f} >= 0.5))"


@query(f"""WITH RECURSIVE c AS (SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') || ' ' || CAST(turn % 3 AS VARCHAR) AS a, {norm("regexp_replace(text, '\\s+', ' ', 'g') || ' ' || CAST(turn % 3 AS VARCHAR)")} AS n FROM conversations), t AS (SELECT *, {toks('n')} AS t FROM c),
  p AS (SELECT x.conv_id, x.turn AS i, y.turn AS j, x.n AS na, y.n AS nb, {f1('x.t', 'y.t')} AS f, list_filter(x.t, lambda e: regexp_matches(e, '^[0-9]+$')) AS mx, list_filter(y.t, lambda e: regexp_matches(e, '^[0-9]+$')) AS my FROM t x JOIN t y ON x.conv_id = y.conv_id AND x.turn < y.turn),
  e AS (SELECT conv_id, i, j FROM p WHERE {_EQUAL.format(f='f')} AND NOT (len(list_filter(mx, lambda v: NOT list_contains(my, v))) > 0 AND len(list_filter(my, lambda v: NOT list_contains(mx, v))) > 0)), bo AS (SELECT conv_id, i, j FROM e UNION SELECT conv_id, j, i FROM e),
  r AS (SELECT conv_id, turn AS i, turn AS j FROM c UNION SELECT r.conv_id, r.i, bo.j FROM r JOIN bo ON bo.conv_id = r.conv_id AND bo.i = r.j) SELECT conv_id, i AS turn, CAST(min(j) AS BIGINT) AS component FROM r GROUP BY 1, 2""")
def equivalence_components(spark, sf):
    """Clusters of a question's answers: what pairwise equivalence, split where numbers disagree, joins in any number of steps."""
    a = F.concat(F.regexp_replace("text", r"\s+", " "), F.lit(" "), (F.col("turn") % 3).cast("string"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", a.alias("a"))
    same = lambda x, y: tx.lexically_equal(x, y, 0.5) & ~tx.numbers_disagree(x, y)
    return ds.equivalence_clusters(c, ["conv_id"], "turn", "a", same).select("conv_id", "turn", "component")


@query(f"WITH {_EDGES}, f AS (SELECT k1, k2, min(a) AS first FROM eq GROUP BY 1, 2), r AS (SELECT k1, k2, CAST(row_number() OVER (PARTITION BY k1 ORDER BY first) - 1 AS INTEGER) AS label FROM f) SELECT eq.a AS item, label FROM eq JOIN r USING (k1, k2)")
def compact_labels(spark, sf):
    """Labels numbered by first appearance within a group."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("item"), F.col("c_nationkey").alias("k1"), F.floor(F.col("c_acctbal") / 500).alias("k2"))
    first = c.groupBy("k1", "k2").agg(F.min("item").alias("first"))
    labels = first.withColumn("label", F.row_number().over(Window.partitionBy("k1").orderBy("first")) - 1).drop("first")
    return c.join(labels, ["k1", "k2"]).select("item", "label")


@query(f"WITH {VECTORS}, {_UNIT} SELECT vec_id, round(list_dot_product(v, v), 6) AS norm2, round(v[1], 6) AS first FROM u")
def l2_normalize(spark, sf):
    u = vectors(spark, sf).withColumn("v", ds.unit(F.col("v")))
    return u.select("vec_id", F.round(ds.dot(F.col("v"), F.col("v")), 6).alias("norm2"), F.round(F.col("v")[0], 6).alias("first"))


@query(f"""WITH t AS (SELECT conv_id, unnest({toks(norm('text'))}) AS token FROM conversations), h AS (SELECT conv_id, (('0x' || substr(md5(token), 1, 8))::BIGINT) % 768 AS bin, CASE WHEN (('0x' || substr(md5(token), 9, 8))::BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS w FROM t),
  s AS (SELECT conv_id, bin, CAST(sum(w) AS DOUBLE) AS x FROM h GROUP BY 1, 2 HAVING sum(w) <> 0), n AS (SELECT conv_id, sqrt(sum(x * x)) AS norm FROM s GROUP BY 1) SELECT s.conv_id, bin, round(x / norm, 6) AS value FROM s JOIN n ON n.conv_id = s.conv_id""")
def hashing_embedding(spark, sf):
    """Unit vectors of hashed token counts, where no model gives vectors."""
    e = ds.hashed_embedding(table(spark, sf, "conversations"), "conv_id", F.col("text"))
    return e.select("conv_id", "bin", F.round("value", 6).alias("value"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, unnest({toks(norm('text'))}) AS token FROM conversations), h AS (SELECT conv_id, turn, (('0x' || substr(md5(token), 1, 8))::BIGINT) % 64 AS bin, CASE WHEN (('0x' || substr(md5(token), 9, 8))::BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS w FROM t),
  s AS (SELECT conv_id, turn, bin, CAST(sum(w) AS DOUBLE) AS x FROM h GROUP BY 1, 2, 3), n AS (SELECT conv_id, turn, greatest(max(x) / nullif(sqrt(sum(x * x)), 0), 0) AS top FROM s GROUP BY 1, 2)
  SELECT c.conv_id, c.turn, round(coalesce(top, 0.0), 6) AS top, c.text IN (SELECT text FROM conversations WHERE role = 'assistant') AS cached FROM conversations c LEFT JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn""")
def embedding_cache(spark, sf):
    """Vectors of all messages from a cache that a first run has filled with the assistant's: each text is encoded once."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    cache = ch.Cache(spark, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}", "hashed-64", ch.hashed)
    cache.encoded(c.filter("role = 'assistant'"), "text")
    found, _ = cache.encoded(c, "text")
    return found.select("conv_id", "turn", F.round(F.array_max("v"), 6).alias("top"), "cached")


@query()
def density_clusters(spark, sf):
    """Density clusters of a question's pooled answers; noise is a cluster of its own each."""

    found = tiles.density_clusters(vectors(spark, sf), 4)
    return found.select(F.col("question_id").cast("int").alias("question_id"), "vec_id", "cluster")


@query()
def projection_2d(spark, sf):
    """The two principal components of all vectors, each with its largest weight positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors(spark, sf).select("vec_id", array_to_vector("v").alias("x"))
    model = PCA(k=2, inputCol="x", outputCol="p").fit(v)
    weights = model.pc.toArray()
    sign = [1.0 if weights[abs(weights[:, k]).argmax(), k] > 0 else -1.0 for k in (0, 1)]
    p = model.transform(v).select("vec_id", vector_to_array("p").alias("p"))
    return p.select("vec_id", *(F.round(F.col("p")[k] * sign[k], 6).alias(n) for k, n in enumerate(("x", "y"))))
