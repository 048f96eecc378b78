"""One query for each training-data operator over its whole table, and its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, clusters, licenses, repair
from tidemark.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.chat import rotate

    return rotate(_table(spark, sf_dir, "conversations"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import SHARDS, external_shuffle, shard_of, size_of, slots

    out = external_shuffle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    # sizes and checksums are taken while the shards are read, so that no text goes through the join
    rows = slots(spark, out, ["doc_id", size_of(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("__shard").cast("int").alias("shard"), F.col("__slot").alias("slot"), shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontam import scan

    return scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.langid import fit, predict
    from tidemark.llm.toxicity import held_out

    docs = _table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    return predict(docs, fit(docs, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import fit, held_out, score

    docs = _table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 5, 0)
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels"), ~out))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_id_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.tokenstore import TokenStore

    docs = _table(spark, sf_dir, "documents")
    store = TokenStore.write(docs)
    return store.read(store.lookup(docs), payload=False)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import KINDS, find_pii

    found = find_pii(_table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.array_remove(F.transform("base", lambda s: F.when(s["kind"] == F.lit(k), k).otherwise("")), "")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.clusters import kmeans, report

    return report(*kmeans(_table(spark, sf_dir, "embeddings"))).drop("scans")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    found = repair.with_all(rows, repair.digests(repair.repair(repair.damage(rows))))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, md5(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT p.doc_id AS a, q.doc_id AS b FROM c JOIN n nx ON nx.r = c.x JOIN n ny ON ny.r = c.y JOIN w p ON p.r = c.x JOIN w q ON q.r = c.y WHERE 100 * common >= 75 * (nx.n + ny.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
k AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.component, w.doc_id) AS component_id, coalesce(k.component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.r = w.r LEFT JOIN k ON k.a = w.doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_sharding": op3_sharding,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_token_id_binary": op7_token_id_binary,
    "op8_packing": op8_packing,
    "op9_pii": op9_pii,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_license_scans": op11_license_scans,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op2_chat_formatting": chat.SQL,
    "op4_benchmark_decontamination": OP4_SQL,
    "op10_minhash_near_dedup": OP10_SQL,
    "op11_license_scans": licenses.SQL,
    "op12_centroid_clustering": clusters.SQL,
    "op13_conversation_repair": repair.SQL,
}
