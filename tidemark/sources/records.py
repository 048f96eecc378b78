"""Record sources and sinks: JSON lines, CSV, nested version maps, canonical datasets, append logs."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.nested import split_json

RESPONSE = "question_id string, question string, gold_answer string, condition string, sample_idx long, answer string, context_hash string, error string"
DATASET = "id string, question string, gold_answer string, stale_answer string, current_docs array<string>, stale_docs array<string>, metadata struct<stale_answer:string,old_answer:string,previous_answer:string,time_x:string,time_y:string,change_label:string>"
VERSIONS = "map<string,map<string,struct<source_timestamp:string,source_text:string,archive_url:string>>>"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; a bad line fails the read; a missing path is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(spark: SparkSession, frames: list[DataFrame], path: str) -> None:
    """Ragged frames under the union of their columns, in order of first appearance; no frames make one empty file."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if out is None:
        spark.createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(path)
    else:
        out.write.mode("overwrite").option("header", True).csv(path)


def write_document(value, path: str | Path) -> None:
    """A manifest or setting, as JSON."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def read_document(path: str | Path):
    """A JSON document, or a YAML one where the yaml package is there."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml package") from e
        return yaml.safe_load(text)
    return json.loads(text)


def run_folder(root: str | Path, name: str, settings: dict, stamp: str) -> dict[str, Path]:
    """A new folder ``<stamp>_<name>`` for a run with its parts, and a copy of its settings."""
    base = Path(root) / f"{stamp}_{name}"
    parts = {k: base / k for k in ("samples", "metrics", "figures", "reports")}
    for p in parts.values():
        p.mkdir(parents=True, exist_ok=False)
    write_document(settings, base / "settings.json")
    return {"run": base, **parts}


def read_dataset(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Canonical records; the stale answer is looked for in four places; a missing required field fails."""
    d = read_jsonl(spark, path, DATASET)
    need = F.col("id").isNull() | F.col("question").isNull() | F.col("gold_answer").isNull() | F.col("current_docs").isNull() | F.col("stale_docs").isNull()
    d = d.withColumn("id", F.when(need, F.raise_error(F.lit("a record lacks a required field"))).otherwise(F.col("id")))
    d = d.withColumn("stale_answer", F.coalesce("stale_answer", "metadata.stale_answer", "metadata.old_answer", "metadata.previous_answer"))
    return d.orderBy("id").limit(limit) if limit else d


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, failing when a key comes twice."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key comes more than once: {twice[0].asDict()}")
    return df


def versions(raw: DataFrame, column: str, least: int = 80) -> DataFrame:
    """JSON maps of URL to timestamp to version as one row a version of ``least`` characters or more.

    Of several versions with one archive URL and timestamp, the first stays, by source URL and key.
    """
    urls = raw.select(F.explode(F.from_json(column, T.DataType.fromDDL(VERSIONS))).alias("source_url", "versions")).select("source_url", F.explode("versions").alias("key", "v"))
    rows = urls.select(
        F.trim("source_url").alias("source_url"), F.trim(F.coalesce(F.nullif("v.archive_url", F.lit("")), "source_url")).alias("url"),
        F.trim(F.coalesce(F.nullif("v.source_timestamp", F.lit("")), "key")).alias("timestamp"), F.trim(F.coalesce("v.source_text", F.lit(""))).alias("text"), "key",
    )
    kept = rows.filter((F.col("timestamp") != "") & (F.length("text") >= least))
    first = kept.groupBy("url", "timestamp").agg(F.min_by(F.struct("source_url", "text"), F.struct("source_url", "key")).alias("r"))
    return first.select("r.source_url", "url", "timestamp", "r.text")


def read_versions(spark: SparkSession, path: str, least: int = 80) -> DataFrame:
    """``versions`` of files that hold one map each, however large."""
    return versions(split_json(spark, path), "item", least)


#: Parts of a field's path that say what it holds.
FIELDS = {
    "title": ("title", "headline", "article_title", "source_title", "page_title"),
    "text": ("text", "article_text", "body", "content", "page_content", "source_text", "main_text"),
    "url": ("archive_url", "url", "source_url", "link", "href"),
    "timestamp": ("timestamp", "article_timestamp", "published", "published_at", "publish_date", "date", "datetime", "retrieved_at", "archive_timestamp"),
    "hint": ("question", "questions", "query", "subject", "entity"),
}


def _walk(value, path: str = ""):
    """(path, value) of all that a nested value holds, each before what is inside it."""
    inside = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for key, child in inside:
        here = f"{path}[{key}]" if isinstance(value, list) else f"{path}.{key}" if path else str(key)
        yield here, child
        yield from _walk(child, here)


def _fields(item: str | None, least: int) -> dict[str, str]:
    try:
        found = list(_walk(json.loads(item or "null")))
    except ValueError:
        found = []
    plain = lambda v: " ".join(str(v).split())
    out = {}
    for name, parts in FIELDS.items():
        said = (plain(v) for p, v in found if isinstance(v, (str, int, float)) and any(x in p.lower() for x in parts))
        out[name] = next((t for t in said if t and t.lower() != "nan"), "")
    if not out["text"]:
        long = [t for t in (plain(v) for _, v in found if isinstance(v, str)) if len(t) >= least]
        out["text"] = max(long, key=len, default="")
    return out


def scan_items(items: DataFrame, column: str, carry: list[str], least: int = 80) -> DataFrame:
    """The carried columns with title, text, url, timestamp and hint of JSON items of any shape.

    Each field is the first value, walking down in order, whose path contains one of its names; a text that no
    path names is the longest one of ``least`` characters or more.  A null, broken or bare item has empty fields.
    No column expression walks a value of unknown depth, so this runs in Arrow batches.
    """
    schema = T.StructType([items.schema[c] for c in carry] + [T.StructField(n, T.StringType()) for n in FIELDS])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [_fields(i, least) for i in b.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], *(pa.array([r[n] for r in rows], pa.string()) for n in FIELDS)], names=[*carry, *FIELDS])

    return items.select(*carry, column).mapInArrow(run, schema)


def read_items(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(item) of a file: a JSON object a line (.jsonl), the objects of a list or of a map of objects (.json), or the rows of a CSV file as JSON.

    A .json file is one row first; of a list or map that is too large for that, ``split_json`` gives the members.
    """
    if suffix == ".jsonl":
        return spark.read.text(path).filter(F.trim("value") != "").withColumnRenamed("value", "item")
    if suffix == ".csv":
        rows = spark.read.option("header", True).csv(path)
        return rows.select(F.to_json(F.struct(*rows.columns)).alias("item"))
    if suffix != ".json":
        raise ValueError(f"no reader for {suffix}")
    text = spark.read.option("wholetext", True).text(path)
    listed = F.from_json("value", T.ArrayType(T.StringType()))
    mapped = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    objects = F.size(F.filter(F.map_values(mapped), lambda v: ~F.startswith(F.trim(v), F.lit("{")))) == 0
    one = F.when(F.startswith(F.trim("value"), F.lit("[")), F.filter(listed, lambda v: F.startswith(F.trim(v), F.lit("{")))).when(objects, F.map_values(mapped)).otherwise(F.array("value"))
    return text.select(F.explode(one).alias("item"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question histories of a CSV file: rows without question or answer are dropped, spans are in order."""
    raw = spark.read.option("header", True).csv(path)
    t = lambda c: F.try_to_timestamp(F.col(c))
    rows = raw.select(
        F.trim("Question").alias("question"), F.trim("Answer").alias("answer"), t("Start timestamp").alias("start_ts"), t("End timestamp").alias("end_ts"),
        t("Known start timestamp").alias("known_start_ts"), t("Known end timestamp").alias("known_end_ts"),
    ).filter("question <> '' and answer <> ''")
    key = F.struct(F.coalesce("known_start_ts", "start_ts").alias("begin"), "answer", "start_ts", "end_ts", "known_start_ts", "known_end_ts")
    return rows.groupBy("question").agg(F.array_sort(F.collect_list(key)).alias("spans"))


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """A map of timestamp to questions as (timestamp, question)."""
    raw = split_json(spark, path).select(F.from_json("item", T.DataType.fromDDL("map<string,array<string>>")).alias("m"))
    return raw.select(F.explode("m").alias("t", "questions")).select(F.to_timestamp("t").alias("t"), F.explode("questions").alias("question"))


def last_by_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, by an aggregate that combines before the exchange."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def fingerprints(spark: SparkSession, path: str, block: int = 1 << 20) -> DataFrame:
    """(path, sha256) of files, for lock manifests; a worker reads a file block by block, whatever its size."""
    names = spark.read.format("binaryFile").load(path).select("path")

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            sums = []
            for uri in b["path"].to_pylist():
                files, where = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
                digest = hashlib.sha256()
                with files.open_input_stream(where) as f:
                    while data := f.read(block):
                        digest.update(data)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b["path"], pa.array(sums, pa.string())], names=["path", "sha256"])

    return names.mapInArrow(run, "path string, sha256 string")
