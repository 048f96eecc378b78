import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import tables, text
from tidemark.operators import cache
from tidemark.sources import nested, records
from tidemark.streaming import responses


def test_jsonl_missing_bad_and_round_trip(spark, tmp_path):
    assert records.read_jsonl(spark, str(tmp_path / "none"), records.RESPONSE).count() == 0
    (tmp_path / "bad.json").write_text('{"question_id": "1"}\n{oops\n')
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(tmp_path / "bad.json"), records.RESPONSE).collect()
    df = spark.createDataFrame([("1", "a"), ("2", None)], "question_id string, answer string")
    records.write_jsonl(df, str(tmp_path / "out"))
    records.write_jsonl(df, str(tmp_path / "out"), append=True)
    assert records.read_jsonl(spark, str(tmp_path / "out"), records.RESPONSE).count() == 4


def test_dataset_coalesces_the_stale_answer(spark, tmp_path):
    rec = {"id": "q", "question": "?", "gold_answer": "g", "current_docs": [], "stale_docs": ["d"], "metadata": {"old_answer": "o"}}
    (tmp_path / "d.json").write_text(json.dumps(rec) + "\n")
    assert records.read_dataset(spark, str(tmp_path / "d.json")).first()["stale_answer"] == "o"
    (tmp_path / "e.json").write_text(json.dumps({k: v for k, v in rec.items() if k != "question"}) + "\n")
    with pytest.raises(Exception):
        records.read_dataset(spark, str(tmp_path / "e.json")).collect()


def test_versions_and_questions(spark, tmp_path):
    long = "x" * 80
    (tmp_path / "v.json").write_text(json.dumps({"http://a": {"2024-01-01": {"source_text": long}, "2024-01-02": {"source_text": "short"}}, "http://b": {"t": {"source_text": long, "archive_url": "http://a", "source_timestamp": "2024-01-01"}}}))
    assert records.read_versions(spark, str(tmp_path / "v.json")).count() == 1
    (tmp_path / "q.csv").write_text("Question,Answer,Start timestamp,End timestamp,Known start timestamp,Known end timestamp\nq,b,2024-02-01,,,\nq,a,2024-01-01,2024-02-01,,\nq,,2024-01-01,,,\n")
    row = records.read_questions(spark, str(tmp_path / "q.csv")).first()
    assert [s["answer"] for s in row["spans"]] == ["a", "b"]


def test_csv_under_the_union_of_columns(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([("y", 2)], "b string, k int")
    records.write_csv(spark, [a, b], str(tmp_path / "c"))
    got = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert got.columns == ["k", "a", "b"] and sorted(tuple(r) for r in got.na.fill("-").collect()) == [("1", "x", "-"), ("2", "-", "y")]
    records.write_csv(spark, [], str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_versions_that_come_twice(spark):
    text = lambda t: (t + " ") * 40
    maps = [json.dumps({"http://b": {"1": {"source_text": text("late"), "archive_url": "http://x", "source_timestamp": "t"}}, "http://a": {"2": {"source_text": text("first"), "archive_url": "http://x", "source_timestamp": "t"}}})]
    got = records.versions(spark.createDataFrame([(m,) for m in maps], "value string"), "value").collect()
    assert [(r["source_url"], r["url"], r["text"]) for r in got] == [("http://a", "http://x", text("first").strip())]


def test_items_of_any_shape(spark, tmp_path):
    long = "word " * 20
    items = [None, "oops", "[1, 2]", json.dumps({"x": {"Headline": "", "title_of": " A  title "}, "n": [{"body_text": "short"}], "link": 5}), json.dumps({"a": "tiny", "b": [long, long + "more"]}), json.dumps({"q": {"question": "why"}, "published_on": "2024-01-01", "t": None})]
    df = spark.createDataFrame(list(enumerate(items)), "id int, item string")
    got = {r["id"]: r for r in records.scan_items(df, "item", ["id"]).collect()}
    assert [(got[i]["title"], got[i]["text"], got[i]["url"]) for i in range(5)] == [("", "", "")] * 3 + [("A title", "short", "5"), ("", (long + "more").strip(), "")]
    assert (got[5]["hint"], got[5]["timestamp"]) == ("why", "2024-01-01")
    write = lambda name, text: (tmp_path / name).write_text(text)
    write("a.jsonl", '{"k": 1}\n\n{"k": 2}\n')
    write("b.json", '[{"k": 1}, 5, {"k": 2}]')
    write("c.json", '{"u": {"k": 1}, "v": {"k": 2}}')
    write("d.json", '{"k": 1, "v": {"k": 2}}')
    write("e.csv", "k,t\n1,x\n")
    count = lambda name: records.read_items(spark, str(tmp_path / name), "." + name.split(".")[1]).count()
    assert [count(n) for n in ("a.jsonl", "b.json", "c.json", "d.json", "e.csv")] == [2, 2, 2, 1, 1]
    with pytest.raises(ValueError):
        records.read_items(spark, "x.txt", ".txt")


def test_documents_folders_and_fingerprints(spark, tmp_path):
    folders = records.run_folder(tmp_path, "trial", {"a": [1, "é"]}, "20240101")
    assert records.read_document(folders["run"] / "settings.json") == {"a": [1, "é"]} and folders["metrics"].is_dir()
    with pytest.raises(FileExistsError):
        records.run_folder(tmp_path, "trial", {}, "20240101")
    (tmp_path / "f.bin").write_bytes(b"x" * 3_000_000)
    import hashlib

    got = records.fingerprints(spark, str(tmp_path / "f.bin")).first()
    assert got["sha256"] == hashlib.sha256(b"x" * 3_000_000).hexdigest()


def test_checkpoints_and_last_rows(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"2024-01-01T00:00:00": ["a", "b"], "2024-02-01T00:00:00": ["a"]}))
    assert sorted((str(r["t"])[:10], r["question"]) for r in records.read_checkpoints(spark, str(tmp_path / "t.json")).collect()) == [("2024-01-01", "a"), ("2024-01-01", "b"), ("2024-02-01", "a")]
    rows = spark.createDataFrame([(1, 0, "x"), (1, 2, "z"), (1, 1, "y"), (2, 0, "w")], "k int, line int, v string")
    assert sorted((r["k"], r["v"]) for r in records.last_by_key(rows, "k", "line").collect()) == [(1, "z"), (2, "w")]


def test_live_budgets_and_sessions(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{s:02d}", 7, "a", 1.0, None) for i, s in enumerate((0, 5, 8))] + [(9, "2024-01-01 02:00:00", 7, "a", 5.0, None), (10, "2024-01-02 00:00:00", 8, "a", 1.0, None)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value", "props")
    df.write.parquet(str(tmp_path / "src"))
    for name, make, want in (("b", lambda s: responses.budget(s, "60 seconds", "60 seconds"), {(3, 3.0), (1, 5.0)}), ("s", responses.sessions, {3, 1})):
        responses.run_to_end(make(responses.events(spark, str(tmp_path / "src"))), str(tmp_path / f"log{name}"), str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name)).filter("user_id = 7").collect()
        assert {(r["requests"], r["spent"]) if name == "b" else r["events"] for r in got} == want


def test_unique_keys(spark):
    with pytest.raises(ValueError):
        records.require_unique(spark.createDataFrame([(1,), (1,)], "id int"), "id")


def test_stream_resumes_and_drops_repeats(spark, tmp_path):
    src, out, log = (str(tmp_path / x) for x in ("src", "out", "log"))
    rows = [(1, "2024-01-01 00:00:00", 7, "a", 1.0, None), (1, "2024-01-01 00:00:00", 7, "a", 1.0, None), (2, "2024-01-01 00:00:30", 7, "a", 2.0, None)]
    make = lambda r: spark.createDataFrame(r, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value", "props")
    make(rows).write.mode("append").parquet(src)
    responses.run_to_end(responses.first_answers(responses.events(spark, src)), log, out)
    assert spark.read.parquet(out).count() == 2
    make([(3, "2024-01-01 00:01:00", 7, "a", 1.0, None)]).write.mode("append").parquet(src)
    responses.run_to_end(responses.first_answers(responses.events(spark, src)), log, out)
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_rolling_totals_keep_order_out_and_late_rows_apart(spark, tmp_path):
    """Rows of open spans come in any order; a span that is closed takes none."""
    rng = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=rng.randrange(6 * 3600)), rng.randrange(9)) for i in range(300)] + [(900, base + dt.timedelta(seconds=3599), 5), (901, base + dt.timedelta(seconds=3600), 7)]
    df = spark.createDataFrame(rows, responses.REQUEST)
    stream, late = responses.replayed(df, slices=3)
    responses.run_to_end(responses.rolling_totals(stream, late=late), str(tmp_path / "p"), str(tmp_path / "o"))
    got = {r["event_id"]: (r["requests"], r["tokens"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    want = {}
    for i, t, _ in rows:
        near = [n for _, u, n in rows if dt.timedelta(0) <= t - u < dt.timedelta(seconds=60)]
        want[i] = (len(near), sum(near))
    assert got == want
    # a row of the first hour behind rows of the third day
    folder = str(tmp_path / "late")
    for k, part in enumerate(([(1, base, 1)], [(2, base + dt.timedelta(days=3), 1)], [(3, base, 1)], [(4, base + dt.timedelta(days=6), 1)], [(5, base + dt.timedelta(days=9), 1)])):
        spark.createDataFrame(part, responses.REQUEST).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(responses.REQUEST).option("maxFilesPerTrigger", 1).parquet(folder)
    responses.run_to_end(responses.rolling_totals(stream), str(tmp_path / "lp"), str(tmp_path / "lo"))
    got = {r["event_id"]: r["requests"] for r in spark.read.parquet(str(tmp_path / "lo")).collect()}
    assert got[1] == 1 and 3 not in got


def test_a_second_run_encodes_nothing(spark, tmp_path):
    asked = []

    def encode(texts):
        asked.append(texts.count())
        return cache.hashed(texts, 8)

    c = cache.Cache(spark, str(tmp_path / "c"), "toy", encode)
    one = spark.createDataFrame([(1, "red fish"), (2, "red fish"), (3, None), (4, "")], "id int, text string").withColumn("v0", F.lit(1))
    rows, n = c.encoded(one, "text")
    first = {r["id"]: (r["v"], r["cached"]) for r in rows.collect()}
    assert n == 2 and first[1] == first[2] and first[3] == first[4] == ([0.0] * 8, False)
    rows, n = c.encoded(one.unionByName(spark.createDataFrame([(5, "blue fish")], "id int, text string").withColumn("v0", F.lit(1))), "text")
    again = {r["id"]: (r["v"], r["cached"]) for r in rows.collect()}
    assert n == 1 and again[1] == (first[1][0], True) and not again[5][1]
    assert c.encoded(one, "text")[1] == 0 and asked == [2, 1, 0]
    # another encoder shares nothing; the key that the last run did not use goes first
    assert cache.Cache(spark, str(tmp_path / "c"), "other", encode).key("text") is not None
    assert c.evict(2) == 2 and c.encoded(one, "text")[1] == 0
    assert c.encoded(spark.createDataFrame([("blue fish",)], "text string"), "text")[1] == 1


def test_the_table_function_equals_the_expression(spark):
    texts = [None, "", "  ", "one", "a b c d e f g h", "word " * 11, "\n x  y\tz "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    tables.register(spark)
    for size, shared, least in ((3, 1, 1), (5, 2, 4), (180, 40, 80), (2, 2, 1)):
        got = spark.sql(f"SELECT d.id, p.* FROM {{d}} d, LATERAL word_passages(d.text, {size}, {shared}, {least}) p", d=df).collect()
        want = df.select("id", F.explode(text.chunks_of_words(text.words_between(F.col("text")), size, shared, least)).alias("c")).select("id", "c.chunk_index", "c.chunk").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


_ODD = ['a "quoted" [x], {y}', "back\\slash\\\\", "\\" * 9 + '"', "é, ü]", "", "x" * 50, ",]}{["]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 1 << 20])
def test_members_of_a_list_by_blocks_of_any_size(spark, tmp_path, block):
    value = [{"k": t, "more": [t, {"a,": [1, [2, "]"]]}]} for t in _ODD] + [1, None, "s, \"t\"", [], {}, [[1], 2]]
    (tmp_path / "a.json").write_text(json.dumps(value, ensure_ascii=False, indent=1), encoding="utf-8")
    got = nested.split_json(spark, str(tmp_path / "a.json"), block=block, task=200).orderBy("at").collect()
    assert [json.loads(r["item"]) for r in got] == value and {r["kind"] for r in got} == {"["}


@pytest.mark.parametrize("block", [2, 5, 1 << 20])
def test_members_of_maps_and_of_files_without_any(spark, tmp_path, block):
    value = {t: {"inner, ": [t]} for t in _ODD}
    (tmp_path / "a.json").write_text("\ufeff \n" + json.dumps(value, ensure_ascii=True), encoding="utf-8")
    for name, text_ in (("b", "[]"), ("c", " { } "), ("d", ""), ("e", " \n"), ("f", "12"), ("g", '"[1, 2]"')):
        (tmp_path / f"{name}.json").write_text(text_)
    got = nested.split_json(spark, str(tmp_path), block=block, task=50).orderBy("at").collect()
    assert [json.loads(r["item"]) for r in got] == [{k: v} for k, v in value.items()]
    (tmp_path / "cut.json").write_text('[1, "two')
    with pytest.raises(Exception, match="ends within a member"):
        nested.split_json(spark, str(tmp_path / "cut.json"), block=block).collect()


def test_a_large_list_is_read_by_many_tasks(spark, tmp_path):
    with open(tmp_path / "big.json", "w") as f:
        f.write("[" + ",".join(json.dumps({"id": i, "text": "word " * 40}) for i in range(40000)) + "]")
    rows = nested.split_json(spark, str(tmp_path / "big.json"), block=1 << 18, task=1 << 20)
    ids = rows.select(F.from_json("item", "id long").alias("r")).select("r.id").distinct().count()
    assert ids == 40000
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() >= 6
