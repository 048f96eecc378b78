"""Operators on small tables with odd rows, and whole queries against brute force and SQL."""

import hashlib
import itertools
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, decontam, langid, linear, neardup, packing, pii, quality, queries, sharding, tokenstore, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, rep long, kept string"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def odd(spark, rows=None):
    """Nulls, empty and long texts, repeats, ties and columns with clashing names."""
    many = " ".join(f"w{i}" for i in range(60000))
    texts = [None, "", "  \n ", BASE, BASE, BASE + " one", BASE.upper(), "one two", "one two", many, many + " end", "x", BASE.replace("nu", "other words")]
    rows = rows if rows is not None else [(i, t, "en" if i % 2 else None, None, None, 1, 2, "k") for i, t in enumerate(texts)] + [(None, "null id", None, "s", 0, None, None, None), (3, BASE, "en", "s", 1, 1, 1, "k")]
    return spark.createDataFrame(rows, DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def got_components(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_near_duplicates_of_odd_rows(spark):
    df = odd(spark)
    assert got_components(neardup.near_duplicates(df)) == brute_components([(r["doc_id"], r["text"]) for r in df.collect()])
    assert neardup.near_duplicates(odd(spark, [])).count() == 0
    kept = neardup.keep_representatives(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {None, 0, 1, 2, 3, 7, 9, 11, 12}


@pytest.mark.parametrize("leaf, block", [(4096, 1024), (4, 1024), (4, 3)])
def test_near_duplicates_in_large_and_split_nodes(spark, leaf, block):
    rng = np.random.default_rng(3)
    rows = []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(60)]
        for _ in range(14):
            w = list(base)
            for p in rng.integers(0, 60, rng.integers(0, 4)).tolist():
                w[p] = f"r{rng.integers(1000)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_components(neardup.near_duplicates(df, leaf=leaf, block=block)) == brute_components(rows)


def test_near_duplicates_keep_links_of_large_nodes(spark):
    """Pairs of exactly 0.75 among rows just below it: all share nodes above ``leaf``, and no pair may get lost."""
    rows = []
    for g in range(60):
        prefix = [f"g{g}w{i}" for i in range(94)]
        rows += [(g * 100 + k, " ".join(prefix + [f"g{g}k{k}t{i}" for i in range(15)])) for k in (0, 1)]
        rows += [(g * 100 + k, " ".join(prefix[:93] + [f"g{g}k{k}t{i}" for i in range(16)])) for k in range(2, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_components(neardup.near_duplicates(df, leaf=1)) == brute_components(rows)


def test_one_id_with_two_texts_links_them(spark):
    rows = [(1, BASE), (2, BASE), (2, "q w e r t y u i o p"), (3, "q w e r t y u i o p")]
    got = got_components(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {c for _, _, c in got} == {1}


def test_components_of_a_long_chain(spark):
    n = 70
    labels = neardup.components(spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201)], "a long, b long"))
    got = {r["vertex"]: r["label"] for r in labels.collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 200: 200, 201: 200}


def test_decontamination_of_odd_rows(spark):
    passage = " ".join(f"Item{i}" for i in range(12))
    rows = [(1, f"before {passage} after, all of these words are clean and stay as they are in here", "k"), (2, None, "k"), (3, "", "k"), (4, "tiny test", "k"), (5, passage, "k"), (5, "clean", None), (None, f"x {passage}", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string")
    bench = spark.createDataFrame([(7, passage), (8, "Tiny, TEST"), (9, None), (10, "..."), (None, "clean"), (7, passage)], "item_id long, text string")
    want = [("1", 12, "7"), ("2", 0, ""), ("3", 0, ""), ("4", 2, "8"), ("5", 0, ""), ("5", 12, "7"), ("None", 12, "7")]
    for size in (8 << 20, 40):
        got = sorted((str(r["doc_id"]), r["n_hit"], ",".join(r["items"])) for r in decontam.scan(docs, bench, block_bytes=size).collect())
        assert got == want
    clean = {(r["doc_id"], r["text"]) for r in decontam.decontaminate(docs, bench).collect()}
    assert clean == {(1, "before   after, all of these words are clean and stay as they are in here"), (2, None), (3, ""), (5, "clean")}
    assert decontam.scan(docs.limit(0), bench).count() == 0 and decontam.scan(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_sharding_of_odd_rows(spark, tmp_path):
    df = odd(spark)
    rows = sharding.slots(spark, sharding.external_shuffle(df, 4, bucket_bytes=100000, out=str(tmp_path / "s")), df.columns).collect()
    assert len(rows) == df.count()
    for shard in {r["__shard"] for r in rows}:
        mine = sorted(r["__slot"] for r in rows if r["__shard"] == shard)
        assert mine == list(range(len(mine)))
    one, more = (df.select("doc_id", sharding.shard_of(F.col("doc_id"), n).alias("s")).collect() for n in (4, 5))
    assert all(b["s"] in (a["s"], 4) for a, b in zip(one, more))


def test_token_store_of_odd_rows(spark, tmp_path):
    df = odd(spark).unionByName(odd(spark, [(3, BASE, None, None, None, None, None, None)] * 5))
    e = bpe.Encoder.shared(bpe.default_path())
    ids = lambda t: e.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    root = str(tmp_path / "t")
    tokenstore.TokenStore.write(df, root, shard_bytes=200, segment_keys=3)
    store = tokenstore.TokenStore.open(spark, root)
    got = sorted(store.read(store.lookup(df)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([r["doc_id"] for r in df.collect()], key=lambda x: -1 if x is None else x)
    at = 0
    for r in got:
        raw = bytes(r["ids"])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(raw) // 4, zlib.crc32(raw))
        at += r["n_tokens"]
    want = sorted(np.array(ids(r["text"]), "<u4").tobytes() for r in df.collect())
    assert sorted(bytes(r["ids"]) for r in got) == want
    by_id = {}
    for r in df.collect():
        by_id.setdefault(r["doc_id"], []).append(ids(r["text"]))
    for doc_id, texts in by_id.items():
        assert sorted(x.tolist() for x in store.get(doc_id)) == sorted(texts)
    assert store.get(12345) == [] and store.lookup(spark.createDataFrame([(12345,)], "doc_id long")).count() == 0
    # an index file that is lost is an error
    os.remove(next(f for f in tmp_path.glob("t/index-*")))
    with pytest.raises(Exception, match="index-"):
        store.lookup(df).count()
    none = tokenstore.TokenStore.write(odd(spark, []), str(tmp_path / "none"))
    assert none.read(none.lookup(df)).count() == 0 and none.get(1) == []


def test_a_keyed_read_touches_little(spark, tmp_path, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), "id", F.repeat(F.lit(" word"), 300)).alias("text"))
    store = tokenstore.TokenStore.write(rows, str(tmp_path / "t"))
    fetched, fetch = [], tokenstore.fetch
    monkeypatch.setattr(tokenstore, "fetch", lambda *a: fetched.append(out := fetch(*a)) or out)
    e = bpe.Encoder.shared(bpe.default_path())
    assert store.get(1234)[0].tolist() == e.tokenizer.encode("text number 1234" + " word" * 300, add_special_tokens=False).ids + [2]
    assert sum(map(len, fetched)) < 10000 and len(fetched) < 100


def test_packing_of_odd_rows(spark):
    df = odd(spark)
    e = bpe.Encoder.shared(bpe.default_path())
    rows = packing.pack(df).collect()
    total = sum(len(e.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in df.collect())
    assert sum(r["length"] for r in rows) == total == sum(len(r["ids"]) // 4 for r in rows)
    by = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 2048 and packing.pack(odd(spark, [])).count() == 0


def test_scoring_of_odd_and_empty_tables(spark):
    df, none = odd(spark), odd(spark, [])
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 1), (None, 1, 1), (99, 1, 1), (4, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for d in (df, none):
        for lab in (labels, labels.limit(0)):
            q = quality.score(d, quality.fit(d, lab)).collect()
            t = toxicity.score(d, toxicity.fit(d, lab, F.lit(True))).collect()
            assert len(q) == len(t) == d.count() and all(0 <= r["score"] <= 1 for r in t)
        p = {r["doc_id"]: r["lang_pred"] for r in langid.predict(d, langid.fit(d, F.lit(True))).collect()}
        assert len(p) == d.select("doc_id").distinct().count()
    assert p == {} and {r["lang_pred"] for r in langid.predict(df, langid.fit(none, F.lit(True))).collect()} == {"und"}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, langid.fit(df, F.lit(True))).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] == "en"


def test_long_rows_do_not_end_a_sample(spark):
    """Texts that are longer than the bound, or than a row's share of it, leave the rest of the sample as it is."""
    rows = [(i, f"text {i}", i % 2) for i in range(300)]
    longer = [(1000 + i, "long " * (3000 if i % 2 else 400), 1) for i in range(60)]
    df = lambda r: spark.createDataFrame(r, "doc_id long, text string, y int")
    sample = lambda r, size: linear.labelled_sample(df(r), None, "y", 200, size, 7)
    want = sample(rows, 10000)
    assert len(want) == 200 and sample(rows + longer, 10000) == want
    with pytest.warns(UserWarning, match="rows with"):
        some = sample(rows, 500)
    assert len(some) >= 50 and sum(len(t) for t, _ in some) <= 500
    # where all are long, some are taken all the same
    with pytest.warns(UserWarning, match="rows with"):
        assert len(sample(longer, 5000)) == 2
    with pytest.warns(UserWarning, match="no labelled text"):
        assert sample(longer, 100) == []


def test_pii_frames(spark):
    rows = [(1, "a@b.co and joe [at] site [dot] org", "x"), (2, None, "y"), (3, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find_pii(df).collect()}
    assert found == {1: ["email", "email"], 2: [], 3: []}
    assert [tuple(r) for r in pii.redact(df).collect()] == [(1, "<EMAIL> and <EMAIL>", "x"), (2, None, "y"), (3, "", None)]


def test_chat_parts_join_up(spark):
    rows = [(1, t, ["ann", "bob", "system", None][t % 4], f"t{t}") for t in range(10)] + [(2, 0, "system", "only"), (None, None, "cy", None), (1, 9, "bob", "t9")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def whole(part):
        out = {}
        for r in sorted(chat.rotate(df, part).collect(), key=lambda r: r["part"]):
            text, spans = out.get((r["conv_id"], r["perspective"]), ("", []))
            assert r["char_start"] == len(text)
            spans = spans + [text_span(r, m) for m in r["mask"].split(",") if m]
            out[r["conv_id"], r["perspective"]] = (text + r["text"], spans)
        return out

    text_span = lambda r, m: r["text"][slice(*map(int, m.split(":")))]
    assert whole(256) == whole(3)
    text, spans = whole(256)[1, "ann"]
    assert spans == ["t0<|end|>\n", "t4<|end|>\n", "t8<|end|>\n"] and "<|user name=unknown|>\nt3" in text and text.count("t9") == 2
    assert whole(256)[2, None] == ("<|system|>\nonly<|end|>\n", [])
    plan = chat.rotate(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="synthetic tables are not there")
class TestTables:
    def test_queries_equal_sql(self, spark):
        c = duckdb.connect()
        for t in ("documents", "benchmark", "conversations", "embeddings"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        for name, sql in queries.ORACLES.items():
            got = queries.QUERIES[name](spark, SF)
            names = ", ".join(got.columns)
            want = c.execute(f"SELECT {names} FROM ({sql})").fetchall()
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)), name

    def test_base_spans(self, spark):
        docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
        phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
        ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
        card = re.compile(r"[0-9]([\x20-]?[0-9])+")
        digits = lambda s: re.sub("[^0-9]", "", s)
        for r in queries.QUERIES["op9_pii"](spark, SF).collect():
            t = docs[r["doc_id"]]
            spans = [("email", *m.span()) for m in email.finditer(t)]
            spans += [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
            spans += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
            spans += [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(digits(m.group())) <= 15]
            assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()

    def test_held_out_accuracy(self, spark):
        sf = SF.replace("sf0.001", "sf0.01")
        d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
        lang = queries.QUERIES["op5_language_id"](spark, sf).join(d, "doc_id").filter("held_out")
        assert lang.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97
        lab = spark.read.parquet(f"{sf}/labels.parquet")
        good = queries.QUERIES["op1_quality_rules"](spark, sf).join(lab, "doc_id").filter("not base_failed and quality = 1")
        assert good.agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.95

    def test_pipeline(self, spark):
        import corpus_pipeline

        got = corpus_pipeline.run(spark, SF)
        assert {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns) and got.count() > 0
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        kept = docs.select("doc_id").join(got.select("doc_id"), "doc_id", "left_semi").count()
        reps = neardup.near_duplicates(docs).filter("kept").count()
        assert 0.9 * reps <= kept <= reps
