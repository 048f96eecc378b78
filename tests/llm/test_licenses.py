"""License scans (operator 11) against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import licenses

PAIRS = (("red", "alpha beta gamma delta epsilon"), ("blue", "one two three four five six seven eight nine ten the the of"), ("red", "iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega the of a"))
SAID = {"cc by nc": "cc", "the mit": "mit"}


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if ord(c) > 0x7A or c.isascii() and c.isalnum() else " " for c in low).replace("{", " ").replace("|", " ").replace("}", " ").replace("~", " ").replace("\x7f", " ").split(" ")


def brute(text, threshold=0.8):
    w = [x for x in words(text) if x]
    places, found, hits = [], set(), set()
    for p, label in SAID.items():
        p = p.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        found |= {label} if at else set()
    best = 0.0
    for n, (label, template) in enumerate(PAIRS):
        t = template.split()
        width = 4
        while width < len(t):
            width *= 2
        for b in range(max((len(w) - 1) // width - 1, 0) + 1):
            both = set(w[b * width : b * width + 2 * width]) & set(t)
            if len(both) >= threshold * len(set(t)) - 1e-9:
                hits.add((label, n, b * width, len(both)))
                best = max(best, len(both) / len(set(t)))
    labels = found | {h[0] for h in hits}
    return (len(w), len(places), min(places, default=None), max(places, default=None), sorted(found), sorted(labels), 1.0 if places else best, hits)


def got(df):
    return [
        (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"], {(h["label"], h["template"], h["word_start"], round(h["containment"] * len(set(PAIRS[h["template"]][1].split())))) for h in r["hits"]})
        for r in df.orderBy("n").collect()
    ]


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = licenses.scan(docs, licenses.templates_of(PAIRS), SAID)
    return got(out.withColumn("n", F.col("doc_id")))


def test_every_block_over_the_threshold(spark):
    r = np.random.default_rng(2)
    vocabulary = sorted({w for _, t in PAIRS for w in t.split()}) + ["cc", "by", "nc", "mit", "other", "filler", "zeta"] * 3
    texts = []
    for n in [0, 1, 3, 4, 5, 8, 9, 30, 31, 32, 33, 64, 65, 200] * 8:
        w = [vocabulary[i] for i in r.integers(0, len(vocabulary), n)]
        if n and r.random() < 0.7:
            t = PAIRS[r.integers(len(PAIRS))][1].split()
            at = r.integers(0, n)
            w[at:at] = [x for x in t if r.random() < 0.88]
        if r.random() < 0.3:
            w[len(w) // 2 : len(w) // 2] = ["cc", "by", "nc"]
        texts.append(" ".join(x.upper() if r.random() < 0.2 else x for x in w).replace(" ", ", \n", 3))
    want = [brute(t) for t in texts]
    assert scanned(spark, texts) == want and sum(bool(w[-1]) for w in want) > 30 and sum(w[1] for w in want) > 10


def test_places_of_phrases(spark):
    texts = ["cc by nc cc by nc", "CC-BY-NC/cc by\tnc", "xcc by nc", "cc by ncx", "the mit the mit", "é cc by nc é cc by", "cc by cc by nc", "..cc by nc..", "the  MIT", "a|b{c}d~e\x7ff cc by nc", "ÀCC by nc"]
    assert scanned(spark, texts) == [brute(t) for t in texts]


def test_real_notices(spark):
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2", "This work is licensed under the GNU General Public License, version 3.": "gpl-3", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "A licence to fish, under the terms of the public water board, version 3.": "", "": ""}
    texts = list(lines) + [f"{'some other prose here. ' * 50}{x}{' and more of it' * 50}" for x in lines]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [",".join(r["labels"]) for r in found] == [*lines.values()] * 2


def test_odd_rows(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "cc by nc", 6), (3, "", 0), (4, " \n.", 0), (5, "filler " * 200_000 + "cc by nc " + "alpha beta, gamma. delta epsilon", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").withColumns({"blocks": F.lit(1), "norm": F.lit("n"), "hits": F.lit(None), "words": F.lit("w")})
    out = licenses.scan(docs, licenses.templates_of(PAIRS), SAID).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], ",".join(r["labels"])) for r in out) == [(0, 3, "cc"), (1, 0, ""), (1, 0, ""), (3, 0, ""), (4, 0, ""), (5, 200_008, "cc,red")]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_no_python_on_its_path(spark):
    out = licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
