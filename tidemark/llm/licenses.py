"""License scans (operator 11): an exact set-similarity join of text blocks and license templates, in DataFrame operations only.

A text block is a window of words: templates of up to m words (m a power of two) meet windows of 2m words, one every m
words, so any m consecutive words lie in one of them whole.  Of a template with t different words, a block must have
``need`` = ceil(THRESHOLD * t).  The join is exact:

* Only words of templates can count, so a block is its set of those.  All sets are in one order, rarest first, by how many
  documents have the word; the counts come from all documents, the order is as long as the templates' vocabulary.
* Prefix filter: a pair that shares ``need`` words shares one of the first t - need + 1 of the template and one of the first
  b - need + 1 of the block.  Prefix words of blocks meet an index of prefix words of templates, which is broadcast.
* Length filter: b >= need.  Positional filter: what follows the shared words can still make up ``need``.
* A pair is looked at where its first shared word is, once, and the whole sets are compared there.

Beside the templates there are phrases: words that stand one after another.  They are found by string functions in the
normalised text, where each word stands between two blanks of its own.

Rows of documents carry a number of their own, so that repeated ids stay rows of their own.  Documents' texts are read twice
(counts, then blocks) and never exchanged; what is exchanged is the hits.  The cost in memory is in proportion to one text.

Defined cases: a null or wordless text has no words, no places, no labels and score 0; a null doc_id is a row like others;
repeated rows are judged one by one; ties in the order go by the word; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# fixed values: the base phrases
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Public license notices, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
THRESHOLD = 0.8
#: Templates of fewer different words would be met by chance.
LEAST_WORDS, MOST_VOCABULARY = 4, 20_000


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]

    @property
    def size(self) -> int:
        return len(set(self.words))

    @property
    def width(self) -> int:
        """The words that a block of this template advances by; a power of two."""
        return 1 << max(2, (len(self.words) - 1).bit_length())

    def need(self, threshold: float) -> int:
        return math.ceil(threshold * self.size - 1e-9)


def templates_of(pairs=TEMPLATES) -> list[Template]:
    """Templates as words; one of too few different words, or a vocabulary too large to send to every task, is an error."""
    out = [Template(label, tuple(w for w in re.split(GAP, text.translate(str.maketrans(UPPER, LOWER))) if w)) for label, text in pairs]
    if any(t.size < LEAST_WORDS for t in out) or len({w for t in out for w in t.words}) > MOST_VOCABULARY:
        raise ValueError(f"templates have {LEAST_WORDS} different words at least and {MOST_VOCABULARY} together at most")
    return out


def read_words(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep and, of each text, ``norm`` (the words, each between two blanks of its own) and ``words``.

    The steps are selects of their own, so that no text is lowered or split twice.
    """
    bare, none = F.col("bare"), F.col("bare") == ""
    lowered = docs.select(*keep, F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), GAP, "  ").alias("bare"))
    return lowered.select(*keep, F.trim("bare").alias("bare")).select(
        *keep, F.when(none, "").otherwise(F.concat(F.lit(" "), bare, F.lit(" "))).alias("norm"), F.when(none, F.array().cast("array<string>")).otherwise(F.split(bare, "  ")).alias("words")
    )


def _n_words(norm: Column) -> Column:
    """A half of the blanks."""
    return F.expr("0L") + (F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit("")))).cast("long") / F.lit(2)


def _literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _base(norm: Column, phrases: dict[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels of a normalised text."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        k = len(phrase.split())
        needle = " " + "  ".join(phrase.split()) + " "
        there = F.contains(norm, F.lit(needle))
        n = ((F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(needle), F.lit("")))) / len(needle.encode())).cast("long")
        before, after = _n_words(F.substring_index(norm, needle, 1)), _n_words(F.substring_index(norm, needle, -1))
        counts.append(F.when(there, n).otherwise(F.lit(0)))
        firsts.append(F.when(there, before.cast("long")))
        lasts.append(F.when(there, (_n_words(norm) - after).cast("long") - k))
        labels.append(F.when(there, F.lit(label)))
    pick = lambda f, of: f(*of) if len(of) > 1 else of[0]
    return {
        "n_base": sum(counts[1:], counts[0]), "first_word": pick(F.least, firsts), "last_word": pick(F.greatest, lasts),
        "base_labels": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def frequency_order(docs: DataFrame, templates: list[Template]) -> list[str]:
    """The templates' words, those of the fewest documents first."""
    words = sorted({w for t in templates for w in t.words})
    there = read_words(docs).select(F.array_intersect(_literal(words), F.col("words")).alias("of")).select(F.explode("of").alias("w"))
    counts = {r["w"]: r["n"] for r in there.groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row for each word of the templates
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def _index(docs: DataFrame, templates: list[Template], order: list[str], threshold: float) -> DataFrame:
    """(word, i, template, label, width, size, need, words): a row for each prefix word of each template."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for number, t in enumerate(templates):
        words = sorted(set(t.words), key=rank.get)
        need = t.need(threshold)
        rows += [(words[i], i, number, t.label, t.width, t.size, need, words) for i in range(t.size - need + 1)]
    return docs.sparkSession.createDataFrame(rows, "word string, i int, template int, label string, width int, size int, need int, words array<string>")


def _cut(words: Column, width: int, vocabulary: Column, need: int) -> Column:
    last = F.greatest(F.floor((F.size(words) - 1) / width) - 1, F.lit(0)).cast("int")
    own = lambda b: F.array_intersect(vocabulary, F.slice(words, b * width + 1, 2 * width))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(F.lit(width).alias("width"), b.alias("block"), own(b).alias("own")))
    return F.filter(blocks, lambda x: F.size(x["own"]) >= need)


def _blocks(words: Column, templates: list[Template], order: list[str], threshold: float) -> Column:
    """(width, block, own) of the blocks that have enough words for a template of their width; own is in the common order."""
    rank = {w: i for i, w in enumerate(order)}
    out = []
    for width in sorted({t.width for t in templates}):
        of = [t for t in templates if t.width == width]
        vocabulary = _literal(sorted({w for t in of for w in t.words}, key=rank.get))
        need = min(t.need(threshold) for t in of)
        rare = sorted({w for t in of for w in sorted(set(t.words), key=rank.get)[: t.size - t.need(threshold) + 1]})
        enough = _cut(words, width, vocabulary, need)
        # a text without any prefix word has no block to cut
        out.append(F.when(F.arrays_overlap(words, _literal(rare)), enough).otherwise(F.array().cast("array<struct<width:int,block:int,own:array<string>>>")))
    return F.concat(*out)


def join(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """(row, width, block, template, label, size, overlap) of every pair over the threshold; blocks are (row, width, block, own)."""
    least = index.groupBy("width").agg(F.min("need").alias("least"))
    prefixes = blocks.join(F.broadcast(least), "width").select("row", "width", "block", "own", F.posexplode(F.slice("own", 1, F.greatest(F.size("own") - F.col("least") + 1, F.lit(0)))).alias("j", "word"))
    b = F.size("own")
    pairs = prefixes.join(F.broadcast(index), ["width", "word"]).filter((b >= F.col("need")) & (F.col("j") <= b - F.col("need")) & (1 + F.least(b - F.col("j") - 1, F.col("size") - F.col("i") - 1) >= F.col("need")))
    shared = pairs.withColumn("shared", F.array_intersect("own", "words"))
    return shared.filter((F.size("shared") >= F.col("need")) & (F.col("shared")[0] == F.col("word"))).select("row", "width", "block", "template", "label", "size", F.size("shared").alias("overlap"))


def scan(docs: DataFrame, templates: list[Template] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, hits) of every document.

    Labels are sorted arrays.  ``hits`` is (label, template, word_start, word_end, containment) of every block that meets a
    template, in order; ``score`` is 1 where a phrase stands, else the best containment of a hit, or 0.
    """
    templates, phrases = templates_of() if templates is None else templates, PHRASES if phrases is None else phrases
    docs = docs.select("doc_id", "text")
    order = frequency_order(docs, templates)
    norm, words = F.col("norm"), F.col("words")
    found = read_words(docs, "doc_id").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size(words).cast("long").alias("n_words"), *(c.alias(n) for n, c in _base(norm, phrases).items()), _blocks(words, templates, order, threshold).alias("blocks"))
    found = materialise(found, "licenses")
    blocks = found.filter(F.size("blocks") > 0).select("row", F.explode("blocks").alias("x")).select("row", "x.*")
    start = F.col("block") * F.col("width")
    hit = F.struct("label", "template", start.cast("long").alias("word_start"), (start + 2 * F.col("width")).cast("long").alias("word_end"), (F.col("overlap") / F.col("size")).alias("containment"))
    hits = join(blocks, _index(docs, templates, order, threshold)).groupBy("row").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    own = F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType))
    out = found.drop("blocks").join(hits, "row", "left").withColumn("hits", F.transform(own, lambda h: h.withField("word_end", F.least(h["word_end"], F.col("n_words")))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_sort(F.array_union("base_labels", F.transform("hits", lambda h: h["label"]))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("hits", lambda h: h["containment"])), F.lit(0.0))).alias("score"), "hits",
    )


def _sql(pairs, phrases: dict[str, str], threshold: float) -> str:
    """The same in SQL: every block of a template's width is compared with it."""
    templates = templates_of(pairs)
    rows = ", ".join(f"('{t.label}', {t.width}, {t.need(threshold)}, {t.size}, {sorted(set(t.words))})" for t in templates)
    said = ", ".join(f"('{label}', {p.split()})" for p, label in phrases.items())
    return rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(label, width, need, size, words) AS (VALUES {rows}),
p(label, words) AS (VALUES {said}),
f AS (
  SELECT r, label, i FROM (SELECT r, w, label, words, unnest(range(1, len(w) - len(words) + 2)) AS i FROM d, p WHERE list_has_all(w, words)) WHERE w[i : i + len(words) - 1] = words),
fb AS (SELECT r, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS z FROM f GROUP BY r),
k AS (SELECT r, width, w[b * width + 1 : (b + 2) * width] AS w FROM (SELECT r, w, width, unnest(range(0, greatest((len(w) - 1) // width - 1, 0) + 1)) AS b FROM d, (SELECT DISTINCT width FROM t) WHERE len(w) > 0)),
h AS (SELECT r, label, len(list_intersect(w, words)) / size AS c FROM k JOIN t USING (width) WHERE len(list_intersect(w, words)) >= need),
hs AS (SELECT r, max(c) AS c FROM h GROUP BY r),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT DISTINCT r, label FROM f) GROUP BY r),
al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT r, label FROM f UNION SELECT r, label FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(fb.n, 0) AS BIGINT) AS n_base, CAST(fb.a AS BIGINT) AS first_word, CAST(fb.z AS BIGINT) AS last_word,
  coalesce(bl.l, '') AS base_labels, coalesce(al.l, '') AS labels, CASE WHEN fb.n > 0 THEN 1.0 ELSE coalesce(hs.c, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN fb USING (r) LEFT JOIN hs USING (r) LEFT JOIN bl USING (r) LEFT JOIN al USING (r)
"""


SQL = _sql(TEMPLATES, PHRASES, THRESHOLD)
