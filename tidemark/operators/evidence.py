"""Support facts of questions: linkage, payloads, probe documents and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import urls
from tidemark.operators import temporal as tp
from tidemark.operators.probe import STAGES
from tidemark.shared import written


def fact_id(row: Column, subject: Column, prop: Column, obj: Column, link: Column) -> Column:
    """A name for a fact that its row number and fields determine."""
    return F.concat(F.lit("fact_"), tx.text_hash(F.concat_ws("|", row.cast("string"), *(F.coalesce(c, F.lit("")) for c in (subject, prop, obj, link)))))


def entries(facts: DataFrame, templates: dict[str, dict[str, tuple[str, str]]], absent: dict[str, list[tuple[str, str, str]]]) -> DataFrame:
    """(fact columns, kind, question, answer, q, a): the questions that facts answer, from templates of their property.

    ``templates`` maps a property to kinds and their (question, answer) with {subject} and {object}; ``absent`` maps it to
    (kind, question, answer) for facts without an object.  q and a are the normal forms that questions are looked up by.
    """
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{subject}"), F.coalesce("subject", F.lit(""))), F.lit("{object}"), F.coalesce("object", F.lit("")))
    entry = lambda kind, q, a: F.struct(F.lit(kind).alias("kind"), tx.squeeze(fill(q)).alias("question"), tx.squeeze(fill(a)).alias("answer"))
    empty = F.coalesce("object", F.lit("")) == ""
    made = F.array().cast("array<struct<kind:string,question:string,answer:string>>")
    for prop, kinds in templates.items():
        made = F.when(F.col("property") == prop, F.array(*(entry(k, q, a) for k, (q, a) in kinds.items()))).otherwise(made)
    for prop, kinds in absent.items():
        made = F.when((F.col("property") == prop) & empty, F.array(*(entry(*k) for k in kinds))).otherwise(made)
    rows = facts.select("*", F.explode(made).alias("_e")).select(*facts.columns, "_e.*")
    return rows.withColumns({"q": tx.normalize(F.col("question")), "a": tx.normalize(F.col("answer"))})


def asked_once(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, q, a, start_ts, end_ts) of one row for all that ask the same in the same time, and (first, row): whom each of these stands for."""
    q = questions.select("row", tx.normalize(F.col("question")).alias("q"), tx.normalize(F.col("answer")).alias("a"), "start_ts", "end_ts")
    # a row that comes more than once asks all that it asks
    each = written(q.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("q", "a", "start_ts", "end_ts"))).alias("asks"), F.count("*").alias("times")))
    first = written(each.groupBy("asks").agg(F.min("row").alias("first")))
    stands = each.join(first, "asks").select("first", "row", "times")
    return first.select(F.col("first").alias("row"), F.explode("asks").alias("e")).select("row", "e.*"), stands


def link_once(q: DataFrame, made: DataFrame, facts: DataFrame) -> DataFrame:
    """(row, status, fact_id, support) of rows of ``asked_once``.

    direct: the facts whose template gives question and answer, those that agree best with its interval.  Else for
    ``no`` to a yes/no question about a fact: other objects of its subject and property in that time; for ``yes`` to
    a question of absence: any object in that time.  What has no support keeps a row that says so.
    """
    span = lambda c: F.col(c)
    scored = q.join(made.select("q", "a", "fact_id", F.col("start_ts").alias("fs"), F.col("end_ts").alias("fe")), ["q", "a"])
    scored = scored.withColumn("score", tp.match_score(span("start_ts"), span("end_ts"), span("fs"), span("fe")))
    direct = written(tp.best_matches(scored, ["row"], "score").select("row", "fact_id").distinct().select("row", F.lit("direct").alias("status"), "fact_id", F.lit("direct").alias("support")))
    open_ = q.join(direct.select("row").distinct(), "row", "left_anti")

    def competing(answer: str, kind: str, support: str, found: str, lost: str) -> DataFrame:
        asked = open_.filter(F.col("a") == answer).select("row", "q", "start_ts", "end_ts")
        # of the facts that a question is about, what their peers are held against: the objects, and two of each object's facts, as no fact competes with itself
        target = made.filter(F.col("kind") == kind).select("q", "subject", "property", "fact_id", F.coalesce("object", F.lit("")).alias("target_object"))
        of = ["q", "subject", "property", *(["target_object"] if kind == "binary" else [])]
        target = target.groupBy(*of).agg(F.min("fact_id").alias("one"), F.max("fact_id").alias("two"))
        hits = asked.join(target, "q")
        peers = facts.select("subject", "property", "fact_id", F.coalesce("object", F.lit("")).alias("object"), F.col("start_ts").alias("fs"), F.col("end_ts").alias("fe"))
        other = ((F.col("fact_id") != F.col("one")) | (F.col("fact_id") != F.col("two"))) & (F.col("object") != F.col("target_object")) if kind == "binary" else F.col("object") != ""
        pairs = written(hits.join(peers, ["subject", "property"]).filter(other & tp.overlap(span("start_ts"), span("end_ts"), span("fs"), span("fe"))).select("row", "fact_id").distinct())
        none = hits.select("row").distinct().join(pairs.select("row").distinct(), "row", "left_anti")
        return pairs.select("row", F.lit(found).alias("status"), "fact_id", F.lit(support).alias("support")).unionByName(none.select("row", F.lit(lost).alias("status"), F.lit(None).cast("string").alias("fact_id"), F.lit(None).cast("string").alias("support")))

    no = competing("no", "binary", "competing_current_fact", "binary_no_competing", "binary_no_unmapped")
    yes = competing("yes", "absence", "competing_present_fact", "absence_yes_competing", "absence_yes_unmapped")
    known = direct.unionByName(no).unionByName(yes)
    rest = q.select("row").distinct().join(known.select("row").distinct(), "row", "left_anti").select("row", F.lit("unmapped").alias("status"), F.lit(None).cast("string").alias("fact_id"), F.lit(None).cast("string").alias("support"))
    return known.unionByName(rest)


def link(questions: DataFrame, made: DataFrame, facts: DataFrame) -> DataFrame:
    """(row, status, fact_id, support): the facts behind each question (row, question, answer, start_ts, end_ts), see ``link_once``.

    Rows that ask the same in the same time have the same facts: these are looked for once and given to all of them.
    """
    q, stands = asked_once(questions)
    found = written(link_once(q, made, facts))
    out = found.withColumnRenamed("row", "first").join(stands, "first").select("row", "status", "fact_id", "support")
    # an unmapped row comes as often as it is asked
    more = found.filter("status = 'unmapped'").withColumnRenamed("row", "first").join(stands.filter("times > 1").withColumn("times", F.explode(F.sequence(F.lit(2), F.col("times").cast("int")))), "first")
    return out.unionByName(more.select("row", "status", "fact_id", "support"))


def coverage(questions: DataFrame, made: DataFrame, facts: DataFrame) -> DataFrame:
    """(status, questions, facts): how many questions are linked in each way, and to how many facts; counted without listing each question's facts."""
    q, stands = asked_once(questions)
    each = link_once(q, made, facts).groupBy("row", "status").agg(F.count("fact_id").alias("facts"))
    rows = stands.groupBy(F.col("first").alias("row")).agg(F.count("*").alias("questions"))
    return each.join(rows, "row").groupBy("status").agg(F.sum("questions").alias("questions"), F.sum(F.col("questions") * F.col("facts")).alias("facts"))


def payloads(facts: DataFrame, versions: DataFrame) -> DataFrame:
    """facts with archive_versions: those of their link (source_url, timestamp, archive_url), by timestamp."""
    v = versions.select(F.col("source_url").alias("_u"), F.struct("timestamp", F.coalesce(F.nullif("archive_url", F.lit("")), "source_url").alias("archive_url")).alias("_v"))
    per = v.groupBy("_u").agg(F.array_sort(F.collect_list("_v")).alias("archive_versions"))
    out = facts.join(per, facts["source_url"] == per["_u"], "left").drop("_u")
    return out.withColumn("archive_versions", F.coalesce("archive_versions", F.array().cast(per.schema["archive_versions"].dataType)))


def with_support(facts: Column) -> Column:
    """The facts that quote evidence."""
    return F.filter(facts, lambda f: F.coalesce(f["evidence_span"], F.lit("")) != "")


def eligible(docs: Column, facts: Column) -> Column:
    """Whether a record can be probed: it has current documents and a fact with evidence."""
    return (F.coalesce(F.size(docs), F.lit(0)) > 0) & (F.coalesce(F.size(with_support(facts)), F.lit(0)) > 0)


def renumber(docs: Column) -> Column:
    """Documents under rank headers in array order; one without a header gets one."""
    head = lambda i: F.concat(F.lit("[retrieved rank "), (i + 1).cast("string"), F.lit("]"))
    pattern = r"^\[retrieved rank \d+\]"
    return F.transform(docs, lambda d, i: F.when(d.rlike(pattern), F.concat(head(i), F.regexp_replace(d, pattern, ""))).otherwise(F.concat(head(i), F.lit("\n"), d)))


def _or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def evidence_document(fact: Column, rank: Column) -> Column:
    """A fact's evidence in the form of a retrieved document."""
    host = F.regexp_replace(F.regexp_extract(F.coalesce(fact["source_url"], F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^www\.", "")
    lines = [
        F.concat(F.lit("[retrieved rank "), rank.cast("string"), F.lit("]")),
        F.concat(F.lit("Timestamp: "), F.coalesce(F.nullif(fact["source_date"], F.lit("")), F.nullif(fact["valid_start"], F.lit("")), F.lit("unknown"))),
        F.concat(F.lit("Title: Evidence from "), _or(host, "source")), F.concat(F.lit("Source URL: "), F.coalesce(fact["source_url"], F.lit(""))),
        F.concat(F.lit("Document ID: "), _or(fact["fact_id"], "official-evidence")), F.concat(F.lit("Chunk: "), F.coalesce(fact["row"].cast("string"), F.lit("0"))), F.trim(F.coalesce(fact["evidence_span"], F.lit(""))),
    ]
    return F.concat_ws("\n", *lines)


def fact_card(date: Column, relation: Column, gold: Column, facts: Column) -> Column:
    """What is known, in words: the date, the answer and each fact."""
    head = [
        F.concat(F.lit("Evaluation date: "), F.coalesce(F.left(date, F.lit(10)), F.lit(""))), F.concat(F.lit("Question subject: "), F.coalesce(F.get(facts, F.lit(0))["subject"], F.lit("unknown"))),
        F.concat(F.lit("Question relation: "), _or(relation, "unknown")), F.concat(F.lit("Verified answer to the question: "), gold),
    ]
    text = lambda f: F.concat_ws("\n", F.concat(F.lit("Current fact: "), F.concat_ws(" | ", f["subject"], f["property"], f["object"])), F.concat(F.lit("Valid from: "), _or(f["valid_start"], "unknown")), F.concat(F.lit("Source date: "), _or(f["source_date"], "unknown")), F.concat(F.lit("Source URL: "), F.coalesce(f["source_url"], F.lit(""))))
    return F.concat_ws("\n", *head, F.transform(facts, text))


def support_index(docs: Column, best_rank: Column, support_urls: Column) -> Column:
    """The place (from 0) of the supporting document: the recorded rank if there is such a document, else the first that names a support URL."""
    keys = F.filter(F.transform(F.coalesce(support_urls, F.array().cast("array<string>")), lambda u: F.lower(urls.url_key(u))), lambda k: k != "")

    def find(s: Column) -> Column:
        hit = F.transform(docs, lambda d: F.exists(s["keys"], lambda k: F.contains(F.replace(F.lower(d), F.lit("www."), F.lit("")), k)))
        return F.nullif(F.array_position(hit, True), F.lit(0)).cast("int") - 1

    recorded = best_rank.cast("int") - 1
    return F.coalesce(F.when((recorded >= 0) & (recorded < F.size(docs)), recorded), tx.let(find, keys=keys))


def probe_documents(docs: Column, facts: Column, best_rank: Column, support_urls: Column, date: Column, relation: Column, gold: Column) -> Column:
    """Struct of the five stages' documents and what was changed for them.

    As retrieved; with the support among them (the first fact's evidence as the tenth, if it was missing); with it
    first; the facts' evidence alone; the facts in words alone.
    """

    def build(s: Column) -> Column:
        natural, used = s["natural"], s["used"]
        at = support_index(natural, best_rank, support_urls)

        def staged(t: Column) -> Column:
            injected = t["at"].isNull()
            grown = F.concat(F.slice(natural, 1, 9), F.array(evidence_document(F.get(used, F.lit(0)), F.lit(10))))
            presence = renumber(F.when(injected, grown).otherwise(natural))
            place = F.when(injected, F.least(F.size(natural), F.lit(9))).otherwise(t["at"])

            def whole(u: Column) -> Column:
                first = renumber(F.concat(F.array(F.get(u["presence"], u["place"])), F.filter(u["presence"], lambda _, i: i != u["place"])))
                return F.struct(
                    natural.alias(STAGES[0]), u["presence"].alias(STAGES[1]), first.alias(STAGES[2]), F.transform(used, lambda f, i: evidence_document(f, i + 1)).alias(STAGES[3]), F.array(fact_card(date, relation, gold, used)).alias(STAGES[4]),
                    (~injected).alias("natural_support_hit"), (t["at"] + 1).alias("natural_support_rank"), injected.alias("injected"), (u["place"] != 0).alias("moved"), F.size(used).alias("n_facts"),
                )

            return tx.let(whole, presence=presence, place=place)

        return tx.let(staged, at=at)

    return tx.let(build, natural=renumber(docs), used=with_support(facts))


def check_cohort(rows: DataFrame) -> DataFrame:
    """(problem, id) of what is wrong with prepared records (id, gold_answer, docs as of ``probe_documents``, times): no row if all is well."""
    docs = lambda s: F.lower(F.array_join(F.col(f"docs.{s}"), "\n"))
    named = None
    for s in STAGES:
        for t in STAGES:
            hit = docs(s).contains(t)
            named = hit if named is None else named | hit
    per = rows.select("id", F.explode(F.array(
        F.when(named, "stage name in a context"), F.when(F.size(F.array_distinct("times")) != 1, "times differ"),
        F.when(~F.coalesce(docs(STAGES[4]).contains(F.lower("gold_answer")), F.lit(False)), "fact card without the answer"),
        F.when(~F.col("docs.injected") & (docs(STAGES[0]) != docs(STAGES[1])), "unchanged second stage differs"),
    )).alias("problem")).filter("problem is not null")
    twice = rows.groupBy("id").count().filter("count > 1").select("id", F.lit("id comes twice").alias("problem"))
    return per.unionByName(twice).select("problem", "id")
