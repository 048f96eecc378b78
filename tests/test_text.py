import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import urls


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, want", [("Hello,  World!", "hello world"), (None, ""), ("a\tb\n", "a b"), ("It's", "its")])
def test_normalize(spark, text, want):
    assert value(spark, tx.normalize(F.col("a")), a=text) == want


def test_token_f1_counts_repeats(spark):
    assert value(spark, tx.text_f1(F.col("a"), F.col("b")), a="a a b", b="a b b") == pytest.approx(2 / 3)
    assert value(spark, tx.text_f1(F.col("a"), F.col("b")), a="", b="x") == 0


def test_lcs():
    assert tx.lcs_length("a b c d".split(), "b x d".split()) == 2
    assert tx.lcs_length([], ["a"]) == 0


@pytest.mark.parametrize("a, b, want", [("yes", "no", True), ("it won", "it lost", True), ("about 5 men", "about 6 men", True), ("5 men", "women of 6 and more cities", False), ("", "no", False)])
def test_contradiction(spark, a, b, want):
    assert value(spark, tx.contradicts(F.col("a"), F.col("b")), a=a, b=b) is want


def test_missing_answer(spark):
    assert value(spark, tx.is_missing(F.col("a")), a="I don't know.")
    assert not value(spark, tx.is_missing(F.col("a")), a="The retrieved context is insufficient.")


def test_numbers(spark):
    assert sorted(value(spark, tx.numbers(F.col("a")), a="1,500% of the 2nd, -3.5 x7")) == ["-3.5", "1500", "2"]


def test_stem(spark):
    for word, want in (("running", "runn"), ("studies", "study"), ("walked", "walk"), ("cars", "cars"), ("trains", "train"), ("thing", "thing")):
        assert value(spark, tx.stem(F.col("a")), a=word) == want


def test_query_ladder_broadens(spark):
    df = spark.createDataFrame([("who leads the Alpha Beta Gamma council today",)], "q string")
    steps = df.select(tx.focus_terms(F.col("q")).alias("f"), tx.query_terms(F.col("q")).alias("t")).select(tx.query_ladder(F.col("f"), F.col("t")).alias("v")).first()["v"]
    assert steps[0].count(" AND ") == 4 and steps[-1].count(" OR ") == 5


def test_urls(spark):
    assert value(spark, urls.normalize_url(F.col("u")), u="HTTP://www.Site.org/a/b/?q=1#x") == "http://site.org/a/b?q=1"
    assert value(spark, urls.url_key(F.col("u")), u="https://m.site.org/a/") == "m.site.org/a"
    assert str(value(spark, urls.timestamp_of(F.col("u")), u="https://x.org/2022/10/09/a")) == "2022-10-09 00:00:00"
