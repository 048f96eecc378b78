"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="synthetic tables are not there")


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v) -> str:
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "none"
        return repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


def test_whole_tables(spark):
    """Joins of intervals and contexts cover all users and documents."""
    users = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
    assert catalog.QUERIES["interval_overlap_join"](spark, SF).select("question_id").distinct().count() == users
    assert catalog.QUERIES["interleaved_context"](spark, SF).count() == 25


def test_versions_that_start_alike(spark, tmp_path):
    """Only rows of one time, title and opening are one version."""
    opening = "An opening line that many have\n" + "licence " * 60
    # 850 days apart is the same time again
    rows = [(1, opening + "first"), (2, opening + "second"), (3, opening + "first"), (851, opening + "first"), (852, "Another title of this\n" + opening), (1701, "short")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["doc_id"] for r in catalog.QUERIES["version_dedup"](spark, str(tmp_path)).collect()) == [1, 2, 3, 852]


#: Of each supplier's lines before and after the date: how many, and how many of them are N.
_STEPS = [(100, 35, 100, 33), (100, 33, 100, 35), (100, 50, 100, 48), (300, 97, 300, 103), (300, 103, 300, 97), (3, 1, 150, 47), (25, 8, 100, 31), (0, 0, 50, 17), (40, 13, 0, 0), (90, 31, 90, 31)]


@pytest.mark.parametrize("name", ["outcome_states", "state_counts", "primary_subset"])
def test_outcomes_at_exactly_the_drop(spark, tmp_path, name):
    """A difference that is the drop but for the last digits of its numbers counts as in SQL."""
    flags = lambda n, k: [i < k for i in range(n)]
    rows = [(s, "N" if f else "A", t) for s, (n, k, m, j) in enumerate(_STEPS) for t, fs in (("1998-01-01", flags(n, k)), ("1998-07-01", flags(m, j))) for f in fs]
    df = pd.DataFrame(rows, columns=["l_suppkey", "l_returnflag", "l_shipdate"]).astype({"l_suppkey": "int64", "l_shipdate": "datetime64[us]"})
    df.to_parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
    assert normal(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()) == normal(c.execute(catalog.ORACLES[name]).df())


def test_rates_that_end_in_a_five(spark, tmp_path):
    """Shares of 640 suppliers have seven digits, of which the last is rounded as SQL does."""
    rows = [(s, "N" if t < "1998-06" or s >= 41 else "A", t) for s in range(640) for t in ("1998-01-01", "1998-07-01")]
    df = pd.DataFrame(rows, columns=["l_suppkey", "l_returnflag", "l_shipdate"]).astype({"l_suppkey": "int64", "l_shipdate": "datetime64[us]"})
    df.to_parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
    got, want = catalog.QUERIES["state_counts"](spark, str(tmp_path)).toPandas(), c.execute(catalog.ORACLES["state_counts"]).df()
    assert sorted(map(tuple, got[["outcome_state", "n", "rate"]].values)) == sorted(map(tuple, want[["outcome_state", "n", "rate"]].values)) and (got.n == 41).any()


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns
