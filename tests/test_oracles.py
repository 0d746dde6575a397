"""Every registered query runs on sf0.001; those with an oracle match DuckDB."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import rows_of  # noqa: E402
from rivulet.sources.tables import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
from rivulet.plans import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["userId", "similarUsers"] and df.count() > 0


def test_entry_registers_all():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_every_query_has_a_known_check():
    missing = set(ORACLES) - set(QUERIES)
    assert not missing
    rows_only = set(QUERIES) - set(ORACLES)
    assert rows_only <= {"item_popularity_approx", "als_recommend", "kmeans_users", "kmeans_items",
                         "batch_outputs", "factor_train_recommend"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    pdf = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(pdf) > 0
        return
    dpdf = con.execute(ORACLES[name]).df()
    c1, r1 = rows_of(pdf, True)
    c2, r2 = rows_of(dpdf, True)
    assert c1 == c2
    assert r1 == r2, (name, list((r1 - r2).items())[:3], list((r2 - r1).items())[:3])


def test_branches_are_reached(con):
    def count(name, cond):
        return con.execute(f"SELECT COUNT(*) FROM ({ORACLES[name]}) q WHERE {cond}").fetchone()[0]
    for cond in ("k = 0", "k = 20", "k > 20 AND k < 100", "k = 100", "category IS NULL"):
        assert count("audience_quota_spread", cond), cond
    cut = con.execute(f"SELECT COUNT(*) FROM ({ORACLES['distinct_pairs']}) q").fetchone()[0]
    assert 0 < count("stratified_sample_spread", "TRUE") < cut
    for cond in ("user_count = 0", "user_count_text LIKE '%,%' OR user_count > 100"):
        assert count("popularity_lookup_spread", cond), cond
    assert count("item_peers_long_titles", "length(title) = 35") and count("item_peers_long_titles", "length(title) < 35")
    assert count("parse_duration_edges", "length IS NULL") and count("parse_duration_edges", "length IS NOT NULL")
    assert count("json_fields_missing", "k = '0'") and count("json_fields_missing", "k <> '0'")
    for cond in ("age = 14", "age = 60", "age > 14 AND age < 60", "age IS NULL"):
        assert count("clean_users", cond), cond
