"""Every query with SQL gives the rows that DuckDB gives, with the same column names."""

import duckdb
import pytest

from grainflow.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    key = lambda row: tuple((v is None, repr(v)) for v in row)
    ours = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    order = [rel.columns.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)
    assert len(ours) == len(theirs)
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not wrong, (len(wrong), wrong[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_bootstrap_has_all_resamples(spark):
    assert sorted(r.resample for r in QUERIES["bootstrap"](spark, SF).collect()) == list(range(100))
