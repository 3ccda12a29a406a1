import pytest

import __spark_entry__ as entry
from tidelog.plans import kv_queries, store_queries

SF = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["key", "value", "place"] and df.count() > 0


QUERIES, SQL = kv_queries.queries() | store_queries.queries(), kv_queries.oracle_sql() | store_queries.oracle_sql()


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "conversations", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(expected, key=str)
