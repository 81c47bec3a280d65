"""Every registered query that SQL can express, against DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from stipple.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()
ENTRIES = registry.registry()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if sql])
def test_query_equals_sql(spark, duck, sf, name):
    run, sql = ENTRIES[name]
    a, b = run(spark, sf).toPandas(), duck.sql(sql).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-6)


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if not sql])
def test_other_queries_run(spark, sf, name):
    assert ENTRIES[name][0](spark, sf).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
