"""Every query with a DuckDB twin gives the twin's rows on the smallest tables; the others give rows."""

import glob
import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from labspark.plans import analysis_queries, base, lake_queries, text_queries  # noqa: E402, F401


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(base.ORACLE_SQL))
def test_twin(spark, sf_dir, duck, name):
    df = base.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(base.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.ORACLE_SQL)))
def test_rows(spark, sf_dir, name):
    """Values are held by tests/test_values.py and tests/test_fixtures.py; here each query must give whole rows."""
    found = base.QUERIES[name](spark, sf_dir)
    rows = found.collect()
    assert rows and all(len(r) == len(found.columns) for r in rows) and any(v is not None for r in rows for v in r)


def test_entry_survives_without_the_training_data_operators():
    import __spark_entry__

    assert set(base.QUERIES) <= set(__spark_entry__.queries()) and set(base.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


def test_filters_reach_the_scan(spark, sf_dir):
    plan = base.table(spark, sf_dir, "events").where("user_id = 7").select("event_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan
