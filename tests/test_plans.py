"""Every registered query with SQL gives DuckDB's rows."""

import os

import duckdb
import pytest

from scriptorium.plans import queries as plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, names):
    cell = lambda v: "~" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[names.index(c)]) for c in sorted(names)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA)
    want = duck.sql(plans.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)


def test_entry_imports():
    import __spark_entry__

    assert set(plans.SQL) <= set(__spark_entry__.oracle_sql())
