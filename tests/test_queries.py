"""Every registered query of the library with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from covertile.plans import queries as q
from covertile.plans import surface  # noqa: F401 registers more queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def canon(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])

    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "None"
        return f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(one(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_equals_sql(spark, sf, con, name):
    df = q.QUERIES[name](spark, sf)
    rel = con.sql(q.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("name", ["segments", "assign_hosts", "alternatives"])
def test_others_give_rows(spark, sf, name):
    assert q.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
