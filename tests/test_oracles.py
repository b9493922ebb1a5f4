"""Every registered query against its DuckDB oracle on the smallest driver tables (the driver repeats this at
sf0.01); queries without an oracle must run and return their declared columns."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from wellspark.plans import all_oracles, all_queries
from wellspark.sources.tables import TABLES

from conftest import SF_SMALL

QUERIES = all_queries()
ORACLES = all_oracles()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, float):
        return (1, round(v, 9))
    if hasattr(v, "isoformat"):
        return (1, v.isoformat())
    return (1, repr(v))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_exposes_the_plans():
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns == ["user_id", "trend_n_events", "trend_total_value"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(ORACLES[name])
    o_cols = rel.columns
    o_rows = rel.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    oi = [o_cols.index(c) for c in order]
    left = sorted([[_norm(r[i]) for i in si] for r in s_rows])
    right = sorted([[_norm(r[i]) for i in oi] for r in o_rows])
    assert len(left) == len(right)
    assert left == right
