"""Physical-plan checks: SQL-expressible queries stay JVM-side, filters reach the scan, fixed dimensions are
broadcast, and no operator sends a whole participant to one window task."""

import pytest

from wellspark.plans import all_queries as queries
from conftest import SF_SMALL

PYTHON_STAGES = ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonMapInArrow")
PYTHON_QUERIES = {"stress_score", "ppg_stress", "ppg_stress_5s", "ppg_stress_lines", "reconstruction_error"}
STREAM_QUERIES = {"stream_window_60s", "stream_daily_nutrients", "stream_sessions", "stream_dedup"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(queries()) - PYTHON_QUERIES - STREAM_QUERIES))
def test_no_python_in_sql_queries(spark, name):
    plan = _plan(queries()[name](spark, SF_SMALL))
    assert not any(p in plan for p in PYTHON_STAGES), name


def test_range_filter_pushed_to_scan(spark):
    plan = _plan(queries()["range_select"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_column_pruning(spark):
    plan = _plan(queries()["seconds_to_minutes"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_attributes_are_not_broadcast_from_an_estimate(spark):
    """The side's size is measured at run time (AQE); the initial plan shuffles."""
    assert "BroadcastExchange" not in _plan(queries()["profile_join"](spark, SF_SMALL))


def test_no_whole_user_window(spark):
    """Ordered event operators window over (user, day) buckets, never over the user alone."""
    for name in ("run_starts", "last_segment", "fixed_chunks", "beat_intervals"):
        df = queries()[name](spark, SF_SMALL)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and "windowspecdefinition(user_id, ts" in line:
                pytest.fail(f"{name}: whole-user window: {line.strip()[:200]}")
