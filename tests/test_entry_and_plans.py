"""Driver contract and plan shape (pushdown, broadcast, no Python UDF)."""

from datetime import datetime

from sensorframe.operators import dedup, enrich, resample
from sensorframe.sources import driver_tables as dt
from sensorframe.sources.facts import read_timeseries
from sensorframe.sources.metadata import normalize_metadata
from tests.conftest import SF0001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert df.columns == ["ID", "type", "vanity", "building", "floor", "area", "nodeTypeName", "timestamp", "value"]
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q)
    from sensorframe.plans import registry
    assert set(registry.Q) <= set(q)
    assert set(registry.Q) == set(registry.SQL)


def test_range_and_channel_pushed_to_scan(spark):
    df = read_timeseries(spark, dt.history(spark, SF0001), dt.env(spark, SF0001), [1, 2], ["click", "error"],
                         datetime(2024, 1, 5), datetime(2024, 1, 9), dt.ROUTING)
    plan = _plan(df)
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "In(event_type" in plan or "EqualTo(event_type" in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_enrichment_broadcasts_metadata(spark):
    meta = normalize_metadata(dt.metadata_raw(spark, SF0001))
    plan = _plan(enrich.enrich(dt.facts(spark, SF0001), meta))
    assert "BroadcastHashJoin" in plan


def test_resample_aggregates_before_join(spark):
    meta = normalize_metadata(dt.metadata_raw(spark, SF0001))
    df = resample.resample_series(dt.facts(spark, SF0001), meta, "H", "mean")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # the aggregate sits below the join with the metadata
    assert plan.index("Join") < plan.rindex("Aggregate")
    assert "PythonUDF" not in _plan(df)


def test_dedup_is_partial_aggregate(spark):
    plan = _plan(dedup.dedup_keep_first(dt.repeated_key_facts(spark, SF0001)))
    assert "partial_min" in plan
