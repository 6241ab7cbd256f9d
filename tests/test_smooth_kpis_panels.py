"""Rolling mean (M4), binary flag (M5), chart groups (M8), labels (M9), KPIs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorframe.functions.expressions import binary_flag, series_label
from sensorframe.operators import kpis, panels, smooth


def _frame(spark, values, sensor=1, channel="a", step_minutes=1):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(t0 + timedelta(minutes=i * step_minutes), v, sensor, channel)
                                  for i, v in enumerate(values)],
                                 "timestamp timestamp_ntz, value double, ID long, type string")


def _values(df):
    return [r["value"] for r in df.orderBy("ID", "type", "timestamp").collect()]


def test_m4_rolling(spark):
    df = _frame(spark, [1.0, None, 3.0, None, None, None, 5.0])
    assert _values(smooth.rolling_mean(df, 3)) == [1.0, 1.0, 2.0, 3.0, 3.0, None, 5.0]
    assert _values(smooth.rolling_mean(df, 1)) == [1.0, None, 3.0, None, None, None, 5.0]
    assert _values(smooth.rolling_mean(df, 0)) == [1.0, None, 3.0, None, None, None, 5.0]


def test_rolling_blocks_equal_plain_window(spark):
    """Split series with halos give the same numbers as one window per series."""
    vals = [float((i * 7) % 13) if i % 5 else None for i in range(300)]
    # 37-minute steps spread each series over several days (day offsets are used)
    df = _frame(spark, vals, 1, step_minutes=37).unionByName(_frame(spark, vals[::-1], 2, "b", step_minutes=37))
    n = 7
    plain = df.withColumn("value", F.avg("value").over(
        Window.partitionBy("ID", "type").orderBy("timestamp", "value").rowsBetween(-(n - 1), 0)))
    for block in (8, 16, 1000):  # 8 and 16 take the halo-block path, 1000 the plain window
        blocked = smooth.rolling_mean(df, n, block_rows=block)
        a = sorted(map(tuple, blocked.collect()), key=str)
        b = sorted(map(tuple, plain.select(*df.columns).collect()), key=str)
        assert a == b


@pytest.mark.parametrize("values,expected", [
    ([0.0, 1.0], True), ([-0.5, 1.49], True), ([1.5], False), ([2.5], False),
    ([None], False), ([float("inf"), float("-inf")], False), ([0.0, None, 1.0], True),
])
def test_m5_binary_flag(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "value double")
    assert df.agg(binary_flag("value")).first()[0] is expected


def test_m8_chart_groups(spark):
    df = spark.createDataFrame([(i,) for i in [3, 1, 9, 4, 7, 3]], "ID long")
    got = {r["ID"]: (r["group_no"], r["group_count"]) for r in panels.chart_groups(df, 2).collect()}
    assert got == {1: (1, 3), 3: (1, 3), 4: (2, 3), 7: (2, 3), 9: (3, 3)}


def test_m9_label(spark):
    df = spark.createDataFrame([("tempc", "Desk 4", "HQ", "2", "West"), ("co2", None, None, None, None)],
                               "type string, vanity string, building string, floor string, area string")
    got = [r[0] for r in df.select(series_label()).collect()]
    assert got == ["tempc | Desk 4 (HQ 2/West)", "co2 |  ( /)"]


def test_kpis_and_text(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), 1.0, 1, "a")] * 1234 + [(datetime(2024, 1, 5), 2.0, 2, "b")],
                               "timestamp timestamp_ntz, value double, ID long, type string")
    k = kpis.kpis(df).first()
    assert (k.data_points, k.sensors, k.channels) == (1235, 2, 2)
    t = kpis.kpi_text(kpis.kpis(df)).first()
    assert t.data_points_text == "1.235"
    assert t.date_range_text == "2024-01-01 → 2024-01-05"


def test_panels_flag_binary_panel(spark):
    rows = [(datetime(2024, 1, 1, h), float(h % 2), i, "occupancy") for h in range(4) for i in (1, 2)]
    rows += [(datetime(2024, 1, 1, h), 20.5 + h, 1, "tempc") for h in range(4)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, value double, ID long, type string")
    for c in ("vanity", "building", "floor", "area", "nodeTypeName"):
        df = df.withColumn(c, F.lit("x"))
    p = panels.panels_by_channel(df, 12)
    flags = {r["type"]: (r["is_binary"], r["line_shape"], r["y_min"], r["y_max"])
             for r in p.select("type", "is_binary", "line_shape", "y_min", "y_max").distinct().collect()}
    assert flags == {"occupancy": (True, "hv", -0.05, 1.05), "tempc": (False, "linear", None, None)}
    assert p.select("panel_title").distinct().count() == 2


@pytest.mark.parametrize("freq", ["15min", "H", "D", "W", "M"])
def test_dense_rolling_equals_general(spark, freq):
    from sensorframe.operators import resample
    from sensorframe.sources import driver_tables as dt
    from sensorframe.sources.metadata import normalize_metadata
    from tests.conftest import SF0001
    f = dt.facts(spark, SF0001).filter("ID < 20")
    m = normalize_metadata(dt.metadata_raw(spark, SF0001))
    res = resample.resample_series(f, m, freq, "mean")
    a = smooth.rolling_mean_dense(res, 4, freq).withColumn("value", F.round("value", 9))
    b = smooth.rolling_mean(res, 4).withColumn("value", F.round("value", 9))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_kpis_count_missing_channel(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), 1.0, 1, None), (datetime(2024, 1, 2), 1.0, 1, "a")],
                               "timestamp timestamp_ntz, value double, ID long, type string")
    assert kpis.kpis(df).first().channels == 2


@pytest.mark.parametrize("func, freq", [("mean", "H"), ("sum", "W"), ("sum", "D")])
def test_resampled_panels_equal_panels_of_the_dense_frame(spark, facts_df, func, freq):
    from sensorframe.operators import resample
    facts = facts_df([("2024-01-01 00:10", 0.5, 1, "a"), ("2024-01-01 05:00", 0.5, 1, "a"), ("2024-03-01 00:00", 0.0, 2, "a"),
                      ("2024-01-02 00:00", None, 3, "b"), ("2024-01-02 03:00", float("inf"), 3, "b"),
                      ("2024-01-02 01:00", float("inf"), 4, "b"), ("2024-01-02 01:00", 7.0, 5, "a"), ("2024-01-02 01:00", 7.0, 9, "a"),
                      (None, 7.0, 1, "a"), ("2024-01-02 01:00", 7.0, None, "a"), ("2024-01-02 01:00", 7.0, 1, None)])
    # Sensor 1 is there twice with equal attributes and once under another name; sensor 5 lacks an attribute, 9 has no row.
    meta = spark.createDataFrame([
        (1, "x", "h", "1", "w", "t"), (1, "x", "h", "1", "w", "t"), (1, "y", "h", "1", "w", "t"), (2, "", "h", "1", "w", "t"),
        (3, "", "h", "1", "w", "t"), (4, "y", "h", "1", "w", "t"), (5, "y", None, "1", "w", "t")],
        "id long, vanity string, building string, floor string, area string, nodeTypeName string")
    dense = resample.resample_series(facts, meta, freq, func)
    chosen = ["x", ""]
    for want, got in ((panels.panels_by_channel(dense, 2), panels.resampled_panels(facts, meta, freq, func, 2)),
                      (panels.panels_all_channels(dense, 2), panels.resampled_panels(facts, meta, freq, func, 2, by_channel=False)),
                      (panels.panels_by_vanity(dense, chosen, 1), panels.resampled_panels(facts, meta, freq, func, 1, vanities=chosen))):
        assert got.columns == want.columns
        key = lambda r: tuple(map(str, r))
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert panels.resampled_panels(facts.limit(0), meta, freq, func, 2).count() == 0


def test_running_sum_over_blocks(spark):
    from sensorframe.operators.indexing import running_sum
    rows = [(i, i % 7) for i in range(1, 24)]
    got = running_sum(spark.createDataFrame(rows, "k long, v long"), "k", "v", "s", block=5).orderBy("k").collect()
    assert [r.s for r in got] == [sum(v for _, v in rows[:i]) for i in range(1, 24)]


@pytest.mark.parametrize("freq, func, n", [("15min", "mean", 5), ("H", "mean", 3), ("H", "sum", 2000), ("D", "sum", 3), ("D", "max", 1),
                                           ("W", "mean", 2), ("M", "sum", 5)])
def test_rolling_over_gaps_made_late_equals_the_dense_frame(spark, facts_df, freq, func, n):
    from sensorframe.operators import resample
    day = datetime(2023, 12, 30)
    rng = random.Random(n)
    span = {"15min": 60 * 24, "H": 60 * 24 * 5}.get(freq, 60 * 24 * 300)
    rows = [(day + timedelta(minutes=rng.randrange(span)), None if k % 7 == 0 else float(k), k % 4, "ab"[k % 2]) for k in range(60)]
    facts = facts_df([*rows, (day, 1.0, None, "a"), (day, 1.0, 1, None), (None, 1.0, 1, "a"), (day, 1.0, 9, "a")])
    # Sensor 1 has two different metadata rows, sensor 2 one row twice, sensor 3 one row; 9 has none.
    meta = spark.createDataFrame([(1, "x", "h", "1", "w", "t"), (1, "y", "h", "1", "w", "t"), (2, "z", "h", "1", "w", "t"),
                                  (2, "z", "h", "1", "w", "t"), (3, "", "h", "1", "w", "t"), (0, "o", "h", "1", "w", "t")],
                                 "id long, vanity string, building string, floor string, area string, nodeTypeName string")
    want = smooth.rolling_mean_dense(resample.resample_series(facts, meta, freq, func), n, freq)
    got = smooth.rolling_mean_dense(resample.resample_series(facts, meta, freq, func, fill=False), n, freq, fill=func)
    assert got.columns == want.columns
    # Of two equal values in one bin either metadata row may come first, so names are left out.
    key = lambda r: (r.ID, r.type, r.timestamp, -1.0 if r.value is None else round(r.value, 6))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_dense_rows_are_not_sorted_for_a_rolling_mean(spark):
    from sensorframe.plans import registry
    from tests.conftest import SF0001
    plan = registry.Q["resample_then_roll"](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Generate explode(sequence(_from")]
    assert "Window" in plan and not any(x in above for x in ("Window", "Exchange", "Sort"))
