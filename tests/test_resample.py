"""Resampling, gap filling, NULL keys and week/month edges (FIXTURES M1-M3)."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sensorframe.operators import enrich, resample, smooth
from tests.conftest import ts

M1 = [("2024-01-01 00:05:00", 1.0, 1, "a"), ("2024-01-01 00:16:00", 3.0, 1, "a"),
      ("2024-01-01 01:01:00", None, 1, "a"), ("2024-01-01 01:31:00", 7.0, 1, "a")]
META = [(1, "t", "B", "F", "A", "V1"), (2, "t", "B", "F", "A", "V2")]
BINS_15 = [ts("2024-01-01 00:00"), ts("2024-01-01 00:15"), ts("2024-01-01 00:30"), ts("2024-01-01 00:45"),
           ts("2024-01-01 01:00"), ts("2024-01-01 01:15"), ts("2024-01-01 01:30")]


def _series(df):
    return [(r["timestamp"], r["value"]) for r in df.orderBy("timestamp").collect()]


@pytest.mark.parametrize("func,expected", [
    ("mean", [1, 3, None, None, None, None, 7]),
    ("max", [1, 3, None, None, None, None, 7]),
    ("min", [1, 3, None, None, None, None, 7]),
    ("median", [1, 3, None, None, None, None, 7]),
    ("sum", [1, 3, 0, 0, 0, 0, 7]),
])
def test_m1_fifteen_minutes(spark, facts_df, meta_df, func, expected):
    out = resample.resample_series(facts_df(M1), meta_df(META), "15Min", func)
    got = _series(out)
    assert [t for t, _ in got] == BINS_15
    assert [v for _, v in got] == [None if e is None else float(e) for e in expected]


@pytest.mark.parametrize("func,expected", [("mean", [2, 7]), ("sum", [4, 7]), ("max", [3, 7]),
                                           ("min", [1, 7]), ("median", [2, 7])])
def test_m1_hourly(spark, facts_df, meta_df, func, expected):
    got = _series(resample.resample_series(facts_df(M1), meta_df(META), "H", func))
    assert got == [(ts("2024-01-01 00:00"), float(expected[0])), (ts("2024-01-01 01:00"), float(expected[1]))]


def test_m1_resample_then_roll(spark, facts_df, meta_df):
    mean = smooth.rolling_mean(resample.resample_series(facts_df(M1), meta_df(META), "15Min", "mean"), 3)
    assert [v for _, v in _series(mean)] == [1.0, 2.0, 2.0, 3.0, None, None, 7.0]
    s = smooth.rolling_mean(resample.resample_series(facts_df(M1), meta_df(META), "15Min", "sum"), 3)
    got = [v for _, v in _series(s)]
    assert got == pytest.approx([1, 2, 4 / 3, 1, 0, 0, 7 / 3])


M2 = [("2024-01-07 23:59:59", 5.0, 2, "a"), ("2024-01-08 00:00:00", 6.0, 2, "a"),
      ("2024-01-21 00:00:00", 8.0, 2, "a"), ("2024-01-31 23:59:00", 9.0, 2, "a"),
      ("2024-02-01 00:00:00", 10.0, 2, "a")]


def test_m2_week(spark, facts_df, meta_df):
    mean = _series(resample.resample_series(facts_df(M2), meta_df(META), "W", "mean"))
    total = _series(resample.resample_series(facts_df(M2), meta_df(META), "W", "sum"))
    labels = [ts("2024-01-07"), ts("2024-01-14"), ts("2024-01-21"), ts("2024-01-28"), ts("2024-02-04")]
    assert [t for t, _ in mean] == labels
    assert [v for _, v in mean] == [5.0, 6.0, 8.0, None, 9.5]
    assert [v for _, v in total] == [5.0, 6.0, 8.0, 0.0, 19.0]


def test_m2_month(spark, facts_df, meta_df):
    mean = _series(resample.resample_series(facts_df(M2), meta_df(META), "M", "mean"))
    total = _series(resample.resample_series(facts_df(M2), meta_df(META), "M", "sum"))
    assert mean == [(ts("2024-01-31"), 7.0), (ts("2024-02-29"), 10.0)]
    assert total == [(ts("2024-01-31"), 28.0), (ts("2024-02-29"), 10.0)]


def test_m3_null_key(spark, facts_df, meta_df):
    rows = [("2024-01-01 00:05:00", 1.0, 1, "a"), ("2024-01-01 00:06:00", 2.0, 99, "a")]
    f, m = facts_df(rows), meta_df(META)
    raw = enrich.enrich(f, m)
    assert raw.count() == 2  # the raw path keeps the fact without metadata
    assert raw.filter(F.col("ID") == 99).first()["vanity"] is None
    res = resample.resample(raw, "H", "mean")
    assert [r["ID"] for r in res.collect()] == [1]
    fast = resample.resample_series(f, m, "H", "mean")
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, res.collect()))


def test_duplicate_metadata_counts_for_sum(spark, facts_df, meta_df):
    rows = [("2024-01-01 00:05:00", 2.0, 1, "a")]
    m = meta_df(META + [(1, "t", "B", "F", "A", "V1")])  # exact duplicate of id 1
    slow = resample.resample(enrich.enrich(facts_df(rows), m), "H", "sum")
    fast = resample.resample_series(facts_df(rows), m, "H", "sum")
    assert [r["value"] for r in fast.collect()] == [4.0]
    # pandas groups the two identical rows into one group and sums both copies
    assert sorted(r["value"] for r in slow.collect()) == [4.0]


def test_series_axis_not_padded(spark, facts_df, meta_df):
    rows = [("2024-01-01 10:00:00", 1.0, 1, "a"), ("2024-01-01 12:30:00", 2.0, 1, "a"),
            ("2024-01-01 11:00:00", 5.0, 2, "b")]
    out = resample.resample_series(facts_df(rows), meta_df(META), "H", "mean")
    by = {}
    for r in out.collect():
        by.setdefault(r["ID"], []).append(r["timestamp"])
    assert sorted(by[1]) == [ts("2024-01-01 10:00"), ts("2024-01-01 11:00"), ts("2024-01-01 12:00")]
    assert by[2] == [ts("2024-01-01 11:00")]


def test_fast_path_equals_enrich_then_resample(spark):
    from sensorframe.sources import driver_tables as dt
    from sensorframe.sources.metadata import normalize_metadata
    from tests.conftest import SF0001
    f = dt.facts(spark, SF0001)
    m = normalize_metadata(dt.metadata_raw(spark, SF0001))
    for freq, func in [("D", "median"), ("W", "sum"), ("H", "max")]:
        a = resample.resample_series(f, m, freq, func).withColumn("value", F.round("value", 6))
        b = resample.resample(enrich.enrich(f, m), freq, func).withColumn("value", F.round("value", 6))
        assert a.exceptAll(b.select(*a.columns)).count() == 0
        assert b.select(*a.columns).exceptAll(a).count() == 0


def test_sum_over_bins_equals_raw_sum(spark):
    from sensorframe.sources import driver_tables as dt
    from sensorframe.sources.metadata import normalize_metadata
    from tests.conftest import SF0001
    f = dt.facts(spark, SF0001)
    m = normalize_metadata(dt.metadata_raw(spark, SF0001))
    res = resample.resample_series(f, m, "H", "sum")
    assert res.agg(F.sum("value")).first()[0] == pytest.approx(f.agg(F.sum("value")).first()[0])
    # dense axis: bins per series = span / step + 1
    span = (f.groupBy("ID", "type").agg(((F.unix_timestamp(F.max(F.date_trunc("hour", "timestamp")))
                                          - F.unix_timestamp(F.min(F.date_trunc("hour", "timestamp")))) / 3600 + 1)
                                         .alias("n")).agg(F.sum("n")).first()[0])
    assert res.count() == span


def test_week_label_is_sunday(spark, facts_df):
    rows = [(datetime(2024, 1, d, 12), 1.0, 1, "a") for d in range(1, 15)]
    out = resample.assign_bins(facts_df(rows), "W").select("bin").distinct().collect()
    assert sorted(r[0] for r in out) == [ts("2024-01-07"), ts("2024-01-14")]
