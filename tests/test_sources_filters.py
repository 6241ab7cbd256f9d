"""Metadata tolerance (M6), ranges (M7), channel routing, CSV."""

from datetime import date, datetime, time

from pyspark.sql import functions as F

from sensorframe import model
from sensorframe.operators import filters
from sensorframe.sinks import csv as csv_sink
from sensorframe.session import local_path, work_dir
from sensorframe.sources import metadata
from sensorframe.sources.facts import read_timeseries


def test_m6_metadata_tolerance(spark):
    full = spark.createDataFrame([(1, "V", "B", "F", "A", "ers_eye")],
                                 "id long, vanity string, building string, floor string, area string, nodeTypeName string")
    only_id = spark.createDataFrame([(1,)], "id long")
    alias = spark.createDataFrame([(1, "ers_co2", "other")], "id long, node_type_name string, type string")
    nulls = spark.createDataFrame([(1, None, None, None, None, None)],
                                  "id long, vanity string, building string, floor string, area string, nodeTypeName string")
    for raw, typ in [(full, "ers_eye"), (only_id, ""), (alias, "ers_co2"), (nulls, "")]:
        out = metadata.normalize_metadata(raw)
        assert out.columns == model.META_COLUMNS
        row = out.first()
        assert row["nodeTypeName"] == typ
        assert all(row[c] is not None for c in model.META_COLUMNS)


def test_m7_ranges(spark):
    assert filters.query_range(date(2024, 1, 10), time(0, 0), date(2024, 1, 10), time(23, 59)) == \
        (datetime(2024, 1, 10), datetime(2024, 1, 11))
    assert filters.whole_days(date(2024, 1, 10), date(2024, 1, 11)) == (datetime(2024, 1, 10), datetime(2024, 1, 12))
    df = spark.createDataFrame([(datetime(2024, 1, 11), 1.0, 1, "a"), (datetime(2024, 1, 10, 23, 59, 59), 2.0, 1, "a")],
                               model.FACT_SCHEMA)
    got = filters.filter_range(df, datetime(2024, 1, 10), datetime(2024, 1, 11)).collect()
    assert [r["value"] for r in got] == [2.0]  # a row exactly at the end is out


def test_channel_routing_and_defaults(spark):
    hist = spark.createDataFrame([(datetime(2024, 1, 1), 1.0, 1, "occupancy"), (datetime(2024, 1, 1), 1.0, 1, "tempc")],
                                 model.FACT_SCHEMA)
    env = spark.createDataFrame([(datetime(2024, 1, 1), 2.0, 1, "tempc"), (datetime(2024, 1, 1), 2.0, 1, "occupancy")],
                                model.FACT_SCHEMA)
    out = read_timeseries(spark, hist, env, [1], ["occupancy", "tempc", "bogus"], datetime(2024, 1, 1),
                          datetime(2024, 1, 2))
    # each channel is read only from its own table
    assert sorted((r["type"], r["value"]) for r in out.collect()) == [("occupancy", 1.0), ("tempc", 2.0)]
    assert read_timeseries(spark, hist, env, [], ["tempc"], None, None).count() == 0
    assert read_timeseries(spark, hist, env, [1], [], None, None).columns == model.FACT_COLUMNS
    assert filters.resolve_channels([]) == model.DEFAULT_CHANNELS


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), 1.0, 1, None), (datetime(2024, 1, 1), 1.0, 1, "motion"),
                                (datetime(2024, 1, 1), 1.0, 1, "co2")], model.FACT_SCHEMA)
    assert sorted(str(r["type"]) for r in filters.filter_not_in(df, model.HISTORY_CHANNELS).collect()) == ["None", "co2"]


def test_valid_timestamps(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1.0), ("not a time", 2.0), (None, 3.0)],
                               "timestamp string, value double")
    out = filters.valid_timestamps(df).collect()
    assert [(r["timestamp"], r["value"]) for r in out] == [(datetime(2024, 1, 1), 1.0)]


def test_m10_csv(spark):
    df = spark.createDataFrame([("a,b", 'q"x', None, datetime(2024, 1, 1))],
                               "s1 string, s2 string, s3 string, t timestamp_ntz")
    path = work_dir(spark, "csvtest")
    csv_sink.write_export_csv(df, path + "/export", single_file=True)
    import glob
    text = open(glob.glob(local_path(path) + "/export/part-*.csv")[0], encoding="utf-8").read()
    assert text.splitlines() == ["s1,s2,s3,t", '"a,b","q""x",,2024-01-01 00:00:00']
    n = csv_sink.write_copy_csv(df, path + "/copy")
    assert n == 1
    text = "".join(open(p, encoding="utf-8").read() for p in glob.glob(local_path(path) + "/copy/part-*.csv"))
    assert text.strip() == '"a,b","q""x",\\N,2024-01-01 00:00:00.000000'
    back = csv_sink.read_copy_csv(spark, path + "/copy", df.schema).first()
    assert tuple(back) == ("a,b", 'q"x', None, datetime(2024, 1, 1))
