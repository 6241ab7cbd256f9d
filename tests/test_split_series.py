"""Operators that split one hot series or bin over tasks: exact medians, gap
filling by spans, rolling means by blocks, KPIs without the dense frame."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorframe import model
from sensorframe.operators import kpis, quantiles, resample, smooth

DAY = datetime(2024, 3, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_median_equals_the_buffered_one(spark):
    rng = random.Random(4)
    rows = [("empty", None), ("empty", None), ("one", -3.5), ("inf", float("inf")), ("inf", float("-inf")), ("inf", 1.0), ("nan", float("nan")), ("nan", 2.0)]
    rows += [("hot", rng.choice([rng.gauss(20, 1e-4), rng.gauss(-5, 300), 20.0, None])) for _ in range(4000)]
    for k in range(60):
        scale = 10.0 ** rng.randrange(-14, 15)
        rows += [(f"k{k}", rng.choice([0.0, -0.0, scale, rng.uniform(-1, 1) * scale, None])) for _ in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "k string, value double").repartition(7)
    got = {r.k: r.value for r in quantiles.median_by(df, ["k"]).collect()}
    expect = {r.k: r.m for r in df.groupBy("k").agg(F.median("value").alias("m")).collect()}
    assert set(got) == set(expect)
    same = lambda a, b: a == b or (a is not None and b is not None and a != a and b != b)
    assert all(same(got[k], expect[k]) for k in expect)


def test_hot_bin_is_spread_over_tasks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), (F.rand(1) * 10 + 15).alias("value")).repartition(4).checkpoint()
    assert quantiles.median_by(df, ["k"]).first().value == df.agg(F.median("value")).first()[0]
    plan = _plan(quantiles.median_by(df, ["k"]))
    assert "Percentile" not in plan and "median" not in plan
    # The values travel by (key, value) and (key, bucket): no exchange of them is on the key alone.
    counted = df.select("k", quantiles.value_bucket(F.col("value")).alias("b"))
    assert counted.distinct().count() > 5_000
    assert counted.groupBy("k", "b").count().agg(F.max("count")).first()[0] < 20


def test_buckets_never_fall(spark):
    rng = random.Random(9)
    values = sorted([0.0, 1e-300, 1e300, -1e300, 5e-324] + [rng.choice([-1, 1]) * 10 ** rng.uniform(-20, 20) for _ in range(3000)])
    got = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select(
        "i", quantiles.value_bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("frequency,step", [("15Min", timedelta(minutes=15)), ("H", timedelta(hours=1)), ("D", timedelta(days=1))])
def test_long_axis_is_cut_into_spans(spark, facts_df, meta_df, frequency, step):
    first, last = datetime(1969, 11, 30, 5), datetime(1970, 6, 2) if frequency == "15Min" else datetime(1990, 1, 1)
    gone = [(first, 1.0, 7, "a"), (last, 1.0, 7, "a")]  # no metadata: its bins are never made
    rows = [(first, 2.0, 1, "a"), (first + 3 * step, None, 1, "a"), (last, 4.0, 1, "a"), (first, 5.0, 1, "b")]
    out = resample.resample_series(facts_df(rows + gone), meta_df([(1, "t", "B", "F", "A", "V1")]), frequency, "sum")
    plan = _plan(out)
    assert "_span" in plan and plan.rindex("LeftSemi") > plan.index("Generate")  # deeper in the tree, so below
    got = {(r.type, r.timestamp): r.value for r in out.collect()}
    floor = lambda t: t if frequency != "D" else t.replace(hour=0)
    axis, t = [], floor(first)
    while t <= floor(last):
        axis.append(t)
        t += step
    assert sorted(t for k, t in got if k == "a") == axis
    assert {k: v for k, v in got.items() if v} == {("a", floor(first)): 2.0, ("a", floor(last)): 4.0, ("b", floor(first)): 5.0}


def test_one_hot_sensor_day_rolls_in_blocks(spark):
    rng = random.Random(2)
    rows = [(DAY + timedelta(seconds=rng.randrange(86_400)), rng.choice([None, rng.random()]), 1, "a") for _ in range(3000)]
    rows += [(DAY + timedelta(days=rng.randrange(-400, 400), minutes=rng.randrange(1440)), rng.random(), rng.randrange(3), rng.choice("ab")) for _ in range(500)]
    rows += [(None, 1.0, 1, "a"), (None, 2.0, 1, "a"), (DAY, 1.0, None, "a")]
    df = spark.createDataFrame(rows, model.FACT_SCHEMA).repartition(5)
    spark.sparkContext.setJobGroup("no-measuring", "plan only")
    got = smooth.rolling_mean(df, 6, block_rows=64)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("no-measuring")
    spark.sparkContext.setJobGroup("", "")
    assert "_blk" in _plan(got) and "_minute" in _plan(got)
    plain = df.withColumn("value", F.when(F.col("ID").isNotNull(), F.avg("value").over(
        Window.partitionBy("ID", "type").orderBy("timestamp", "value").rowsBetween(-5, 0))))
    tidy = lambda x: sorted(((str(r.timestamp), r.ID, r.type, None if r.value is None else round(r.value, 9)) for r in x.collect()), key=str)
    assert tidy(got) == tidy(plain)


@pytest.mark.parametrize("frequency", ["15Min", "H", "D", "W", "M"])
def test_kpis_without_the_dense_frame(spark, facts_df, meta_df, frequency):
    rng = random.Random(6)
    rows = [(DAY + timedelta(minutes=rng.randrange(60 * 24 * 50)), 1.0, rng.choice([1, 2, 3, None]), rng.choice(["a", "b", None])) for _ in range(40)]
    rows.append((None, 1.0, 1, "a"))
    meta = meta_df([(1, "t", "B", "F", "A", "V1"), (1, "t", "B", "F", "A", "V1"), (2, "t", "B", "F", "A", "V2"), (2, "t", "B", "F", "A", "V3")])
    for facts in (facts_df(rows), facts_df(rows).limit(0)):
        expect = kpis.kpis(resample.resample_series(facts, meta, frequency, "mean")).collect()
        assert kpis.resampled_kpis(facts, meta, frequency).collect() == expect


@pytest.mark.parametrize("func", ["mean", "sum"])
def test_metadata_meets_occupied_bins_only(spark, facts_df, monkeypatch, func):
    """With metadata too large to broadcast, no shuffle or sort comes after the bins are made."""
    from sensorframe.operators import panels
    facts = facts_df([("2024-01-01 00:05", 1.0, 1, "a"), ("2024-01-09 00:05", 3.0, 1, "a"), ("2024-01-02 00:00", 2.0, 2, "a"),
                      ("2024-01-02 00:00", 2.0, 7, "a")])
    meta = spark.createDataFrame([(1, "x", "B", "F", "A", "V"), (1, "x", "B", "F", "A", "V"), (1, "y", "B", "F", "A", "V"),
                                  (2, "z", "B", "F", "A", "V")],
                                 "id long, vanity string, building string, floor string, area string, nodeTypeName string")
    makers = (lambda: resample.resample_series(facts, meta, "15min", func),
              lambda: panels.resampled_panels(facts, meta, "15min", func, 2))
    want = [sorted(map(str, make().collect())) for make in makers]
    assert len(want[0]) == 2 * (8 * 96 + 1) + 1
    monkeypatch.setattr("sensorframe.operators.joins.BROADCAST_MAX_BYTES", 1)
    monkeypatch.setattr(resample, "bounded_broadcast", lambda df: df)
    monkeypatch.setattr(panels, "bounded_broadcast", lambda df: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for make, rows in zip(makers, want, strict=True):
            df = make()
            plan = df._jdf.queryExecution().executedPlan().toString()
            above = plan[:plan.index("Generate explode(sequence(_from")]
            assert "SortMergeJoin" in plan and not any(x in above for x in ("Join", "Exchange", "Sort"))
            assert sorted(map(str, df.collect())) == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
