"""Resumable chunked copies and the merged coverage ledger."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sensorframe import model
from sensorframe.plans import snapshot
from sensorframe.session import list_dirs, list_files, work_dir
from sensorframe.sources import chunked

DAY = datetime(2024, 1, 1)


def _rows(n, seed=1):
    rng = random.Random(seed)
    return [(DAY + timedelta(minutes=rng.randrange(60 * 24 * 3)), float(i), i, "a") for i in range(n)] + [(None, 1.0, 1, "a")]


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_interrupted_copy_goes_on(spark, monkeypatch):
    df = spark.createDataFrame(_rows(300) + [(DAY, -1.0, 9, "hot")] * 90, model.FACT_SCHEMA).repartition(4)
    path = work_dir(spark, "chunks")
    bounds = chunked.chunk_bounds(df, "timestamp", 40)
    assert sum(b["rows"] for b in bounds) == 390 and len(bounds) > 4
    assert all(a["last"] < b["first"] for a, b in zip(bounds, bounds[1:]))
    # The second wave's rows are committed, but the driver is lost before the ledger says so.
    real, calls = chunked.create_file, []

    def lost(spark, name, text):
        calls.append(name)
        if "_chunks/3" in name:
            raise RuntimeError("driver lost")
        return real(spark, name, text)

    monkeypatch.setattr(chunked, "create_file", lost)
    with pytest.raises(RuntimeError):
        chunked.copy_chunked(spark, path, df, "timestamp", rows=40, chunks_per_job=3)
    monkeypatch.setattr(chunked, "create_file", real)
    part = chunked.read_chunked(spark, path, df.schema)
    assert part.count() == sum(b["rows"] for b in bounds[:3])
    copied, left = chunked.copy_chunked(spark, path, df, "timestamp", rows=7, chunks_per_job=3)  # the stored bounds hold
    assert (copied, left) == (len(bounds) + 1 - 3, 0)
    assert _sorted(chunked.read_chunked(spark, path, df.schema)) == _sorted(df)
    assert chunked.copy_chunked(spark, path, df, "timestamp") == (0, 0)
    with pytest.raises(ValueError):
        chunked.copy_chunked(spark, path, df, "ID")


def test_copy_by_number_and_of_nothing(spark):
    df = spark.createDataFrame([(i * i - 50, f"v{i}") for i in range(60)] + [(None, "x")], "id long, v string")
    path = work_dir(spark, "chunks")
    assert chunked.copy_chunked(spark, path, df, "id", rows=10, width=25, chunks_per_job=2)[1] == 0
    assert _sorted(chunked.read_chunked(spark, path, df.schema)) == _sorted(df)
    none = work_dir(spark, "chunks")
    assert chunked.copy_chunked(spark, none, df.limit(0), "id") == (1, 0)
    assert chunked.read_chunked(spark, none, df.schema).count() == 0


def test_range_predicate_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(_rows(50), model.FACT_SCHEMA).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    k = F.col("timestamp")
    plan = df.filter((k >= chunked._start("2024-01-01T05:00:00")) & (k < chunked._after("2024-01-01T07:00:00", 1)))
    assert "GreaterThanOrEqual(timestamp" in plan._jdf.queryExecution().executedPlan().toString()


def test_merge_ranges(spark):
    rng = random.Random(3)
    at = lambda h: DAY + timedelta(hours=h)
    rows = [(rng.randrange(3), "a", a, a + rng.randrange(1, 6)) for a in (rng.randrange(80) for _ in range(60))]
    got = snapshot.merge_ranges(spark.createDataFrame([(i, t, at(a), at(z)) for i, t, a, z in rows], snapshot.COVERAGE_SCHEMA)).collect()
    for i in range(3):
        hours = {h for k, _, a, z in rows if k == i for h in range(a, z)}
        mine = sorted((r.from_ts, r.to_ts) for r in got if r.ID == i)
        assert {h for h in range(100) if any(a <= at(h) < z for a, z in mine)} == hours
        assert all(z < a for (_, z), (a, _) in zip(mine, mine[1:]))


def test_quiet_ranges_are_fetched_once_and_the_ledger_is_merged(spark, monkeypatch):
    monkeypatch.setattr(snapshot, "COMPACT_AFTER", 4)
    root = work_dir(spark, "snaptest")
    ids = spark.createDataFrame([(1,), (2,)], "ID long")
    env = spark.createDataFrame([(DAY + timedelta(hours=5), 1.0, 1, "tempc"), (DAY + timedelta(days=40), 2.0, 9, "tempc")], model.FACT_SCHEMA)
    broken = env.withColumn("value", F.raise_error(F.lit("source was read")).cast("double"))
    for k in range(4):
        a, z = DAY + timedelta(days=k), DAY + timedelta(days=k + 1)
        first = snapshot.read_through(spark, root, None, env, ids, ["tempc"], a, z)
        assert first.count() == (k == 0)
        assert snapshot.read_through(spark, root, None, broken, ids, ["tempc"], a, z, high_water=DAY + timedelta(days=40)).count() == (k == 0)
    folder = root + "/coverage"
    (version,) = list_dirs(spark, folder)
    assert version != "v=1" and len(list_files(spark, f"{folder}/{version}")) <= 6
    # Not settled yet: the last two weeks before the newest reading are looked at again.
    late = DAY + timedelta(days=39)
    assert snapshot.missing_ranges(spark, root, ids, ["tempc"], DAY, DAY + timedelta(days=4)).count() == 0
    snapshot.read_through(spark, root, None, env, ids, ["tempc"], late, late + timedelta(hours=9))
    assert snapshot.missing_ranges(spark, root, ids, ["tempc"], late, late + timedelta(hours=9)).count() == 2


@pytest.mark.parametrize("n", [1, 2, 3, 7, 256])
def test_a_row_finds_its_chunk_by_halving(spark, n):
    import bisect
    firsts = [DAY + timedelta(hours=2 * i) for i in range(n)]
    wave = [{"chunk": 10 + i, "first": f.isoformat()} for i, f in enumerate(firsts)]
    keys = [f + timedelta(minutes=m) for f in firsts for m in (0, 59, 119)]
    df = spark.createDataFrame([(k,) for k in keys], "k timestamp_ntz").select("k", chunked._chunk_of(F.col("k"), wave).alias("c"))
    assert [r.c for r in df.orderBy("k").collect()] == [9 + bisect.bisect_right(firsts, k) for k in keys]
    assert df.schema["c"].dataType.simpleString() == "int"
    # n - 1 comparisons with the bare key in the tree, of which a row meets one per level; no search through a list.
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "make_timestamp" not in plan
    depth = lambda m: 0 if m == 1 else 1 + depth(m - m // 2)
    assert depth(256) == 8
