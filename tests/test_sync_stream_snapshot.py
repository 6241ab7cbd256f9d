"""Replication (FIXTURES §4), stream ingest, snapshot append and read-through."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sensorframe import model
from sensorframe.plans import snapshot, sync
from sensorframe.session import work_dir
from sensorframe.streaming import ingest

T0 = datetime(2024, 3, 1, 10)
T = [T0 + timedelta(hours=i) for i in range(4)]


def _facts(spark, pairs):
    return spark.createDataFrame([(t, float(v), 1, "a") for t, v in pairs], model.FACT_SCHEMA)


def _table(spark, root, name="t"):
    df = sync.read_incremental(spark, root, name)
    return sorted((r["timestamp"], r["value"]) for r in df.collect()) if df is not None else []


def _rows_loaded(spark, root, run_id):
    return sync.sync_runs(spark, root).filter(F.col("id") == run_id).first()["rows_loaded"]


TARGET = [(T[0], 10), (T[1], 20), (T[2], 30)]
SOURCE = [(T[0], 11), (T[1], 21), (T[2], 30), (T[3], 40)]


def _seeded(spark):
    root = work_dir(spark, "synctest")
    sync.sync_incremental(spark, root, "t", _facts(spark, TARGET), 0)
    return root


@pytest.mark.parametrize("overlap,expected,loaded", [
    (0, [(T[0], 10), (T[1], 20), (T[2], 30), (T[3], 40)], 2),
    (1, [(T[0], 10), (T[1], 21), (T[2], 30), (T[3], 40)], 3),
])
def test_overlap(spark, overlap, expected, loaded):
    root = _seeded(spark)
    run = sync.sync_incremental(spark, root, "t", _facts(spark, SOURCE), overlap)
    assert _table(spark, root) == [(t, float(v)) for t, v in expected]
    assert _rows_loaded(spark, root, run) == loaded


def test_empty_target_and_idempotent_rerun(spark):
    root = work_dir(spark, "synctest")
    run = sync.sync_incremental(spark, root, "t", _facts(spark, SOURCE), 0)
    assert _rows_loaded(spark, root, run) == 4
    assert "cutoff=1900-01-01T00:00:00" in sync.sync_runs(spark, root).first()["details"]
    before = _table(spark, root)
    sync.sync_incremental(spark, root, "t", _facts(spark, SOURCE), 0)
    assert _table(spark, root) == before == [(t, float(v)) for t, v in SOURCE]


def test_source_deletions(spark):
    root = _seeded(spark)
    sync.sync_incremental(spark, root, "t", _facts(spark, [(T[0], 11), (T[1], 21), (T[3], 40)]), 0)
    assert _table(spark, root) == [(T[0], 10.0), (T[1], 20.0), (T[3], 40.0)]  # t3 gone
    root = _seeded(spark)
    sync.sync_incremental(spark, root, "t", _facts(spark, [(T[1], 21), (T[2], 30), (T[3], 40)]), 0)
    assert (T[0], 10.0) in _table(spark, root)  # t1 is never healed


def test_vanished_day_is_removed(spark):
    root = work_dir(spark, "synctest")
    day2 = T0 + timedelta(days=1)
    sync.sync_incremental(spark, root, "t", _facts(spark, [(T0, 1), (day2, 2), (day2 + timedelta(days=1), 3)]), 0)
    sync.sync_incremental(spark, root, "t", _facts(spark, [(T0, 1)]), 72)
    assert _table(spark, root) == [(T0, 1.0)]


def test_null_timestamps_counted(spark):
    root = work_dir(spark, "synctest")
    src = _facts(spark, SOURCE).unionByName(spark.createDataFrame([(None, 5.0, 1, "a")], model.FACT_SCHEMA))
    run = sync.sync_incremental(spark, root, "t", src, 0)
    assert _rows_loaded(spark, root, run) == 4
    assert "null_timestamps=1" in sync.sync_runs(spark, root).filter(F.col("id") == run).first()["details"]


def test_failing_run_keeps_table(spark):
    root = _seeded(spark)
    bad = _facts(spark, SOURCE).withColumn("value", F.raise_error(F.lit("x" * 5000)).cast("double"))
    with pytest.raises(Exception):
        sync.sync_incremental(spark, root, "t", bad, 0)
    assert _table(spark, root) == [(t, float(v)) for t, v in TARGET]
    state = sync.sync_state(spark, root).first()
    assert state["run_status"] == "failed"
    assert 0 < len(state["last_error"]) <= model.MAX_ERROR_CHARS
    assert state["target_max_timestamp"] == max(t for t, _ in TARGET)
    # the next run starts from the last good high-water mark
    sync.sync_incremental(spark, root, "t", _facts(spark, SOURCE), 0)
    assert _table(spark, root)[-1] == (T[3], 40.0)


def test_full_refresh_versions_and_state(spark):
    root = work_dir(spark, "synctest")
    meta = spark.createDataFrame([(1, "t", "B", "F", "A", "V")], model.META_SCHEMA)
    sync.sync_all(spark, root, {"h": meta}, {"t": _facts(spark, SOURCE)}, 0)
    sync.sync_all(spark, root, {"h": meta.union(meta)}, {"t": _facts(spark, SOURCE)}, 0)
    assert sync.read_full(spark, root, "h").count() == 2
    st = {r["table_name"]: r for r in sync.sync_state(spark, root).collect()}
    assert st["h"]["sync_mode"] == "full" and st["h"]["last_rows_loaded"] == 2
    assert st["t"]["target_max_timestamp"] == T[3] and st["t"]["next_cutoff_timestamp"] == T[3]
    assert [r["id"] for r in sync.latest_runs(spark, root, 3).collect()] == [4, 3, 2]


def test_stream_ingest_overlap(spark):
    base = work_dir(spark, "streamtest")
    day1 = datetime(2024, 1, 1)
    f1 = _facts(spark, [(day1, 10), (day1 + timedelta(hours=500), 20), (day1 + timedelta(hours=501), 30)])
    f2 = _facts(spark, [(day1 + timedelta(hours=500), 21), (day1 + timedelta(hours=502), 40), (day1, 11)])
    for i, f in enumerate([f1, f2]):
        f.coalesce(1).write.parquet(f"{base}/landing/b{i}")
        ingest.start_ingest(spark, f"{base}/landing/*", f"{base}/table", f"{base}/ckpt", 336).awaitTermination()
    got = [r["value"] for r in ingest.read_table(spark, f"{base}/table").orderBy("timestamp").collect()]
    assert got == [10.0, 21.0, 30.0, 40.0]
    assert ingest.read_late(spark, f"{base}/table").count() == 1


def test_snapshot_append_idempotent_and_read_through(spark):
    root = work_dir(spark, "snaptest")
    rows = [(datetime(2024, 1, d, h), float(d * 100 + h), i, ch) for d in range(1, 6) for h in (0, 12)
            for i in (1, 2) for ch in ("occupancy", "tempc")]
    src = spark.createDataFrame(rows, model.FACT_SCHEMA)
    hist = src.filter(F.col("type").isin(model.HISTORY_CHANNELS))
    env = src.filter(~F.col("type").isin(model.HISTORY_CHANNELS))
    assert snapshot.append_facts(spark, root, src) == len(rows)
    assert snapshot.append_facts(spark, root, src) == 0
    ids = spark.createDataFrame([(1,), (2,)], "ID long")
    root2 = work_dir(spark, "snaptest")
    snapshot.preload(spark, root2, hist, env, ids.filter("ID = 1"), ["occupancy", "tempc"],
                     datetime(2024, 1, 2), datetime(2024, 1, 3))
    gaps = snapshot.missing_ranges(spark, root2, ids, ["tempc"], datetime(2024, 1, 1), datetime(2024, 1, 5))
    got = sorted((r["ID"], r["from_ts"], r["to_ts"]) for r in gaps.collect())
    # Sensor 1 is covered up to its last reading seen, not to the end of the request.
    assert got == [(1, datetime(2024, 1, 1), datetime(2024, 1, 2)), (1, datetime(2024, 1, 2, 12), datetime(2024, 1, 5)),
                   (2, datetime(2024, 1, 1), datetime(2024, 1, 5))]
    served = snapshot.read_through(spark, root2, hist, env, ids, ["occupancy", "tempc"],
                                   datetime(2024, 1, 1), datetime(2024, 1, 5))
    direct = src.filter(F.col("timestamp") < F.lit("2024-01-05").cast("timestamp_ntz"))
    assert sorted(map(tuple, served.collect())) == sorted(map(tuple, direct.collect()))
    # now fully covered: snapshot-only serves the same
    only = snapshot.read_through(spark, root2, None, None, ids, ["occupancy", "tempc"],
                                 datetime(2024, 1, 1), datetime(2024, 1, 5), snapshot_only=True)
    assert only.count() == direct.count()
    stats = {r["table_name"]: r["n_rows"] for r in snapshot.stats(spark, root2).collect()}
    assert stats == {"nodes_hierarchy_cache": 0, "nodes_history_cache": direct.filter("type = 'occupancy'").count(),
                     "nodes_history_env_cache": direct.filter("type = 'tempc'").count()}


def test_read_through_follows_a_growing_source(spark):
    root = work_dir(spark, "snaptest")
    ids = spark.createDataFrame([(1,), (2,)], "ID long")
    day = (datetime(2024, 1, 10), datetime(2024, 1, 11))
    hours = lambda *hs: spark.createDataFrame([(datetime(2024, 1, 10, h), float(h), 1, "tempc") for h in hs], model.FACT_SCHEMA)
    read = lambda env: sorted(r["timestamp"].hour for r in snapshot.read_through(
        spark, root, None, env, ids, ["tempc"], *day).collect())
    assert read(hours()) == []
    assert read(hours(3)) == [3]
    assert read(hours(3, 3, 9)) == [3, 9]
    assert read(hours(3, 9, 17)) == [3, 9, 17]


def test_clear_snapshot_and_meta_versions(spark):
    root = work_dir(spark, "snaptest")
    meta = spark.createDataFrame([(1, "t", "B", "F", "A", "V")], model.META_SCHEMA)
    snapshot.write_meta(spark, root, meta)
    snapshot.append_facts(spark, root, _facts(spark, SOURCE))
    assert {r["n_rows"] for r in snapshot.stats(spark, root).collect()} == {1, 0, 4}
    snapshot.clear(spark, root)
    assert {r["n_rows"] for r in snapshot.stats(spark, root).collect()} == {0}
    assert snapshot.read_meta(spark, root).count() == 0


def test_sync_lag_and_listing(spark):
    root = _seeded(spark)
    st = sync.state_listing(spark, root).first()
    assert st["lag_micros"] == 0


def test_full_refresh_keeps_recent_versions(spark):
    from sensorframe.session import list_dirs
    root = work_dir(spark, "synctest")
    meta = spark.createDataFrame([(1, "t", "B", "F", "A", "V")], model.META_SCHEMA)
    for _ in range(5):
        sync.sync_full(spark, root, "h", meta, keep_versions=2, keep_hours=0)
    assert sorted(list_dirs(spark, root + "/h")) == ["v=4", "v=5"]
    assert sync.read_full(spark, root, "h").count() == 1


def test_table_page(spark):
    from sensorframe.operators.indexing import global_index, table_page
    rows = [(datetime(2024, 1, 1, h, m), float(m), 1, "a") for h in range(3) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, model.FACT_SCHEMA).repartition(4)
    numbered = global_index(df, ["timestamp", "ID", "type", "value"], "row_no")
    page = table_page(df, 2, 5)
    expect = [tuple(r)[:4] for r in numbered.filter("row_no > 10 AND row_no <= 15").orderBy("row_no").collect()]
    assert [tuple(r) for r in page.collect()] == expect


def test_stream_batch_replay_is_idempotent(spark):
    base = work_dir(spark, "streamtest")
    table = f"{base}/table"
    day1 = datetime(2024, 1, 1)
    b0 = _facts(spark, [(day1, 10), (day1 + timedelta(hours=500), 20)])
    b1 = _facts(spark, [(day1 + timedelta(hours=500), 21), (day1 + timedelta(hours=501), 30), (day1, 11)])
    ingest.merge_batch(spark, table, b0, 0, 336)
    ingest.merge_batch(spark, table, b1, 1, 336)
    first = sorted(map(tuple, ingest.read_table(spark, table).select(*model.FACT_COLUMNS).collect()))
    # batch 1 delivered again after a failure: same table, same late rows
    ingest.merge_batch(spark, table, b1, 1, 336)
    again = sorted(map(tuple, ingest.read_table(spark, table).select(*model.FACT_COLUMNS).collect()))
    assert first == again
    assert [r[1] for r in first] == [10.0, 21.0, 30.0]
    assert ingest.read_late(spark, table).count() == 1


def test_stream_starting_mark_makes_the_first_batch_late(spark):
    table = f"{work_dir(spark, 'streammark')}/table"
    day1 = datetime(2024, 1, 1)
    batch = _facts(spark, [(day1, 10), (day1 + timedelta(hours=47), 20), (day1 + timedelta(hours=49), 30)])
    for _ in range(2):  # a replay changes nothing
        ingest.merge_batch(spark, table, batch, 0, 24, start=day1 + timedelta(hours=72))
        assert [r[1] for r in ingest.read_table(spark, table).select(*model.FACT_COLUMNS).collect()] == [30.0]
        assert sorted(r.value for r in ingest.read_late(spark, table).collect()) == [10.0, 20.0]


def test_sync_crash_after_commit_recovers(spark, monkeypatch):
    """The driver dies after the data commit, before the run is recorded:
    the next run starts from the last recorded mark and gives the same table."""
    root = _seeded(spark)
    real_finish = sync._finish

    def crash_on_success(*a, **k):
        if a[7] == "success":
            raise RuntimeError("driver lost")
        return real_finish(*a, **k)

    monkeypatch.setattr(sync, "_finish", crash_on_success)
    with pytest.raises(RuntimeError):
        sync.sync_incremental(spark, root, "t", _facts(spark, SOURCE), 0)
    monkeypatch.setattr(sync, "_finish", real_finish)
    sync.sync_incremental(spark, root, "t", _facts(spark, SOURCE), 0)
    assert _table(spark, root) == [(T[0], 10.0), (T[1], 20.0), (T[2], 30.0), (T[3], 40.0)]


def test_snapshot_dedup_only_after_plain_appends(spark):
    root = work_dir(spark, "snaptest")
    src = _facts(spark, SOURCE + [(T[0], 99)])  # a duplicate key inside the batch
    snapshot.append_facts(spark, root, src)
    ids = spark.createDataFrame([(1,)], "ID long")
    read = snapshot.read_snapshot(spark, root, ids, ["a"], T[0], T[3] + timedelta(hours=1))
    assert "partial_min" not in read._jdf.queryExecution().executedPlan().toString()  # no dedup aggregate
    assert sorted(r["value"] for r in read.collect()) == [11.0, 21.0, 30.0, 40.0]
    snapshot.append_facts(spark, root, _facts(spark, [(T[1], 5)]), skip_existing=False)
    read = snapshot.read_snapshot(spark, root, ids, ["a"], T[0], T[3] + timedelta(hours=1))
    assert sorted(r["value"] for r in read.collect()) == [5.0, 11.0, 30.0, 40.0]


def test_full_refresh_spares_versions_in_use(spark):
    from sensorframe.session import list_dirs
    root = work_dir(spark, "synctest")
    meta = spark.createDataFrame([(1, "t", "B", "F", "A", "V")], model.META_SCHEMA)
    sync.sync_full(spark, root, "h", meta)
    planned = sync.read_full(spark, root, "h")
    for _ in range(4):
        sync.sync_full(spark, root, "h", meta.union(meta), keep_versions=2)
    assert planned.count() == 1 and len(list_dirs(spark, root + "/h")) == 5


def test_replica_layout_is_applied_and_grows(spark):
    root = work_dir(spark, "synctest")
    first = spark.createDataFrame([(T0, 1, "1.5", [1.0]), (T0 + timedelta(hours=9), 9, "9", [])], "timestamp timestamp_ntz, ID int, value string, list array<double>")
    run = sync.sync_incremental(spark, root, "t", first, 0)
    got = sync.read_incremental(spark, root, "t")
    assert [(c, k) for c, k in got.dtypes] == [("timestamp", "timestamp_ntz"), ("ID", "int"), ("value", "string"), ("list", "string"), ("date", "date")]
    # The source now has wider and narrower types, a new column and no list.
    later = spark.createDataFrame([(T0 + timedelta(days=1), 2, 2.5, Decimal("7.25"))], "timestamp timestamp_ntz, ID long, value double, price decimal(9,2)")
    second = sync.sync_incremental(spark, root, "t", later, 0)
    got = sync.read_incremental(spark, root, "t").orderBy("timestamp")
    assert dict(got.dtypes)["price"] == "decimal(38,18)"
    assert [(r.ID, r.value, r.list, None if r.price is None else float(r.price)) for r in got.collect()] == [
        (1, "1.5", "[1.0]", None), (2, "2.5", None, 7.25)]
    layout = sync.stored_layout(spark, root, "t")
    assert [(c.name, c.target_type, c.since_run) for c in layout] == [
        ("timestamp", "TIMESTAMP WITHOUT TIME ZONE", run), ("ID", "INTEGER", run), ("value", "TEXT", run), ("list", "TEXT", run),
        ("price", "NUMERIC", second)]
    types = {r.column_name: r for r in sync.replica_types(spark, root, ["t", "missing"]).collect()}
    assert types["price"].n_values == 1 and types["price"].n_rows == 2 and types["price"].stored_type == "decimal(38,18)"


def test_replica_refuses_what_the_layout_cannot_hold(spark):
    root = work_dir(spark, "synctest")
    one = spark.range(1).selectExpr("id", "cast(id as smallint) AS small")
    sync.sync_full(spark, root, "h", one)
    assert not sync.stored_layout(spark, root, "h")[0].nullable
    for bad in (spark.range(1).selectExpr("cast(null as bigint) AS id", "cast(1 as smallint) AS small"),
                spark.range(1).selectExpr("id", "100000 AS small")):
        with pytest.raises(Exception):
            sync.sync_full(spark, root, "h", bad)
        assert [tuple(r) for r in sync.read_full(spark, root, "h").collect()] == [(0, 0)]


def test_type_map_is_one_rule(spark):
    from sensorframe.functions.expressions import target_type_name
    from sensorframe.sources.schema import target_type_of
    names = [n for n, _, _ in model.TYPE_NAME_MAP] + list(model.SPARK_TYPE_SYNONYMS) + ["decimal(10,2)", "DOUBLE", "json", "array<int>", "Varchar (9)"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", target_type_name(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in rows} == {n: target_type_of(n) for n in names}


def test_runs_at_the_same_time_have_their_own_ids(spark):
    from concurrent.futures import ThreadPoolExecutor
    root = work_dir(spark, "synctest")
    with ThreadPoolExecutor(8) as pool:
        ids = list(pool.map(lambda k: sync._begin(spark, root, f"t{k}", "full")[0], range(40)))
    assert sorted(ids) == list(range(1, 41))
    meta = spark.createDataFrame([(1, "t", "B", "F", "A", "V")], model.META_SCHEMA)
    with ThreadPoolExecutor(2) as pool:
        two = list(pool.map(lambda n: sync.sync_full(spark, root, n, meta), ["a", "b"]))
    assert sorted(two) == [41, 42]
    assert {r["id"] for r in sync.sync_runs(spark, root).filter("status = 'success'").collect()} == {41, 42}


def test_run_log_compaction_keeps_every_run(spark, monkeypatch):
    from sensorframe.session import list_files
    root = work_dir(spark, "synctest")
    meta = spark.createDataFrame([(1, "t", "B", "F", "A", "V")], model.META_SCHEMA)
    sync._begin(spark, root, "stuck", "full")
    monkeypatch.setattr(sync, "COMPACT_AFTER", 6)
    before = None
    for _ in range(5):
        sync.sync_full(spark, root, "h", meta)
    runs = lambda: sorted((r["id"], r["table_name"], r["status"], r["rows_loaded"], r["finished_at"] is None) for r in sync.sync_runs(spark, root).collect())
    before = runs()
    assert before == [(1, "stuck", "running", 0, True)] + [(i, "h", "success", 1, False) for i in range(2, 7)]
    assert len(list_files(spark, root + "/_sync_runs/events")) <= 8
    sync.compact_runs(spark, root)
    assert runs() == before and list(list_files(spark, root + "/_sync_runs/events")) == ["1-0.json"]
    assert sync.sync_full(spark, root, "h", meta) == 7
    assert {r["table_name"]: r["run_status"] for r in sync.sync_state(spark, root).collect()} == {"stuck": "running", "h": "success"}


def test_incremental_run_takes_few_jobs(spark):
    root = _seeded(spark)
    src = _facts(spark, SOURCE + [(datetime(1850, 1, 1), 1)])
    spark.sparkContext.setJobGroup("few-jobs", "one run")
    run = sync.sync_incremental(spark, root, "t", src, 1)
    spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) <= 5
    assert "before_1900=1" in sync.sync_runs(spark, root).filter(F.col("id") == run).first()["details"]
