"""Replication of source tables with a run log and per-table state.

* Full tables (metadata): each run writes a complete new version
  ``<root>/<table>/v=<run_id>``; readers take the newest successful one.
* Incremental tables (facts): day-partitioned ``<root>/<table>/date=<day>/``.
  A run computes ``cutoff = max(target timestamp) - overlap`` (not below
  1900-01-01; an empty target starts there), and replaces everything at or
  after the cutoff with the source rows at or after it. Only the day
  partitions from the cutoff's day on are rewritten (dynamic partition
  overwrite, committed at the end of the job, so a failed job leaves the
  published table as it was); days that no longer have rows are removed.
  Work per run is proportional to the overlap window, not to the table.

Every table has a stored layout: the source's columns through the type map, fixed
when the table is first copied; columns that the source gains later are added to
it. Both modes cast to the layout before they write, and readers read by it.

A run begins by creating its event file ``_sync_runs/events/<id>-0.json``, which
the file system grants to one driver only, so runs at the same time never
share an id. Finishing adds ``<id>-1.json``. ``sync_runs`` is the latest event per run and ``sync_state`` the latest run
per table; finished runs are compacted into one table now and then. A table's
marks of its last successful run are in a file of their own, so a run reads one small file
whatever the length of the log.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe import model
from sensorframe.functions.expressions import date_lit, ts_lit
from sensorframe.session import create_file, delete_path, list_dirs, list_files, observed, path_exists, read_text, touch
from sensorframe.sources.schema import LayoutColumn, conform, layout_schema, merged_layout

BASELINE = datetime.fromisoformat(model.SYNC_BASELINE_TS)

RUN_EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("event_seq", T.IntegerType(), False),
    T.StructField("table_name", T.StringType(), False),
    T.StructField("mode", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("started_at", T.TimestampType(), True),
    T.StructField("finished_at", T.TimestampType(), True),
    T.StructField("rows_loaded", T.LongType(), False),
    T.StructField("details", T.StringType(), True),
    T.StructField("source_max_timestamp", T.TimestampNTZType(), True),
    T.StructField("target_max_timestamp", T.TimestampNTZType(), True),
    T.StructField("next_cutoff_timestamp", T.TimestampNTZType(), True),
])


def _runs_path(root):
    return f"{root}/_sync_runs"


def table_path(root, table):
    return f"{root}/{table}"


def _now():
    return datetime.now().astimezone()


#: Event files after which finished runs are compacted.
COMPACT_AFTER = 128


def _event_files(spark: SparkSession, root: str) -> dict[str, tuple[int, int]]:
    """Name -> (run id, event number) of the event files."""
    return {n: tuple(int(x) for x in n[:-5].split("-")) for n in list_files(spark, f"{_runs_path(root)}/events")
            if n.endswith(".json")}


def _compacted(spark: SparkSession, root: str) -> list[int]:
    """Compacted logs that are complete, by the largest run id they hold."""
    return _versions(spark, f"{_runs_path(root)}/compact")


def _events(spark: SparkSession, root: str) -> DataFrame | None:
    """All run events; some may be there twice after a compaction broke off."""
    parts = []
    done = _compacted(spark, root)
    if done:
        parts.append(spark.read.schema(RUN_EVENT_SCHEMA).parquet(f"{_runs_path(root)}/compact/v={done[-1]}"))
    if _event_files(spark, root):
        text = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
                                           else f.dataType) for f in RUN_EVENT_SCHEMA.fields])
        raw = spark.read.schema(text).json(f"{_runs_path(root)}/events")
        parts.append(raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RUN_EVENT_SCHEMA.fields]))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _log(spark: SparkSession, root: str, row: tuple) -> bool:
    """Create the event's file; False when the run's event is taken."""
    event = {f.name: v.isoformat() if isinstance(v, datetime) else v for f, v in zip(RUN_EVENT_SCHEMA.fields, row, strict=True)}
    return create_file(spark, f"{_runs_path(root)}/events/{row[0]}-{row[1]}.json", json.dumps(event))


def compact_runs(spark: SparkSession, root: str) -> int:
    """Move the events of finished runs into one new table; returns how many files went.
    The old files go after the new table is complete, so every event is readable at any time."""
    files = _event_files(spark, root)
    ended = {i for i, seq in files.values() if seq == 1}
    gone = [n for n, (i, _) in files.items() if i in ended]
    if not gone:
        return 0
    last = max(ended)
    events = _events(spark, root).filter(F.col("id").isin(sorted(ended)) | (F.col("id") <= F.lit(max(_compacted(spark, root), default=0))))
    # Runs still going keep their files, also those with a smaller id.
    whole = events.dropDuplicates(["id", "event_seq"])
    open_ids = [i for i, seq in files.values() if seq == 0 and i not in ended]
    if open_ids:
        whole = whole.filter(~F.col("id").isin(open_ids))
    whole.coalesce(1).write.mode("overwrite").parquet(f"{_runs_path(root)}/compact/v={last}")
    for n in gone:
        delete_path(spark, f"{_runs_path(root)}/events/{n}")
    for v in _compacted(spark, root)[:-1]:
        delete_path(spark, f"{_runs_path(root)}/compact/v={v}")
    return len(gone)


def sync_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per run: its latest event."""
    ev = _events(spark, root)
    if ev is None:
        return spark.createDataFrame([], RUN_EVENT_SCHEMA).drop("event_seq")
    cols = [c for c in ev.columns if c not in ("id", "event_seq")]
    last = ev.groupBy("id").agg(F.max_by(F.struct(*cols), "event_seq").alias("r"))
    return last.select("id", *[F.col(f"r.{c}").alias(c) for c in cols])


def latest_runs(spark: SparkSession, root: str, n: int = 20) -> DataFrame:
    return sync_runs(spark, root).orderBy(F.col("id").desc()).limit(n)


def sync_state(spark: SparkSession, root: str) -> DataFrame:
    """Per table: mode, status and start of its latest run; rows, marks and
    error of its latest finished run."""
    runs = sync_runs(spark, root)
    latest = runs.groupBy("table_name").agg(
        F.max_by(F.struct("mode", "status", "started_at"), "id").alias("a"))
    done = runs.filter(F.col("status") != "running").groupBy("table_name").agg(
        F.max_by(F.struct("status", "finished_at", "rows_loaded", "details", "source_max_timestamp",
                          "target_max_timestamp", "next_cutoff_timestamp"), "id").alias("b"))
    j = latest.join(done, "table_name", "left")
    return j.select(
        "table_name", F.col("a.mode").alias("sync_mode"), F.col("a.status").alias("run_status"),
        F.col("a.started_at").alias("last_started_at"), F.col("b.finished_at").alias("last_finished_at"),
        F.coalesce(F.col("b.rows_loaded"), F.lit(0)).cast("long").alias("last_rows_loaded"),
        F.col("b.source_max_timestamp").alias("source_max_timestamp"),
        F.col("b.target_max_timestamp").alias("target_max_timestamp"),
        F.col("b.next_cutoff_timestamp").alias("next_cutoff_timestamp"),
        F.when(F.col("a.status") == "running", F.lit(""))
         .when(F.col("b.status") == "failed", F.coalesce(F.col("b.details"), F.lit("")))
         .otherwise(F.lit("")).alias("last_error"),
        # How far the replica trails the source at the last finished run.
        F.expr("timestampdiff(MICROSECOND, b.target_max_timestamp, b.source_max_timestamp)").alias("lag_micros"))


def state_listing(spark: SparkSession, root: str) -> DataFrame:
    """The state table as listed for operators, ordered by table name."""
    return sync_state(spark, root).orderBy("table_name")


def _begin(spark: SparkSession, root: str, table: str, mode: str) -> tuple[int, datetime]:
    """Claim the next free run id by creating its first event."""
    started = _now()
    run_id = 0
    while True:
        taken = max([run_id, *(i for i, _ in _event_files(spark, root).values()), *_compacted(spark, root)])
        run_id = taken + 1
        if _log(spark, root, (run_id, 0, table, mode, "running", started, None, 0, None, None, None, None)):
            if run_id > max(_compacted(spark, root), default=0):
                return run_id, started
            # Another driver finished and compacted this id since the listing.
            delete_path(spark, f"{_runs_path(root)}/events/{run_id}-0.json")


def _finish(spark, root, run_id, table, mode, started, rows, status, details="",
            source_max=None, target_max=None, next_cutoff=None):
    _log(spark, root, (run_id, 1, table, mode, status, started, _now(), int(rows),
                       (details or "")[: model.MAX_ERROR_CHARS], source_max, target_max, next_cutoff))
    if status == "success":
        base = _marks_path(root, table)
        create_file(spark, f"{base}/{run_id}.json", json.dumps({"target_max_timestamp": target_max and target_max.isoformat()}))
        for n in list_files(spark, base):
            if n.endswith(".json") and int(n[:-5]) < run_id:
                delete_path(spark, f"{base}/{n}")
    if len(_event_files(spark, root)) > COMPACT_AFTER:
        compact_runs(spark, root)


def _marks_path(root, table):
    return f"{root}/_sync_marks/{table}"


# --- layouts -------------------------------------------------------------------

def _layout_path(root, table):
    return f"{root}/_layouts/{table}"


def stored_layout(spark: SparkSession, root: str, table: str) -> list[LayoutColumn]:
    """The newest layout of a replica table; empty if it has none."""
    names = [n for n in list_files(spark, _layout_path(root, table)) if n.endswith(".json")]
    if not names:
        return []
    return [LayoutColumn(**c) for c in json.loads(read_text(spark, f"{_layout_path(root, table)}/{max(names, key=lambda n: int(n[:-5]))}"))]


def ensure_layout(spark: SparkSession, root: str, table: str, source: DataFrame, run_id: int) -> list[LayoutColumn]:
    """The table's layout, created from the source or extended by its new columns."""
    stored = stored_layout(spark, root, table)
    layout = merged_layout(stored, source, run_id)
    if layout != stored and not create_file(spark, f"{_layout_path(root, table)}/{run_id}.json", json.dumps([asdict(c) for c in layout])):
        raise RuntimeError(f"layout {run_id} of {table} exists")
    return layout


def replica_types(spark: SparkSession, root: str, tables: list[str]) -> DataFrame:
    """Per column of the replicas: its types, the run that added it, and how many rows and
    non-NULL values the replica holds, counted in one pass over each table."""
    parts = []
    for table in tables:
        layout, df = stored_layout(spark, root, table), read_replica(spark, root, table)
        if df is None or not layout:
            continue
        seen = dict(df.dtypes)
        counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c.name}`")).alias(f"c{i}") for i, c in enumerate(layout)])
        parts.append(counted.select(F.col("n").alias("n_rows"), F.explode(F.array(*[F.struct(
            F.lit(i + 1).cast("long").alias("ordinal_position"), F.lit(c.name).alias("column_name"), F.lit(c.target_type).alias("target_type"),
            F.lit(seen[c.name]).alias("stored_type"), F.lit(c.since_run).cast("long").alias("since_run"), F.col(f"c{i}").alias("n_values"))
            for i, c in enumerate(layout)])).alias("x")).select(F.lit(table).alias("table_name"), "x.*", "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def iso(ts: datetime) -> str:
    return ts.isoformat()


# --- full refresh ------------------------------------------------------------

def _versions(spark, base):
    out = []
    for name in list_dirs(spark, base):
        if name.startswith("v=") and path_exists(spark, f"{base}/{name}/_SUCCESS"):
            out.append(int(name[2:]))
    return sorted(out)


PUBLISHED = "_PUBLISHED"


def sync_full(spark: SparkSession, root: str, table: str, source: DataFrame, keep_versions: int = 3,
              keep_hours: float = 24) -> int:
    """Truncate-and-reload as a new complete version in the table's layout; returns the run id.

    After the version is published, older ones are removed, except the newest
    ``keep_versions`` and those published within ``keep_hours``, which
    readers that planned before may still be reading.
    """
    run_id, started = _begin(spark, root, table, "full")
    try:
        layout = ensure_layout(spark, root, table, source, run_id)
        obs = Observation(f"full_{run_id}")
        path = f"{table_path(root, table)}/v={run_id}"
        conform(source, layout).observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
        rows = int(observed(obs, ["rows"])["rows"] or 0)
        touch(spark, f"{path}/{PUBLISHED}")
        _finish(spark, root, run_id, table, "full", started, rows, "success")
    except Exception as exc:
        _finish(spark, root, run_id, table, "full", started, 0, "failed", str(exc))
        raise
    _drop_old_versions(spark, root, table, keep_versions, keep_hours)
    return run_id


def _published(spark: SparkSession, base: str) -> dict[int, int]:
    """Published versions with their time in milliseconds."""
    out = {}
    for name in list_dirs(spark, base):
        if name.startswith("v="):
            at = list_files(spark, f"{base}/{name}").get(PUBLISHED)
            if at is not None:
                out[int(name[2:])] = at
    return out


def _drop_old_versions(spark: SparkSession, root: str, table: str, keep: int, hours: float) -> None:
    base = table_path(root, table)
    done = _published(spark, base)
    if len(done) <= keep:
        return
    floor = sorted(done)[-keep]
    before = (_now().timestamp() - hours * 3600) * 1000
    for name in list_dirs(spark, base):
        v = int(name[2:]) if name.startswith("v=") else floor
        # A version that was never published is what a failed run left behind.
        if v < floor and done.get(v, 0) <= before:
            delete_path(spark, f"{base}/{name}")


def read_full(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """Newest published version, in the table's layout."""
    base = table_path(root, table)
    done = _published(spark, base)
    if not done:
        return None
    return spark.read.schema(layout_schema(stored_layout(spark, root, table))).parquet(f"{base}/v={max(done)}")


# --- incremental -------------------------------------------------------------

def read_incremental(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    p = table_path(root, table)
    if not list_dirs(spark, p):
        return None
    # Days written before a column was added lack it; the layout has it, so it reads as NULL.
    schema = layout_schema(stored_layout(spark, root, table)).add("date", T.DateType())
    return spark.read.schema(schema).parquet(p)


def _target_high_water(spark, root, table, ts) -> datetime | None:
    """Target high-water mark of the table's latest successful run (one small
    file); scan only if none is recorded."""
    names = [n for n in list_files(spark, _marks_path(root, table)) if n.endswith(".json")]
    if names:
        mark = json.loads(read_text(spark, f"{_marks_path(root, table)}/{max(names, key=lambda n: int(n[:-5]))}"))["target_max_timestamp"]
        if mark:
            return datetime.fromisoformat(mark)
    cur = read_incremental(spark, root, table)
    return cur.agg(F.max(ts)).first()[0] if cur is not None else None


def sync_incremental(spark: SparkSession, root: str, table: str, source: DataFrame,
                     overlap_hours: float = 0, ts: str = "timestamp") -> int:
    """Delete target rows at or after the cutoff, copy source rows at or
    after it, cast to the table's layout. Returns the run id. Source rows with a
    NULL timestamp or one before 1900 are not copied; their numbers are reported in the
    run details, counted by one job whose predicates reach the source."""
    run_id, started = _begin(spark, root, table, "incremental")
    rows = 0
    hwm = cutoff = None
    try:
        hwm = _target_high_water(spark, root, table, ts)
        cutoff = BASELINE if hwm is None else max(hwm - timedelta(hours=overlap_hours), BASELINE)
        path = table_path(root, table)
        layout = ensure_layout(spark, root, table, source, run_id)
        current = read_incremental(spark, root, table)
        cut_day = cutoff.date()

        src_tail = source.filter(F.col(ts) >= ts_lit(cutoff))
        obs = Observation(f"inc_{run_id}")
        # The write also reports the days it covers (a set bounded by the
        # overlap window), so the source tail is scanned once.
        tail = conform(src_tail, layout).observe(obs, F.count(F.lit(1)).alias("rows"), F.max(ts).alias("max_ts"),
                                F.collect_set(F.to_date(F.col(ts))).alias("days"))
        tail = tail.withColumn("date", F.to_date(F.col(ts)))
        kept = Observation(f"kept_{run_id}")
        if current is not None:
            keep = current.filter((F.col("date") == date_lit(cut_day)) & (F.col(ts) < ts_lit(cutoff)))
            tail = tail.unionByName(keep.observe(kept, F.count(F.lit(1)).alias("rows")))
        (tail.hint("rebalance", "date")
         .sortWithinPartitions("date", *[c for c in ("ID", "type") if c in tail.columns], ts)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("date").parquet(path))
        m = observed(obs, ["rows", "max_ts", "days"])
        if m["days"] is None and not src_tail.isEmpty():
            # Metrics were lost: no day may be removed on that ground.
            raise RuntimeError(f"no metrics of the write of {table}, though its source has rows")
        rows = int(m["rows"] or 0)
        keep_days = {d.isoformat() for d in (m["days"] or []) if d is not None}
        if current is not None and observed(kept, ["rows"])["rows"] != 0:  # lost metrics keep the day
            keep_days.add(cut_day.isoformat())

        # Day partitions at or after the cutoff day without rows now are gone at the source.
        for name in list_dirs(spark, path):
            if name.startswith("date=") and name[5:] >= cut_day.isoformat() and name[5:] not in keep_days:
                delete_path(spark, f"{path}/{name}")

        odd = source.filter(F.col(ts).isNull() | (F.col(ts) < ts_lit(BASELINE))).agg(
            F.count(F.lit(1)).alias("n"), F.count(F.col(ts)).alias("early")).first()
        nulls, early = odd["n"] - odd["early"], odd["early"]
        if m["max_ts"] is not None:
            target_max = m["max_ts"]
        else:
            cur = read_incremental(spark, root, table)
            target_max = cur.agg(F.max(ts)).first()[0] if cur is not None else None
        source_max = m["max_ts"] if m["max_ts"] is not None else source.agg(F.max(ts)).first()[0]
        next_cutoff = (max(target_max - timedelta(hours=overlap_hours), BASELINE)
                       if target_max is not None else BASELINE)
        details = f"cutoff={iso(cutoff)}" + (f"; null_timestamps={nulls}" if nulls else "") + (
            f"; before_1900={early}" if early else "")
        _finish(spark, root, run_id, table, "incremental", started, rows, "success", details,
                source_max, target_max, next_cutoff)
    except Exception as exc:
        _finish(spark, root, run_id, table, "incremental", started, rows, "failed", str(exc),
                None, hwm, cutoff)  # the target keeps its mark
        raise
    return run_id


def read_replica(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    full = read_full(spark, root, table)
    if full is not None:
        return full
    return read_incremental(spark, root, table)


def sync_all(spark: SparkSession, root: str, full_tables: dict, incremental_tables: dict,
             overlap_hours: float = 0) -> list[int]:
    """One replication cycle: full tables first, then incremental ones, in
    the given order; a failure stops the cycle (later tables are skipped)."""
    ids = []
    for name, df in full_tables.items():
        ids.append(sync_full(spark, root, name, df))
    for name, df in incremental_tables.items():
        ids.append(sync_incremental(spark, root, name, df, overlap_hours))
    return ids
