"""Local range snapshot of sources.

Layout under ``root`` (a folder in shared storage):

* ``facts/source_table=<history|env>/date=<day>/`` — append-only parquet,
  rows sorted by ``(ID, type, timestamp)`` inside each file so row-group
  statistics prune id lookups;
* ``meta/v=<n>/`` — metadata, one complete version per refresh; readers take
  the newest committed version, so a failed refresh never leaves a
  truncated table;
* ``coverage/v=<n>/`` — ledger of loaded ranges ``(ID, type, from_ts, to_ts)``; loads
  append to the newest version, and once it has many files adjacent and
  overlapping ranges are merged into the next version.

An append adds only rows whose ``(timestamp, ID, type)`` is not yet stored
(anti join against the same days, after keeping one row per key of the
incoming rows), so repeating a load adds nothing and stored keys stay
unique; reads then skip the de-duplication shuffle. A read
is served from the snapshot when the ledger covers the whole request;
otherwise only the uncovered ranges are fetched from the source.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe import model
from sensorframe.functions.expressions import date_lit, ts_lit
from sensorframe.operators.dedup import dedup_keep_first
from sensorframe.operators.joins import bounded_broadcast
from sensorframe.session import delete_path, list_dirs, list_files, observed, path_exists, touch
from sensorframe.sources.facts import coerce_facts, empty_facts, read_timeseries
from sensorframe.sources.metadata import empty_metadata, normalize_metadata

KEY = ["timestamp", "ID", "type"]
COVERAGE_SCHEMA = "ID long, type string, from_ts timestamp_ntz, to_ts timestamp_ntz"
TABLE_NAMES = dict(zip(["hierarchy", "history", "env"], model.SNAPSHOT_TABLES))


def _facts_path(root):
    return f"{root}/facts"


def _coverage_path(root):
    return f"{root}/coverage"


#: Files of the ledger after which it is merged.
COMPACT_AFTER = 64
#: Hours after which a series' silence counts as final: what the source lacks that long before its
#: newest reading is taken as never coming. The replication's overlap in service is as long.
SETTLE_HOURS = 336


def _ledger(spark: SparkSession, root: str) -> DataFrame | None:
    done = _versions(spark, _coverage_path(root))
    return spark.read.schema(COVERAGE_SCHEMA).parquet(f"{_coverage_path(root)}/v={done[-1]}") if done else None


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Adjacent and overlapping ``(ID, type, from_ts, to_ts)`` as one."""
    w = Window.partitionBy("ID", "type").orderBy("from_ts", "to_ts")
    ends = F.max("to_ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(ends.isNull() | (ends < F.col("from_ts")), 1).otherwise(0)
    runs = ranges.withColumn("_new", apart).withColumn("_run", F.sum("_new").over(w))
    return (runs.groupBy("ID", "type", "_run").agg(F.min("from_ts").alias("from_ts"), F.max("to_ts").alias("to_ts"))
            .select("ID", "type", "from_ts", "to_ts"))


def compact_coverage(spark: SparkSession, root: str) -> None:
    """The ledger merged into a new version; the old one goes when that is complete."""
    done = _versions(spark, _coverage_path(root))
    if done:
        merge_ranges(_ledger(spark, root)).write.mode("overwrite").parquet(f"{_coverage_path(root)}/v={done[-1] + 1}")
        for v in done:
            delete_path(spark, f"{_coverage_path(root)}/v={v}")


def _meta_path(root):
    return f"{root}/meta"


def _dup_marker(root):
    """Present once rows were appended without the key check (hidden from
    the parquet reader by its leading underscore)."""
    return f"{root}/facts/_may_have_duplicates"


def route(df: DataFrame, routing: model.ChannelRouting = model.DEFAULT_ROUTING) -> DataFrame:
    """History channels -> ``history``; every other type, NULL included -> ``env``."""
    t = F.col("type")
    return df.withColumn("source_table", F.when(t.isin(list(routing.history)) & t.isNotNull(),
                                                F.lit("history")).otherwise(F.lit("env")))


def _stored(spark: SparkSession, root: str) -> DataFrame | None:
    p = _facts_path(root)
    if not path_exists(spark, p):
        return None
    # The schema is given: after an empty load the folder holds no file to infer it from.
    return spark.read.schema(T.StructType([*model.FACT_SCHEMA.fields, T.StructField("source_table", T.StringType()),
                                           T.StructField("date", T.DateType())])).parquet(p)


def append_facts(spark: SparkSession, root: str, facts: DataFrame,
                 routing: model.ChannelRouting = model.DEFAULT_ROUTING,
                 start: datetime | None = None, end: datetime | None = None,
                 skip_existing: bool = True) -> int:
    """Append rows not yet stored; returns the number appended.

    ``start``/``end`` bound the days compared against (partition pruning);
    without them the incoming rows' day range is computed first. With
    ``skip_existing=False`` rows are appended as given (the reference's
    plain append, which readers de-duplicate).
    """
    incoming = coerce_facts(facts)
    if skip_existing:
        # keep stored keys unique, so reads need no de-duplication shuffle
        incoming = dedup_keep_first(incoming, KEY)
    new = route(incoming, routing).withColumn("date", F.to_date("timestamp"))
    existing = _stored(spark, root) if skip_existing else None
    if existing is not None:
        if start is None or end is None:
            lo, hi = new.agg(F.min("date"), F.max("date")).first()
            if lo is None:
                return 0
        else:
            lo, hi = start.date(), end.date()
        old = existing.filter((F.col("date") >= date_lit(lo)) & (F.col("date") <= date_lit(hi)))
        new = new.join(old.select("source_table", "date", *KEY), ["source_table", "date", *KEY], "left_anti")
    obs = Observation("append")
    out = (new.observe(obs, F.count(F.lit(1)).alias("rows"))
           .select(*model.FACT_COLUMNS, "source_table", "date")
           # AQE rebalance: right-sized files per (table, day), a hot day split over tasks
           .hint("rebalance", "source_table", "date")
           .sortWithinPartitions("source_table", "date", "ID", "type", "timestamp"))
    if not skip_existing:
        touch(spark, _dup_marker(root))  # first, so that a crash in between leaves no duplicates unread
    out.write.mode("append").partitionBy("source_table", "date").parquet(_facts_path(root))
    return int(observed(obs, ["rows"])["rows"] or 0)


def read_snapshot(spark: SparkSession, root: str, ids, channels, start: datetime, end: datetime,
                  routing: model.ChannelRouting = model.DEFAULT_ROUTING, dedup: bool | None = None) -> DataFrame:
    """Snapshot rows of ``ids`` x ``channels`` in ``[start, end)``.

    Partition filters on ``source_table`` and ``date`` prune folders; the
    id key table is a semi join (broadcast behind a size check). Duplicate
    keys are dropped (first row: smallest value) when ``dedup`` is true; by
    default only if rows were ever appended without the key check, since
    checked appends keep keys unique.
    """
    stored = _stored(spark, root)
    if stored is None or not channels:
        return empty_facts(spark)
    tables = sorted({"history" if c in routing.history else "env" for c in channels})
    df = stored.filter(F.col("source_table").isin(tables)
                       & (F.col("date") >= date_lit(start)) & (F.col("date") <= date_lit(end)))
    df = df.filter((F.col("timestamp") >= ts_lit(start)) & (F.col("timestamp") < ts_lit(end))
                   & F.col("type").isin(list(channels)))
    if isinstance(ids, DataFrame):
        k = bounded_broadcast(ids.select(F.col(ids.columns[0]).cast("bigint").alias("ID")).distinct())
        df = df.join(k, "ID", "left_semi")
    else:
        df = df.filter(F.col("ID").isin(list(ids)))
    df = coerce_facts(df.select(*model.FACT_COLUMNS))
    if dedup is None:
        dedup = path_exists(spark, _dup_marker(root))
    return dedup_keep_first(df, KEY) if dedup else df


def _requests(ids: DataFrame, channels, start, end) -> DataFrame:
    ch = F.array(*[F.lit(c) for c in channels])
    return (ids.select(F.col(ids.columns[0]).cast("bigint").alias("ID")).distinct()
            .select("ID", F.explode(ch).alias("type"))
            .withColumn("req_from", ts_lit(start))
            .withColumn("req_to", ts_lit(end)))


def record_coverage(spark: SparkSession, root: str, ranges: DataFrame) -> None:
    """Append ``(ID, type, from_ts, to_ts)`` rows to the ledger and merge it when it has grown."""
    done = _versions(spark, _coverage_path(root))
    path = f"{_coverage_path(root)}/v={done[-1] if done else 1}"
    ranges.select("ID", "type", "from_ts", "to_ts").write.mode("append").parquet(path)
    if len(list_files(spark, path)) > COMPACT_AFTER:
        compact_coverage(spark, root)


def missing_ranges(spark: SparkSession, root: str, ids: DataFrame, channels, start: datetime,
                   end: datetime) -> DataFrame:
    """Parts of the request the ledger does not cover: ``(ID, type, from_ts, to_ts)``.

    Covered intervals are merged per (ID, type) with a running maximum of
    their ends; the holes between them, before the first and after the last
    are the missing ranges.
    """
    req = _requests(ids, channels, start, end)
    led = _ledger(spark, root)
    if led is None:
        return req.select("ID", "type", F.col("req_from").alias("from_ts"), F.col("req_to").alias("to_ts"))
    iv = (led.join(req, ["ID", "type"])
          .filter((F.col("from_ts") < F.col("req_to")) & (F.col("to_ts") > F.col("req_from")))
          .select("ID", "type", "req_from", "req_to",
                  F.greatest("from_ts", "req_from").alias("f"), F.least("to_ts", "req_to").alias("t")))
    w = Window.partitionBy("ID", "type").orderBy("f", "t")
    prev_end = F.max("t").over(w.rowsBetween(Window.unboundedPreceding, -1))
    lo = F.coalesce(prev_end, F.col("req_from"))
    holes = iv.select("ID", "type", lo.alias("from_ts"), F.col("f").alias("to_ts")).filter(
        F.col("from_ts") < F.col("to_ts"))
    tails = (iv.groupBy("ID", "type", "req_to").agg(F.max("t").alias("from_ts"))
             .select("ID", "type", "from_ts", F.col("req_to").alias("to_ts"))
             .filter(F.col("from_ts") < F.col("to_ts")))
    untouched = (req.join(iv.select("ID", "type").distinct(), ["ID", "type"], "left_anti")
                 .select("ID", "type", F.col("req_from").alias("from_ts"), F.col("req_to").alias("to_ts")))
    return holes.unionByName(tails).unionByName(untouched)


def _covered(spark: SparkSession, root: str, gaps: DataFrame, start: datetime, end: datetime,
             settled: datetime | None) -> DataFrame:
    """The parts of fetched ``gaps`` that need no further look: up to the last reading known of
    each (ID, type), stored in ``[start, end)`` or the end of earlier coverage, and up to
    ``settled`` whether there were readings or not."""
    marks = []
    stored = _stored(spark, root)
    if stored is not None:
        marks.append(stored.filter((F.col("date") >= date_lit(start)) & (F.col("date") <= date_lit(end))
                                   & (F.col("timestamp") >= ts_lit(start)) & (F.col("timestamp") < ts_lit(end)))
                     .select("ID", "type", F.col("timestamp").alias("seen")))
    led = _ledger(spark, root)
    if led is not None:
        marks.append(led.select("ID", "type", F.col("to_ts").alias("seen")))
    if settled is not None:
        marks.append(gaps.select("ID", "type", ts_lit(settled).alias("seen")))
    if not marks:
        return gaps.limit(0)
    seen = marks[0]
    for m in marks[1:]:
        seen = seen.unionByName(m)
    return (gaps.join(seen.groupBy("ID", "type").agg(F.max("seen").alias("seen")), ["ID", "type"])
            .withColumn("to_ts", F.least("to_ts", "seen")).filter(F.col("from_ts") < F.col("to_ts"))
            # The ledger is read above and appended to by the caller.
            .select("ID", "type", "from_ts", "to_ts").checkpoint(eager=True))


def source_high_water(*tables: DataFrame | None) -> datetime | None:
    """Newest timestamp of the given tables."""
    marks = [t.agg(F.max("timestamp")).first()[0] for t in tables if t is not None]
    return max((m for m in marks if m is not None), default=None)


def read_through(spark: SparkSession, root: str, history: DataFrame | None, env: DataFrame | None,
                 ids: DataFrame, channels, start: datetime, end: datetime,
                 routing: model.ChannelRouting = model.DEFAULT_ROUTING,
                 snapshot_only: bool = False, high_water: datetime | None = None,
                 settle_hours: float = SETTLE_HOURS) -> DataFrame:
    """Serve from the snapshot; fetch, append and record what it lacks.

    With ``snapshot_only`` the source is never read. A series counts as covered
    up to its last reading seen (readings of one series arrive in time order), and
    up to ``settle_hours`` before the source's newest reading in any case, so quiet
    ranges are not fetched again; what the source gains after that is fetched by a later call.
    ``high_water`` is the source's newest timestamp where the caller knows it (a
    replica's state does); else it is looked up when something was fetched.
    """
    if not snapshot_only:
        gaps = missing_ranges(spark, root, ids, channels, start, end).checkpoint(eager=True)
        if not gaps.isEmpty():
            g = gaps.agg(F.min("from_ts"), F.max("to_ts")).first()
            src = read_timeseries(spark, history, env, gaps.select("ID").distinct(), list(channels),
                                  g[0], g[1], routing)
            fetched = (src.join(gaps, ["ID", "type"])
                       .filter((F.col("timestamp") >= F.col("from_ts")) & (F.col("timestamp") < F.col("to_ts")))
                       .select(*model.FACT_COLUMNS))
            append_facts(spark, root, fetched, routing, g[0], g[1])
            newest = high_water or source_high_water(history, env)
            settled = newest - timedelta(hours=settle_hours) if newest is not None else None
            covered = _covered(spark, root, gaps, g[0], g[1], settled)
            if not covered.isEmpty():
                record_coverage(spark, root, covered)
    return read_snapshot(spark, root, ids, channels, start, end, routing)


def preload(spark: SparkSession, root: str, history: DataFrame | None, env: DataFrame | None,
            ids: DataFrame, channels, start: datetime, end: datetime,
            routing: model.ChannelRouting = model.DEFAULT_ROUTING, **kw) -> DataFrame:
    """Materialise a scope x channels x range into the snapshot (only the
    uncovered parts are fetched) and return the stored rows of the range."""
    return read_through(spark, root, history, env, ids, channels, start, end, routing, **kw)


# --- metadata: versioned full refresh ---------------------------------------

def _versions(spark: SparkSession, base: str) -> list[int]:
    out = []
    for name in list_dirs(spark, base):
        if name.startswith("v=") and path_exists(spark, f"{base}/{name}/_SUCCESS"):
            out.append(int(name[2:]))
    return sorted(out)


def write_meta(spark: SparkSession, root: str, meta: DataFrame, keep_versions: int = 3) -> int:
    """Full refresh: a complete new version, visible once committed; only
    the newest ``keep_versions`` committed versions are kept."""
    base = _meta_path(root)
    versions = _versions(spark, base)
    v = (versions[-1] + 1) if versions else 1
    normalize_metadata(meta).write.mode("errorifexists").parquet(f"{base}/v={v}")
    for old in (versions + [v])[:-keep_versions]:
        delete_path(spark, f"{base}/v={old}")
    return v


def read_meta(spark: SparkSession, root: str) -> DataFrame:
    base = _meta_path(root)
    versions = _versions(spark, base)
    if not versions:
        return empty_metadata(spark)
    return spark.read.parquet(f"{base}/v={versions[-1]}")


def clear(spark: SparkSession, root: str) -> None:
    """Empty the snapshot: an empty metadata version; facts and ledger removed."""
    write_meta(spark, root, empty_metadata(spark))
    delete_path(spark, _facts_path(root))
    delete_path(spark, _coverage_path(root))


def stats(spark: SparkSession, root: str) -> DataFrame:
    """Row count per snapshot table; a missing table counts 0."""
    names = spark.createDataFrame([(k, v) for k, v in TABLE_NAMES.items()], "part string, table_name string")
    parts = []
    stored = _stored(spark, root)
    if stored is not None:
        parts.append(stored.groupBy(F.col("source_table").alias("part")).agg(F.count(F.lit(1)).alias("n")))
    meta_versions = _versions(spark, _meta_path(root))
    if meta_versions:
        parts.append(read_meta(spark, root).agg(F.count(F.lit(1)).alias("n"))
                     .select(F.lit("hierarchy").alias("part"), "n"))
    if not parts:
        return names.select("table_name", F.lit(0).cast("long").alias("n_rows"))
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    return (names.join(counts, "part", "left")
            .select("table_name", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_rows")))
