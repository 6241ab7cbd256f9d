"""Registered queries over the driver tables, and their DuckDB oracles.

Each query reads whole driver tables (in the sensor roles of
``sources.driver_tables``) and runs one operator of the library. Computed
doubles are rounded to 6 decimals on both sides so that summation order
cannot change the comparison.
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe import model
from sensorframe.operators import batches, dedup, enrich, facets, filters, kpis, panels, resample, smooth
from sensorframe.operators.joins import semi_join
from sensorframe.plans import explore, quality, snapshot, sync
from sensorframe.session import work_dir
from sensorframe.sinks import csv as csv_sink
from sensorframe.sinks import ordered
from sensorframe.sources import chunked
from sensorframe.sources import driver_tables as dt
from sensorframe.sources.facts import read_timeseries, union_facts
from sensorframe.sources.metadata import normalize_metadata
from sensorframe.sources.schema import describe, with_target_types
from sensorframe.streaming import ingest

R = 6  # rounding of computed doubles
ROUTING = dt.ROUTING
ALL_CHANNELS = list(ROUTING.default_channels)
DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _rv(df: DataFrame, col: str = "value") -> DataFrame:
    return df.withColumn(col, F.round(F.col(col), R))


def _meta(spark, d):
    return normalize_metadata(dt.metadata_raw(spark, d))


def _ids_of(meta: DataFrame, sel: facets.Selection) -> DataFrame:
    return facets.facet_filter(meta, sel).select(F.col("id").alias("ID"))


# ----------------------------------------------------------------------------
# SQL building blocks (DuckDB)
# ----------------------------------------------------------------------------

FACTS = """facts AS (SELECT ts AS "timestamp", value, user_id AS "ID", event_type AS "type" FROM events)"""
META = """meta AS (SELECT c.c_custkey AS id, c.c_name AS vanity, r.r_name AS building, n.n_name AS floor,
       c.c_mktsegment AS area, 'type_' || CAST(c.c_custkey % 4 AS VARCHAR) AS "nodeTypeName"
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""
BASE = f"WITH {FACTS}, {META}"
K_SQL = 'g."ID", g."type", m.vanity, m.building, m.floor, m.area, m."nodeTypeName"'

_BIN_SQL = {
    "15min": ("time_bucket(INTERVAL 15 MINUTE, \"timestamp\")", "INTERVAL 15 MINUTE", "{t}"),
    "hour": ("date_trunc('hour', \"timestamp\")", "INTERVAL 1 HOUR", "{t}"),
    "day": ("date_trunc('day', \"timestamp\")", "INTERVAL 1 DAY", "{t}"),
    "week": ("date_trunc('week', \"timestamp\")", "INTERVAL 7 DAY", "{t} + INTERVAL 6 DAY"),
    "month": ("date_trunc('month', \"timestamp\")", "INTERVAL 1 MONTH", "CAST(last_day({t}) AS TIMESTAMP)"),
}
_AGG_SQL = {"mean": "avg(value)", "sum": "sum(value)", "max": "max(value)", "min": "min(value)",
            "median": "median(value)"}


def _gapfill_cte(freq: str, func: str, src: str = "facts") -> str:
    b, step, _ = _BIN_SQL[freq]
    return f"""b AS (SELECT "ID", "type", CAST({b} AS TIMESTAMP) AS t, {_AGG_SQL[func]} AS v FROM {src}
           WHERE "ID" IS NOT NULL AND "type" IS NOT NULL GROUP BY ALL),
  r AS (SELECT "ID", "type", min(t) AS a, max(t) AS z FROM b GROUP BY ALL),
  g AS (SELECT "ID", "type", unnest(generate_series(a, z, {step})) AS t FROM r),
  d AS (SELECT g."ID", g."type", g.t, {'coalesce(b.v, 0.0)' if func == 'sum' else 'b.v'} AS v
        FROM g LEFT JOIN b ON g."ID" = b."ID" AND g."type" = b."type" AND g.t = b.t)"""


def _resample_sql(freq: str, func: str, meta_where: str = "") -> str:
    label = _BIN_SQL[freq][2].format(t="g.t")
    return f"""{BASE}, {_gapfill_cte(freq, func)}
SELECT {K_SQL}, {label} AS "timestamp", round(g.v, {R}) AS value
FROM d g JOIN (SELECT * FROM meta {meta_where}) m ON m.id = g."ID\""""


def _resampled_cte(freq: str, func: str) -> str:
    """CTE ``res`` with the resampled, enriched frame (unrounded)."""
    label = _BIN_SQL[freq][2].format(t="g.t")
    return f"""{_gapfill_cte(freq, func)},
  res AS (SELECT {K_SQL}, {label} AS "timestamp", g.v AS value FROM d g JOIN meta m ON m.id = g."ID")"""


ENRICHED = """enriched AS (SELECT f."timestamp", f.value, f."ID", f."type", m.vanity, m.building, m.floor, m.area,
       m."nodeTypeName" FROM facts f LEFT JOIN meta m ON f."ID" = m.id)"""

# ----------------------------------------------------------------------------
# Queries
# ----------------------------------------------------------------------------

Q: dict = {}
SQL: dict = {}


def query(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


EXPLORE_SEL = facets.Selection(building=["EUROPE"])
EXPLORE_RANGE = filters.query_range(date(2024, 1, 1), time(0, 0), date(2024, 1, 30), time(23, 59))


def explore_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily mean per sensor and channel of one building in a range, with names."""
    req = explore.ExploreRequest(start=EXPLORE_RANGE[0], end=EXPLORE_RANGE[1], selection=EXPLORE_SEL,
                                 frequency="day", agg="mean", routing=ROUTING)
    return _rv(explore.load_series(spark, dt.history(spark, d), dt.env(spark, d), _meta(spark, d), req))


Q["explore_daily"] = explore_daily
SQL["explore_daily"] = f"""{BASE}, sel AS (SELECT * FROM facts WHERE "ID" IN (SELECT id FROM meta WHERE building = 'EUROPE')
   AND "timestamp" >= TIMESTAMP '2024-01-01 00:00:00' AND "timestamp" < TIMESTAMP '2024-01-31 00:00:00'),
  {_gapfill_cte('day', 'mean', 'sel')}
SELECT {K_SQL}, g.t AS "timestamp", round(g.v, {R}) AS value FROM d g JOIN meta m ON m.id = g."ID\""""


@query("meta_scan", f"""{BASE}
SELECT id, coalesce(CAST("nodeTypeName" AS VARCHAR), '') AS "nodeTypeName", coalesce(building, '') AS building,
       coalesce(floor, '') AS floor, coalesce(area, '') AS area, coalesce(vanity, '') AS vanity FROM meta""")
def meta_scan(spark, d):
    return _meta(spark, d)


@query("alias_pick", f"""{BASE}
SELECT id, "nodeTypeName", building, floor, '' AS area, vanity FROM meta""")
def alias_pick(spark, d):
    raw = dt.metadata_raw(spark, d)
    # Stand-in metadata: sensor type under another spelling, a decoy 'type'
    # column (listed later among the aliases), and no 'area' column.
    raw = raw.select("id", "vanity", "building", "floor", F.col("area").alias("type"),
                     F.col("nodeTypeName").alias("node_type_name"))
    return normalize_metadata(raw)


@query("ts_scan", f"""{BASE}
SELECT "timestamp", value, "ID", "type" FROM facts WHERE "type" IN ('click', 'signup')
  AND "timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" < TIMESTAMP '2024-01-20'
  AND "ID" IN (SELECT id FROM meta)""")
def ts_scan(spark, d):
    ids = _meta(spark, d).select(F.col("id").alias("ID"))
    return read_timeseries(spark, dt.history(spark, d), dt.env(spark, d), ids, ["click", "signup", "unknown"],
                           datetime(2024, 1, 5), datetime(2024, 1, 20), ROUTING)


@query("filter_ids", f"""{BASE}
SELECT * FROM facts WHERE "ID" IN (SELECT id FROM meta WHERE building = 'EUROPE')""")
def filter_ids(spark, d):
    return filters.filter_ids(dt.facts(spark, d), _ids_of(_meta(spark, d), facets.Selection(building=["EUROPE"])))


@query("filter_channels", f"""{BASE}
SELECT * FROM facts WHERE "type" IN ('purchase', 'view')""")
def filter_channels(spark, d):
    return filters.filter_channels(dt.facts(spark, d), ["purchase", "view"], ROUTING)


@query("filter_range", f"""{BASE}
SELECT * FROM facts WHERE "timestamp" >= TIMESTAMP '2024-01-08' AND "timestamp" < TIMESTAMP '2024-01-15'""")
def filter_range(spark, d):
    return filters.filter_range(dt.facts(spark, d), datetime(2024, 1, 8), datetime(2024, 1, 15))


@query("range_inclusive_minute", f"""{BASE}
SELECT * FROM facts WHERE "timestamp" >= TIMESTAMP '2024-01-10 06:30:00' AND "timestamp" < TIMESTAMP '2024-01-13 00:00:00'""")
def range_inclusive_minute(spark, d):
    start, end = filters.query_range(date(2024, 1, 10), time(6, 30), date(2024, 1, 12), time(23, 59))
    return filters.filter_range(dt.facts(spark, d), start, end)


@query("range_whole_days", f"""{BASE}
SELECT * FROM facts WHERE "timestamp" >= TIMESTAMP '2024-01-20 00:00:00' AND "timestamp" < TIMESTAMP '2024-01-22 00:00:00'""")
def range_whole_days(spark, d):
    start, end = filters.whole_days(date(2024, 1, 20), date(2024, 1, 21))
    return filters.filter_range(dt.facts(spark, d), start, end)


@query("facet_filter", f"""{BASE}
SELECT id, "nodeTypeName", building, floor, area, vanity FROM meta
WHERE building IN ('ASIA', 'EUROPE') AND area IN ('BUILDING', 'MACHINERY')""")
def facet_filter(spark, d):
    return facets.facet_filter(_meta(spark, d), facets.Selection(building=["ASIA", "EUROPE"],
                                                                area=["BUILDING", "MACHINERY"]))


_CASCADE_B = "building IN ('ASIA')"
_CASCADE_BF = _CASCADE_B + " AND floor IN ('NATION_2', 'NATION_7')"


@query("facet_cascade", f"""{BASE}
SELECT DISTINCT 'building' AS facet, building AS value FROM meta WHERE building <> ''
UNION SELECT DISTINCT 'floor', floor FROM meta WHERE {_CASCADE_B} AND floor <> ''
UNION SELECT DISTINCT 'area', area FROM meta WHERE {_CASCADE_BF} AND area <> ''
UNION SELECT DISTINCT 'nodeTypeName', "nodeTypeName" FROM meta WHERE {_CASCADE_BF} AND "nodeTypeName" <> ''
UNION SELECT DISTINCT 'vanity', vanity FROM meta WHERE {_CASCADE_BF} AND vanity <> ''""")
def facet_cascade(spark, d):
    return facets.facet_options(_meta(spark, d), facets.Selection(building=["ASIA"],
                                                                 floor=["NATION_2", "NATION_7"]))


@query("facet_values", f"""{BASE}
SELECT DISTINCT 'building' AS facet, building AS value FROM meta WHERE building <> ''
UNION SELECT DISTINCT 'floor', floor FROM meta WHERE floor <> ''
UNION SELECT DISTINCT 'area', area FROM meta WHERE area <> ''
UNION SELECT DISTINCT 'nodeTypeName', "nodeTypeName" FROM meta WHERE "nodeTypeName" <> ''
UNION SELECT DISTINCT 'vanity', vanity FROM meta WHERE vanity <> ''""")
def facet_values(spark, d):
    return facets.facet_values(_meta(spark, d))


@query("facet_count", f"""{BASE}
SELECT count(DISTINCT id) AS n_sensors, count(*) AS n_selected FROM meta
WHERE building IN ('AMERICA') AND "nodeTypeName" IN ('type_1', 'type_2')""")
def facet_count(spark, d):
    return facets.facet_count(_meta(spark, d), facets.Selection(building=["AMERICA"],
                                                               nodeTypeName=["type_1", "type_2"]))


@query("facet_scope", f"""{BASE},
  scoped AS (SELECT 'all' AS scope, id FROM meta UNION ALL SELECT 'filter', id FROM meta
             WHERE building IN ('AMERICA') AND "nodeTypeName" IN ('type_1', 'type_2'))
SELECT scope, "type", count(*) AS n_rows, count(DISTINCT facts."ID") AS n_sensors FROM facts JOIN scoped ON facts."ID" = scoped.id GROUP BY 1, 2""")
def facet_scope(spark, d):
    """What a load brings, by channel, for every sensor and for those of the selection."""
    meta, facts = _meta(spark, d), dt.facts(spark, d)
    sel = facets.Selection(building=["AMERICA"], nodeTypeName=["type_1", "type_2"])
    parts = [semi_join(facts, facets.scope_ids(meta, sel, scope), "ID").groupBy("type")
             .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ID").alias("n_sensors"))
             .select(F.lit(scope).alias("scope"), "type", "n_rows", "n_sensors") for scope in ("all", "filter")]
    return parts[0].unionByName(parts[1])


@query("filter_not_in", f"""{BASE}
SELECT * FROM facts WHERE "type" NOT IN ('click', 'view') OR "type" IS NULL""")
def filter_not_in(spark, d):
    return filters.filter_not_in(dt.facts(spark, d), dt.HISTORY_TYPES)


@query("valid_timestamp", """
SELECT TRY_CAST(ts_text AS TIMESTAMP) AS "timestamp", value, "ID", "type" FROM (
  SELECT CASE WHEN event_type = 'error' THEN props ELSE CAST(ts AS VARCHAR) END AS ts_text,
         value, user_id AS "ID", event_type AS "type" FROM events)
WHERE TRY_CAST(ts_text AS TIMESTAMP) IS NOT NULL""")
def valid_timestamp(spark, d):
    ev = dt.table(spark, d, "events")
    # Stand-in: timestamps as text; the 'error' events carry non-timestamp text.
    raw = ev.select(F.when(F.col("event_type") == "error", F.col("props"))
                    .otherwise(F.col("ts").cast("string")).alias("timestamp"),
                    "value", F.col("user_id").alias("ID"), F.col("event_type").alias("type"))
    return filters.valid_timestamps(raw)


_PARTIAL_META = "WHERE building IN ('AMERICA', 'ASIA')"


@query("enrich_left", f"""{BASE}
SELECT f."timestamp", f.value, f."ID", f."type", m.vanity, m.building, m.floor, m.area, m."nodeTypeName"
FROM facts f LEFT JOIN (SELECT * FROM meta {_PARTIAL_META}) m ON f."ID" = m.id""")
def enrich_left(spark, d):
    meta = _meta(spark, d).filter(F.col("building").isin("AMERICA", "ASIA"))
    return enrich.enrich(dt.facts(spark, d), meta)


@query("semi_keys", f"""{BASE}
SELECT * FROM facts WHERE "ID" IN (SELECT id FROM meta WHERE building = 'AFRICA') AND "type" IN ('click', 'error')""")
def semi_keys(spark, d):
    ids = _ids_of(_meta(spark, d), facets.Selection(building=["AFRICA"]))
    ids = ids.unionByName(ids)  # repeated keys must not fan out
    channels = spark.createDataFrame([("click",), ("error",), ("error",)], "type string")
    return enrich.semi_keys(dt.facts(spark, d), ids, channels)


@query("vanity_without_data", f"""{BASE}
SELECT DISTINCT vanity FROM meta WHERE building = 'ASIA' AND vanity NOT IN (
  SELECT m.vanity FROM facts f JOIN meta m ON f."ID" = m.id WHERE m.building = 'ASIA'
    AND f."timestamp" >= TIMESTAMP '2024-01-10 00:00:00' AND f."timestamp" < TIMESTAMP '2024-01-10 06:00:00')""")
def vanity_without_data(spark, d):
    meta = _meta(spark, d)
    chosen = facets.facet_filter(meta, facets.Selection(building=["ASIA"]))
    data = enrich.enrich(read_timeseries(spark, dt.history(spark, d), dt.env(spark, d),
                                         chosen.select(F.col("id").alias("ID")), ALL_CHANNELS,
                                         datetime(2024, 1, 10), datetime(2024, 1, 10, 6), ROUTING), meta)
    return enrich.values_without_data(chosen, data, "vanity")


def _resample_query(freq, func):
    def run(spark, d):
        return _rv(resample.resample_series(dt.facts(spark, d), _meta(spark, d), freq, func))
    return run


for _name, _freq, _func in [("resample_mean", "day", "mean"), ("resample_sum", "week", "sum"),
                            ("resample_max", "month", "max"), ("resample_min", "hour", "min"),
                            ("resample_median", "day", "median"), ("gapfill_hour", "hour", "mean"),
                            ("gapfill_day", "day", "sum"), ("gapfill_15min", "15min", "mean"),
                            ("gapfill_week", "week", "median"), ("gapfill_month", "month", "sum")]:
    Q[_name] = _resample_query(_freq, _func)
    SQL[_name] = _resample_sql(_freq, _func)


def _bins_query(freq):
    def run(spark, d):
        return resample.assign_bins(dt.facts(spark, d), freq)
    return run


for _freq in ["15min", "hour", "day", "week", "month"]:
    _b, _, _label = _BIN_SQL[_freq]
    _label = _label.format(t="t")
    _name = "bins_" + _freq
    Q[_name] = _bins_query(_freq)
    SQL[_name] = f"""{BASE}
SELECT "timestamp", value, "ID", "type", {_label} AS bin FROM (SELECT *, CAST({_b} AS TIMESTAMP) AS t FROM facts)"""


@query("resample_null_keys", f"""{BASE}, {ENRICHED.replace('LEFT JOIN meta m', "LEFT JOIN (SELECT * FROM meta WHERE building = 'AMERICA') m")},
  b AS (SELECT "ID", "type", vanity, building, floor, area, "nodeTypeName", date_trunc('day', "timestamp") AS t,
               avg(value) AS v FROM enriched
        WHERE "ID" IS NOT NULL AND "type" IS NOT NULL AND vanity IS NOT NULL AND building IS NOT NULL
          AND floor IS NOT NULL AND area IS NOT NULL AND "nodeTypeName" IS NOT NULL GROUP BY ALL),
  r AS (SELECT "ID", "type", vanity, building, floor, area, "nodeTypeName", min(t) AS a, max(t) AS z FROM b GROUP BY ALL),
  g AS (SELECT "ID", "type", vanity, building, floor, area, "nodeTypeName",
               unnest(generate_series(a, z, INTERVAL 1 DAY)) AS t FROM r)
SELECT g."ID", g."type", g.vanity, g.building, g.floor, g.area, g."nodeTypeName", g.t AS "timestamp",
       round(b.v, {R}) AS value
FROM g LEFT JOIN b ON g."ID" = b."ID" AND g."type" = b."type" AND g.vanity = b.vanity AND g.t = b.t""")
def resample_null_keys(spark, d):
    meta = _meta(spark, d).filter(F.col("building") == "AMERICA")
    enriched = enrich.enrich(dt.facts(spark, d), meta)
    return _rv(resample.resample(enriched, "day", "mean"))


@query("rolling_mean", f"""{BASE}, {ENRICHED}
SELECT "timestamp", round(avg(value) OVER (PARTITION BY "ID", "type" ORDER BY "timestamp", value
         ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), {R}) AS value,
       "ID", "type", vanity, building, floor, area, "nodeTypeName" FROM enriched""")
def rolling_mean(spark, d):
    return _rv(smooth.rolling_mean(enrich.enrich(dt.facts(spark, d), _meta(spark, d)), 5))


@query("rolling_mean_long_series", f"""
SELECT "timestamp", round(avg(value) OVER (PARTITION BY "ID", "type" ORDER BY "timestamp", value
         ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), {R}) AS value, "ID", "type"
FROM (SELECT l_shipdate AS "timestamp", l_quantity AS value, CAST(l_linenumber AS BIGINT) AS "ID",
             l_returnflag AS "type" FROM lineitem)""")
def rolling_mean_long_series(spark, d):
    """Rolling mean over few long series with a 1024-row block size: series
    longer than a block (sf0.01 and up) take the halo-block path that a sensor
    holding a large share of the rows takes; shorter ones a plain window."""
    return _rv(smooth.rolling_mean(dt.long_series_facts(spark, d), 5, block_rows=1024))


@query("resample_then_roll", f"""{BASE}, {_resampled_cte('hour', 'mean')}
SELECT "ID", "type", vanity, building, floor, area, "nodeTypeName", "timestamp",
       round(avg(value) OVER (PARTITION BY "ID", "type" ORDER BY "timestamp"
             ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), {R}) AS value FROM res""")
def resample_then_roll(spark, d):
    res = resample.resample_series(dt.facts(spark, d), _meta(spark, d), "hour", "mean", fill=False)
    return _rv(smooth.rolling_mean_dense(res, 3, "hour", fill="mean"))


@query("chart_groups", f"""{BASE}
SELECT "ID", CAST((row_number() OVER (ORDER BY "ID") - 1) // 12 + 1 AS BIGINT) AS group_no,
       CAST(ceil(count(*) OVER () / 12.0) AS BIGINT) AS group_count
FROM (SELECT DISTINCT "ID" FROM facts)""")
def chart_groups(spark, d):
    return panels.chart_groups(dt.facts(spark, d), 12)


@query("sort_series", f"""{BASE}, {ENRICHED}
SELECT *, row_number() OVER (ORDER BY "ID", "type", "timestamp", value) AS row_no FROM enriched""")
def sort_series(spark, d):
    path = work_dir(spark, "series")
    ordered.write_ordered(enrich.enrich(dt.facts(spark, d), _meta(spark, d)), path, ["ID", "type", "timestamp", "value"])
    return ordered.read_ordered(spark, path)


@query("table_view", f"""{BASE}, {ENRICHED}
SELECT *, row_number() OVER (ORDER BY "timestamp", "ID", "type", value) AS row_no FROM enriched""")
def table_view(spark, d):
    path = work_dir(spark, "view")
    ordered.write_ordered(enrich.enrich(dt.facts(spark, d), _meta(spark, d)), path, ["timestamp", "ID", "type", "value"])
    return ordered.read_ordered(spark, path)


PAGE, PAGE_ROWS = 37, 100


@query("table_deep_page", f"""{BASE}, {ENRICHED},
  numbered AS (SELECT *, row_number() OVER (ORDER BY "timestamp", "ID", "type", value) AS row_no FROM enriched)
SELECT * FROM numbered WHERE row_no > {PAGE * PAGE_ROWS} AND row_no <= {(PAGE + 1) * PAGE_ROWS}""")
def table_deep_page(spark, d):
    """One page far into the ordered table, from the files that hold it."""
    path = work_dir(spark, "pages")
    ordered.write_ordered(enrich.enrich(dt.facts(spark, d), _meta(spark, d)), path, ["timestamp", "ID", "type", "value"], 1000)
    return ordered.read_page(spark, path, PAGE, PAGE_ROWS)


@query("union_facts", f"""{BASE}
SELECT * FROM facts""")
def union_facts_q(spark, d):
    return union_facts(dt.history(spark, d), dt.env(spark, d))


@query("channels_for_types", f"""{BASE}
SELECT DISTINCT f."type" AS channel FROM facts f JOIN meta m ON f."ID" = m.id
WHERE m."nodeTypeName" IN ('type_1', 'type_3')""")
def channels_for_types(spark, d):
    e = enrich.enrich(dt.facts(spark, d), _meta(spark, d))
    # Channel map observed in the data: sensor type -> channels its sensors report.
    cmap = (e.filter(F.col("nodeTypeName").isNotNull()).groupBy(F.col("nodeTypeName").alias("sensor_type"))
            .agg(F.collect_set("type").alias("channels")))
    chosen = spark.createDataFrame([("type_1",), ("type_3",)], "sensor_type string")
    return facets.channels_for_types(chosen, cmap)


@query("series_label", f"""{BASE}
SELECT DISTINCT f."ID", f."type",
  coalesce(f."type", '') || ' | ' || coalesce(m.vanity, '') || ' (' || coalesce(m.building, '') || ' ' ||
  coalesce(m.floor, '') || '/' || coalesce(m.area, '') || ')' AS series
FROM facts f LEFT JOIN (SELECT * FROM meta {_PARTIAL_META}) m ON f."ID" = m.id""")
def series_label(spark, d):
    meta = _meta(spark, d).filter(F.col("building").isin("AMERICA", "ASIA"))
    e = enrich.enrich(dt.facts(spark, d), meta)
    from sensorframe.functions.expressions import series_label as label
    return e.select("ID", "type", label().alias("series")).distinct()


@query("kpis", f"""{BASE}, {_resampled_cte('day', 'mean')}
SELECT count(*) AS data_points, count(DISTINCT "ID") AS sensors,
       count(DISTINCT "type") + coalesce(max(CASE WHEN "type" IS NULL THEN 1 ELSE 0 END), 0) AS channels,
       min("timestamp") AS first_ts, max("timestamp") AS last_ts FROM res""")
def kpis_q(spark, d):
    return kpis.resampled_kpis(dt.facts(spark, d), _meta(spark, d), "day")


@query("kpi_text", f"""{BASE}, {_resampled_cte('day', 'mean')},
  k AS (SELECT count(*) AS n, count(DISTINCT "ID") AS s,
               count(DISTINCT "type") + coalesce(max(CASE WHEN "type" IS NULL THEN 1 ELSE 0 END), 0) AS c,
               min("timestamp") AS a, max("timestamp") AS z FROM res)
SELECT replace(format('{{:,}}', n), ',', '.') AS data_points_text, CAST(s AS VARCHAR) AS sensors_text,
       CAST(c AS VARCHAR) AS channels_text, strftime(a, '%Y-%m-%d') || ' → ' || strftime(z, '%Y-%m-%d') AS date_range_text
FROM k""")
def kpi_text(spark, d):
    return kpis.kpi_text(kpis.resampled_kpis(dt.facts(spark, d), _meta(spark, d), "day"))


@query("binary_series", f"""{BASE},
  s AS (SELECT "ID", "type", value FROM facts
        UNION ALL SELECT doc_id, 'quality', CAST(quality AS DOUBLE) FROM labels
        UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE) FROM labels)
SELECT "ID", "type", coalesce(bool_and(CASE WHEN isfinite(value) THEN round_even(value, 0) IN (0, 1) END), false)
       AS is_binary FROM s GROUP BY ALL""")
def binary_series(spark, d):
    s = dt.facts(spark, d).select("ID", "type", "value").unionByName(dt.label_series(spark, d))
    return kpis.series_binary(s)


def _panel_sql(keys: str, title: str, extra_where: str = "", vanity_col: str = "") -> str:
    return f"""{BASE}, {_resampled_cte('day', 'mean')},
  sel AS (SELECT * FROM res {extra_where}),
  grp AS (SELECT {vanity_col} "ID", CAST((row_number() OVER ({'PARTITION BY vanity ' if vanity_col else ''}ORDER BY "ID") - 1) // 12 + 1 AS BIGINT) AS group_no,
                 CAST(ceil(count(*) OVER ({'PARTITION BY vanity' if vanity_col else ''}) / 12.0) AS BIGINT) AS group_count
          FROM (SELECT DISTINCT {vanity_col} "ID" FROM sel)),
  pts AS (SELECT s.*, grp.group_no, grp.group_count,
                 coalesce(s."type", '') || ' | ' || coalesce(s.vanity, '') || ' (' || coalesce(s.building, '') || ' ' ||
                 coalesce(s.floor, '') || '/' || coalesce(s.area, '') || ')' AS series
          FROM sel s JOIN grp ON s."ID" = grp."ID" {'AND s.vanity = grp.vanity' if vanity_col else ''}),
  fl AS (SELECT {keys}, coalesce(bool_and(CASE WHEN isfinite(value) THEN round_even(value, 0) IN (0, 1) END), false)
                AS is_binary FROM pts GROUP BY ALL)
SELECT {'p.vanity, ' if vanity_col else ''}p.group_no, p.group_count, {title} AS panel_title, p."type", p."timestamp",
       round(p.value, {R}) AS value, p."ID", p.series, fl.is_binary,
       CASE WHEN fl.is_binary THEN 'hv' ELSE 'linear' END AS line_shape,
       CASE WHEN fl.is_binary THEN CAST(-0.05 AS DOUBLE) END AS y_min,
       CASE WHEN fl.is_binary THEN CAST(1.05 AS DOUBLE) END AS y_max
FROM pts p JOIN fl USING ({keys})"""


Q["panels_by_channel"] = lambda spark, d: _rv(panels.resampled_panels(
    dt.facts(spark, d), _meta(spark, d), "day", "mean", 12))
SQL["panels_by_channel"] = _panel_sql(
    'group_no, "type"', "'Time series — ' || p.\"type\" || ' (group ' || p.group_no || '/' || p.group_count || ')'")
Q["panels_all_channels"] = lambda spark, d: _rv(panels.resampled_panels(
    dt.facts(spark, d), _meta(spark, d), "day", "mean", 12, by_channel=False))
SQL["panels_all_channels"] = _panel_sql(
    "group_no", "'Time series (group ' || p.group_no || '/' || p.group_count || ')'")


def panels_by_vanity(spark, d):
    meta = _meta(spark, d)
    chosen = facets.facet_filter(meta, facets.Selection(building=["ASIA"], area=["AUTOMOBILE"])).select("vanity")
    return _rv(panels.resampled_panels(dt.facts(spark, d), meta, "day", "mean", 12, vanities=chosen))


Q["panels_by_vanity"] = panels_by_vanity
SQL["panels_by_vanity"] = _panel_sql(
    'vanity, group_no, "type"',
    "'Time series — ' || p.\"type\" || ' (group ' || p.group_no || '/' || p.group_count || ')'",
    "WHERE vanity IN (SELECT vanity FROM meta WHERE building = 'ASIA' AND area = 'AUTOMOBILE')", "vanity,")


@query("dedup_keep_first", """
SELECT l_shipdate AS "timestamp", min(l_quantity) AS value, l_suppkey AS "ID", l_returnflag AS "type"
FROM lineitem GROUP BY l_shipdate, l_suppkey, l_returnflag""")
def dedup_keep_first(spark, d):
    return dedup.dedup_keep_first(dt.repeated_key_facts(spark, d))


@query("high_water_mark", f"""{BASE}
SELECT CASE WHEN "type" IN ('click', 'view') THEN 'nodes_history' ELSE 'nodes_history_env' END AS table_name,
       max("timestamp") AS max_timestamp FROM facts GROUP BY 1""")
def high_water_mark(spark, d):
    return kpis.high_water_mark({"nodes_history": dt.history(spark, d), "nodes_history_env": dt.env(spark, d)})


@query("batch_load_stats", f"""{BASE},
  ids AS (SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 50 + 1 AS BIGINT) AS batch_no FROM (SELECT DISTINCT id FROM meta)),
  nb AS (SELECT batch_no, count(*) AS n_ids FROM ids GROUP BY 1),
  rb AS (SELECT i.batch_no, count(*) AS rows FROM facts f JOIN ids i ON f."ID" = i.id
         WHERE f."timestamp" >= TIMESTAMP '2024-01-01' AND f."timestamp" < TIMESTAMP '2024-01-31' GROUP BY 1)
SELECT nb.batch_no, nb.n_ids, coalesce(rb.rows, 0) AS rows,
       CAST(sum(coalesce(rb.rows, 0)) OVER (ORDER BY nb.batch_no) AS BIGINT) AS cum_rows,
       CAST(ceil((SELECT count(*) FROM ids) / 50.0) AS BIGINT) AS total_batches
FROM nb LEFT JOIN rb USING (batch_no)""")
def batch_load_stats(spark, d):
    ids = _meta(spark, d).select(F.col("id").alias("ID"))
    loaded = read_timeseries(spark, dt.history(spark, d), dt.env(spark, d), ids, ALL_CHANNELS,
                             datetime(2024, 1, 1), datetime(2024, 1, 31), ROUTING)
    return batches.batch_load_stats(loaded, ids, 50)


_SPARK_TYPE = """CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'BLOB' THEN 'binary'
  WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp'
  WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'DOUBLE[]' THEN 'array<double>' ELSE lower(column_type) END"""


@query("describe_table", f"""SELECT table_name, ordinal_position, column_name, data_type,
       split_part(data_type, '<', 1) AS udt_name, is_nullable FROM (
SELECT table_name, ordinal_position, column_name, {_SPARK_TYPE} AS data_type, "null" AS is_nullable FROM (
""" + "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, row_number() OVER () AS ordinal_position, column_name, column_type, \"null\" FROM (DESCRIBE {t})"
    for t in DRIVER_TABLES) + "))")
def describe_table(spark, d):
    return describe(spark, {t: dt.table(spark, d, t) for t in DRIVER_TABLES})


_TYPE_CASE = """CASE lower(data_type) WHEN 'bigint' THEN 'BIGINT' WHEN 'integer' THEN 'INTEGER'
  WHEN 'smallint' THEN 'SMALLINT' WHEN 'varchar' THEN 'TEXT' WHEN 'double' THEN 'DOUBLE PRECISION'
  WHEN 'float' THEN 'REAL' WHEN 'boolean' THEN 'BOOLEAN' WHEN 'timestamp' THEN 'TIMESTAMP WITHOUT TIME ZONE'
  WHEN 'timestamp_ns' THEN 'TIMESTAMP WITHOUT TIME ZONE' WHEN 'timestamp_ms' THEN 'TIMESTAMP WITHOUT TIME ZONE'
  WHEN 'timestamp_s' THEN 'TIMESTAMP WITHOUT TIME ZONE'
  WHEN 'timestamp with time zone' THEN 'TIMESTAMP WITH TIME ZONE' ELSE 'TEXT' END"""
SQL["type_map"] = "SELECT table_name, column_name, " + _TYPE_CASE + " AS target_type FROM (\n" + \
    "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, column_type AS data_type FROM (DESCRIBE {t})"
                        for t in DRIVER_TABLES) + ")"


def type_map(spark, d):
    described = describe(spark, {t: dt.table(spark, d, t) for t in DRIVER_TABLES})
    return with_target_types(described).select("table_name", "column_name", "target_type")


Q["type_map"] = type_map


# --- sinks -------------------------------------------------------------------

@query("csv_roundtrip", f"""{BASE}, {ENRICHED} SELECT * FROM enriched""")
def csv_roundtrip(spark, d):
    e = enrich.enrich(dt.facts(spark, d), _meta(spark, d))
    path = work_dir(spark, "export") + "/export.csv"
    csv_sink.write_export_csv(e, path)
    return csv_sink.read_export_csv(spark, path, e.schema)


@query("csv_null_marker", f"""{BASE}, {ENRICHED.replace('LEFT JOIN meta m', "LEFT JOIN (SELECT * FROM meta WHERE building = 'AMERICA') m")}
SELECT * FROM enriched""")
def csv_null_marker(spark, d):
    e = enrich.enrich(dt.facts(spark, d), _meta(spark, d).filter(F.col("building") == "AMERICA"))
    path = work_dir(spark, "copy") + "/copy.csv"
    csv_sink.write_copy_csv(e, path)
    return csv_sink.read_copy_csv(spark, path, e.schema)


# --- snapshot ----------------------------------------------------------------

@query("snapshot_append", f"""{BASE}
SELECT *, CASE WHEN "type" IN ('click', 'view') THEN 'history' ELSE 'env' END AS source_table FROM facts""")
def snapshot_append(spark, d):
    root = work_dir(spark, "snapshot")
    f = dt.facts(spark, d)
    snapshot.append_facts(spark, root, f.filter(F.col("timestamp") < F.lit("2024-01-20").cast("timestamp_ntz")), ROUTING)
    snapshot.append_facts(spark, root, f.filter(F.col("timestamp") >= F.lit("2024-01-10").cast("timestamp_ntz")), ROUTING)
    return spark.read.parquet(root + "/facts").select(*model.FACT_COLUMNS, "source_table")


@query("cache_scan", f"""{BASE}
SELECT * FROM facts WHERE "type" IN ('view', 'purchase')
  AND "timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" < TIMESTAMP '2024-01-25'""")
def cache_scan(spark, d):
    root = work_dir(spark, "cache")
    f = dt.facts(spark, d)
    ts = F.col("timestamp")
    # Stand-in snapshot written the reference's way: two plain appends whose
    # days overlap, so the reader must drop duplicates.
    snapshot.append_facts(spark, root, f.filter(ts < F.lit("2024-01-20").cast("timestamp_ntz")), ROUTING,
                          skip_existing=False)
    snapshot.append_facts(spark, root, f.filter(ts >= F.lit("2024-01-10").cast("timestamp_ntz")), ROUTING,
                          skip_existing=False)
    ids = _meta(spark, d).select(F.col("id").alias("ID"))
    return snapshot.read_snapshot(spark, root, ids, ["view", "purchase"], datetime(2024, 1, 5),
                                  datetime(2024, 1, 25), ROUTING)


@query("full_refresh", f"""{BASE}
SELECT id, "nodeTypeName", building, floor, area, vanity FROM meta""")
def full_refresh(spark, d):
    root = work_dir(spark, "meta")
    meta = _meta(spark, d)
    snapshot.write_meta(spark, root, meta.filter(F.col("building") == "AFRICA"))
    snapshot.write_meta(spark, root, meta)
    return snapshot.read_meta(spark, root)


@query("snapshot_stats", f"""{BASE}
SELECT 'nodes_hierarchy_cache' AS table_name, count(*) AS n_rows FROM meta
UNION ALL SELECT 'nodes_history_cache', count(*) FROM facts WHERE "type" IN ('click', 'view')
UNION ALL SELECT 'nodes_history_env_cache', count(*) FROM facts WHERE "type" NOT IN ('click', 'view')""")
def snapshot_stats(spark, d):
    root = work_dir(spark, "stats")
    snapshot.write_meta(spark, root, _meta(spark, d))
    snapshot.append_facts(spark, root, dt.facts(spark, d), ROUTING)
    return snapshot.stats(spark, root)


@query("snapshot_clear", """
SELECT table_name, CAST(n AS BIGINT) AS n_rows FROM (VALUES ('nodes_hierarchy_cache', 0),
  ('nodes_history_cache', 0), ('nodes_history_env_cache', 0)) v(table_name, n)""")
def snapshot_clear(spark, d):
    """Fill a snapshot from the tables, clear it, report per-table counts."""
    root = work_dir(spark, "clear")
    snapshot.write_meta(spark, root, _meta(spark, d))
    snapshot.append_facts(spark, root, dt.facts(spark, d), ROUTING)
    snapshot.clear(spark, root)
    return snapshot.stats(spark, root)


@query("snapshot_refill", f"""{BASE},
  t(table_name, rows) AS (SELECT 'nodes_hierarchy_cache', count(*) FROM meta
    UNION ALL SELECT 'nodes_history_cache', count(*) FILTER ("type" IN ('click', 'view')) FROM facts
    UNION ALL SELECT 'nodes_history_env_cache', count(*) FILTER ("type" NOT IN ('click', 'view')) FROM facts)
SELECT phase, table_name, CASE WHEN phase = 'filled' OR (phase = 'refilled' AND table_name = 'nodes_history_env_cache')
                               THEN rows ELSE 0 END AS n_rows
FROM t CROSS JOIN (VALUES ('filled'), ('cleared'), ('refilled')) p(phase)""")
def snapshot_refill(spark, d):
    """Counts of a snapshot that is filled, cleared and filled again with one of its tables."""
    root = work_dir(spark, "refill")
    phases = []

    def note(phase):  # three rows, read before the next step changes the files
        phases.append(snapshot.stats(spark, root).select(F.lit(phase).alias("phase"), "table_name", "n_rows").checkpoint())

    snapshot.write_meta(spark, root, _meta(spark, d))
    snapshot.append_facts(spark, root, dt.facts(spark, d), ROUTING)
    note("filled")
    snapshot.clear(spark, root)
    note("cleared")
    snapshot.append_facts(spark, root, dt.env(spark, d), ROUTING)
    note("refilled")
    return phases[0].unionByName(phases[1]).unionByName(phases[2])


@query("meta_snapshot_scan", f"""{BASE}
SELECT id, "nodeTypeName", building, floor, area, vanity FROM meta WHERE building <> 'AFRICA'""")
def meta_snapshot_scan(spark, d):
    """Metadata read snapshot-first: a missing snapshot falls through to the
    source, a stored one is served."""
    from sensorframe.sources.metadata import load_metadata
    root = work_dir(spark, "metasnap")
    raw = dt.metadata_raw(spark, d)
    first = load_metadata(spark, raw, root + "/meta/v=0")          # no snapshot yet: source
    v = snapshot.write_meta(spark, root, first.filter(F.col("building") != "AFRICA"))
    return load_metadata(spark, raw, f"{root}/meta/v={v}")          # served from the snapshot


_EUROPE_IDS = "(SELECT id FROM meta WHERE building = 'EUROPE')"


@query("preload_range", f"""{BASE}
SELECT * FROM facts WHERE "ID" IN {_EUROPE_IDS}
  AND "timestamp" >= TIMESTAMP '2024-01-03' AND "timestamp" < TIMESTAMP '2024-01-10'""")
def preload_range(spark, d):
    root = work_dir(spark, "preload")
    h, e, meta = dt.history(spark, d), dt.env(spark, d), _meta(spark, d)
    ids = _ids_of(meta, facets.Selection(building=["EUROPE"]))
    # A first, narrower preload; the second only fetches what is not covered.
    s1, e1 = filters.whole_days(date(2024, 1, 5), date(2024, 1, 7))
    snapshot.preload(spark, root, h, e, ids, ALL_CHANNELS, s1, e1, ROUTING)
    s2, e2 = filters.whole_days(date(2024, 1, 3), date(2024, 1, 9))
    return snapshot.preload(spark, root, h, e, ids, ALL_CHANNELS, s2, e2, ROUTING)


@query("read_through", f"""{BASE}
SELECT * FROM facts WHERE "ID" IN (SELECT id FROM meta WHERE building IN ('EUROPE', 'ASIA'))
  AND "timestamp" >= TIMESTAMP '2024-01-08' AND "timestamp" < TIMESTAMP '2024-01-16'""")
def read_through(spark, d):
    root = work_dir(spark, "readthrough")
    h, e, meta = dt.history(spark, d), dt.env(spark, d), _meta(spark, d)
    s1, e1 = filters.whole_days(date(2024, 1, 5), date(2024, 1, 10))
    snapshot.preload(spark, root, h, e, _ids_of(meta, facets.Selection(building=["EUROPE"])), ALL_CHANNELS,
                     s1, e1, ROUTING)
    ids = _ids_of(meta, facets.Selection(building=["EUROPE", "ASIA"]))
    s2, e2 = filters.whole_days(date(2024, 1, 8), date(2024, 1, 15))
    return snapshot.read_through(spark, root, h, e, ids, ALL_CHANNELS, s2, e2, ROUTING)


@query("read_through_growing", f"""{BASE}
SELECT * FROM facts WHERE "ID" IN {_EUROPE_IDS}
  AND "timestamp" >= TIMESTAMP '2024-01-08' AND "timestamp" < TIMESTAMP '2024-01-13'""")
def read_through_growing(spark, d):
    """The source gains readings inside a day that an earlier preload asked for."""
    root = work_dir(spark, "growing")
    h, e, meta = dt.history(spark, d), dt.env(spark, d), _meta(spark, d)
    ids = _ids_of(meta, facets.Selection(building=["EUROPE"]))
    early = F.col("timestamp") < F.expr("TIMESTAMP_NTZ '2024-01-10 12:00:00'")
    s1, e1 = filters.whole_days(date(2024, 1, 8), date(2024, 1, 10))
    snapshot.preload(spark, root, h.filter(early), e.filter(early), ids, ALL_CHANNELS, s1, e1, ROUTING)
    s2, e2 = filters.whole_days(date(2024, 1, 8), date(2024, 1, 12))
    return snapshot.read_through(spark, root, h, e, ids, ALL_CHANNELS, s2, e2, ROUTING)


@query("read_through_quiet", f"""{BASE}
SELECT * FROM facts WHERE "ID" IN {_EUROPE_IDS}
  AND "timestamp" >= TIMESTAMP '2024-01-03' AND "timestamp" < TIMESTAMP '2024-01-09'""")
def read_through_quiet(spark, d):
    """Silent series of a settled range are covered too: the second call fetches nothing,
    so it is given sources that would spoil the result."""
    root = work_dir(spark, "quiet")
    h, e, meta = dt.history(spark, d), dt.env(spark, d), _meta(spark, d)
    ids = _ids_of(meta, facets.Selection(building=["EUROPE"]))
    s1, e1 = filters.whole_days(date(2024, 1, 3), date(2024, 1, 8))
    mark = datetime(2024, 1, 31)
    snapshot.preload(spark, root, h, e, ids, ALL_CHANNELS, s1, e1, ROUTING, high_water=mark)
    wrong = [t.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 SECOND")) for t in (h, e)]
    return snapshot.read_through(spark, root, *wrong, ids, ALL_CHANNELS, s1, e1, ROUTING, high_water=mark)


@query("chunked_scan", f"""{BASE}
SELECT * FROM facts""")
def chunked_scan(spark, d):
    """The fact table copied in chunks: a first call that ends early, then one that goes on where it stopped."""
    path = work_dir(spark, "chunked") + "/events"
    f = dt.facts(spark, d)
    chunked.copy_chunked(spark, path, f, "timestamp", rows=2_000, chunks_per_job=4, max_jobs=1)
    chunked.copy_chunked(spark, path, f, "timestamp", rows=2_000)
    return chunked.read_chunked(spark, path, f.schema)


# --- replication -------------------------------------------------------------

SYNC_TABLES = dict(zip(model.REPLICA_INCREMENTAL_TABLES, [dt.history, dt.env]))
FULL_TABLE = model.REPLICA_FULL_TABLES[0]
_OLD = "2024-01-20"
_CHANGED = "2024-01-15"


def _old_source(df: DataFrame) -> DataFrame:
    """Stand-in earlier state of a source: rows before 01-20, values of the
    last five days different (later corrected at the source)."""
    ts = F.col("timestamp")
    return (df.filter(ts < F.lit(_OLD).cast("timestamp_ntz"))
            .withColumn("value", F.when(ts >= F.lit(_CHANGED).cast("timestamp_ntz"), F.col("value") + 1)
                        .otherwise(F.col("value"))))


def _sync_query(overlap):
    def run(spark, d):
        root = work_dir(spark, "replica")
        for name, fn in SYNC_TABLES.items():
            sync.sync_incremental(spark, root, name, _old_source(fn(spark, d)), overlap)
        for name, fn in SYNC_TABLES.items():
            sync.sync_incremental(spark, root, name, fn(spark, d), overlap)
        parts = [sync.read_incremental(spark, root, n).select(F.lit(n).alias("table_name"), *model.FACT_COLUMNS)
                 for n in SYNC_TABLES]
        return parts[0].unionByName(parts[1])
    return run


def _sync_sql(overlap_hours):
    return f"""{BASE},
  src AS (SELECT CASE WHEN "type" IN ('click', 'view') THEN 'nodes_history' ELSE 'nodes_history_env' END AS table_name, *
          FROM facts),
  old AS (SELECT table_name, "timestamp", CASE WHEN "timestamp" >= TIMESTAMP '{_CHANGED}' THEN value + 1 ELSE value END AS value,
                 "ID", "type" FROM src WHERE "timestamp" < TIMESTAMP '{_OLD}'),
  cut AS (SELECT table_name, max("timestamp") - INTERVAL {overlap_hours} HOUR AS cutoff FROM old GROUP BY 1)
SELECT o.table_name, o."timestamp", o.value, o."ID", o."type" FROM old o JOIN cut USING (table_name) WHERE o."timestamp" < cut.cutoff
UNION ALL
SELECT s.table_name, s."timestamp", s.value, s."ID", s."type" FROM src s JOIN cut USING (table_name) WHERE s."timestamp" >= cut.cutoff"""


Q["sync_incremental"] = _sync_query(0)
SQL["sync_incremental"] = _sync_sql(0)
Q["sync_overlap_heals"] = _sync_query(336)
SQL["sync_overlap_heals"] = _sync_sql(336)

SYNC_CYCLES = 7
CYCLE_DAYS = 5


def _run_cycles(spark, d) -> str:
    """Seven replication cycles of a growing source (every five days)."""
    root = work_dir(spark, "cycles")
    meta = _meta(spark, d)
    for k in range(1, SYNC_CYCLES + 1):
        lim = F.lit((datetime(2024, 1, 1) + timedelta(days=CYCLE_DAYS * k)).isoformat(sep=" ")).cast("timestamp_ntz")
        sync.sync_all(spark, root, {FULL_TABLE: meta},
                      {n: fn(spark, d).filter(F.col("timestamp") < lim) for n, fn in SYNC_TABLES.items()}, 0)
    return root


_CYCLES_SQL = f"""{BASE},
  cyc AS (SELECT k, TIMESTAMP '2024-01-01' + to_days(CAST({CYCLE_DAYS} * k AS INTEGER)) AS lim FROM range(1, {SYNC_CYCLES + 1}) t(k)),
  tbl AS (SELECT 'nodes_history' AS table_name, 1 AS pos UNION ALL SELECT 'nodes_history_env', 2),
  src AS (SELECT CASE WHEN "type" IN ('click', 'view') THEN 'nodes_history' ELSE 'nodes_history_env' END AS table_name,
                 "timestamp" FROM facts),
  cut AS (SELECT c.k, t.table_name, t.pos, c.lim,
                 coalesce((SELECT max(s."timestamp") FROM src s JOIN cyc p ON s."timestamp" < p.lim
                           WHERE s.table_name = t.table_name AND p.k = c.k - 1), TIMESTAMP '1900-01-01') AS cutoff
          FROM cyc c CROSS JOIN tbl t),
  inc AS (SELECT CAST(3 * (k - 1) + 1 + pos AS BIGINT) AS id, table_name, 'incremental' AS mode,
                 (SELECT count(*) FROM src s WHERE s.table_name = cut.table_name AND s."timestamp" >= cut.cutoff
                    AND s."timestamp" < cut.lim) AS rows_loaded, 'success' AS status,
                 'cutoff=' || CASE WHEN epoch_us(cutoff) % 1000000 = 0 THEN strftime(cutoff, '%Y-%m-%dT%H:%M:%S')
                                   ELSE strftime(cutoff, '%Y-%m-%dT%H:%M:%S.%f') END AS details
          FROM cut),
  runs AS (SELECT id, table_name, mode, rows_loaded, status, details FROM inc
           UNION ALL SELECT CAST(3 * (k - 1) + 1 AS BIGINT), 'nodes_hierarchy', 'full', (SELECT count(*) FROM meta),
                            'success', '' FROM cyc)"""


@query("latest_runs", _CYCLES_SQL + "\nSELECT * FROM runs ORDER BY id DESC LIMIT 20")
def latest_runs(spark, d):
    root = _run_cycles(spark, d)
    return sync.latest_runs(spark, root, 20).select("id", "table_name", "mode", "rows_loaded", "status", "details")


@query("sync_state_latest", _CYCLES_SQL + """,
  last AS (SELECT * FROM runs WHERE id IN (SELECT max(id) FROM runs GROUP BY table_name)),
  mx AS (SELECT table_name, max("timestamp") AS m FROM src GROUP BY 1)
SELECT l.table_name, l.mode AS sync_mode, l.status AS run_status, l.rows_loaded AS last_rows_loaded,
       mx.m AS source_max_timestamp, mx.m AS target_max_timestamp, mx.m AS next_cutoff_timestamp, '' AS last_error,
       CASE WHEN mx.m IS NOT NULL THEN CAST(0 AS BIGINT) END AS lag_micros
FROM last l LEFT JOIN mx USING (table_name)""")
def sync_state_latest(spark, d):
    root = _run_cycles(spark, d)
    return sync.sync_state(spark, root).select(
        "table_name", "sync_mode", "run_status", "last_rows_loaded", "source_max_timestamp",
        "target_max_timestamp", "next_cutoff_timestamp", "last_error", "lag_micros")


@query("state_listing", f"""{BASE},
  t(table_name, sync_mode, last_rows_loaded, m) AS (
    SELECT 'nodes_hierarchy', 'full', count(*), CAST(NULL AS TIMESTAMP) FROM meta
    UNION ALL SELECT 'nodes_history', 'incremental', count(*), max("timestamp") FROM facts WHERE "type" IN ('click', 'view')
    UNION ALL SELECT 'nodes_history_env', 'incremental', count(*), max("timestamp") FROM facts WHERE "type" NOT IN ('click', 'view'))
SELECT row_number() OVER (ORDER BY table_name) AS pos, table_name, sync_mode, 'success' AS run_status, last_rows_loaded,
       m AS source_max_timestamp, m AS target_max_timestamp, '' AS last_error FROM t""")
def state_listing(spark, d):
    """One replication cycle and its state as listed; ``pos`` is the place in the list."""
    root = work_dir(spark, "listing")
    sync.sync_all(spark, root, {FULL_TABLE: _meta(spark, d)}, {n: fn(spark, d) for n, fn in SYNC_TABLES.items()}, 0)
    path = work_dir(spark, "listed")
    listed = sync.state_listing(spark, root).select("table_name", "sync_mode", "run_status", "last_rows_loaded",
                                                    "source_max_timestamp", "target_max_timestamp", "last_error")
    ordered.write_ordered(listed, path, ["table_name"])
    return ordered.read_ordered(spark, path, "pos")


# Tables copied whole, tables copied by their time column, and the column that ``events`` gains after a first cycle.
REPLICA_FULL = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings", "labels"]
REPLICA_BY_TIME = {"events": "ts"}
_STORED_CASE = """CASE target_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'SMALLINT' THEN 'smallint'
  WHEN 'DOUBLE PRECISION' THEN 'double' WHEN 'REAL' THEN 'float' WHEN 'BOOLEAN' THEN 'boolean'
  WHEN 'TIMESTAMP WITHOUT TIME ZONE' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE 'string' END"""


def _replica_columns_sql(t: str) -> str:
    rows = t if t != "events" else f"""(SELECT * REPLACE (CASE WHEN ts >= (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '{_OLD}')
                                              OR (SELECT count(*) FROM events WHERE ts < TIMESTAMP '{_OLD}') = 0 THEN value END AS value) FROM events)"""
    return f"""SELECT '{t}' AS table_name, row_number() OVER (ORDER BY d.column_name = 'value' AND '{t}' = 'events', pos) AS ordinal_position,
       d.column_name, column_type AS data_type, coalesce(u.n, 0) AS n_values, (SELECT count(*) FROM {t}) AS n_rows
FROM (SELECT column_name, column_type, row_number() OVER () AS pos FROM (DESCRIBE {t})) d
LEFT JOIN (SELECT name, count(*) AS n FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM {rows}) ON COLUMNS(*) INTO NAME name VALUE v) GROUP BY name) u
  ON u.name = d.column_name"""


@query("replica_types", f"""SELECT table_name, ordinal_position, column_name, target_type, {_STORED_CASE} AS stored_type, n_values, n_rows
FROM (SELECT *, {_TYPE_CASE} AS target_type FROM (
""" + "\nUNION ALL ".join(_replica_columns_sql(t) for t in [*REPLICA_FULL, *REPLICA_BY_TIME]) + "))")
def replica_types(spark, d):
    """Both sync modes write through the type map: the replicas' columns, types and filled values."""
    root = work_dir(spark, "types")
    for t in REPLICA_FULL:
        sync.sync_full(spark, root, t, dt.table(spark, d, t))
    early = dt.table(spark, d, "events").filter(F.col("ts") < F.lit(_OLD).cast("timestamp_ntz")).drop("value")
    sync.sync_incremental(spark, root, "events", early, 0, ts="ts")
    for t, ts in REPLICA_BY_TIME.items():
        sync.sync_incremental(spark, root, t, dt.table(spark, d, t), 0, ts=ts)
    return sync.replica_types(spark, root, [*REPLICA_FULL, *REPLICA_BY_TIME]).drop("since_run")


# --- streaming ---------------------------------------------------------------

STREAM_OVERLAP_H = 336


@query("stream_ingest", f"""{BASE},
  th AS (SELECT max("timestamp") - INTERVAL {STREAM_OVERLAP_H} HOUR AS t FROM facts WHERE "timestamp" < TIMESTAMP '2024-01-20')
SELECT "timestamp",
       CASE WHEN ("timestamp" >= TIMESTAMP '2024-01-12' OR "timestamp" < TIMESTAMP '2024-01-03')
                 AND "timestamp" >= (SELECT t FROM th) THEN value + 1 ELSE value END AS value,
       "ID", "type" FROM facts""")
def stream_ingest(spark, d):
    base = work_dir(spark, "stream")
    landing, table, ckpt = f"{base}/landing", f"{base}/table", f"{base}/_checkpoint"
    f = dt.facts(spark, d)
    ts = F.col("timestamp")
    # Landed files: first the data before 01-20; later corrections (+1) of
    # 01-12 onwards together with new rows, and too-late corrections before 01-03.
    first = f.filter(ts < F.lit("2024-01-20").cast("timestamp_ntz"))
    second = (f.filter((ts >= F.lit("2024-01-12").cast("timestamp_ntz")) | (ts < F.lit("2024-01-03").cast("timestamp_ntz")))
              .withColumn("value", F.col("value") + 1))
    for i, part in enumerate([first, second]):
        part.write.mode("overwrite").parquet(f"{landing}/batch_{i}")
        q = ingest.start_ingest(spark, landing + "/*", table, ckpt, STREAM_OVERLAP_H)
        q.awaitTermination()
    return ingest.read_table(spark, table).select(*model.FACT_COLUMNS)


# --- checks ------------------------------------------------------------------

QC_NOW = datetime(2024, 1, 31)


@query("quality_checks", f"""{BASE}
SELECT * FROM (VALUES ('Source reachable', true, 'OK'), ('history columns', true, 'OK'),
                      ('env columns', true, 'OK'), ('metadata columns', true, 'OK'),
                      ('Metadata has ''vanity''', true, 'OK')) v("Check", "OK", "Details")
UNION ALL
SELECT 'Timeseries probe', true, CAST(count(*) AS VARCHAR) || ' rows' FROM facts
WHERE "ID" = (SELECT min(id) FROM meta) AND "timestamp" >= TIMESTAMP '2024-01-24' AND "timestamp" < TIMESTAMP '2024-01-31'""")
def quality_checks(spark, d):
    return quality.quality_checks(spark, dt.history(spark, d), dt.env(spark, d), dt.metadata_raw(spark, d),
                                  QC_NOW, ROUTING)
