"""KPIs of a result frame and per-series flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.bins import bin_label, bin_start
from sensorframe.functions.expressions import binary_flag, date_range_text, thousands_dot
from sensorframe.operators.joins import bounded_broadcast
from sensorframe.operators.resample import complete_meta
from sensorframe.operators.smooth import bin_number


def kpis(df: DataFrame) -> DataFrame:
    """One row: data points, distinct sensors, distinct channels, first and
    last timestamp. One aggregation pass; counts gap rows of a resampled
    frame like the reference does."""
    return df.agg(F.count(F.lit(1)).alias("data_points"),
                  F.countDistinct("ID").alias("sensors"),
                  # a missing channel counts as one more value, as in the reference
                  (F.countDistinct("type") + F.coalesce(F.max(F.col("type").isNull().cast("long")), F.lit(0)))
                  .alias("channels"),
                  F.min("timestamp").alias("first_ts"),
                  F.max("timestamp").alias("last_ts"))


def resampled_kpis(facts: DataFrame, meta: DataFrame, frequency: str) -> DataFrame:
    """``kpis`` of the gap-filled resampled frame, without making it: a series has
    one point for every bin from its first to its last and every metadata row, so
    two timestamps per series, from one partial aggregate, are enough."""
    f = facts.filter(F.col("timestamp").isNotNull() & F.col("ID").isNotNull() & F.col("type").isNotNull())
    ends = f.groupBy("ID", "type").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("z"))
    kinds = complete_meta(meta).groupBy("ID").agg(F.count(F.lit(1)).alias("kinds"))  # one point for each kind of metadata row
    n = bin_number("z", frequency) - bin_number("a", frequency) + 1
    rows = ends.join(bounded_broadcast(kinds), "ID").withColumn("n", n * F.col("kinds"))
    out = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("data_points"), F.countDistinct("ID").alias("sensors"),
                   F.countDistinct("type").alias("channels"), F.min("a").alias("a"), F.max("z").alias("z"))
    for c, name in (("a", "first_ts"), ("z", "last_ts")):  # without readings a stand-in time, as bins drop NULL ones
        known = F.coalesce(F.col(c), F.lit("1970-01-01").cast("timestamp_ntz"))
        out = out.withColumn(name, bin_label(bin_start(known, frequency), frequency))
        out = out.withColumn(name, F.when(F.col(c).isNotNull(), F.col(name)))
    return out.drop("a", "z")


def kpi_text(k: DataFrame) -> DataFrame:
    """KPI strings as shown: ``1.234`` points, ``YYYY-MM-DD → YYYY-MM-DD``."""
    return k.select(thousands_dot("data_points").alias("data_points_text"),
                    F.col("sensors").cast("string").alias("sensors_text"),
                    F.col("channels").cast("string").alias("channels_text"),
                    date_range_text("first_ts", "last_ts").alias("date_range_text"))


def series_binary(df: DataFrame, keys=("ID", "type"), value: str = "value") -> DataFrame:
    """Per group: every finite value rounds (half-even) to 0 or 1."""
    return df.groupBy(*keys).agg(binary_flag(value).alias("is_binary"))


def high_water_mark(tables: dict, ts: str = "timestamp") -> DataFrame:
    """``(table_name, max_timestamp)`` for each named frame."""
    parts = [df.agg(F.max(ts).alias("max_timestamp")).select(F.lit(name).alias("table_name"), "max_timestamp")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
