"""Fact scans.

A fact row is ``(timestamp, value, ID, type)``. History and environment
tables hold different channels; a scan reads only the tables whose channels
are asked for, and each branch carries its id, channel and half-open range
predicates so they reach the parquet reader.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe import model
from sensorframe.functions.expressions import nan_to_null, ts_lit
from sensorframe.operators.joins import bounded_broadcast


def empty_facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], model.FACT_SCHEMA)


def coerce_facts(df: DataFrame) -> DataFrame:
    """Four typed columns; bad timestamps become NULL and are dropped, NaN
    values become NULL."""
    ts_type = dict(df.dtypes).get("timestamp")
    ts = F.col("timestamp")
    if ts_type != "timestamp_ntz":
        ts = F.expr("try_cast(`timestamp` AS timestamp_ntz)") if ts_type == "string" \
            else ts.cast("timestamp_ntz")
    out = df.select(ts.alias("timestamp"), nan_to_null(F.col("value").cast("double")).alias("value"),
                    F.col("ID").cast("bigint").alias("ID"), F.col("type").cast("string").alias("type"))
    return out.filter(F.col("timestamp").isNotNull())


def _ids_filter(df: DataFrame, ids) -> DataFrame:
    if isinstance(ids, DataFrame):
        return df.join(ids, "ID", "left_semi")
    return df.filter(F.col("ID").isin(list(ids)))


def _id_keys(ids):
    """Id key table, broadcast-hinted once (behind a row count check)."""
    if not isinstance(ids, DataFrame):
        return ids
    key = "ID" if "ID" in ids.columns else ids.columns[0]
    return bounded_broadcast(ids.select(F.col(f"`{key}`").cast("bigint").alias("ID")))


def _range_filter(df: DataFrame, start, end) -> DataFrame:
    if start is not None:
        df = df.filter(F.col("timestamp") >= ts_lit(start))
    if end is not None:
        df = df.filter(F.col("timestamp") < ts_lit(end))
    return df


def scan_table(table: DataFrame, ids, channels, start: datetime | None, end: datetime | None) -> DataFrame:
    """One fact table: channel, range and id predicates, then typing."""
    ids = _id_keys(ids) if isinstance(ids, DataFrame) and "ID" not in ids.columns else ids
    df = table.select(*model.FACT_COLUMNS)
    df = df.filter(F.col("type").isin(list(channels)))
    df = _range_filter(df, start, end)
    if ids is not None:
        df = _ids_filter(df, ids)
    return coerce_facts(df)


def read_timeseries(spark: SparkSession, history: DataFrame | None, env: DataFrame | None,
                    ids, channels, start: datetime | None, end: datetime | None,
                    routing: model.ChannelRouting = model.DEFAULT_ROUTING) -> DataFrame:
    """Facts of ``ids`` x ``channels`` in ``[start, end)``.

    ``ids`` is a list (IN-list) or a DataFrame of ids (semi join, broadcast
    only behind a size check). Empty ids or channels -> empty result with
    the four-column schema. Unknown channels read nothing.
    """
    if ids is None or (not isinstance(ids, DataFrame) and len(list(ids)) == 0) or not channels:
        return empty_facts(spark)
    ids = _id_keys(ids)
    hist_ch = [c for c in channels if c in routing.history]
    env_ch = [c for c in channels if c in routing.env]
    parts = []
    if hist_ch and history is not None:
        parts.append(scan_table(history, ids, hist_ch, start, end))
    if env_ch and env is not None:
        parts.append(scan_table(env, ids, env_ch, start, end))
    if not parts:
        return empty_facts(spark)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def union_facts(*frames: DataFrame) -> DataFrame:
    """Bag union of fact tables."""
    out = frames[0].select(*model.FACT_COLUMNS)
    for f in frames[1:]:
        out = out.unionByName(f.select(*model.FACT_COLUMNS))
    return out
