"""Filters and range construction."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe import model
from sensorframe.functions.expressions import ts_lit
from sensorframe.operators.joins import semi_join


def query_range(date_from: date, from_time: time, date_to: date | None = None,
                to_time: time = time(23, 59)) -> tuple[datetime, datetime]:
    """User range -> half-open ``[start, end)``; the end minute is included
    (``to_time`` 23:59 reaches the next midnight). One date -> same day."""
    date_to = date_from if date_to is None else date_to
    start = datetime.combine(date_from, from_time)
    end = datetime.combine(date_to, to_time) + timedelta(minutes=1)
    return start, end


def whole_days(date_from: date, date_to: date | None = None) -> tuple[datetime, datetime]:
    """``[from 00:00, to + 1 day 00:00)`` for preloading whole days."""
    date_to = date_from if date_to is None else date_to
    return (datetime.combine(date_from, time(0, 0)),
            datetime.combine(date_to + timedelta(days=1), time(0, 0)))


def resolve_channels(selected, routing: model.ChannelRouting = model.DEFAULT_ROUTING) -> list[str]:
    """Empty choice means every default channel."""
    return list(selected) if selected else list(routing.default_channels)


def filter_range(df: DataFrame, start, end, ts: str = "timestamp") -> DataFrame:
    """``start <= ts < end`` on the raw column, so the scan can prune."""
    c = F.col(ts)
    if start is not None:
        df = df.filter(c >= ts_lit(start))
    if end is not None:
        df = df.filter(c < ts_lit(end))
    return df


def filter_ids(df: DataFrame, ids, col: str = "ID") -> DataFrame:
    """IN-list for a Python list, semi join for a DataFrame of ids."""
    if isinstance(ids, DataFrame):
        key = ids.columns[0]
        return semi_join(df, ids.select(F.col(f"`{key}`").alias(col)), col)
    return df.filter(F.col(col).isin(list(ids)))


def filter_channels(df: DataFrame, channels, routing: model.ChannelRouting = model.DEFAULT_ROUTING,
                    col: str = "type") -> DataFrame:
    return df.filter(F.col(col).isin(resolve_channels(channels, routing)))


def filter_not_in(df: DataFrame, values, col: str = "type") -> DataFrame:
    """Rows whose ``col`` is not in ``values``; NULL counts as not in."""
    c = F.col(col)
    return df.filter(~c.isin(list(values)) | c.isNull())


def valid_timestamps(df: DataFrame, col: str = "timestamp") -> DataFrame:
    """Coerce ``col`` to timestamp_ntz (bad text -> NULL) and drop NULLs."""
    ts_type = dict(df.dtypes)[col]
    if ts_type == "string":
        parsed = F.expr(f"try_cast(`{col}` AS timestamp_ntz)")
    else:
        parsed = F.col(col).cast("timestamp_ntz")
    return df.withColumn(col, parsed).filter(F.col(col).isNotNull())
