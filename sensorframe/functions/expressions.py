"""Scalar and aggregate expressions (all JVM built-ins, no Python UDF)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorframe import model


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def str_or_empty(c) -> Column:
    """``COALESCE(CAST(c AS STRING), '')``."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def nan_to_null(c) -> Column:
    """One notion of missing: NaN becomes NULL."""
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def is_finite(c) -> Column:
    c = _c(c)
    return (c.isNotNull() & ~F.isnan(c)
            & (c != F.lit(float("inf"))) & (c != F.lit(float("-inf"))))


def binary_flag(value="value") -> Column:
    """Aggregate: every finite value rounds half-even to 0 or 1.

    At least one finite value is required (an all-infinite or all-NULL
    group is not binary).
    """
    v = _c(value)
    per_row = F.when(is_finite(v), F.bround(v, 0).isin(0.0, 1.0))
    return F.coalesce(F.bool_and(per_row), F.lit(False))


def series_label(type_="type", vanity="vanity", building="building", floor="floor",
                 area="area") -> Column:
    """``type | vanity (building floor/area)``; missing parts are empty."""
    return F.format_string(model.SERIES_LABEL_FORMAT, *[str_or_empty(c) for c in
                                                   (type_, vanity, building, floor, area)])


def thousands_dot(n) -> Column:
    """Integer with '.' as thousands separator (``1.234.567``)."""
    return F.translate(F.format_number(_c(n).cast("double"), 0), ",", model.THOUSANDS_SEPARATOR)


def date_range_text(first, last) -> Column:
    return F.concat(F.date_format(_c(first), model.KPI_DATE_FORMAT), F.lit(model.KPI_RANGE_SEPARATOR),
                    F.date_format(_c(last), model.KPI_DATE_FORMAT))


def ceil_div(a, b) -> Column:
    return F.floor((_c(a) + _c(b) - 1) / _c(b)).cast("long")


def per_second(amount, seconds) -> Column:
    """Amount per second; 0 when no time passed."""
    return F.when(_c(seconds) > 0, _c(amount) / _c(seconds)).otherwise(F.lit(0.0))


def channel_map_column(mapping: dict | None = None) -> Column:
    """Sensor type -> channel list as a ``map<string, array<string>>`` literal."""
    mapping = model.SENSOR_CHANNELS if mapping is None else mapping
    pairs = chain.from_iterable(
        (F.lit(k), F.array(*[F.lit(c) for c in v]).cast("array<string>"))
        for k, v in mapping.items())
    return F.create_map(*pairs)


def channels_of(type_col, mapping: dict | None = None) -> Column:
    """Channels of a sensor type; unknown type -> empty array."""
    return F.coalesce(F.try_element_at(channel_map_column(mapping), _c(type_col)),
                      F.array().cast("array<string>"))


def _map_of(d: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def target_type_name(data_type, udt_name=None) -> Column:
    """Source column type -> target type name, default ``TEXT``.

    ``data_type`` may be an information-schema name (``character varying``)
    or a Spark SQL name (``string``, ``decimal(10,2)``); parameters are
    dropped before the lookup.
    """
    base = F.regexp_replace(F.lower(F.trim(_c(data_type))), r"\s*\(.*\)$", "")
    base = F.coalesce(F.try_element_at(_map_of(model.SPARK_TYPE_SYNONYMS), base), base)
    udt = F.lower(F.coalesce(_c(udt_name), F.lit(""))) if udt_name is not None else F.lit("")
    expr = None
    for dtype, udt_key, target in model.TYPE_NAME_MAP:
        cond = base == F.lit(dtype)
        if udt_key is not None:
            cond = cond | (udt == F.lit(udt_key))
        expr = F.when(cond, F.lit(target)) if expr is None else expr.when(cond, F.lit(target))
    return expr.otherwise(F.lit(model.TYPE_NAME_DEFAULT))


def ts_lit(value) -> Column:
    """A ``timestamp_ntz`` literal built from its text, independent of the
    Python and session time zones (``F.lit(datetime)`` is zone-bound)."""
    from datetime import date, datetime
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(value, date):
        return F.lit(value.isoformat()).cast("timestamp_ntz")
    return F.lit(str(value)).cast("timestamp_ntz")


def date_lit(value) -> Column:
    from datetime import datetime
    if isinstance(value, datetime):
        value = value.date()
    return F.lit(value.isoformat()).cast("date")
