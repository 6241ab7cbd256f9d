"""Sensor metadata scan with a tolerant schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe import model
from sensorframe.functions.expressions import str_or_empty


def pick_column(columns, candidates) -> str | None:
    """First candidate present in ``columns``; exact spelling first, then
    case-insensitive (a database folds unquoted names)."""
    cols = list(columns)
    for cand in candidates:
        if cand in cols:
            return cand
    lower = {}
    for c in cols:
        lower.setdefault(c.lower(), c)
    for cand in candidates:
        if cand.lower() in lower:
            return lower[cand.lower()]
    return None


def normalize_metadata(raw: DataFrame, aliases=None) -> DataFrame:
    """``raw`` -> ``(id, nodeTypeName, building, floor, area, vanity)``.

    ``id`` is required. The sensor type comes from the first alias found;
    optional columns that are absent become ``''``; every string is non-null.
    One projection, decided at plan time from ``raw.columns``.
    """
    aliases = model.NODE_TYPE_ALIASES if aliases is None else aliases
    id_col = pick_column(raw.columns, ["id"])
    if id_col is None:
        raise ValueError("metadata needs an 'id' column")
    type_col = pick_column(raw.columns, aliases)
    exprs = [F.col(f"`{id_col}`").cast("bigint").alias("id"),
             (str_or_empty(F.col(f"`{type_col}`")) if type_col else F.lit("")).alias("nodeTypeName")]
    for name in model.OPTIONAL_META_COLUMNS:
        src = pick_column(raw.columns, [name])
        exprs.append((str_or_empty(F.col(f"`{src}`")) if src else F.lit("")).alias(name))
    return raw.select(*exprs)


def empty_metadata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], model.META_SCHEMA)


def load_metadata(spark: SparkSession, source: DataFrame | None = None,
                  snapshot_path: str | None = None, snapshot_only: bool = False) -> DataFrame:
    """Snapshot first; an empty or missing snapshot falls through to the
    source, unless ``snapshot_only``."""
    if snapshot_path is not None:
        from sensorframe.session import path_exists
        if path_exists(spark, snapshot_path):
            snap = normalize_metadata(spark.read.parquet(snapshot_path))
            if not snap.isEmpty():
                return snap
        if snapshot_only:
            return empty_metadata(spark)
    if source is None:
        return empty_metadata(spark)
    return normalize_metadata(source)
