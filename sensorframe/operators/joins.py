"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest table broadcast after a row count check, in (estimated) bytes.
BROADCAST_MAX_BYTES = 64 << 20
# Bytes assumed per value when estimating a row; strings are counted
# generously so the row bound errs on the small side.
_WIDTH = {T.StringType: 64, T.BinaryType: 64, T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2,
          T.IntegerType: 4, T.DateType: 4, T.FloatType: 4}


def row_width(schema: T.StructType) -> int:
    width = 8  # row overhead
    for f in schema.fields:
        width += next((w for t, w in _WIDTH.items() if isinstance(f.dataType, t)),
                      64 if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else 8)
    return width


def broadcast_row_limit(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> int:
    return max(1, max_bytes // row_width(df.schema))


# Row bound of a one-column id key table (kept for callers that pass rows).
BROADCAST_MAX_ROWS = BROADCAST_MAX_BYTES // 16


def row_count_at_most(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows (reads at most limit+1)."""
    return df.limit(limit + 1).count() <= limit


def bounded_broadcast(df: DataFrame, max_rows: int | None = None,
                      max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast-hint ``df`` if its size is proven small (row count times the
    schema's row width), else leave it to the planner (sort-merge join, or
    AQE's runtime broadcast)."""
    limit = broadcast_row_limit(df, max_bytes)
    if max_rows is not None:
        limit = min(limit, max_rows)
    return F.broadcast(df) if row_count_at_most(df, limit) else df


def semi_join(facts: DataFrame, keys: DataFrame, on, broadcast_max_rows: int | None =
              BROADCAST_MAX_ROWS) -> DataFrame:
    """``facts`` rows whose key appears in ``keys`` (no fan-out, no dedup needed)."""
    on = [on] if isinstance(on, str) else list(on)
    k = keys.select(*on)
    if broadcast_max_rows:
        k = bounded_broadcast(k, broadcast_max_rows)
    return facts.join(k, on, "left_semi")
