"""Duplicate elimination keeping the first row of each key.

"First" needs an order Spark does not have implicitly, so the tie-break is
stated: the smallest ``order`` columns (then the remaining columns) win,
NULLs last.
That is a ``min`` per key, an aggregate with map-side combine: a key that
holds a third of the rows is reduced inside each task before the shuffle,
where a ``row_number`` window would sort all of them in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_KEYS = ("timestamp", "ID", "type")


def dedup_keep_first(df: DataFrame, keys=DEFAULT_KEYS, order=("value",)) -> DataFrame:
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order = [c for c in order if c in rest]
    ranked = order + [c for c in rest if c not in order]
    if not ranked:
        return df.select(*keys).distinct()
    if len(ranked) == 1:
        c = ranked[0]
        out = df.groupBy(*keys).agg(F.min(c).alias(c))
        return out.select(*df.columns)
    # NULLs of the order columns sort last, as ``min`` on one column does.
    nulls_last = [F.col(c).isNull().alias(f"_null_{i}") for i, c in enumerate(order)]
    packed = df.groupBy(*keys).agg(F.min(F.struct(*nulls_last, *ranked)).alias("_first"))
    return packed.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in ranked]).select(*df.columns)
