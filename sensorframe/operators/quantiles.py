"""Exact medians that several tasks share (A4).

A group's values are counted by value, so equal values meet before any shuffle
that matters and a group that holds a third of all rows is spread by its
values. A histogram over monotone value buckets, one row per group and
occupied bucket, tells which one or two buckets hold the middle ranks; only
the values of those are put in order. No task holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each factor of e between values, and the smallest magnitude told apart by them.
RESOLUTION = 65536.0
SMALLEST = 1e-9


def value_bucket(value: Column) -> Column:
    """A bucket that never falls as the value grows (NaN last, as Spark orders it)."""
    return F.rint(F.signum(value) * F.log1p(F.abs(value) / SMALLEST) * RESOLUTION)


def median_by(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """``(keys, value)``: the median of the non-NULL values of each group, the mean of
    the two middle ones for an even number, NULL for groups of NULLs only. Keys are not NULL."""
    keys = list(keys)
    v = F.col(value).cast("double")
    counted = (df.groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_b", value_bucket(F.col("_v"))))
    known = F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)
    hist = counted.groupBy(*keys, "_b").agg(F.sum(known).alias("_n"))
    # One row per occupied bucket of the group: the window is over the histogram, not the values.
    order = Window.partitionBy(*keys).orderBy(F.col("_b").asc_nulls_first())
    hist = hist.select(*keys, "_b", "_n", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
                       F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    low, high = F.expr("(_all - 1) div 2"), F.expr("_all div 2")
    start = F.col("_upto") - F.col("_n")
    holds = lambda rank, a, b: (a <= rank) & (rank < b)
    picked = hist.filter(F.col("_b").isNotNull() & (holds(low, start, F.col("_upto")) | holds(high, start, F.col("_upto")))).select(
        *keys, "_b", start.alias("_start"), low.alias("_low"), high.alias("_high"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = counted.join(picked, [*keys, "_b"]).withColumn("_end", F.col("_start") + F.sum("_n").over(inside))
    begin = F.col("_end") - F.col("_n")
    middle = near.groupBy(*keys).agg(
        F.max(F.when(holds(F.col("_low"), begin, F.col("_end")), F.col("_v"))).alias("_a"),
        F.max(F.when(holds(F.col("_high"), begin, F.col("_end")), F.col("_v"))).alias("_z"))
    none = hist.filter(F.col("_all") == 0).select(*keys, F.lit(None).cast("double").alias(value))
    return middle.select(*keys, (F.col("_a") * 0.5 + F.col("_z") * 0.5).alias(value)).unionByName(none)
