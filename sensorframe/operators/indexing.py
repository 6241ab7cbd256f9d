"""Consecutive 1-based row numbers in a global order, without a
single-partition window.

The frame is range-partitioned and sorted by ``orderBy`` and checkpointed to
the shared checkpoint folder, which fixes partition boundaries. Rows are
counted per partition (one small row per partition), running offsets are
computed over those counts, and each row's number is its partition offset
plus its position inside the partition. The offset table has one row per
partition, so broadcasting it is bounded by the partition count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.session import ensure_checkpoint_dir


def global_index(df: DataFrame, order_cols, name: str = "row_no", total: str | None = None) -> DataFrame:
    """``df`` with its row number in column ``name`` and, if named, the number of all rows in ``total``."""
    ensure_checkpoint_dir(df.sparkSession)
    cols = df.columns
    ordered = df.orderBy(*order_cols).checkpoint(eager=True)
    tagged = (ordered.withColumn("_p", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    counts = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(every).alias("_all"))
    local = F.col("_mid") - F.shiftleft(F.col("_p").cast("long"), 33)
    out = tagged.join(F.broadcast(offsets), "_p")
    return out.select(*cols, (F.col("_o") + local + 1).cast("long").alias(name),
                      *([F.col("_all").cast("long").alias(total)] if total else []))


def running_sum(df: DataFrame, number: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """``df`` with the sum of ``value`` over its rows up to each, in order of the dense row number
    ``number`` (from 1). Rows are summed within blocks of ``block`` numbers; only the blocks'
    sums, one row for each ``block`` rows, are added up in one task."""
    cols = df.columns
    d = df.withColumn("_blk", F.floor((F.col(number) - 1) / block))
    before = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("_blk").agg(F.sum(value).alias("_s"))
    offsets = sums.select("_blk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    upto = Window.partitionBy("_blk").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(offsets, "_blk").select(*cols, (F.col("_o") + F.sum(value).over(upto)).cast("long").alias(name))


def table_page(df: DataFrame, page: int, page_size: int, order_cols=("timestamp", "ID", "type", "value")) -> DataFrame:
    """One page (0-based) of the time-ordered table.

    ``ORDER BY ... OFFSET ... LIMIT`` is planned as a per-partition top-k of
    (offset + limit) rows merged in one task, so a page costs one scan and
    never sorts or numbers the whole result. For pages far in, or many of them,
    write the table once with ``sinks.ordered``.
    """
    ordered = df.orderBy(*order_cols)
    return ordered.offset(page * page_size).limit(page_size) if page else ordered.limit(page_size)
