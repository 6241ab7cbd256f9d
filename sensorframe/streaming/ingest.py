"""Scheduled ingest of landed fact files with Structured Streaming.

The reference polls its source every 15 minutes and re-copies an overlap
window so late corrections are picked up. Here new files in a landing folder
are the stream; every micro-batch is merged into a day-partitioned table:

* duplicates inside the batch keep the first row (smallest value);
* rows older than ``high-water mark - overlap`` are too late: they go to a
  ``_late`` table and do not touch the published data;
* the other rows replace rows with the same ``(timestamp, ID, type)`` and
  are added otherwise; only the days they fall on are rewritten (dynamic
  partition overwrite).

A micro-batch is not a full source, so nothing missing from it is deleted
(deletions at the source are healed by the batch sync). No stream state is
kept beyond the high-water mark table, one row per batch id; the batch
function only reads marks of *earlier* batches and overwrites its own
outputs, so a replayed batch (after a failure) gives the same table.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe import model
from sensorframe.functions.expressions import ts_lit
from sensorframe.operators.dedup import dedup_keep_first
from sensorframe.session import list_dirs, path_exists

KEY = ["timestamp", "ID", "type"]
HWM_SCHEMA = T.StructType([T.StructField("batch_id", T.LongType(), False),
                           T.StructField("max_ts", T.TimestampNTZType(), True)])


def _hwm_path(table):
    return f"{table}/_hwm"


def _late_path(table):
    return f"{table}/_late"


def _prior_mark(spark: SparkSession, table: str, batch_id: int):
    p = _hwm_path(table)
    if not path_exists(spark, p):
        return None
    return (spark.read.schema(HWM_SCHEMA).parquet(p).filter(F.col("batch_id") < batch_id)
            .agg(F.max("max_ts")).first()[0])


def read_table(spark: SparkSession, table: str) -> DataFrame | None:
    days = [d for d in list_dirs(spark, table) if d.startswith("date=")]
    if not days:
        return None
    return spark.read.option("basePath", table).parquet(*[f"{table}/{d}" for d in days])


def read_late(spark: SparkSession, table: str) -> DataFrame | None:
    p = _late_path(table)
    if not path_exists(spark, p):
        return None
    return spark.read.parquet(p)


def merge_batch(spark: SparkSession, table: str, batch: DataFrame, batch_id: int,
                overlap_hours: float, start: datetime | None = None) -> None:
    """foreachBatch body: merge one micro-batch into ``table``. ``start`` is the mark that holds before
    any batch has left one, such as that of a replica that the stream takes over from."""
    rows = dedup_keep_first(batch.select(*model.FACT_COLUMNS).filter(F.col("timestamp").isNotNull()), KEY)
    # Several actions read the batch; a lost cached block is recomputed from
    # the landed files, which do not change.
    rows = rows.persist()
    try:
        _merge(spark, table, rows, batch_id, overlap_hours, start)
    finally:
        rows.unpersist()


def _merge(spark: SparkSession, table: str, rows: DataFrame, batch_id: int, overlap_hours: float,
           start: datetime | None) -> None:
    prior = _prior_mark(spark, table, batch_id) or start
    if prior is None:
        accepted, late = rows, None
    else:
        threshold = prior - timedelta(hours=overlap_hours)
        accepted = rows.filter(F.col("timestamp") >= ts_lit(threshold))
        late = rows.filter(F.col("timestamp") < ts_lit(threshold))
    if late is not None:
        (late.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(_late_path(table)))
    accepted = accepted.withColumn("date", F.to_date("timestamp"))
    days = [d for (d,) in accepted.select("date").distinct().collect()]
    merged = accepted
    current = read_table(spark, table)
    if current is not None and days:
        touched = current.filter(F.col("date").isin(days))
        kept = touched.join(accepted.select(*KEY), KEY, "left_anti")
        merged = accepted.unionByName(kept.select(*accepted.columns))
    if days:
        (merged.hint("rebalance", "date").sortWithinPartitions("date", "ID", "type", "timestamp")
         .write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(table))
    new_mark = accepted.agg(F.max("timestamp")).first()[0]
    mark = max([m for m in (prior, new_mark) if m is not None], default=None)
    (spark.createDataFrame([(int(batch_id), mark)], HWM_SCHEMA).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(_hwm_path(table)))


def start_ingest(spark: SparkSession, landing: str, table: str, checkpoint: str,
                 overlap_hours: float = 336, schema: T.StructType = model.FACT_SCHEMA,
                 available_now: bool = True, interval: str = "900 seconds",
                 max_files_per_trigger: int | None = None, start: datetime | None = None):
    """Start the stream; ``available_now`` processes what has landed and stops
    (tests, catch-up), otherwise it triggers every ``interval``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(landing)
    writer = (stream.writeStream.foreachBatch(
        lambda df, bid: merge_batch(spark, table, df, bid, overlap_hours, start))
        .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
