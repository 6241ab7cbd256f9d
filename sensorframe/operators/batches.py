"""Id batches and per-batch load metrics.

The reference loads ids serially in batches of 50 and reports rows per batch
and running totals. Here the load is one distributed scan; the batch number
is a column, so the same metrics come from one aggregation.
"""

from __future__ import annotations

from time import perf_counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe import model
from sensorframe.functions.expressions import per_second
from sensorframe.operators.indexing import global_index, running_sum
from sensorframe.operators.joins import bounded_broadcast


def batch_numbers(ids: DataFrame, size: int = model.DEFAULT_BATCH_SIZE, id_col: str = "ID") -> DataFrame:
    """``(ID, batch_no)``: ids in ascending order cut into batches of ``size``."""
    distinct = ids.select(F.col(id_col).cast("bigint").alias("ID")).filter(F.col("ID").isNotNull()).distinct()
    ranked = global_index(distinct, ["ID"], "_rank")
    return ranked.select("ID", (F.floor((F.col("_rank") - 1) / size) + 1).cast("long").alias("batch_no"))


def batch_load_stats(facts: DataFrame, ids: DataFrame, size: int = model.DEFAULT_BATCH_SIZE,
                     id_col: str = "ID") -> DataFrame:
    """Per batch: ids, rows loaded, cumulative rows, and the batch count.

    The batch table has one row per id, the per-batch table one row per
    batch; the running total is summed in blocks of batches.
    """
    b = batch_numbers(ids, size, id_col)
    total = b.agg(F.max("batch_no")).first()[0] or 0
    per_batch_ids = b.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_ids"))
    rows = facts.join(bounded_broadcast(b), "ID").groupBy("batch_no").agg(F.count(F.lit(1)).alias("rows"))
    stats = per_batch_ids.join(rows, "batch_no", "left").select(
        "batch_no", "n_ids", F.coalesce(F.col("rows"), F.lit(0)).cast("long").alias("rows"))
    return running_sum(stats, "batch_no", "rows", "cum_rows").withColumn("total_batches", F.lit(total).cast("long"))


def load_batches(facts: DataFrame, ids: DataFrame, path: str, size: int = model.DEFAULT_BATCH_SIZE,
                 id_col: str = "ID") -> DataFrame:
    """Load the facts of ``ids`` into parquet at ``path``, one folder per batch, and report per batch
    ``(batch_no, n_ids, rows, bytes, seconds, rows_per_s)``.

    Bytes are those of the batch's files, which each know their size. All batches load
    side by side in one job, so ``seconds`` is the time of the load, the same for each, and
    ``rows_per_s`` what the batch contributed to it. A batch without facts has zeros. AQE
    splits the files of a batch that outgrows a task.
    """
    spark = facts.sparkSession
    b = batch_numbers(ids, size, id_col).checkpoint(eager=True)
    loaded = facts.join(bounded_broadcast(b), "ID")
    t0 = perf_counter()
    loaded.hint("rebalance", "batch_no").write.partitionBy("batch_no").parquet(path)
    seconds = perf_counter() - t0
    schema = loaded.schema
    files = (spark.read.schema(schema).parquet(path)
             .groupBy(F.col("batch_no").cast("long").alias("batch_no"), F.col("_metadata.file_path").alias("file"))
             .agg(F.count(F.lit(1)).alias("rows"), F.first("_metadata.file_size").alias("bytes")))
    sums = files.groupBy("batch_no").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    n_ids = b.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_ids"))
    zero = F.lit(0).cast("long")
    return n_ids.join(sums, "batch_no", "left").select(
        "batch_no", "n_ids", F.coalesce("rows", zero).alias("rows"), F.coalesce("bytes", zero).alias("bytes"),
        F.lit(seconds).alias("seconds"), per_second(F.coalesce("rows", zero), F.lit(seconds)).alias("rows_per_s"))
