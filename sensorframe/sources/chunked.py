"""Resumable copy of a source in chunks of about equal size.

A first pass counts the source's rows per hour of its time column (or per range of
a whole-number key). Running sums over those counts, whose number is
bounded by the calendar and not by the rows, give the bounds of the chunks, which are stored
with the copy. Chunks are then copied some at a time, each wave one job whose
range predicate reaches the scan, and a ledger file is created for every chunk
once its rows are committed. A copy that broke off goes on with the chunks that the ledger lacks;
readers see finished chunks only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.functions.expressions import ts_lit
from sensorframe.session import create_file, list_files, path_exists, read_text

#: Rows of a chunk, the reference's default, and chunks copied by one job.
CHUNK_ROWS = 50_000
CHUNKS_PER_JOB = 256
#: The chunk of the rows without a key.
NO_KEY = -1


def _unit(key: Column, kind: T.DataType, width: int) -> Column:
    """The key range that a row is counted in."""
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        at = key.cast("timestamp_ntz")
        return F.make_timestamp_ntz(F.year(at), F.month(at), F.day(at), F.hour(at), F.lit(0), F.lit(0))
    return F.floor(key / width) * width


def chunk_bounds(source: DataFrame, key: str, rows: int = CHUNK_ROWS, width: int = 10_000) -> list[dict]:
    """``{"chunk", "first", "last", "rows"}`` of chunks of ``rows`` rows or, where a single
    key range holds more, of that range; ``first`` and ``last`` name the chunk's key ranges."""
    kind = source.schema[key].dataType
    counts = source.filter(F.col(key).isNotNull()).groupBy(_unit(F.col(key), kind, width).alias("u")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("u")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (counts.withColumn("chunk", F.floor(before / rows)).groupBy("chunk")
           .agg(F.min("u").alias("first"), F.max("u").alias("last"), F.sum("n").alias("rows")).orderBy("first"))
    text = lambda v: v.isoformat() if hasattr(v, "isoformat") else int(v)
    return [{"chunk": i, "first": text(r["first"]), "last": text(r["last"]), "rows": r["rows"]} for i, r in enumerate(cut.collect())]


def _after(bound, width: int) -> Column:
    """The first key beyond the range that starts at ``bound``."""
    return ts_lit(bound.replace("T", " ")) + F.expr("INTERVAL 1 HOUR") if isinstance(bound, str) else F.lit(bound + width)


def _start(bound) -> Column:
    return ts_lit(bound.replace("T", " ")) if isinstance(bound, str) else F.lit(bound)


def _chunk_of(key: Column, wave: list[dict]) -> Column:
    """The number of the last of the wave's chunks that starts at or before the key. They are
    in key order and halved at every step, so a row takes as many comparisons as there are halvings."""
    if len(wave) == 1:
        return F.lit(wave[0]["chunk"])
    half = len(wave) // 2
    return F.when(key < _start(wave[half]["first"]), _chunk_of(key, wave[:half])).otherwise(_chunk_of(key, wave[half:]))


def _finished(spark: SparkSession, path: str) -> set[int]:
    return {int(n[:-5]) for n in list_files(spark, f"{path}/_chunks") if n.endswith(".json")}


def copy_chunked(spark: SparkSession, path: str, source: DataFrame, key: str, rows: int = CHUNK_ROWS,
                 chunks_per_job: int = CHUNKS_PER_JOB, width: int = 10_000, max_jobs: int | None = None) -> tuple[int, int]:
    """Copy what the folder ``path`` still lacks of ``source``; returns (chunks copied now, chunks left).

    The bounds are those of the first call; keys beyond them that the source has
    gained since are not copied. Rows without a key are one more chunk. ``max_jobs`` ends the call early.
    """
    plan_file = f"{path}/_plan.json"
    if not path_exists(spark, plan_file):
        plan = {"key": key, "width": width, "chunks": chunk_bounds(source, key, rows, width)}
        create_file(spark, plan_file, json.dumps(plan))  # whoever is first decides
    plan = json.loads(read_text(spark, plan_file))
    if plan["key"] != key:
        raise ValueError(f"{path} is cut by {plan['key']}, not by {key}")
    width, done = plan["width"], _finished(spark, path)
    todo = [c for c in plan["chunks"] if c["chunk"] not in done]
    waves = [todo[i:i + chunks_per_job] for i in range(0, len(todo), chunks_per_job)]
    if NO_KEY not in done:
        waves.append([])
    copied = 0
    for wave in waves[:max_jobs]:
        if wave:
            k = F.col(key)
            span = source.filter((k >= _start(wave[0]["first"])) & (k < _after(wave[-1]["last"], width)))
            part = span.withColumn("chunk", _chunk_of(k, wave))
        else:
            part = source.filter(F.col(key).isNull()).withColumn("chunk", F.lit(NO_KEY))
        (part.hint("rebalance", "chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("chunk").parquet(f"{path}/rows"))
        for c in wave or [{"chunk": NO_KEY}]:
            create_file(spark, f"{path}/_chunks/{c['chunk']}.json", json.dumps(c))
        copied += max(len(wave), 1)
    return copied, len(plan["chunks"]) + 1 - len(_finished(spark, path))


def read_chunked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of finished chunks."""
    done = sorted(_finished(spark, path))
    if not done or not path_exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("chunk", T.IntegerType())])).parquet(f"{path}/rows")
    return stored.filter(F.col("chunk").isin(done)).drop("chunk")
