"""Ordered tables with a page index (K7, O1, O2).

``write_ordered`` range-partitions and sorts the rows once and writes them as parquet files
whose numbers follow the order, then a small index: per file its rows and the number of
rows before it. A page of any depth opens only the files that hold it, and row numbers
of the whole table are a file's offset plus the row's place in the file, so reading
either needs no sort, no shuffle and no checkpoint of the rows.

The index is written last: a write that broke off has no index and can't be read. It has one
row per file, and only these are put in order in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorframe.operators.joins import bounded_broadcast

# Spark names the files of a task ``part-<task>-<id>-c<number>``.
_TASK, _CUT = r"^part-(\d+)-", r"-c(\d+)\."


def _rows_path(path: str) -> str:
    return f"{path}/rows"


def _index_path(path: str) -> str:
    return f"{path}/index"


def write_ordered(df: DataFrame, path: str, order_cols, rows_per_file: int = 0) -> None:
    """Write ``df`` at ``path`` in the order of ``order_cols`` (NULLs first), with its index.

    ``rows_per_file`` bounds a file's rows (0: a file per sorted partition). Rows that are equal in
    all ``order_cols`` come in any order, which stays the same from then on.
    """
    spark = df.sparkSession
    df.orderBy(*order_cols).write.option("maxRecordsPerFile", rows_per_file).parquet(_rows_path(path))
    files = (spark.read.schema(df.schema).parquet(_rows_path(path))
             .groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n_rows")))
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    before = Window.orderBy(number(_TASK), number(_CUT)).rowsBetween(Window.unboundedPreceding, -1)
    index = files.select("file", "n_rows", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).cast("long").alias("first_row"))
    index.write.parquet(_index_path(path))


def _numbered(rows: DataFrame, index: DataFrame, name: str) -> DataFrame:
    cols = rows.columns
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    at = index.select(F.col("file").alias("_file"), F.col("first_row").alias("_first"))
    return placed.join(at, "_file").select(*cols, (F.col("_first") + F.col("_at") + 1).cast("long").alias(name))


def read_ordered(spark: SparkSession, path: str, name: str = "row_no") -> DataFrame:
    """All rows with their number (from 1) in column ``name``."""
    index = spark.read.parquet(_index_path(path))
    return _numbered(spark.read.parquet(_rows_path(path)), bounded_broadcast(index), name)


def row_total(spark: SparkSession, path: str) -> int:
    """Rows of the table, from the index alone."""
    return spark.read.parquet(_index_path(path)).agg(F.sum("n_rows")).first()[0] or 0


def read_page(spark: SparkSession, path: str, page: int, page_size: int, name: str = "row_no") -> DataFrame:
    """Page ``page`` (from 0) with row numbers, in order. Opens only the files that hold its rows: each
    has at least one of them, so at most ``page_size`` names reach the driver."""
    lo, hi = page * page_size, (page + 1) * page_size
    index = spark.read.parquet(_index_path(path))
    index = index.filter((F.col("first_row") < hi) & (F.col("first_row") + F.col("n_rows") > lo))
    schema = spark.read.parquet(_rows_path(path)).schema
    names = [r.file for r in index.select("file").collect()]
    if not names:  # a page behind the end
        return spark.createDataFrame([], schema).withColumn(name, F.lit(0).cast("long"))
    rows = spark.read.schema(schema).parquet(*[f"{_rows_path(path)}/{f}" for f in names])
    numbered = _numbered(rows, F.broadcast(index), name)  # at most page_size rows
    return numbered.filter((F.col(name) > lo) & (F.col(name) <= hi)).orderBy(name)
