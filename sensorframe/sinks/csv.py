"""CSV sinks (K1 export, K2 bulk-load format).

Export: header, UTF-8, NULL as empty field, quotes doubled inside quoted
fields, timestamps as ``yyyy-MM-dd HH:mm:ss`` (with ``.SSSSSS`` when any
value has a fraction of a second, as pandas does per column). Bulk-load
format: no header, NULL as ``\\N``. Files are written in parallel; one
file only on request (``single_file``), which funnels the data through one
task and is meant for small results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe import model
from sensorframe.session import ensure_checkpoint_dir, observed

WHOLE_SECONDS = "yyyy-MM-dd HH:mm:ss"
WITH_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _has_fraction(df: DataFrame) -> bool:
    ts_cols = [f.name for f in df.schema.fields
               if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))]
    if not ts_cols:
        return False
    flags = [F.max((F.unix_micros(F.col(c).cast("timestamp")) % 1_000_000) != 0) for c in ts_cols]
    row = df.select(*ts_cols).agg(*flags).first()
    return any(bool(v) for v in row if v is not None)


def export_name(start, end) -> str:
    """File name carrying the range, as the reference offers it."""
    return model.EXPORT_NAME_FORMAT.format(start=start, end=end)


def _writer(df: DataFrame, single_file: bool):
    return (df.coalesce(1) if single_file else df).write.mode("overwrite")


def write_export_csv(df: DataFrame, path: str, single_file: bool = False,
                     timestamp_format: str | None = None) -> int:
    """Write the export and return the number of rows written. Without a given format the rows are
    kept in the checkpoint folder, so that the look for fractions and the write share one evaluation."""
    if timestamp_format is None:
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    fmt = timestamp_format or (WITH_MICROS if _has_fraction(df) else WHOLE_SECONDS)
    obs = Observation("export")
    watched = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    (_writer(watched, single_file).option("header", True).option("nullValue", "")
     .option("emptyValue", '""').option("quote", '"').option("escape", '"')
     .option("timestampNTZFormat", fmt).option("timestampFormat", fmt)
     .option("encoding", "UTF-8").csv(path))
    return int(observed(obs, ["rows"])["rows"] or 0)


def read_export_csv(spark: SparkSession, path: str, schema: T.StructType,
                    timestamp_format: str | None = None) -> DataFrame:
    fmt = timestamp_format or "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
    return (spark.read.schema(schema).option("header", True).option("nullValue", "")
            .option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
            .option("timestampNTZFormat", fmt).option("timestampFormat", fmt).csv(path))


def write_copy_csv(df: DataFrame, path: str) -> int:
    """Bulk-load format: no header, NULL as ``\\N``; returns rows written
    (0 for an empty frame)."""
    obs = Observation("copy")
    watched = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    (watched.write.mode("overwrite").option("header", False).option("nullValue", "\\N")
     .option("quote", '"').option("escape", '"')
     .option("timestampNTZFormat", WITH_MICROS).option("timestampFormat", WITH_MICROS).csv(path))
    return int(observed(obs, ["rows"])["rows"] or 0)


def read_copy_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema).option("header", False).option("nullValue", "\\N")
            .option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
            .option("timestampNTZFormat", WITH_MICROS).option("timestampFormat", WITH_MICROS).csv(path))
