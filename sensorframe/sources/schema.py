"""Schema introspection (S8, S9) and the source -> target type mapping (K6)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe import model
from sensorframe.functions.expressions import target_type_name

DESCRIBE_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType(), False),
    T.StructField("ordinal_position", T.LongType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("udt_name", T.StringType(), False),
    T.StructField("is_nullable", T.StringType(), False),
])


def describe(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, ordinal_position, column_name, data_type, udt_name, is_nullable)``
    from each table's schema, in column order; ``udt_name`` is the type without its
    parameters (``array`` of ``array<float>``). No job runs on the data."""
    rows = []
    for name, df in tables.items():
        for pos, f in enumerate(df.schema.fields, start=1):
            rows.append((name, pos, f.name, f.dataType.simpleString(), f.dataType.simpleString().split("<")[0].split("(")[0],
                         "YES" if f.nullable else "NO"))
    return spark.createDataFrame(rows, DESCRIBE_SCHEMA)


def with_target_types(described: DataFrame, udt_col: str | None = None) -> DataFrame:
    """Add ``target_type`` (type map, default TEXT) to a describe result."""
    udt = F.col(udt_col) if udt_col else None
    return described.withColumn("target_type", target_type_name(F.col("data_type"), udt))


def target_schema(described_rows) -> T.StructType:
    """StructType of a replica table from described rows (with target_type)."""
    fields = []
    for r in described_rows:
        dtype = model.TARGET_SPARK_TYPES.get(r["target_type"], T.StringType())
        fields.append(T.StructField(r["column_name"], dtype, r["is_nullable"] == "YES"))
    return T.StructType(fields)


def target_type_of(data_type: str, udt_name: str = "") -> str:
    """The type map for one name on the driver (``target_type_name`` is the same for a column)."""
    base = re.sub(r"\s*\(.*\)$", "", data_type.strip().lower())
    base = model.SPARK_TYPE_SYNONYMS.get(base, base)
    return next((to for name, udt, to in model.TYPE_NAME_MAP if base == name or (udt and udt_name.lower() == udt)),
                model.TYPE_NAME_DEFAULT)


@dataclass(frozen=True)
class LayoutColumn:
    """A column of a replica table: its type at the source, in the replica, and the run that added it."""

    name: str
    source_type: str
    target_type: str
    nullable: bool
    since_run: int

    @property
    def spark_type(self) -> T.DataType:
        return model.TARGET_SPARK_TYPES[self.target_type]


def merged_layout(stored: list[LayoutColumn], source: DataFrame, run_id: int) -> list[LayoutColumn]:
    """The stored columns as they are, then the source's other columns through the type
    map, in the source's order. A column that the source has lost stays; a column
    that joins a table already filled can be NULL, as older rows lack it."""
    have = {c.name.lower() for c in stored}
    new = [LayoutColumn(f.name, f.dataType.simpleString(), target_type_of(f.dataType.simpleString()),
                        f.nullable or bool(stored), run_id)
           for f in source.schema.fields if f.name.lower() not in have]
    return stored + new


def layout_schema(layout: list[LayoutColumn]) -> T.StructType:
    return T.StructType([T.StructField(c.name, c.spark_type, c.nullable) for c in layout])


def conform(df: DataFrame, layout: list[LayoutColumn]) -> DataFrame:
    """``df`` in the layout's columns, order and types. Absent columns are NULL. A value
    that the type cannot hold, or a NULL in a column without NULLs, fails the job that reads it."""
    have = {f.name.lower(): f for f in df.schema.fields}
    out = []
    for c in layout:
        field = have.get(c.name.lower())
        col = F.lit(None) if field is None else F.col(f"`{field.name}`")
        if field is None or field.dataType != c.spark_type:
            col = col.cast(c.spark_type)
        if not c.nullable and (field is None or field.nullable):
            col = F.coalesce(col, F.raise_error(F.lit(f"NULL in column {c.name}, which allows none")).cast(c.spark_type))
        out.append(col.alias(c.name))
    return df.select(*out)


def missing_columns(df: DataFrame, required) -> list[str]:
    """Required columns absent from ``df`` (schema only, no job)."""
    have = set(df.columns)
    return sorted(c for c in required if c not in have)
