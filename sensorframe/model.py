"""Schemas, channel routing and the fixed lookup values of the domain."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- Fixed values (must equal the reference's for equal results) -----------
# Sensor type -> channels it reports.
SENSOR_CHANNELS = {
    "ems_desk": ["occupancy", "tempc", "hum"],
    "ers_eye": ["occupancy", "motion", "light", "tempc", "hum"],
    "ers_co2": ["tempc", "hum", "co2"],
    "ers_desk": ["occupancy", "tempc", "hum"],
}
# Channels stored in the history table, and in the environment table.
HISTORY_CHANNELS = ["occupancy", "motion"]
ENV_CHANNELS = ["tempc", "hum", "co2", "light"]
# Channels loaded when none is chosen.
DEFAULT_CHANNELS = ["occupancy", "motion", "tempc", "hum", "co2", "light"]
# Spellings accepted for the sensor-type column, first found wins.
NODE_TYPE_ALIASES = ["nodeTypeName", "nodetypename", "node_type_name", "nodetype", "type"]
# Optional metadata columns; absent ones become ''.
OPTIONAL_META_COLUMNS = ["building", "floor", "area", "vanity"]
# Lowest cutoff of the incremental copy.
SYNC_BASELINE_TS = "1900-01-01 00:00:00"
# Longest error text kept in the run log.
MAX_ERROR_CHARS = 4000
# Default id batch size and sensors per chart.
DEFAULT_BATCH_SIZE = 50
DEFAULT_SENSORS_PER_CHART = 12
# Axis range of charts of 0/1 series.
BINARY_AXIS_RANGE = (-0.05, 1.05)
# Source type name -> target type name (lower-cased data_type, udt_name).
TYPE_NAME_MAP = [
    ("timestamp without time zone", None, "TIMESTAMP WITHOUT TIME ZONE"),
    ("timestamp with time zone", None, "TIMESTAMP WITH TIME ZONE"),
    ("character varying", None, "TEXT"),
    ("text", None, "TEXT"),
    ("boolean", None, "BOOLEAN"),
    ("bigint", "int8", "BIGINT"),
    ("integer", "int4", "INTEGER"),
    ("smallint", "int2", "SMALLINT"),
    ("double precision", "float8", "DOUBLE PRECISION"),
    ("real", "float4", "REAL"),
    ("numeric", None, "NUMERIC"),
]
TYPE_NAME_DEFAULT = "TEXT"
# Resampling frequency names offered to the user.
FREQUENCY_NAMES = ["15Min", "H", "D", "W", "M"]
# Aggregation functions offered for resampling.
AGG_FUNCTION_NAMES = ["mean", "sum", "max", "min", "median"]
# Series label: type | vanity (building floor/area).
SERIES_LABEL_FORMAT = "%s | %s (%s %s/%s)"
# Panel titles (by channel, all channels).
PANEL_TITLE_BY_CHANNEL = "Time series — %s (group %d/%d)"
PANEL_TITLE_ALL_CHANNELS = "Time series (group %d/%d)"
# Line shape of 0/1 panels and of other panels.
LINE_SHAPE_BINARY = "hv"
LINE_SHAPE_DEFAULT = "linear"
# KPI texts: thousands separator, date format, range separator.
THOUSANDS_SEPARATOR = "."
KPI_DATE_FORMAT = "yyyy-MM-dd"
KPI_RANGE_SEPARATOR = " → "
# CSV export file name.
EXPORT_NAME_FORMAT = "sensor_export_{start:%Y%m%d}_{end:%Y%m%d}.csv"
# Snapshot table names.
SNAPSHOT_TABLES = ["nodes_hierarchy_cache", "nodes_history_cache", "nodes_history_env_cache"]
# Replicated tables: full refresh, then incremental ones, in this order.
REPLICA_FULL_TABLES = ["nodes_hierarchy"]
REPLICA_INCREMENTAL_TABLES = ["nodes_history", "nodes_history_env"]
# ----------------------------------------------------------------------------

# Spark SQL type names that mean the same as a source type name above.
SPARK_TYPE_SYNONYMS = {
    "timestamp_ntz": "timestamp without time zone",
    "timestamp": "timestamp with time zone",
    "string": "text",
    "varchar": "character varying",
    "int": "integer",
    "long": "bigint",
    "short": "smallint",
    "double": "double precision",
    "float": "real",
    "decimal": "numeric",
}

# Target type name -> Spark type used for the replica schema.
TARGET_SPARK_TYPES = {
    "TIMESTAMP WITHOUT TIME ZONE": T.TimestampNTZType(),
    "TIMESTAMP WITH TIME ZONE": T.TimestampType(),
    "TEXT": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "BIGINT": T.LongType(),
    "INTEGER": T.IntegerType(),
    "SMALLINT": T.ShortType(),
    "DOUBLE PRECISION": T.DoubleType(),
    "REAL": T.FloatType(),
    "NUMERIC": T.DecimalType(38, 18),
}

FACT_COLUMNS = ["timestamp", "value", "ID", "type"]
META_COLUMNS = ["id", "nodeTypeName", "building", "floor", "area", "vanity"]
META_ATTRS = ["vanity", "building", "floor", "area", "nodeTypeName"]
# Group keys of resampling: series id plus its metadata.
SERIES_KEYS = ["ID", "type", "vanity", "building", "floor", "area", "nodeTypeName"]

FACT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("ID", T.LongType(), True),
    T.StructField("type", T.StringType(), True),
])

META_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("nodeTypeName", T.StringType(), False),
    T.StructField("building", T.StringType(), False),
    T.StructField("floor", T.StringType(), False),
    T.StructField("area", T.StringType(), False),
    T.StructField("vanity", T.StringType(), False),
])

CHECK_SCHEMA = T.StructType([
    T.StructField("Check", T.StringType(), False),
    T.StructField("OK", T.BooleanType(), False),
    T.StructField("Details", T.StringType(), False),
])


@dataclass(frozen=True)
class ChannelRouting:
    """Which fact table holds which channels.

    ``history`` channels live in the history table; ``env`` channels in the
    environment table. A channel in neither list is read from nowhere.
    """

    history: tuple = tuple(HISTORY_CHANNELS)
    env: tuple = tuple(ENV_CHANNELS)
    default_channels: tuple = field(default=tuple(DEFAULT_CHANNELS))

    @property
    def all_channels(self):
        return sorted(set(self.history) | set(self.env))


DEFAULT_ROUTING = ChannelRouting()
