"""Sources: metadata and fact scans, schema introspection, JDBC arguments."""

from sensorframe.sources.facts import (
    coerce_facts, empty_facts, read_timeseries, scan_table, union_facts,
)
from sensorframe.sources.metadata import (
    empty_metadata, load_metadata, normalize_metadata, pick_column,
)
from sensorframe.sources.schema import describe, missing_columns, target_schema, with_target_types

__all__ = ["coerce_facts", "empty_facts", "read_timeseries", "scan_table", "union_facts",
           "empty_metadata", "load_metadata", "normalize_metadata", "pick_column",
           "describe", "missing_columns", "target_schema", "with_target_types"]
