"""Data-quality checks (C1-C4): one ``(Check, OK, Details)`` row per check.

A check is a requirement with a name and a finding: a function that returns
None when the requirement holds, or what is wrong, or raises. Requirements on columns
look at schemas only; reachability reads a row of each table, the probe one week of one sensor.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe import model
from sensorframe.sources.facts import read_timeseries
from sensorframe.sources.metadata import normalize_metadata, pick_column

#: Columns of a reading; every entry lists alternatives of which one is enough.
READING = [["timestamp"], ["value"], ["ID"], ["type"]]
SENSOR = [["id"], list(model.NODE_TYPE_ALIASES)]


@dataclass
class Requirement:
    name: str
    finding: Callable[[], str | None]
    success: Callable[[], str] = lambda: "OK"

    def row(self) -> tuple[str, bool, str]:
        try:
            wrong = self.finding()
            return (self.name, wrong is None, self.success() if wrong is None else wrong)
        except Exception as exc:  # noqa: BLE001  (a check that cannot run has failed)
            return (self.name, False, str(exc))


def _lacking(table: DataFrame | None, needed: list[list[str]]) -> str | None:
    if table is None:
        return "no such table"
    absent = ["|".join(names) for names in needed if pick_column(table.columns, names) is None]
    return f"Missing: {absent}" if absent else None


def quality_checks(spark: SparkSession, history: DataFrame | None, env: DataFrame | None,
                   meta_raw: DataFrame | None, now: datetime,
                   routing: model.ChannelRouting = model.DEFAULT_ROUTING) -> DataFrame:
    """The rows of all requirements, in a fixed order."""
    tables = {"history": history, "env": env, "metadata": meta_raw}
    probed: dict[str, int] = {}

    def unreachable() -> str | None:
        absent = [name for name, table in tables.items() if table is None or not table.schema.fields]
        if absent:
            return f"No columns or no table: {absent}"
        for table in tables.values():
            table.limit(1).collect()  # opens the storage, whatever is in it, and raises if that can't be read
        return None

    def probe() -> str | None:
        sensor = normalize_metadata(meta_raw).agg(F.min("id")).first()[0]
        if sensor is None:
            return "metadata empty"
        week = read_timeseries(spark, history, env, [sensor], list(routing.default_channels),
                               now - timedelta(days=7), now, routing)
        probed["rows"] = week.count()
        return _lacking(week, READING)

    def unnamed() -> str | None:
        column = pick_column(meta_raw.columns, ["vanity"])
        return "missing" if column is None or meta_raw.filter(F.col(f"`{column}`").isNotNull()).isEmpty() else None

    requirements = [
        Requirement("Source reachable", unreachable),
        Requirement("history columns", lambda: _lacking(history, READING)),
        Requirement("env columns", lambda: _lacking(env, READING)),
        Requirement("metadata columns", lambda: _lacking(meta_raw, SENSOR)),
        Requirement("Timeseries probe", probe, lambda: f"{probed['rows']} rows"),
        Requirement("Metadata has 'vanity'", unnamed),
    ]
    return spark.createDataFrame([r.row() for r in requirements], model.CHECK_SCHEMA)
