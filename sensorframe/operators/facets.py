"""Faceted selection of sensors.

Facets are metadata columns. A selection is a list per facet; an empty list
does not restrict. Option lists are distinct, non-empty and sorted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe import model
from sensorframe.functions.expressions import channels_of

FACETS = ["building", "floor", "area", "nodeTypeName", "vanity"]


@dataclass(frozen=True)
class Selection:
    building: list = field(default_factory=list)
    floor: list = field(default_factory=list)
    area: list = field(default_factory=list)
    nodeTypeName: list = field(default_factory=list)
    vanity: list = field(default_factory=list)

    def as_dict(self):
        return {f: list(getattr(self, f)) for f in FACETS}


def _match(facet: str, values) -> F.Column:
    return F.col(facet).isin(list(values)) if values else F.lit(True)


def facet_filter(meta: DataFrame, sel: Selection) -> DataFrame:
    """Metadata rows matching every non-empty facet list."""
    cond = F.lit(True)
    for facet, values in sel.as_dict().items():
        if values:
            cond = cond & _match(facet, values)
    return meta.filter(cond)


def scope_ids(meta: DataFrame, sel: Selection, scope: str = "filter") -> DataFrame:
    """Ids of a load or preload: every sensor (``scope="all"``) or those
    matching the current selection (``"filter"``)."""
    chosen = meta if scope == "all" else facet_filter(meta, sel)
    return chosen.select(F.col("id").alias("ID"))


def _stack_options(meta: DataFrame, flags: dict) -> DataFrame:
    """One pass: for each facet emit ``(facet, value)`` where its flag holds,
    then distinct non-empty values."""
    entries = [F.when(flag, F.struct(F.lit(facet).alias("facet"), F.col(facet).alias("value")))
               for facet, flag in flags.items()]
    exploded = meta.select(F.explode(F.array(*entries)).alias("o")).select("o.*")
    return (exploded.filter(F.col("facet").isNotNull() & F.col("value").isNotNull()
                            & (F.col("value") != ""))
            .distinct())


def facet_values(meta: DataFrame) -> DataFrame:
    """All non-empty distinct values of the five facets (no selection)."""
    return _stack_options(meta, {f: F.lit(True) for f in FACETS})


def facet_options(meta: DataFrame, sel: Selection) -> DataFrame:
    """Cascading options: floor from chosen buildings, area from building and
    floor, sensor type and vanity from building, floor and area."""
    b = _match("building", sel.building)
    bf = b & _match("floor", sel.floor)
    bfa = bf & _match("area", sel.area)
    flags = {"building": F.lit(True), "floor": b, "area": bf, "nodeTypeName": bfa, "vanity": bfa}
    return _stack_options(meta, flags)


def facet_count(meta: DataFrame, sel: Selection) -> DataFrame:
    """Number of distinct sensors matching the selection, and matching rows."""
    return facet_filter(meta, sel).agg(F.countDistinct("id").alias("n_sensors"),
                                       F.count(F.lit(1)).alias("n_selected"))


def channel_map_frame(spark, mapping: dict | None = None) -> DataFrame:
    """The fixed sensor-type -> channels map as a small table."""
    mapping = model.SENSOR_CHANNELS if mapping is None else mapping
    return spark.createDataFrame([(k, list(v)) for k, v in mapping.items()],
                                 "sensor_type string, channels array<string>")


def channels_for_types(types: DataFrame, channel_map: DataFrame | dict | None = None,
                       type_col: str = "sensor_type") -> DataFrame:
    """Distinct channels of the chosen sensor types.

    ``channel_map`` is a table ``(sensor_type, channels)`` or a dict (then
    looked up as a map literal, unknown types give no channel).
    """
    t = types.select(F.col(type_col).alias("sensor_type")).distinct()
    if isinstance(channel_map, DataFrame):
        lists = t.join(channel_map.select("sensor_type", "channels"), "sensor_type")
        ch = lists.select(F.explode("channels").alias("channel"))
    else:
        ch = t.select(F.explode(channels_of(F.col("sensor_type"), channel_map)).alias("channel"))
    return ch.filter(F.col("channel").isNotNull()).distinct()
