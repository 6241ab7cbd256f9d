"""The interactive "load data" query as one lazy plan.

facets -> id selection -> channel-routed fact scan in a half-open range ->
enrichment, or resample with gap fill -> optional rolling mean. Display order
is applied at the edge (``table_page`` or ``orderBy``), not inside the plan.
Only actions the caller runs leave the cluster; KPIs and panels are further
DataFrames over the same plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe import model
from sensorframe.operators.enrich import enrich
from sensorframe.operators.facets import Selection, facet_filter
from sensorframe.operators.filters import resolve_channels
from sensorframe.operators.resample import resample_series
from sensorframe.operators.smooth import rolling_mean, rolling_mean_dense
from sensorframe.sources.facts import read_timeseries


@dataclass(frozen=True)
class ExploreRequest:
    start: datetime
    end: datetime
    selection: Selection = field(default_factory=Selection)
    channels: tuple = ()
    frequency: str | None = None        # None = raw data
    agg: str = "mean"
    rolling: int = 0
    routing: model.ChannelRouting = model.DEFAULT_ROUTING


def load_series(spark: SparkSession, history: DataFrame, env: DataFrame, meta: DataFrame,
                req: ExploreRequest) -> DataFrame:
    """Final frame of the request: enriched raw rows or resampled, gap-filled
    bins; then the optional rolling mean (in series and time order)."""
    chosen = facet_filter(meta, req.selection)
    ids = chosen.select(F.col("id").alias("ID"))
    channels = resolve_channels(req.channels, req.routing)
    facts = read_timeseries(spark, history, env, ids, channels, req.start, req.end, req.routing)
    rolling = req.rolling and req.rolling > 0
    if req.frequency:
        out = resample_series(facts, meta, req.frequency, req.agg, fill=not rolling)
    else:
        out = enrich(facts, meta)
    if rolling:
        out = (rolling_mean_dense(out, req.rolling, req.frequency, fill=req.agg) if req.frequency
               else rolling_mean(out, req.rolling))
    return out
