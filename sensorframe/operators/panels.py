"""Chart-ready datasets (W2, E3, A13, P1-P4). Drawing is left to the caller.

Sorted distinct sensor ids are cut into groups of ``n`` (one chart per group,
or per group and channel). Each point carries its series label, its panel
and the panel's 0/1 flag, line shape and axis range.

``panels_by_*`` take any frame of points and read it twice: once for a per-series
partial aggregate (finite values and values that do not round to 0/1, one row per
series) from which groups and panel flags are derived, and once to attach that
per-series info with a broadcast join (behind a size check).

``resampled_panels`` charts resampled facts without reading their dense frame at
all before the result: occupied bins are aggregated once and written, groups and
flags come from them in closed form, and the bins are expanded last, in the
result's own plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe import model
from sensorframe.functions.bins import bin_label
from sensorframe.functions.expressions import ceil_div, is_finite, series_label
from sensorframe.operators.indexing import global_index
from sensorframe.operators.joins import bounded_broadcast
from sensorframe.operators.resample import complete_meta, gap_fill, sparse_bins
from sensorframe.operators.smooth import bin_number
from sensorframe.session import ensure_checkpoint_dir


def chart_groups(df: DataFrame, n: int = model.DEFAULT_SENSORS_PER_CHART, id_col: str = "ID",
                 within: str | None = None) -> DataFrame:
    """``(ID, group_no, group_count)``, groups restarting within ``within``.

    Numbers the *distinct ids* only, never the points.
    """
    if within is None:
        ids = df.select(id_col).filter(F.col(id_col).isNotNull()).distinct()
        ranked = global_index(ids, [id_col], "_rank", total="_total")
        return ranked.select(id_col, (F.floor((F.col("_rank") - 1) / n) + 1).cast("long").alias("group_no"),
                             ceil_div("_total", F.lit(n)).alias("group_count"))
    pairs = (df.select(within, id_col).filter(F.col(id_col).isNotNull() & F.col(within).isNotNull())
             .distinct())
    # One global order instead of a window per section: unnamed sensors all share one section.
    ranked = global_index(pairs, [within, id_col], "_rank")
    sections = ranked.groupBy(within).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_total"))
    ranked = ranked.join(sections, within)
    return ranked.select(within, id_col, (F.floor((F.col("_rank") - F.col("_first")) / n) + 1).cast("long").alias("group_no"),
                         ceil_div("_total", F.lit(n)).alias("group_count"))


def _series_flags(df: DataFrame, keys) -> DataFrame:
    """Per series: finite values, and finite values that do not round to 0/1.

    A partial aggregate over the points (skew-safe), checkpointed because it
    is small (one row per series) and used for groups and panel flags.
    """
    v = F.col("value")
    finite = is_finite(v)
    bad = finite & ~F.bround(v, 0).isin(0.0, 1.0)
    agg = (df.filter(F.col("ID").isNotNull())
           .groupBy(*keys).agg(F.count(F.when(finite, 1)).alias("_fin"), F.count(F.when(bad, 1)).alias("_bad")))
    return agg.checkpoint(eager=True)


def _panel_info(series: DataFrame, groups: DataFrame, group_on, panel_keys, series_keys) -> DataFrame:
    """One row per series: its panel and the panel's 0/1 flag."""
    s = series.join(groups, group_on)
    flags = s.groupBy(*panel_keys).agg(((F.sum("_fin") > 0) & (F.sum("_bad") == 0)).alias("is_binary"))
    return s.join(flags, list(panel_keys)).select(*series_keys, "group_no", "group_count", "is_binary")


def _finish(df: DataFrame, info: DataFrame, series_keys, title: F.Column, lead_cols) -> DataFrame:
    pts = df.filter(F.col("ID").isNotNull()).join(bounded_broadcast(info), list(series_keys))
    return _points(pts, title, lead_cols)


def _points(pts: DataFrame, title: F.Column, lead_cols) -> DataFrame:
    lo, hi = model.BINARY_AXIS_RANGE
    return pts.select(
        *lead_cols, "group_no", "group_count", title.alias("panel_title"),
        "type", "timestamp", "value", "ID", series_label().alias("series"), "is_binary",
        F.when(F.col("is_binary"), F.lit(model.LINE_SHAPE_BINARY)).otherwise(F.lit(model.LINE_SHAPE_DEFAULT))
        .alias("line_shape"),
        F.when(F.col("is_binary"), F.lit(lo)).alias("y_min"),
        F.when(F.col("is_binary"), F.lit(hi)).alias("y_max"))


def _title(by_channel: bool) -> F.Column:
    if by_channel:
        return F.format_string(model.PANEL_TITLE_BY_CHANNEL, F.col("type"), F.col("group_no"), F.col("group_count"))
    return F.format_string(model.PANEL_TITLE_ALL_CHANNELS, F.col("group_no"), F.col("group_count"))


def panels_by_channel(df: DataFrame, n: int = model.DEFAULT_SENSORS_PER_CHART) -> DataFrame:
    """One panel per (group, channel)."""
    series = _series_flags(df, ["ID", "type"])
    info = _panel_info(series, chart_groups(series, n), "ID", ["group_no", "type"], ["ID", "type"])
    return _finish(df, info, ["ID", "type"], _title(True), [])


def panels_all_channels(df: DataFrame, n: int = model.DEFAULT_SENSORS_PER_CHART) -> DataFrame:
    """One panel per group with every channel."""
    series = _series_flags(df, ["ID", "type"])
    info = _panel_info(series, chart_groups(series, n), "ID", ["group_no"], ["ID", "type"])
    return _finish(df, info, ["ID", "type"], _title(False), [])


def _of_vanities(df: DataFrame, vanities) -> DataFrame:
    if isinstance(vanities, DataFrame):
        return df.join(vanities.select(F.col(vanities.columns[0]).alias("vanity")).distinct(), "vanity", "left_semi")
    return df.filter(F.col("vanity").isin(list(vanities)))


def panels_by_vanity(df: DataFrame, vanities, n: int = model.DEFAULT_SENSORS_PER_CHART,
                     by_channel: bool = True) -> DataFrame:
    """Panels per chosen vanity (a list, or a DataFrame of vanities); groups
    restart within each vanity and titles are those of the other panels (the
    ``vanity`` column tells the sections apart)."""
    sub = _of_vanities(df, vanities)
    keys = ["vanity", "ID", "type"]
    series = _series_flags(sub.filter(F.col("vanity").isNotNull()), keys)
    panel_keys = ["vanity", "group_no"] + (["type"] if by_channel else [])
    info = _panel_info(series, chart_groups(series, n, within="vanity"), ["vanity", "ID"], panel_keys, keys)
    return _finish(sub, info, keys, _title(by_channel), ["vanity"])


def _profiles(sparse: DataFrame, meta: DataFrame, frequency: str, func: str) -> DataFrame:
    """Per series and metadata row: finite points, and finite points that do not round to 0/1, of the
    gap-filled series, counted from its occupied bins.

    Gap bins are NULL and count for neither, except under ``sum``: there each is a finite
    0.0, as many as lie between the first and last bin less the occupied ones, and a metadata row that
    is there ``_mult`` times multiplies every value.
    """
    on = ["ID"]
    rows = sparse
    if func == "sum":
        on = ["ID", "_mult"]
        rows = sparse.join(meta.select(*on).distinct(), "ID").withColumn("value", F.col("value") * F.col("_mult"))
    finite = is_finite(F.col("value"))
    per = rows.groupBy("type", *on).agg(
        F.count(F.when(finite, 1)).alias("_fin"),
        F.count(F.when(finite & ~F.bround("value", 0).isin(0.0, 1.0), 1)).alias("_bad"),
        F.count(F.lit(1)).alias("_bins"), F.min("_bin").alias("_a"), F.max("_bin").alias("_z"))
    gaps = bin_number("_z", frequency) - bin_number("_a", frequency) + 1 - F.col("_bins")
    per = per.withColumn("_fin", F.col("_fin") + (gaps if func == "sum" else F.lit(0)))
    return per.select("type", *on, "_fin", "_bad").join(meta, on)


def resampled_panels(facts: DataFrame, meta: DataFrame, frequency: str, func: str = "mean",
                     n: int = model.DEFAULT_SENSORS_PER_CHART, by_channel: bool = True, vanities=None) -> DataFrame:
    """``panels_by_channel`` (or ``panels_all_channels``, or with ``vanities`` ``panels_by_vanity``) of
    ``resample_series(facts, meta, frequency, func)``, whose dense rows are made once, in the result.

    Three build steps, each of reduced rows: the occupied bins are written (the facts are read
    once), the sensors are numbered, and the table of series is written. Series without a panel
    are dropped before their bins are expanded.
    """
    ensure_checkpoint_dir(facts.sparkSession)
    m = complete_meta(meta)
    lead = []
    if vanities is not None:
        m = _of_vanities(m, vanities)
        lead = ["vanity"]
    sparse = sparse_bins(facts, frequency, func).checkpoint(eager=True)
    kinds = _profiles(sparse, m, frequency, func)
    groups = chart_groups(kinds, n, within="vanity" if lead else None)
    panel_keys = [*lead, "group_no"] + (["type"] if by_channel else [])
    placed = kinds.join(groups, [*lead, "ID"])
    flags = placed.groupBy(*panel_keys).agg(((F.sum("_fin") > 0) & (F.sum("_bad") == 0)).alias("is_binary"))
    info = (placed.join(flags, panel_keys).select("ID", "type", *model.META_ATTRS, "_mult", "group_no", "group_count", "is_binary")
            .checkpoint(eager=True))
    info = bounded_broadcast(info)
    charted = sparse.join(info.select("ID", "type"), ["ID", "type"], "left_semi")
    dense = gap_fill(charted, ["ID", "type"], "_bin", frequency, func, info=info, on=["ID", "type"])
    if func == "sum":
        dense = dense.withColumn("value", F.col("value") * F.col("_mult"))
    return _points(dense.withColumn("timestamp", bin_label(F.col("_bin"), frequency)), _title(by_channel), lead)
