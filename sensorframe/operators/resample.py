"""Resampling with dense gap filling.

Semantics (pandas ``groupby(keys).resample(freq)``):

* rows whose group key is NULL are dropped (facts without metadata vanish);
* each series gets *every* bin from its first to its last bin, empty bins
  included: NULL for mean/max/min/median, 0.0 for sum (also for a bin whose
  values are all NULL);
* the series axis is not padded to the query range.

Plan shape: one partial/final aggregation on ``(keys, bin)`` (map-side
combine, so a hot sensor is pre-reduced before the shuffle; the median is put
together from several tasks, see ``quantiles``), then one window on the
*aggregated* rows to find each bin's successor. Every stretch from a bin to its
successor is cut at fixed calendar spans, the pieces are dealt by (series, span), and
``sequence`` + ``explode`` emits their bins, so a series over decades expands in
many tasks. The shuffles carry sparse rows only. No self-join, no calendar table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe import model
from sensorframe.functions.bins import bin_label, bin_start, bin_step, freq
from sensorframe.operators.enrich import meta_keyed
from sensorframe.operators.joins import bounded_broadcast
from sensorframe.operators.quantiles import median_by
from sensorframe.operators.smooth import bin_number

AGG_FUNCS = tuple(model.AGG_FUNCTION_NAMES)


def _agg_expr(func: str, value: str = "value") -> Column:
    v = F.col(value)
    if func == "mean":
        return F.avg(v)
    if func == "sum":
        return F.coalesce(F.sum(v), F.lit(0.0))
    if func == "max":
        return F.max(v)
    if func == "min":
        return F.min(v)
    raise ValueError(f"no plain aggregate for {func!r}")


def _sparse(binned: DataFrame, keys, func: str) -> DataFrame:
    """``(keys, value)`` of the occupied bins; the reference's last branch: anything else is the median."""
    if func in ("mean", "sum", "max", "min"):
        return binned.groupBy(*keys).agg(_agg_expr(func).alias("value"))
    return median_by(binned, keys)


#: Days of the pieces that a series' axis is cut into, by bin: some thousands of bins each.
#: Weeks and months are not cut, as a century has a few thousand of them.
SPAN_DAYS = {"15min": 32, "hour": 128, "day": 4096}


def _fill_value(func: str) -> Column:
    return F.lit(0.0) if func == "sum" else F.lit(None).cast("double")


def gap_fill(sparse: DataFrame, keys, bin_col: str, frequency: str, func: str,
             value: str = "value", info: DataFrame | None = None, on=None, most: int | None = None) -> DataFrame:
    """Expand sparse ``(keys, bin, value)`` to every bin between each series'
    first and last bin. Gap bins get the function's empty value. The columns of
    ``info`` are joined by ``on`` (some of the keys) before any bin is made, so that
    the join and its shuffles see occupied bins only. With ``most`` only the first
    ``most`` bins of every gap are made."""
    keys = list(keys)
    step = bin_step(frequency)
    span = SPAN_DAYS.get(freq(frequency).name)
    w = Window.partitionBy(*keys).orderBy(bin_col)
    nxt = F.lead(bin_col).over(w)
    rows = sparse.withColumn("_last", F.coalesce(nxt - step, F.col(bin_col)))
    if most is not None:
        made = F.least(F.lit(most), bin_number("_last", frequency) - bin_number(bin_col, frequency))
        rows = rows.withColumn("_last", F.col(bin_col) + step * made)
    if span and most is None:
        number = lambda c: F.floor(F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) / span).cast("int")
        begin = lambda p: F.date_add(F.lit("1970-01-01").cast("date"), p * span).cast("timestamp_ntz")
        rows = rows.withColumn("_span", F.explode(F.sequence(number(F.col(bin_col)), number(F.col("_last")))))
        rows = rows.withColumns({"_from": F.greatest(F.col(bin_col), begin(F.col("_span"))),
                                 "_to": F.least(F.col("_last"), begin(F.col("_span") + 1) - step)})
    else:
        rows = rows.withColumns({"_span": F.lit(0), "_from": F.col(bin_col), "_to": F.col("_last")})
    extra = []
    if info is not None:
        extra = [c for c in info.columns if c not in on]
        rows = rows.join(info, on)
    # The expansion multiplies rows after this shuffle, so its size says
    # little about the work behind it: fix the partition count (AQE does not
    # coalesce an explicit count) instead of letting small sparse input
    # collapse into a few tasks.
    spark = sparse.sparkSession
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    parts = int(conf) if str(conf).isdigit() else spark.sparkContext.defaultParallelism
    if most is None:
        rows = rows.repartition(parts, *keys, "_span")
    seq = rows.select(*keys, *extra, value, F.col(bin_col).alias("_own"),
                      F.explode(F.sequence(F.col("_from"), F.col("_to"), step)).alias("_bin"))
    return seq.select(*keys, *extra, F.col("_bin").alias(bin_col),
                      F.when(F.col("_bin") == F.col("_own"), F.col(value)).otherwise(_fill_value(func)).alias(value))


def resample(df: DataFrame, frequency: str, func: str = "mean", keys=None,
             ts: str = "timestamp", value: str = "value", fill: bool = True) -> DataFrame:
    """Resample any frame with a timestamp and a value per ``keys``.

    Output: ``keys + [timestamp, value]`` with bin labels as timestamps.
    """
    keys = list(model.SERIES_KEYS if keys is None else keys)
    clean = df.filter(F.col(ts).isNotNull())
    for k in keys:
        clean = clean.filter(F.col(k).isNotNull())
    binned = clean.select(*keys, bin_start(F.col(ts), frequency).alias("_bin"), F.col(value).alias("value"))
    sparse = _sparse(binned, [*keys, "_bin"], func)
    dense = gap_fill(sparse, keys, "_bin", frequency, func) if fill else sparse
    return dense.select(*keys, bin_label(F.col("_bin"), frequency).alias("timestamp"), "value")


def complete_meta(meta: DataFrame) -> DataFrame:
    """Metadata rows without NULLs as ``(ID, attributes, _mult)``; _mult counts equal rows."""
    m = meta_keyed(meta).dropna(subset=["ID", *model.META_ATTRS])
    return m.groupBy("ID", *model.META_ATTRS).agg(F.count(F.lit(1)).alias("_mult"))


def sparse_bins(facts: DataFrame, frequency: str, func: str = "mean") -> DataFrame:
    """``(ID, type, _bin, value)``: the occupied bins of every series."""
    f = facts.filter(F.col("timestamp").isNotNull() & F.col("ID").isNotNull() & F.col("type").isNotNull())
    binned = f.select("ID", "type", bin_start(F.col("timestamp"), frequency).alias("_bin"), "value")
    return _sparse(binned, ["ID", "type", "_bin"], func)


def resample_series(facts: DataFrame, meta: DataFrame, frequency: str, func: str = "mean",
                    fill: bool = True) -> DataFrame:
    """Enrich-then-resample, computed as aggregate-then-enrich.

    Equal to ``resample(enrich(facts, meta), ...)``, but the aggregation runs
    on the four narrow fact columns, series without metadata are dropped, and metadata (a
    dimension) is joined to the occupied bins before the gap fill, by broadcast when its
    size check allows it and by sort-merge otherwise. Duplicate metadata rows are kept as a
    multiplicity so ``sum`` still counts each copy, as the fan-out join would.
    """
    sparse = sparse_bins(facts, frequency, func)
    m = bounded_broadcast(complete_meta(meta))
    if fill:
        # Series without metadata go before their successors are looked up.
        known = sparse.join(m.select("ID"), "ID", "left_semi")
        joined = gap_fill(known, ["ID", "type"], "_bin", frequency, func, info=m, on=["ID"])
    else:
        joined = sparse.join(m, "ID", "inner")
    if func == "sum":
        joined = joined.withColumn("value", F.col("value") * F.col("_mult"))
    return joined.select(*model.SERIES_KEYS, bin_label(F.col("_bin"), frequency).alias("timestamp"), "value")


def assign_bins(df: DataFrame, frequency: str, ts: str = "timestamp", name: str = "bin") -> DataFrame:
    """Label of the bin of each row (no aggregation)."""
    return df.withColumn(name, bin_label(bin_start(F.col(ts), frequency), frequency))
