"""Rolling mean over the last ``n`` rows of each series.

``avg(value)`` over ``ROWS BETWEEN n-1 PRECEDING AND CURRENT ROW`` per
``(ID, type)`` ordered by timestamp (tie: value): NULLs are skipped, one
non-null value is enough, ``n <= 0`` switches it off.

A plain window partitioned by series would put a whole series in one task, and
one sensor can hold a third of the data. The series is cut into blocks of
``block_rows`` consecutive rows and each block also receives the last ``n-1`` rows of the
block before it (a halo). Every block is then an independent window
partition; halo rows are dropped after the average. Every series goes this way, whatever its size.

The row index that defines blocks is built without a window over a series or a
day: rows are counted per (series, minute) (partial aggregate), minutes are summed up
within their day and days within their series (running sums over those counts), and each
row's index is its minute's offset plus its number within the minute. The largest single
task holds one minute of one series, or one block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK_ROWS = 1 << 16


def _row_offsets(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """``(_o0, _o1, ..., _off)``: rows of the series before each of its minutes."""
    before = lambda *part: Window.partitionBy(*part)
    upto = (Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, "_minute").agg(F.count(F.lit(1)).alias("_cnt")).withColumn("_day", F.to_date("_minute"))
    days = counts.groupBy(*keys, "_day").agg(F.sum("_cnt").alias("_cnt"))
    days = days.select(*[F.col(k).alias(f"_d{i}") for i, k in enumerate([*keys, "_day"])],
                       F.coalesce(F.sum("_cnt").over(before(*keys).orderBy("_day").rowsBetween(*upto)), F.lit(0)).alias("_days"))
    within = counts.withColumn("_in", F.coalesce(F.sum("_cnt").over(
        before(*keys, "_day").orderBy("_minute").rowsBetween(*upto)), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_d{i}")) for i, k in enumerate([*keys, "_day"])]
    return within.join(days, same).select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate([*keys, "_minute"])],
                                          (F.col("_days") + F.col("_in")).alias("_off"))


def rolling_mean(df: DataFrame, n: int, keys=("ID", "type"), ts: str = "timestamp",
                 value: str = "value", tie=("value",), block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Rolling mean of the last ``n`` rows per series (see module doc)."""
    if not n or n <= 1:
        return df
    keys = list(keys)
    tie = [t for t in tie if t != ts]
    cols = df.columns
    block = max(int(block_rows), n)
    halo = n - 1

    # ``window`` would drop rows without a timestamp, ``date_trunc`` would bring in the session's zone.
    d = df.withColumn("_minute", F.expr(f"make_timestamp_ntz(year(`{ts}`), month(`{ts}`), day(`{ts}`), hour(`{ts}`), minute(`{ts}`), 0)"))
    offsets = _row_offsets(d, keys, ts)
    okeys = [*keys, "_minute"]
    within = Window.partitionBy(*okeys).orderBy(F.col(ts), *[F.col(t) for t in tie])
    d = d.withColumn("_rn", F.row_number().over(within))
    cond = [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(okeys)]
    d = d.join(offsets, cond, "inner").select(*cols, "_rn", "_off")
    idx = F.col("_off") + F.col("_rn") - 1                      # 0-based index in the series
    home = F.floor(idx / block)
    in_tail = (idx % block) >= (block - halo)
    d = d.withColumn("_idx", idx).withColumn("_home", home)
    d = d.withColumn("_blk", F.explode(F.when(in_tail, F.array(F.col("_home"), F.col("_home") + 1))
                                       .otherwise(F.array(F.col("_home")))))
    frame = Window.partitionBy(*keys, "_blk").orderBy("_idx").rowsBetween(-halo, 0)
    rolled = d.withColumn("_rv", F.avg(F.col(value)).over(frame)).filter(F.col("_blk") == F.col("_home"))
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    out = rolled.withColumn(value, F.when(null_key, F.lit(None).cast("double")).otherwise(F.col("_rv")))
    return out.select(*cols)


def bin_number(ts, frequency: str):
    """Absolute number of the bin holding ``ts`` (consecutive bins differ by
    one), computed from calendar fields so no time zone is involved."""
    from sensorframe.functions.bins import freq as _freq
    ts = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    name = _freq(frequency).name
    if name == "15min":
        return days * 96 + F.hour(ts) * 4 + F.floor(F.minute(ts) / 15)
    if name == "hour":
        return days * 24 + F.hour(ts)
    if name == "day":
        return days
    if name == "week":
        return F.floor((days - 4) / 7)
    return F.year(ts).cast("long") * 12 + F.month(ts)


def rolling_mean_dense(df: DataFrame, n: int, frequency: str, keys=("ID", "type"), ts: str = "timestamp",
                       value: str = "value", fill: str | None = None) -> DataFrame:
    """Rolling mean over the last ``n`` rows of a gap-filled (dense) resampled
    frame, rows in order of their bin. A sensor with several metadata rows has
    several rows per bin; they count one by one, ordered by value (NULLs last).
    A resampled series holds at most (time span / bin step) rows per metadata row
    whatever the raw volume, so one window partition per series is bounded.

    With ``fill`` (the resampling function) ``df`` holds the occupied bins only
    (``resample_series(..., fill=False)``); the gaps are filled here and the result is that of
    the dense frame, which is neither shuffled nor sorted.
    """
    if fill is not None:
        return _filled_rolling_mean(df, n, frequency, list(keys), ts, value, fill)
    if not n or n <= 1:
        return df
    keys = list(keys)
    cols = df.columns
    d = df.withColumn("_idx", bin_number(ts, frequency))
    frame = Window.partitionBy(*keys).orderBy("_idx", F.col(value).asc_nulls_last()).rowsBetween(-(n - 1), 0)
    rolled = d.withColumn("_rv", F.avg(F.col(value)).over(frame))
    null_key = F.lit(False)
    for c in keys:
        null_key = null_key | F.col(c).isNull()
    out = rolled.withColumn(value, F.when(null_key, F.lit(None).cast("double")).otherwise(F.col("_rv")))
    return out.select(*cols)


def _filled_rolling_mean(df: DataFrame, n: int, frequency: str, keys: list[str], ts: str, value: str, func: str) -> DataFrame:
    """``rolling_mean_dense`` from the occupied bins. A gap bin's mean differs from the fill
    value only if it is one of the first ``n - 1`` of its gap, so those are made first and
    averaged; the others are made last, in the result's own plan.

    Every series of ``keys`` has the same metadata rows in all its bins, ``_copies`` of them, so a
    row's place in the dense series is known without the rows between.
    """
    from sensorframe.functions.bins import bin_label, bin_start
    from sensorframe.operators.resample import gap_fill
    cols = df.columns
    series = [*keys, *[c for c in cols if c not in (*keys, ts, value)]]
    rows = df.select(*series, bin_start(F.col(ts), frequency).alias("_bin"), value)
    if n and n > 1:
        # One exchange serves all windows, here and in gap_fill.
        near = gap_fill(rows.repartition(*keys), series, "_bin", frequency, func, value, most=n - 1)
        near = near.withColumn("_idx", bin_number("_bin", frequency))
        one_bin = Window.partitionBy(*keys, "_idx")
        near = near.withColumns({"_nth": F.row_number().over(one_bin.orderBy(F.col(value).asc_nulls_last())),
                                 "_copies": F.count(F.lit(1)).over(one_bin)})
        near = near.withColumn("_at", F.col("_idx") * F.col("_copies") + F.col("_nth"))
        one = Window.partitionBy(*keys)
        frame = one.orderBy("_at").rangeBetween(-(n - 1), 0)
        if func == "sum":  # bins that are not made hold 0.0 and count
            mean = F.sum(value).over(frame) / F.least(F.lit(n), F.col("_at") - F.min("_at").over(one) + 1)
        else:
            mean = F.avg(value).over(frame)
        rows = near.withColumn(value, mean).select(*series, "_bin", value)
    dense = gap_fill(rows, series, "_bin", frequency, func, value)
    return dense.withColumn(ts, bin_label(F.col("_bin"), frequency)).select(*cols)
