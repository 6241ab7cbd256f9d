"""Time bins of the resampler.

All bins are computed on ``timestamp_ntz`` without passing through a session
time zone: fixed-length bins use ``window`` (which keeps NTZ), months use
date arithmetic. Labels follow the reference's resampling rules:

* 15 minutes, hour, day: left-closed bins labelled by their start;
* week: Monday 00:00 to Sunday 23:59:59, labelled Sunday 00:00;
* month: calendar month labelled by its last day 00:00.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorframe import model


@dataclass(frozen=True)
class Freq:
    name: str
    step: str            # interval literal usable in ``sequence``
    window: str | None   # window duration for fixed-length bins
    start_offset: str | None = None


# Weeks start on Monday; 1970-01-05 is the first Monday after the epoch.
_FREQS = {
    "15min": Freq("15min", "INTERVAL 15 MINUTES", "15 minutes"),
    "hour": Freq("hour", "INTERVAL 1 HOUR", "1 hour"),
    "day": Freq("day", "INTERVAL 1 DAY", "1 day"),
    "week": Freq("week", "INTERVAL 7 DAYS", "7 days", "4 days"),
    "month": Freq("month", "INTERVAL 1 MONTH", None),
}
# The user-facing frequency names (model.FREQUENCY_NAMES), in order, map to
# the bins above.
_ALIASES = dict(zip(model.FREQUENCY_NAMES, ["15min", "hour", "day", "week", "month"]))


def freq(name: str) -> Freq:
    key = _ALIASES.get(name, name)
    try:
        return _FREQS[key]
    except KeyError as exc:
        raise ValueError(f"unknown resampling frequency {name!r}") from exc


def bin_start(ts: Column | str, frequency: str) -> Column:
    """Start of the bin holding ``ts`` (timestamp_ntz)."""
    f = freq(frequency)
    ts = F.col(ts) if isinstance(ts, str) else ts
    if f.window is None:
        return F.trunc(ts, "month").cast("timestamp_ntz")
    if f.start_offset:
        return F.window(ts, f.window, f.window, f.start_offset).start
    return F.window(ts, f.window).start


def bin_label(start: Column | str, frequency: str) -> Column:
    """Label shown for a bin given its start."""
    f = freq(frequency)
    start = F.col(start) if isinstance(start, str) else start
    if f.name == "week":
        return start + F.expr("INTERVAL 6 DAYS")
    if f.name == "month":
        return F.last_day(start).cast("timestamp_ntz")
    return start


def bin_step(frequency: str) -> Column:
    return F.expr(freq(frequency).step)
