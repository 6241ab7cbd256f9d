"""Column expressions: time bins, labels, text formats, type and channel maps."""

from sensorframe.functions.bins import bin_label, bin_start, bin_step, freq
from sensorframe.functions.expressions import (
    binary_flag, ceil_div, channel_map_column, channels_of, date_range_text, is_finite,
    nan_to_null, series_label, str_or_empty, target_type_name, thousands_dot,
)

__all__ = ["bin_label", "bin_start", "bin_step", "freq", "binary_flag", "ceil_div",
           "channel_map_column", "channels_of", "date_range_text", "is_finite", "nan_to_null",
           "series_label", "str_or_empty", "target_type_name", "thousands_dot"]
