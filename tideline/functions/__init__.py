from tideline.functions.common import col_of
from tideline.functions.dates import (
    DEFAULT_DATE_FORMATS,
    MICROS_PER_DAY,
    day_diff,
    days_from,
    elapsed_days,
    interval_days,
    micros_between,
    shift_days,
    to_timestamp_lenient,
)
from tideline.functions.numbers import NUMBER_PATTERN, bar_label, is_number, to_number

__all__ = [
    "DEFAULT_DATE_FORMATS",
    "MICROS_PER_DAY",
    "NUMBER_PATTERN",
    "bar_label",
    "col_of",
    "day_diff",
    "days_from",
    "elapsed_days",
    "interval_days",
    "is_number",
    "micros_between",
    "shift_days",
    "to_number",
    "to_timestamp_lenient",
]
