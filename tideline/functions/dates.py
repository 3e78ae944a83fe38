"""Day arithmetic (P4, P6, P7, P11, P12) as built-in Column expressions.

All of these stay inside whole-stage codegen.  The difference functions work
on ``timestamp``, ``timestamp_ntz`` and ``date`` inputs alike (dates count as
midnight) because they go through ``timestampdiff(MICROSECOND, ...)``; with the
session zone pinned to UTC the result does not depend on the machine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.common import ColumnOrName, col_of

MICROS_PER_DAY = 86_400_000_000

# String date layouts tried after Spark's own ISO parsing, in order.
DEFAULT_DATE_FORMATS: tuple[str, ...] = ("yyyyMMdd", "ddMMMyyyy", "M/d/yyyy", "yyyy/M/d")
# The text shape each layout can parse.  A parse attempt that fails costs an
# exception inside Spark, so text of another shape is not tried at all.
FORMAT_SHAPES: dict[str, str] = {
    "yyyyMMdd": r"^[0-9]{8}$",
    "ddMMMyyyy": r"^[0-9]{2}[A-Za-z]{3}[0-9]{4}$",
    "M/d/yyyy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    "yyyy/M/d": r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$",
}
# ISO text must open with a four-digit year; Spark alone would also read
# "12345" as the year 12345.
ISO_PREFIX = r"^[0-9]{4}($|[-T ])"


def micros_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``end - start`` in whole microseconds (bigint)."""
    return F.timestamp_diff("MICROSECOND", col_of(start), col_of(end))


def day_diff(start: ColumnOrName, end: ColumnOrName, inclusive: bool = False) -> Column:
    """Whole days from ``start`` to ``end``, rounded toward minus infinity.

    23:00 to 01:00 the next day is 0 days; 23:00 back to 12:00 the same day is
    -1.  ``inclusive`` adds one so that the reference day itself is day 1.
    ``datediff`` (calendar days) and ``timestampdiff(DAY)`` (toward zero) give
    other answers for sub-day and negative spans.
    """
    days = _whole_days(micros_between(start, end))
    return days + F.lit(1) if inclusive else days


def _whole_days(micros: Column) -> Column:
    """Floor of microseconds to days in integers: exact for any span."""
    day = F.lit(MICROS_PER_DAY).cast("long")
    return F.call_function("div", micros - F.pmod(micros, day), day)


def elapsed_days(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Fractional days from ``start`` to ``end`` (double)."""
    return micros_between(start, end) / F.lit(float(MICROS_PER_DAY))


def shift_days(c: ColumnOrName, n: int | ColumnOrName, kind: str = "timestamp") -> Column:
    """Move a date or timestamp by ``n`` days.

    ``kind='date'`` keeps a ``date`` result (``date_add``); otherwise the result
    is a timestamp of the input's flavour (``timestampadd(DAY, ...)``).
    """
    amount = F.lit(n) if isinstance(n, int) else col_of(n)
    if kind == "date":
        return F.date_add(col_of(c), amount)
    return F.timestamp_add("DAY", amount, col_of(c))


def to_timestamp_lenient(
    c: ColumnOrName, formats: tuple[str, ...] = DEFAULT_DATE_FORMATS
) -> Column:
    """Parse a string as a timestamp, or NULL when no layout fits.

    ISO forms (``2020``, ``2020-01``, ``2020-01-01``, ``2020-01-01T10:00``) are
    tried first, then each of ``formats``.  Never raises under ANSI mode.
    Parsing follows the session time zone (UTC under :mod:`tideline.session`).
    """
    s = F.trim(col_of(c).cast("string"))
    iso = F.when(s.rlike(ISO_PREFIX), F.try_to_timestamp(s))
    tries = [iso]
    for f in formats:
        parsed = F.try_to_timestamp(s, F.lit(f))
        shape = FORMAT_SHAPES.get(f)
        tries.append(F.when(s.rlike(shape), parsed) if shape else parsed)
    return F.coalesce(*tries)


def interval_days(c: ColumnOrName) -> Column:
    """Whole days of a day-time interval (e.g. ``end - start``), floored.

    ``-11 hours`` is day -1, as for :func:`day_diff`.  Works on
    ``INTERVAL DAY TO SECOND`` values of any precision.
    """
    iv = col_of(c)
    # total microseconds: the interval added to a fixed instant, measured back
    anchor = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = micros_between(anchor, anchor + iv)
    return _whole_days(micros)


def days_from(reference: ColumnOrName, c: ColumnOrName, inclusive: bool = False) -> Column:
    """Express a datetime ``c`` as study days from ``reference``."""
    return day_diff(reference, c, inclusive=inclusive)
