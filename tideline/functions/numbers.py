"""Numeric parsing and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.common import ColumnOrName, col_of

# Fixed value: the shape of a plain decimal number a lenient numeric parse
# accepts (optional sign, digits with an optional point, optional exponent,
# or an infinity), surrounding blanks allowed.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[Ii][Nn][Ff]([Ii][Nn][Ii][Tt][Yy])?)\s*$"


def to_number(c: ColumnOrName) -> Column:
    """String to double, NULL when the text is not a number.

    ``try_cast`` alone also accepts Java literal suffixes (``'1d'``, ``'1f'``),
    which would turn a bar label such as ``12d`` back into a number; the regex
    guard rejects them.  NaN text becomes NULL, like a missing value.
    """
    s = col_of(c).cast("string")
    parsed = F.when(s.rlike(NUMBER_PATTERN), F.trim(s).try_cast("double"))
    return F.nanvl(parsed, F.lit(None).cast("double"))


def is_number(c: ColumnOrName) -> Column:
    """True when :func:`to_number` yields a value, NULL for NULL input."""
    return F.when(col_of(c).isNotNull(), to_number(c).isNotNull())


def bar_label(c: ColumnOrName, suffix: str = "d") -> Column:
    """P10: text shown at the end of a bar, e.g. ``12d``; NULL stays NULL."""
    return F.concat(col_of(c).cast("string"), F.lit(suffix))
