"""Numbers from hand-entered text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedge.functions.missing import strip

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_float(c: Column) -> Column:
    """The finite number that a text holds, else null (suffixes such as 1d, nan and infinities are no numbers)."""
    s = strip(c.cast("string"))
    v = F.when(s.rlike(NUMBER), s.try_cast("double"))
    return F.when(F.abs(v) < float("inf"), v)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))
