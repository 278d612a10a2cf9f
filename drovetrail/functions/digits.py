"""Holding numbers: the digits of a county-parish-holding (CPH) reference, however it is spelled."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    """The ASCII digits of a value, everything else removed; null stays null."""
    return F.regexp_replace(value, "[^0-9]+", "")


def nine_digits(value: Column) -> Column:
    """The digits if there are exactly nine of them, else null."""
    d = digits(value)
    return F.when(F.length(d) == 9, d)
