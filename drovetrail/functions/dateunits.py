"""Calendar units: floors, grids of periods, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS_IN = {"month": 1, "bimonth": 2, "quarter": 3, "halfyear": 6, "year": 12}
_UNIT = re.compile(r"^\s*(?:(\d+)\s+)?(day|week|month|bimonth|quarter|season|halfyear|year)s?\s*$")


def parse_unit(unit: str) -> tuple[int, str]:
    """Count and unit of texts like "month" or "2 weeks"; ValueError for others."""
    m = _UNIT.match(unit)
    if not m or (m[1] is not None and int(m[1]) < 1):
        raise ValueError(f"not a date unit: {unit!r}")
    return int(m[1] or 1), m[2]


def floor_date(d: Column, unit: str, week_start: int = 7) -> Column:
    """The first day of the unit that d lies in. ``week_start``: 1 Monday to 7 Sunday.

    Several days are counted within the month, several months within the year (up to 12), several years from year 0;
    seasons begin in December, March, June and September. Several weeks can't be floored: ValueError.
    """
    n, name = parse_unit(unit)
    if name == "day":
        return d if n == 1 else F.make_date(F.year(d), F.month(d), F.floor((F.dayofmonth(d) - 1) / n).cast("int") * n + 1)
    if name == "week":
        if n > 1:
            raise ValueError("dates can't be rounded to several weeks")
        if not 1 <= week_start <= 7:
            raise ValueError("week_start must be from 1 (Monday) to 7 (Sunday)")
        return F.date_sub(d, F.pmod(F.weekday(d) - (week_start - 1) + 7, F.lit(7)))
    if name == "season":
        return F.add_months(floor_date(F.add_months(d, 1), "quarter"), -1)
    months = n * MONTHS_IN[name]
    if months > 12 and months % 12:
        raise ValueError(f"dates can't be rounded to {unit!r}")
    if months > 12:
        return F.make_date(F.floor(F.year(d) / (months // 12)).cast("int") * (months // 12), F.lit(1), F.lit(1))
    return F.make_date(F.year(d), F.floor((F.month(d) - 1) / months).cast("int") * months + 1, F.lit(1))


def bucket(d: Column, start: Column, days: int) -> Column:
    """The first day of the n-day period, counted from start, that d lies in: arithmetic, no join with periods."""
    return F.date_add(start, (F.floor(F.date_diff(d, start) / days) * days).cast("int"))


def label(d: Column, unit: str) -> Column:
    """Jan 2020, Q1 2020 or 2020."""
    if unit == "quarter":
        return F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string"))
    return F.date_format(d, {"month": "MMM yyyy", "year": "yyyy"}[unit])


def periods(moves: DataFrame, date: str, period: str) -> DataFrame:
    """period (from 1), start, end (not included) of all periods from the first date to the last.

    Counted days and weeks are anchored at the first date, other units at the floor of it.
    """
    n, name = parse_unit(period)
    span = moves.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    days = {"day": n, "week": 7 * n}.get(name)
    start = F.col("a") if days else floor_date(F.col("a"), name if name != "season" else "season")
    step = F.expr(f"interval {days} days" if days else f"interval {n * (3 if name == 'season' else MONTHS_IN[name])} months")
    grid = span.select(F.posexplode(F.sequence(start, F.col("b"), step)).alias("i", "start"))
    end = F.date_add("start", days) if days else F.add_months("start", n * (3 if name == "season" else MONTHS_IN[name]))
    return grid.select((F.col("i") + 1).alias("period"), "start", end.alias("end"))
