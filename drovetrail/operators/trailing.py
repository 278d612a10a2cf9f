"""Rolling totals over trailing periods, days without activity included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_spans(daily: DataFrame, entity: str, day: str, value: str, periods: list[int]) -> DataFrame:
    """Spans of days over which an entity's trailing totals are constant: entity, first_day, last_day, total_<n>, average_<n>.

    Cumulative sums per entity give each total as a difference of two prefix values, at the day and n days before. A
    prefix changes only on days with activity, so the differences change only there and n days later: these days, with
    the prefixes carried forward, are all that is sorted, however long the calendar. Spans end when the next begins;
    the last of an entity begins where the longest period has passed, with totals of zero, and is left out. Averages are
    per calendar day: totals over the days of the period.

    ``daily`` has days as dates and may hold several rows of an entity and day. Null entities, days or values don't count.
    """
    shifts = [0, *sorted(periods)]
    per_day = daily.filter(F.col(entity).isNotNull() & F.col(day).isNotNull() & F.col(value).isNotNull()).groupBy(entity, day).agg(F.sum(value).alias("v"))
    change = per_day.select(F.col(entity), "v", F.col(day).alias("d0"), F.explode(F.array(*map(F.lit, shifts))).alias("shift"))
    points = change.groupBy(F.col(entity), F.date_add("d0", F.col("shift")).alias("first_day")).agg(*(F.coalesce(F.sum(F.when(F.col("shift") == s, F.col("v"))), F.lit(0)).alias(f"c{s}") for s in shifts))
    forward = Window.partitionBy(entity).orderBy("first_day")
    prefixes = points.select(
        entity, "first_day", F.date_sub(F.lead("first_day").over(forward), 1).alias("last_day"), *(F.sum(f"c{s}").over(forward).alias(f"p{s}") for s in shifts)
    )
    total = lambda n: F.col("p0") - F.col(f"p{n}")
    return prefixes.filter("last_day is not null").select(entity, "first_day", "last_day", *(total(n).alias(f"total_{n}") for n in periods), *((total(n) / n).alias(f"average_{n}") for n in periods))


def trailing_totals(daily: DataFrame, entity: str, day: str, value: str, periods: list[int], having: Column | None = None) -> DataFrame:
    """One row per entity and calendar day, idle ones included: entity, day, total_<n>, average_<n>.

    From an entity's first day until its longest period after the last activity has passed; later totals are zero.
    ``having`` keeps days by their totals and is applied to spans before they are spread over days.
    """
    spans = trailing_spans(daily, entity, day, value, periods)
    if having is not None:
        spans = spans.filter(having)
    return spans.select(entity, F.explode(F.sequence("first_day", "last_day")).alias("day"), *(f"{of}_{n}" for of in ("total", "average") for n in periods))
