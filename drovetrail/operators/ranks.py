"""Quantiles and ranks within groups, without one task sorting a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, fresh


def _same(by: list[str], a: DataFrame, b: DataFrame):
    return reduce(lambda c, k: c & a[k].eqNullSafe(b[f"__{k}"]), by, F.lit(True))


def _attach(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the further columns of their group, of which there is one row each; null keys are groups too."""
    renamed = groups.withColumnsRenamed({k: f"__{k}" for k in by})
    return rows.join(renamed, _same(by, rows, renamed), "left").drop(*(f"__{k}" for k in by))


def ahead(counts: DataFrame, by: list[str], value: str, n: str = "n", descending: bool = False) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over the lower (or higher) values of a group. Values are distinct within groups.

    Rows are put into ranges of (group, value); sums within a range are running ones, to which those of the ranges before
    are added. A group of any number of values is spread over as many tasks as it fills.
    """
    part = fresh("part")
    order = F.col(value).desc() if descending else F.col(value).asc()
    ranges = cut(counts.repartitionByRange(*by, order).withColumn(part, F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy(*by, part).agg(F.sum(n).alias("s")).select(*by, part, F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(*by, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = ranges.withColumn("before", F.coalesce(F.sum(n).over(within), F.lit(0)))
    return _attach(running, starts, [*by, part]).withColumn("before", F.col("before") + F.col("start")).drop(part, "start")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], n: str | None = None) -> DataFrame:
    """Per group: quantiles of a value, interpolated linearly between neighbours; nulls don't count.

    Rows are counted by value first (``n`` names a column that counts already), so what is sorted are distinct values, and
    those by ranges. Groups without values have no row.
    """
    if not by:
        return quantiles(rows.withColumn("__all", F.lit(1)), ["__all"], value, shares, n).drop("__all")
    size = F.sum(n) if n else F.count("*")
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(size.alias("n"))
    placed = ahead(counts, by, "v")
    totals = placed.groupBy(*by).agg(F.sum("n").alias("total"))
    whole = _attach(placed, totals, by)
    at = {name: F.col("total").cast("double").__sub__(1) * q for name, q in shares.items()}
    holds = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("v")))
    picked = whole.groupBy(*by, "total").agg(*(holds(f(p)).alias(f"{side}_{name}") for name, p in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))))
    between = lambda name, p: F.col(f"lo_{name}") + (F.col(f"hi_{name}") - F.col(f"lo_{name}")) * (p - F.floor(p))
    return picked.select(*by, *(between(name, p).alias(name) for name, p in at.items()))


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds the rank from the highest value down; equal values share the mean of their ranks, nulls have none."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    placed = ahead(counts, by, value, descending=True)
    ranks = placed.select(*by, value, (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    return _attach(rows, ranks, [*by, value])


def top_rows(rows: DataFrame, value: str, k: int, *ties: str) -> DataFrame:
    """The k rows of the highest value, of equal ones those that come first by the other columns: a top-k by heaps, no full sort."""
    return rows.orderBy(F.col(value).desc_nulls_last(), *ties).limit(k)


def nth_largest(rows: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    """The row of the n-th largest value (from 1); none if there are fewer."""
    worst = top_rows(rows, value, n, *ties)
    return worst.orderBy(F.col(value).asc_nulls_first(), *(F.col(t).desc() for t in ties)).limit(1).join(worst.agg(F.count("*").alias("__k")).filter(F.col("__k") == n), F.lit(True), "left_semi")


def in_numeric_order(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows in the order of ids read as numbers; ids that are none come last, by their text."""
    number = F.when(F.col(id_col).rlike("^[0-9]{1,18}$"), F.col(id_col)).cast("bigint")
    return rows.orderBy(number.asc_nulls_last(), id_col)
