"""Temporal summaries and temporal node properties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dateunits import bucket, floor_date
from ..runtime import cut
from .fixpoint import earliest_arrivals, strong_components
from .network import endpoints
from .ranks import quantiles


def _totals(pairs: DataFrame) -> tuple[float, float, float]:
    """Nodes, movements and edges of the whole network from its pairs per period; self-moves count for nodes only."""
    none = F.lit(0).cast("bigint")
    real = pairs.filter("from_id <> to_id").groupBy("from_id", "to_id").agg(F.sum("n").alias("n"))
    parts = endpoints(pairs).agg(F.count("*").alias("nodes")).select("nodes", none.alias("moves"), none.alias("edges")).unionAll(
        real.agg(F.coalesce(F.sum("n"), none).alias("moves"), F.count("*").alias("edges")).select(none, "moves", "edges")
    )
    return tuple(float(x) for x in parts.agg(F.sum("nodes"), F.sum("moves"), F.sum("edges")).first())


def activity(moves: DataFrame, start: Column, name: str = "period") -> DataFrame:
    """Active holdings, movements and edges of each period, with their shares of the whole and the density of edges.

    The movements are read once, into one row per period and pair, from which all counts follow. Periods without
    movements have no row; movements without date or an end don't count.
    """
    return _activity(cut(_dated(moves, start, name).groupBy(name, "from_id", "to_id").agg(F.count("*").alias("n"))), name)


def _dated(moves: DataFrame, start: Column, name: str) -> DataFrame:
    return moves.filter("date is not null and from_id is not null and to_id is not null").withColumn(name, start)


def _activity(pairs: DataFrame, name: str) -> DataFrame:
    nodes = endpoints(pairs, name).groupBy(name).agg(F.count("*").alias("holdings_active"))
    edges = pairs.filter("from_id <> to_id").groupBy(name).agg(F.sum("n").alias("movements"), F.count("*").alias("edges"))
    n, m, e = _totals(pairs)
    share = lambda c, of: F.try_divide(F.col(c).cast("double"), F.lit(of))
    joined = nodes.join(edges, name, "left").fillna(0, ["movements", "edges"])
    return joined.select(
        name, "holdings_active", share("holdings_active", n).alias("holdings_share"), "movements", share("movements", m).alias("movements_share"),
        "edges", share("edges", e).alias("edges_share"), share("edges", n * (n - 1)).alias("density"),
    )


def six_numbers(rows: DataFrame, by: str, value: str = "weight", n: str | None = None) -> DataFrame:
    """min, q1, median, mean, q3 and max of a value, quantiles interpolated linearly; nulls don't count.

    Rows are counted by value first (or by ``n`` already), so no task gets all values of a period.
    """
    size = F.sum(n) if n else F.count("*")
    counts = cut(rows.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("v")).agg(size.alias("n")))
    ends = counts.groupBy(by).agg(F.min("v").alias("w_min"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("w_mean"), F.max("v").alias("w_max"))
    q = quantiles(counts, [by], "v", {"w_q1": 0.25, "w_median": 0.5, "w_q3": 0.75}, "n")
    return ends.join(q, by).select(by, "w_min", "w_q1", "w_median", "w_mean", "w_q3", "w_max")


def summary(moves: DataFrame, unit: str) -> DataFrame:
    """Activity and the six numbers of movement weights per month, quarter or year.

    The movements are read once, into counts by period, pair and weight, from which both follow.
    """
    cells = cut(_dated(moves, floor_date(F.col("date"), unit), "period").groupBy("period", "from_id", "to_id", "weight").agg(F.count("*").alias("n")))
    pairs = cut(cells.groupBy("period", "from_id", "to_id").agg(F.sum("n").alias("n")))
    return _activity(pairs, "period").join(six_numbers(cells.filter("from_id <> to_id"), "period", n="n"), "period", "left")


def grid_summary(moves: DataFrame, days: int, whole_months: bool = True) -> DataFrame:
    """Activity of n-day periods from the first day, or from the first of its month."""
    first = moves.agg(F.min("date").alias("d")).first()["d"]
    if first is None:
        return activity(moves, F.col("date"))
    anchor = F.lit(first.replace(day=1) if whole_months else first)
    return activity(moves, bucket(F.col("date"), anchor, days))


def grids(moves: DataFrame, whole_months: bool = True) -> DataFrame:
    """The first days of all daily, n-day and calendar periods: grid, start."""
    span = moves.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    if whole_months:
        span = span.select(F.trunc("a", "month").alias("a"), F.last_day("b").alias("b"))
    parts = [span.select(F.lit(f"{n}days" if n > 1 else "daily").alias("grid"), F.explode(F.sequence("a", "b", F.expr(f"interval {n} days"))).alias("start")) for n in (1, 7, 14, 28, 84)]
    for unit, n in (("month", 1), ("quarter", 3), ("year", 12)):
        parts.append(span.select(F.lit(unit).alias("grid"), F.explode(F.sequence(floor_date(F.col("a"), unit), F.col("b"), F.expr(f"interval {n} months"))).alias("start")))
    return reduce(DataFrame.unionAll, parts)


def temporal_degree(moves: DataFrame, way: str, *by: str) -> DataFrame:
    """Distinct partners of each day, summed over days: way is all, in or out. Nodes without any have 0."""
    days = moves.filter("from_id <> to_id").select(*by, "date", "from_id", "to_id").distinct()
    sides = {"out": [("from_id",)], "in": [("to_id",)], "all": [("from_id",), ("to_id",)]}[way]
    ends = days.select(*by, F.explode(F.array(*(s[0] for s in sides))).alias("id"))
    degree = ends.groupBy(*by, "id").agg(F.count("*").alias("degree"))
    return endpoints(moves, *by).join(degree, [*by, "id"], "left").fillna(0, ["degree"])


def reach(moves: DataFrame, backward: bool = False, *by: str) -> DataFrame:
    """How many nodes each node reaches by movements of ascending days, itself included; each movement takes a day."""
    pairs = earliest_arrivals(moves, backward, by=by)
    return pairs.groupBy(*by, F.col("source").alias("id")).agg(F.count("*").alias("reach"))


def summarise_nodes(values: DataFrame, value: str, statistics: dict, *by: str, name_nodes: bool = False) -> DataFrame:
    """Statistics of a node property per network; with ``name_nodes`` also the ids of the highest.

    ``statistics`` maps names to functions of a column, or to shares, which stand for quantiles.
    """
    values = cut(values)
    made = values.groupBy(*by).agg(*(f(F.col(value)).alias(name) for name, f in statistics.items() if callable(f)), F.max(value).alias("__top"))
    if shares := {name: q for name, q in statistics.items() if not callable(q)}:
        made = made.join(quantiles(values, list(by), value, shares), list(by), "left")
    made = made.select(*by, *statistics, "__top")
    if not name_nodes:
        return made.drop("__top")
    top = values.join(made.select(*by, F.col("__top").alias(value)), [*by, value]).groupBy(*by).agg(F.array_sort(F.collect_set("id")).alias("max_nodes"))
    return made.drop("__top").join(top, list(by))


def aggregation_profile(moves: DataFrame, units: list[str]) -> DataFrame:
    """unit, period, active, edges, density, median_degree, gscc_share: the network of every period at every level of aggregation.

    All levels are networks side by side. Degrees count edges both ways; gscc_share is the largest strong component's share of the
    active nodes.
    """
    levels = F.array(*(F.struct(F.lit(u).alias("unit"), floor_date(F.col("date"), u).alias("period")) for u in units))
    real = moves.filter("date is not null and from_id <> to_id")
    edges = cut(real.select("from_id", "to_id", F.explode(levels).alias("l")).select("l.*", "from_id", "to_id").distinct())
    by = ["unit", "period"]
    degree = edges.select(*by, F.explode(F.array("from_id", "to_id")).alias("id")).groupBy(*by, "id").agg(F.count("*").alias("degree"))
    middle = summarise_nodes(degree, "degree", {"active": F.count, "median_degree": 0.5}, *by)
    size = edges.groupBy(*by).agg(F.count("*").alias("edges"))
    strong = strong_components(edges, tuple(by)).groupBy(*by, "component").agg(F.count("*").alias("k")).groupBy(*by).agg(F.max("k").alias("gscc"))
    dense = F.try_divide(F.col("edges").cast("double"), F.col("active") * (F.col("active") - 1))
    return middle.join(size, by).join(strong, by).select(*by, "active", "edges", dense.alias("density"), "median_degree", (F.col("gscc") / F.col("active")).alias("gscc_share"))
