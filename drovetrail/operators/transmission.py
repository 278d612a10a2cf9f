"""Probabilities of transmission between holdings, as sparse (i, j, p) tables: pairs that are absent have 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored
from .nearby import cell_meetings, great_circle

# Probability of local spread a day by distance in metres, [lower, upper).
LOCAL_TIERS = ((0.0, 100.0, 0.1), (100.0, 500.0, 0.006), (500.0, 1000.0, 0.002), (1000.0, 2000.0, 0.000015), (2000.0, None, 0.0))


def tier(metres: Column) -> Column:
    """The probability of the tier that a distance falls in."""
    out = F.lit(0.0)
    for low, high, p in reversed(LOCAL_TIERS):
        out = F.when((metres >= low) & (metres < high if high is not None else F.lit(True)), p).otherwise(out)
    return out


def average_daily_weight(moves: DataFrame, whole_months: bool = True) -> DataFrame:
    """from_id, to_id, daily: weight a day over the days spanned, by whole months or from first to last date."""
    span = moves.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = F.date_diff(F.last_day("b"), F.trunc("a", "month")) + 1 if whole_months else F.date_diff("b", "a") + 1
    n = span.select(days.alias("n")).first()["n"] or 1
    return moves.groupBy("from_id", "to_id").agg((F.sum("weight") / F.lit(float(n))).alias("daily"))


def movement_spread(moves: DataFrame, q: float, whole_months: bool = True) -> DataFrame:
    """i, j, p = 1 - (1 - q) ** (average daily weight); nothing from a holding to itself."""
    if not 0 <= q <= 1:
        raise ValueError("q must be a probability")
    daily = average_daily_weight(moves, whole_months).filter("from_id <> to_id")
    return daily.select(F.col("from_id").alias("i"), F.col("to_id").alias("j"), (1 - F.pow(F.lit(1.0 - q), F.col("daily"))).alias("p"))


def local_spread(holdings: DataFrame, key: str = "id", lon: str = "lon", lat: str = "lat", max_lat: float = 61.0) -> DataFrame:
    """i, j, p by the tier of the distance; pairs beyond the last tier and holdings without place have 0, so no row.

    Holdings meet in cells of a grid and pairs leave the join as they are returned: no pair is moved. A holding of several
    places counts at the least of them.
    """
    reach = max(low for low, _, p in LOCAL_TIERS if p == 0)
    known = holdings.select(F.col(key).alias("k"), F.col(lon).alias("x"), F.col(lat).alias("y")).dropna()
    at = stored(known.groupBy("k").agg(F.min(F.struct("x", "y")).alias("at")).select("k", "at.x", "at.y"), "places")
    metres = great_circle(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb"))
    met = cell_meetings(at, "x", "y", reach, max_lat).filter((F.col("ka") != F.col("kb")) & (metres < reach))  # others have 0 in any case
    spread = met.select("ka", "kb", "home", tier(metres).alias("p")).filter("p > 0")
    there, back = F.struct(F.col("ka").alias("i"), F.col("kb").alias("j")), F.struct(F.col("kb").alias("i"), F.col("ka").alias("j"))
    # Pairs of one cell meet both ways round, others once.
    return spread.select(F.explode(F.when(F.col("home"), F.array(there)).otherwise(F.array(there, back))).alias("e"), "p").select("e.i", "e.j", "p")


def combine_routes(routes: list[DataFrame]) -> DataFrame:
    """i, j, p = 1 - product of (1 - p) over all routes; the diagonal is left out."""
    if not routes:
        raise ValueError("no route of spread given")
    every = reduce(DataFrame.unionByName, routes).filter("i <> j")
    return every.groupBy("i", "j").agg((1 - F.product(1 - F.col("p"))).alias("p"))


def checked_route(route: DataFrame, name: str) -> DataFrame:
    """i, j, p of a table of probabilities; ValueError if columns are missing, a pair is repeated, or p isn't from 0 to 1."""
    if missing := [c for c in ("i", "j", "p") if c not in route.columns]:
        raise ValueError(f"{name} lacks the columns {', '.join(missing)}")
    bad = route.agg(F.count_if(F.col("p").isNull() | ~F.col("p").between(0, 1)).alias("p"), F.count_if(F.col("i").isNull() | F.col("j").isNull()).alias("ids")).first()
    twice = not route.groupBy("i", "j").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    if bad["p"] or bad["ids"] or twice:
        raise ValueError(f"{name}: {bad['p']} values are no probabilities, {bad['ids']} pairs lack an id{', pairs are repeated' if twice else ''}")
    return route.select("i", "j", "p")


def contact_matrix(moves: DataFrame, holdings: DataFrame | None = None, q: float = 0.3, others: list[DataFrame] | None = None, whole_months: bool = True) -> DataFrame:
    """i, j, p over movements, local spread if holdings are given, and further tables of probabilities, which are checked."""
    more = [checked_route(r, f"table {n}") for n, r in enumerate(others or [], 1)]
    routes = [movement_spread(moves, q, whole_months), *([local_spread(holdings)] if holdings is not None else []), *more]
    return combine_routes(routes)


def numbered_matrix(matrix: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The matrix with consecutive numbers instead of ids, and its key (old_id, new_id); ``ids`` (id) adds those without contacts."""
    from .privacy import pseudonym_key, replace_ids

    every = matrix.select(F.explode(F.array("i", "j")).alias("id"))
    key = pseudonym_key(every if ids is None else every.unionAll(ids.select("id")), "id")
    numbered = replace_ids(matrix, ["i", "j"], key)
    return numbered.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "p"), key


def infected_at_start(nodes: DataFrame, key: str = "id", chosen: list | None = None, share: float | None = None, seed: int = 1) -> DataFrame:
    """key, infected (0 or 1): the chosen ids, or those whose hash falls under a share."""
    from ..functions.noise import STEPS, draw

    if (chosen is None) == (share is None):
        raise ValueError("give chosen ids or a share")
    hit = F.col(key).isin(chosen) if chosen is not None else draw(F.col(key), seed, "infected") < F.lit(int(share * STEPS))
    return nodes.select(key, F.when(hit, 1).otherwise(0).alias("infected"))


def seir_events(moves: DataFrame, key: DataFrame) -> DataFrame:
    """Movements as external-transfer events of a compartment model: event, time (days from the first), node, dest, n, proportion, select, shift.

    ``key`` (old_id, new_id) numbers the holdings.
    """
    first = moves.agg(F.min("date").alias("d")).first()["d"]
    number = lambda c, name: key.select(F.col("old_id").alias(c), F.col("new_id").cast("int").alias(name))
    day = F.date_diff("date", F.lit(first).cast("date")) + 1
    numbered = moves.filter("from_id <> to_id").join(number("from_id", "node"), "from_id").join(number("to_id", "dest"), "to_id")
    return numbered.select(F.lit("extTrans").alias("event"), day.alias("time"), "node", "dest", F.col("weight").cast("int").alias("n"), F.lit(0.0).alias("proportion"), F.lit(1).alias("select"), F.lit(0).alias("shift"))


def seir_nodes(infected: DataFrame, key: DataFrame) -> DataFrame:
    """Starting state of each numbered holding: node, S, E, I, R."""
    return infected.join(key.withColumnRenamed("old_id", "id"), "id").select(F.col("new_id").cast("int").alias("node"), (1 - F.col("infected")).alias("S"), F.lit(0).alias("E"), F.col("infected").alias("I"), F.lit(0).alias("R"))
