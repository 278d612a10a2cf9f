"""Contact chains: movements that may have carried something to or from a root holding."""

from __future__ import annotations

import datetime
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut


def windows(t_end: list | None = None, days: list | None = None, in_begin=None, in_end=None, out_begin=None, out_end=None) -> list[tuple]:
    """(in_begin, in_end, out_begin, out_end) of each root: from {t_end, days} or from four dates, never both.

    Windows are inclusive: from t_end - days to t_end. ValueError for other combinations.
    """
    four = [in_begin, in_end, out_begin, out_end]
    if (t_end is not None or days is not None) == any(x is not None for x in four):
        raise ValueError("give either t_end and days, or all of in_begin, in_end, out_begin and out_end")
    as_date = lambda x: x if isinstance(x, datetime.date) else datetime.date.fromisoformat(x)
    if t_end is not None or days is not None:
        if t_end is None or days is None:
            raise ValueError("t_end and days belong together")
        if any(isinstance(t, (int, float)) for t in t_end):
            raise ValueError("t_end must hold dates")
        if any(isinstance(d, bool) or not isinstance(d, int) or d < 0 for d in days):
            raise ValueError("days must be whole numbers from 0")
        ends = [as_date(t) for t in t_end]
        return [(e - datetime.timedelta(n), e, e - datetime.timedelta(n), e) for e in ends for n in days]
    if any(x is None for x in four) or len({len(x) for x in four}) != 1:
        raise ValueError("in_begin, in_end, out_begin and out_end must have the same length")
    made = [tuple(map(as_date, w)) for w in zip(*four, strict=True)]
    if any(a > b or c > d for a, b, c, d in made):
        raise ValueError("a window ends before it begins")
    return made


def roots_table(spark: SparkSession, roots: list[str], spans: list[tuple]) -> DataFrame:
    """root and its windows; a single window serves all roots."""
    if len(spans) not in (1, len(roots)):
        raise ValueError("as many windows as roots are needed, or one")
    rows = list(dict.fromkeys((r, *w) for r, w in zip(roots, spans * len(roots) if len(spans) == 1 else spans, strict=False)))
    return spark.createDataFrame(rows, "root string, in_begin date, in_end date, out_begin date, out_end date")


def trace(moves: DataFrame, roots: DataFrame, max_distance: int | None = None) -> DataFrame:
    """root, direction, source, destination, date, distance: every movement on a contact chain, by ids and date.

    Outgoing from a root within its window: all movements from a node to nodes not yet on the path, not before the
    path's arrival there; the earliest one carries the path on. Same-day movements follow each other. Ingoing is the
    mirror image in time. A movement may come out at several distances. Paths of equal nodes, end and arrival count once;
    without ``max_distance`` (0 allows no movement) paths are followed until they end by themselves, as no node is visited twice.
    """
    found = []
    for direction, a, b, sign in (("out", "from_id", "to_id", 1), ("in", "to_id", "from_id", -1)):
        hops = cut(moves.filter("from_id <> to_id and date is not null").select(F.col(a).alias("u"), F.col(b).alias("v"), (F.unix_date("date") * sign).alias("t")).distinct())
        begin, end = (f"{direction}_begin", f"{direction}_end") if sign == 1 else ("in_end", "in_begin")
        front = roots.select("root", F.col("root").alias("node"), (F.unix_date(begin) * sign).alias("at"), (F.unix_date(end) * sign).alias("until"), F.array("root").alias("path")).distinct()
        distance = 1
        while max_distance is None or distance <= max_distance:
            step = front.join(hops, front["node"] == hops["u"]).filter((F.col("t") >= F.col("at")) & (F.col("t") <= F.col("until")) & ~F.array_contains("path", F.col("v")))
            step = cut(step.select("root", "u", "v", "t", "until", "path"))
            if step.isEmpty():
                break
            found.append(step.select("root", F.lit(direction).alias("direction"), F.col("u" if sign == 1 else "v").alias("source"), F.col("v" if sign == 1 else "u").alias("destination"), F.date_from_unix_date(F.col("t") * sign).alias("date"), F.lit(distance).alias("distance")).distinct())
            front = step.groupBy("root", F.col("v").alias("node"), "until", F.array_sort(F.array_append("path", F.col("v"))).alias("path")).agg(F.min("t").alias("at")).select("root", "node", "at", "until", "path")
            distance += 1
    empty = roots.select("root", F.lit("").alias("direction"), F.lit("").alias("source"), F.lit("").alias("destination"), F.lit(None).cast("date").alias("date"), F.lit(0).alias("distance")).limit(0)
    for f in found:
        empty = empty.unionAll(f)
    return empty


def trace_fast(moves: DataFrame, roots: DataFrame) -> DataFrame:
    """root, direction, source, destination, date: movements on contact chains, by times of arrival instead of paths.

    A movement is on a chain if it leaves a holding not before something from the root can have come there (ingoing: the mirror
    image), within the window, and doesn't go back to the root. That takes one time per root and holding, however many
    paths there are. Of what ``trace`` gives nothing is missing; movements back to a holding that all paths passed already
    come out too, and there are no distances.
    """
    found = None
    for direction, a, b, sign in (("out", "from_id", "to_id", 1), ("in", "to_id", "from_id", -1)):
        hops = cut(moves.filter("from_id <> to_id and date is not null").select(F.col(a).alias("u"), F.col(b).alias("v"), (F.unix_date("date") * sign).alias("t")).distinct())
        begin, end = (f"{direction}_begin", f"{direction}_end") if sign == 1 else ("in_end", "in_begin")
        keys = ["root", "until", "node"]
        front = cut(roots.select("root", (F.unix_date(end) * sign).alias("until"), F.col("root").alias("node"), (F.unix_date(begin) * sign).alias("at")).groupBy(*keys).agg(F.min("at").alias("at")))
        known = front
        ahead = lambda df: df.join(hops, df["node"] == hops["u"]).filter((F.col("t") >= F.col("at")) & (F.col("t") <= F.col("until")) & (F.col("v") != F.col("root")))
        while not front.isEmpty():  # ends: times only get earlier
            new = ahead(front).groupBy("root", "until", F.col("v").alias("node")).agg(F.min("t").alias("new"))
            merged = cut(known.join(new, keys, "full").select(*keys, F.least("at", "new").alias("at"), (F.col("new") < F.coalesce("at", F.lit(2**31 - 1))).alias("better")))
            known, front = merged.drop("better"), merged.filter("better").drop("better")
        own = ahead(known).select("root", F.lit(direction).alias("direction"), F.col("u" if sign == 1 else "v").alias("source"), F.col("v" if sign == 1 else "u").alias("destination"), F.date_from_unix_date(F.col("t") * sign).alias("date")).distinct()
        found = own if found is None else found.unionAll(own)
    return found


def traced_moves(chains: DataFrame, moves: DataFrame) -> DataFrame:
    """The movements on chains with their own columns and the direction; repeated movements come out repeatedly.

    Every movement of a chain stays, with nulls if ``moves`` lacks it. If the chains have weights, they are matched as well.
    """
    keys = [F.col("source").alias("from_id"), F.col("destination").alias("to_id"), "date", *(["weight"] if "weight" in chains.columns else [])]
    on = chains.select("root", "direction", *keys).distinct()
    return on.join(moves, ["from_id", "to_id", "date", *(["weight"] if "weight" in chains.columns else [])], "left")


@dataclass(frozen=True)
class Contacts:
    """What tracing gives: chains, movements and holdings on them, and counts per root and direction; area totals if areas were given."""

    chains: DataFrame
    moves: DataFrame
    holdings: DataFrame
    counts: DataFrame
    areas_in: DataFrame | None = None
    areas_out: DataFrame | None = None


def chain_counts(chains: DataFrame, roots: DataFrame) -> DataFrame:
    """root, direction, movements, holdings, farthest: what was found of each root; 0 where nothing was."""
    other = F.when(F.col("direction") == "out", F.col("destination")).otherwise(F.col("source"))
    farthest = F.max("distance") if "distance" in chains.columns else F.lit(None).cast("int")
    found = chains.groupBy("root", "direction").agg(F.count_distinct("source", "destination", "date").alias("movements"), F.count_distinct(F.when(other != F.col("root"), other)).alias("holdings"), farthest.alias("farthest"))
    both = roots.select("root").distinct().select("root", F.explode(F.array(F.lit("in"), F.lit("out"))).alias("direction"))
    return both.join(found, ["root", "direction"], "left").fillna(0, ["movements", "holdings"])


def trace_contacts(
    moves: DataFrame, holdings: DataFrame, roots: list[str], t_end: list | None = None, days: list | None = None, in_begin=None, in_end=None, out_begin=None, out_end=None,
    max_distance: int | None = None, areas_of: DataFrame | None = None, areas: DataFrame | None = None, fast: bool = False,
) -> Contacts | None:
    """Contact chains of some roots in one call; None, with a warning, if there are none.

    Windows are given as ``windows`` takes them; one serves all roots. Roots given repeatedly count once, with a warning. With
    ``areas_of`` (id, area_id) and ``areas`` (area_id) the weights moved between areas along chains are summed. ``fast`` goes
    by times of arrival instead of paths, which dense networks and long windows need; it knows no ``max_distance``.
    """
    if not roots:
        raise ValueError("at least one root is needed")
    if fast and max_distance is not None:
        raise ValueError("fast tracing has no distances")
    spans = windows(t_end, days, in_begin, in_end, out_begin, out_end)
    table = roots_table(moves.sparkSession, roots, spans)
    if len(set(roots)) < len(roots):
        warnings.warn("some roots are given repeatedly; each counts once per window", stacklevel=2)
    chains = cut(trace_fast(moves, table) if fast else trace(moves, table, max_distance))
    if chains.isEmpty():
        warnings.warn("no contact chains were found", stacklevel=2)
        return None
    on = traced_moves(chains, moves)
    totals = lambda side: area_totals(on, areas_of, areas, side) if areas_of is not None and areas is not None else None
    return Contacts(chains, on, traced_holdings(chains, holdings), chain_counts(chains, table), totals("to_area"), totals("from_area"))


def traced_holdings(chains: DataFrame, holdings: DataFrame) -> DataFrame:
    """id, root, direction (root, in, out) and the holding's columns, null where it isn't known."""
    ends = chains.select("root", "direction", F.when(F.col("direction") == "out", F.col("destination")).otherwise(F.col("source")).alias("id")).filter("id <> root").distinct()
    own = chains.select("root", F.lit("root").alias("direction"), F.col("root").alias("id")).distinct()
    return own.unionAll(ends).join(holdings, "id", "left")


def area_totals(moves: DataFrame, areas_of: DataFrame, areas: DataFrame, side: str) -> DataFrame:
    """area_id, weight and movements between areas, by the area of one side (from_area, to_area); areas without have nulls.

    ``areas_of`` has id and area_id. Movements within an area or with an end in none don't count.
    """
    located = moves.join(areas_of.select(F.col("id").alias("from_id"), F.col("area_id").alias("from_area")), "from_id", "left").join(areas_of.select(F.col("id").alias("to_id"), F.col("area_id").alias("to_area")), "to_id", "left")
    sums = located.filter("from_area <> to_area").groupBy(F.col(side).alias("area_id")).agg(F.sum("weight").alias("weight"), F.count("*").alias("moves"))
    return areas.join(sums, "area_id", "left")


def move_lines(moves: DataFrame, holdings: DataFrame) -> DataFrame:
    """Movements with the line from origin to destination (two points), where both places are known."""
    at = F.struct("lon", "lat")
    a = holdings.select(F.col("id").alias("from_id"), at.alias("a"))
    b = holdings.select(F.col("id").alias("to_id"), at.alias("b"))
    return moves.join(a, "from_id", "left").join(b, "to_id", "left").filter("a.lon is not null and b.lon is not null").withColumn("line", F.array("a", "b")).drop("a", "b")


def parallel_offsets(moves: DataFrame, order: list[str]) -> DataFrame:
    """Movements of equal ends side by side: edge_no, width (2 to the number of digits less 1) and offset.

    The offset is minus the running sum of widths plus one, up to the middle of the own width.
    """
    w = Window.partitionBy("from_id", "to_id").orderBy(*order)
    width = F.pow(F.lit(2.0), F.floor(F.log10(F.col("weight"))))
    wide = moves.withColumn("width", width)
    running = F.sum(F.col("width") + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return wide.withColumn("edge_no", F.row_number().over(w)).withColumn("offset", -(running - (F.col("width") + 1) / 2))


def width_label(width: Column) -> Column:
    """The weights that a line's width stands for: 2**k is 10**k to 10**(k+1) - 1."""
    k = F.log2(width)
    whole = lambda c: F.round(c).cast("bigint").cast("string")
    return F.concat(whole(F.pow(F.lit(10.0), k)), F.lit(" to "), whole(F.pow(F.lit(10.0), k + 1) - 1))


def colour_domain(df: DataFrame, column: str, domain: tuple[float, float] | None = None) -> tuple[float, float]:
    """The range of a column, or the given one if it covers it; ValueError if it doesn't."""
    r = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if domain is None:
        return r["a"], r["b"]
    if r["a"] is not None and (r["a"] < domain[0] or r["b"] > domain[1]):
        raise ValueError(f"{column} has values outside {domain}")
    return domain


def popup_text(traced: DataFrame, fields: list[str]) -> DataFrame:
    """id, direction and one text per holding for a map: its part in the chain, then its known fields."""
    part = F.when(F.col("direction") == "root", "Root holding").when(F.col("direction") == "in", "Ingoing contact").otherwise("Outgoing contact")
    lines = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}: "), F.col(f).cast("string"))) for f in fields]
    return traced.select("id", "direction", F.concat_ws("<br>", part, F.col("id"), *lines).alias("text"))
