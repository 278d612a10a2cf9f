"""Points near other points, and the region that contains a point."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, fresh, salted_lookup

EARTH_RADIUS = 6_371_000.0
#: Places of one grid cell that are compared in one task; cells with more are divided among several.
CELL_PLACES = 2048
#: Corners of regions that share a column of the map, on average: columns are as narrow as that takes.
COLUMN_CORNERS = 4


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the sphere (haversine form)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def cell_meetings(points: DataFrame, lon: str, lat: str, metres: float, max_lat: float, cell_places: int = CELL_PLACES) -> DataFrame:
    """Every column of the points twice, ending in a and b, and ``home``: pairs whose latitudes and longitudes don't rule out that they are near.

    Points are put into grid cells twice as wide as the distance, whose columns go round the globe; each meets its own
    cell (``home``: those pairs come both ways round, and a point meets itself) and, of half of its neighbours, those
    whose border is near (these pairs come once). The points of a crowded cell are divided into parts of about
    ``cell_places``, and those of the cells around it meet every part, so no task gets a cell's square. Points are read
    three times.
    """
    own = points.columns
    angle = metres / EARTH_RADIUS
    step = math.degrees(angle) * 1.0001
    # How far apart in longitude two places of that distance can be, at the highest latitude.
    bound = math.sin(min(angle, math.pi / 2)) / max(math.cos(math.radians(max_lat)), 1e-9)
    wide = math.degrees(math.asin(bound)) * 1.0001 if bound < 1 else 180.0
    n_columns = max(1, math.floor(180 / wide))
    n_columns = n_columns if n_columns > 2 else 1  # neighbours to either side must differ
    column, row = 360 / n_columns, 2 * step
    wrap = lambda c: F.pmod(c, F.lit(n_columns))
    gx, gy = (F.col(lon) + 180) / column, F.col(lat) / row
    at = points.withColumns({"cx": wrap(F.floor(gx)), "cy": F.floor(gy)})
    east, north, south = (F.floor(gx) + 1 - gx) * column <= wide, (F.floor(gy) + 1 - gy) * row <= step, (gy - F.floor(gy)) * row <= step
    near = ((0, 0, F.lit(True)), (0, 1, north), *(((1, -1, east & south), (1, 0, east), (1, 1, east & north)) if n_columns > 1 else ()))
    around = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))) for i, j, c in near)))
    ends = lambda end: [F.col(c).alias(f"{c}{end}") for c in own]
    left = at.select(*ends("a"), F.explode(around).alias("o"), "cx", "cy").withColumns({"home": (F.col("o.i") == 0) & (F.col("o.j") == 0), "cx": wrap(F.col("cx") + F.col("o.i")), "cy": F.col("cy") + F.col("o.j")}).drop("o")
    right = at.select(*ends("b"), "cx", "cy")
    crowded = cut(at.groupBy("cx", "cy").agg(F.count("*").alias("n")).filter(F.col("n") > cell_places).select("cx", "cy", F.ceil(F.col("n") / cell_places).cast("int").alias("parts")))
    cell = ["cx", "cy"]
    if not crowded.isEmpty():
        parts = F.coalesce("parts", F.lit(1))
        left = left.join(crowded, cell, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        right = right.join(crowded, cell, "left").withColumn("part", F.pmod(F.xxhash64(*(f"{c}b" for c in own)), parts).cast("int")).drop("parts")
        cell = [*cell, "part"]
    # The differences in latitude and longitude rule out most candidates, without trigonometry.
    apart = F.abs(F.col(f"{lon}a") - F.col(f"{lon}b"))
    return left.join(right, cell).filter((F.abs(F.col(f"{lat}a") - F.col(f"{lat}b")) <= step) & ((apart <= wide) | (apart >= 360 - wide))).drop(*cell)


def near_places(places: DataFrame, lon: str, lat: str, metres: float, max_lat: float, cell_places: int = CELL_PLACES) -> DataFrame:
    """xa, ya, xb, yb of different places at most so many metres apart, each pair once; ``max_lat`` bounds the latitude's absolute value.

    ``places`` are distinct; they meet in cells of a grid (``cell_meetings``).
    """
    at = places.select(F.col(lon).alias("x"), F.col(lat).alias("y"))
    # A pair of one cell meets both ways round.
    before = (F.col("xa") < F.col("xb")) | ((F.col("xa") == F.col("xb")) & (F.col("ya") < F.col("yb")))
    first, second = F.struct(F.col("xa").alias("x"), F.col("ya").alias("y")), F.struct(F.col("xb").alias("x"), F.col("yb").alias("y"))
    other = (F.col("xa") != F.col("xb")) | (F.col("ya") != F.col("yb"))
    met = cell_meetings(at, "x", "y", metres, max_lat, cell_places).filter(other & (great_circle(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb")) <= metres))
    ordered = met.select(F.when(before, first).otherwise(second).alias("a"), F.when(before, second).otherwise(first).alias("b"))
    return ordered.select(F.col("a.x").alias("xa"), F.col("a.y").alias("ya"), F.col("b.x").alias("xb"), F.col("b.y").alias("yb")).distinct()


def near_pairs(points: DataFrame, key: str, lon: str, lat: str, metres: float, max_lat: float) -> DataFrame:
    """key_a < key_b of points at most so many metres apart; ``max_lat`` bounds the latitude's absolute value.

    Distinct places are compared (``near_places``); the points of a place come in after that, so copies of a place cost
    nothing while distances are measured. Null keys or coordinates don't count, repeated points count once.
    """
    members = points.select(F.col(key).alias("k"), F.col(lon).alias("x"), F.col(lat).alias("y")).dropna().distinct()
    places = members.select("x", "y").distinct()
    pairs = near_places(places, "x", "y", metres, max_lat)
    shared = members.groupBy("x", "y").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    a = members.select(F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("k").alias("ka"))
    b = members.select(F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("k").alias("kb"))
    met = pairs.unionAll(shared).join(a, ["xa", "ya"]).join(b, ["xb", "yb"]).filter("ka <> kb")
    return met.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def trapezoids(regions: DataFrame, region: str, ring: str, column_width: float) -> DataFrame:
    """Trapezoidal decomposition of region boundaries: one row per slab, with its trapezoids in ascending order.

    Every edge goes to the columns of the map that it crosses, which are built independently of each other. Within a
    column, the corners cut the plane into vertical slabs in which edges don't cross; each region's edges in a slab,
    ordered by height, pair into trapezoids (even-odd rule, so rings may be concave). An edge's ends are cuts themselves,
    so it finds the numbers of its first and last slab and is spread over just those. Result: col, nth (number of the slab
    in its column), xa, xb (where it begins and ends) and traps (region, and the two lines as height at 0 and slope). Rings
    that are null or have no extent give nothing; vertical edges need no trapezoid.
    """
    w = F.lit(column_width)
    corners = regions.filter(F.col(region).isNotNull()).select(F.col(region).alias("region"), F.posexplode(F.arrays_zip(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))).alias("p"), F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))).alias("q"))).alias("i", "e"))
    p, q = F.col("e.p"), F.col("e.q")
    ends = lambda f: F.when(p["lon"] < q["lon"], p[f]).otherwise(q[f]), lambda f: F.when(p["lon"] < q["lon"], q[f]).otherwise(p[f])
    edges = corners.filter(p.isNotNull() & q.isNotNull() & (p["lon"] != q["lon"])).select("region", "i", ends[0]("lon").alias("x1"), ends[0]("lat").alias("y1"), ends[1]("lon").alias("x2"), ends[1]("lat").alias("y2"))
    edges = edges.withColumn("m", (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).withColumn("h", F.col("y1") - F.col("m") * F.col("x1"))
    placed = edges.withColumn("col", F.explode(F.sequence(F.floor(F.col("x1") / w), F.floor(F.col("x2") / w))))
    # A column reaches a little beyond its own points, as a product of the width may be rounded past some of them.
    edge = max(column_width * 1e-9, 1e-12)
    left, right = F.col("col") * w - edge, (F.col("col") + 1) * w + edge
    start, end = F.when(F.floor(F.col("x1") / w) < F.col("col"), left).otherwise(F.col("x1")), F.when(F.floor(F.col("x2") / w) > F.col("col"), right).otherwise(F.col("x2"))
    placed = cut(placed.withColumns({"from": start, "to": end}))
    ordered = Window.partitionBy("col").orderBy("xa")
    cuts = placed.select("col", F.explode(F.array("from", "to")).alias("xa")).distinct().withColumns({"xb": F.lead("xa").over(ordered), "nth": F.row_number().over(ordered)})
    number = lambda c: cuts.select("col", F.col("xa").alias(c), F.col("nth").alias(f"nth_{c}"))
    spread = placed.join(number("from"), ["col", "from"]).join(number("to"), ["col", "to"]).filter("nth_from < nth_to").withColumn("nth", F.explode(F.sequence(F.col("nth_from"), F.col("nth_to") - 1)))
    crossing = spread.join(cuts, ["col", "nth"]).withColumn("at", F.col("h") + F.col("m") * (F.col("xa") + F.col("xb")) / 2)
    pairs = Window.partitionBy("col", "nth", "region").orderBy("at", "m", "i")
    traps = crossing.select("col", "nth", "xa", "xb", "region", "at", "h", "m", F.row_number().over(pairs).alias("k"), F.lead("h").over(pairs).alias("h2"), F.lead("m").over(pairs).alias("m2")).filter("k % 2 = 1 and h2 is not null")
    return traps.groupBy("col", "nth", "xa", "xb").agg(F.array_sort(F.collect_list(F.struct("at", "region", "h", "m", "h2", "m2"))).alias("traps"))


def _last_at_most(values: Column, longest: int, height) -> Column:
    """Binary search: the 0-based index of the last entry whose height is at most 0 more than asked; -1 if none.

    Goes ahead by powers of two, from the greatest that the ``longest`` list takes down to 1.
    """
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(longest.bit_length()))))
    return F.aggregate(steps, F.lit(-1), lambda at, k: F.when((at + k < F.size(values)) & height(F.get(values, at + k)), at + k).otherwise(at))


def column_width(regions: DataFrame, ring: str) -> float:
    """A width of columns in which COLUMN_CORNERS corners lie on average."""
    lon = F.transform(ring, lambda p: p["lon"])
    r = regions.agg(F.sum(F.size(ring)).alias("n"), F.min(F.array_min(lon)).alias("a"), F.max(F.array_max(lon)).alias("b")).first()
    return (r["b"] - r["a"]) * COLUMN_CORNERS / r["n"] if r["n"] and r["a"] is not None and r["b"] > r["a"] else 1.0


def locate(points: DataFrame, regions: DataFrame, region: str, ring: str, lon: str, lat: str, width: float | None = None) -> DataFrame:
    """Points (all columns) with the ``region`` whose ring contains them; points in none are left out.

    Slabs are rows, distributed by column and number. A point finds its slab among the few of its column, whose
    beginnings alone travel for that, and then meets the trapezoids of just that slab, among which it finds its own by
    binary search. Both lookups spread crowded columns and slabs over tasks. A point on a shared border belongs to the
    region above or to the right. Null coordinates are in no region. ``width`` is that of a column of the map in degrees;
    by default it follows from the number of corners.
    """
    width = width or column_width(regions, ring)
    x, y = F.col(lon), F.col(lat)
    col, slab, own = fresh("col"), fresh("slab"), list(points.columns)
    placed = points.filter(x.isNotNull() & y.isNotNull()).withColumn(col, F.floor(x / F.lit(width)))
    crowd = placed.groupBy(F.col(col).alias("col")).agg(F.count("*").alias("n"))
    slabs = cut(trapezoids(regions, region, ring, width).join(crowd, "col").withColumn("slab", F.struct("col", "nth")))
    beginnings = slabs.groupBy(F.col("col").alias(col), "n").agg(F.array_sort(F.collect_list(F.struct("xa", "xb", F.col("slab").alias("id")))).alias("slabs"))
    met = salted_lookup(placed, beginnings, col, F.struct(*own), "n", "inner")
    met = met.withColumn(slab, F.try_element_at(F.filter("slabs", lambda s: (s["xa"] <= x) & (s["xb"] > x)), F.lit(-1))["id"]).select(*own, slab)
    # A slab has at most the points of its column, so it is spread at least as wide as it needs.
    met = salted_lookup(met.filter(F.col(slab).isNotNull()), slabs.select(F.col("slab").alias(slab), "traps", "n"), slab, F.struct(*own), "n", "inner")
    trap, traps = fresh("trap"), F.col("traps")
    longest = slabs.agg(F.max(F.size("traps")).alias("n")).first()["n"] or 1
    met = met.withColumn(trap, F.get(traps, _last_at_most(traps, longest, lambda t: t["h"] + t["m"] * x <= y)))
    return met.filter(F.col(trap)["h2"] + F.col(trap)["m2"] * x > y).select(*own, F.col(trap)["region"].alias("region"))
