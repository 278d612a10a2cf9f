"""Static network measures that are compositions of joins and aggregations.

``edges`` are simplified (one row per pair, no self-moves) with from_id, to_id and weight; ``by`` names columns that tell
networks apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut
from . import shared
from .network import endpoints
from .ranks import average_ranks, quantiles


def strength(edges: DataFrame, *by: str) -> DataFrame:
    """id, out_strength, in_strength, out_degree, in_degree: weighted and plain degrees, 0 where there are no edges."""
    side = lambda c, way: F.struct(F.col(c).alias("id"), *(F.when(F.lit(way == w), v).otherwise(F.lit(z)).alias(n) for n, w, v, z in (("o", "out", F.col("weight"), 0.0), ("i", "in", F.col("weight"), 0.0), ("od", "out", F.lit(1), 0), ("id_", "in", F.lit(1), 0))))
    ends = edges.select(*by, F.explode(F.array(side("from_id", "out"), side("to_id", "in"))).alias("e")).select(*by, "e.*")
    return ends.groupBy(*by, "id").agg(F.sum("o").alias("out_strength"), F.sum("i").alias("in_strength"), F.sum("od").alias("out_degree"), F.sum("id_").alias("in_degree"))


def strength_rank(edges: DataFrame, *by: str) -> DataFrame:
    """id, gm (geometric mean of both strengths), rank (1 for the highest; equal ones share the mean of their ranks)."""
    gm = strength(edges, *by).select(*by, "id", F.sqrt(F.col("in_strength") * F.col("out_strength")).alias("gm"))
    return average_ranks(cut(gm), list(by), "gm", "rank")


def pearson(x: Column, y: Column) -> Column:
    """Correlation from sums; null where either has no variance."""
    n, sx, sy = F.count(x + y).cast("double"), F.sum(x), F.sum(y)
    vx, vy = n * F.sum(x * x) - sx * sx, n * F.sum(y * y) - sy * sy
    return F.when((vx > 1e-9 * n * F.sum(x * x)) & (vy > 1e-9 * n * F.sum(y * y)), (n * F.sum(x * y) - sx * sy) / F.sqrt(vx * vy))


def assortativity(edges: DataFrame, *by: str, weighted: bool = True) -> DataFrame:
    """Correlation over edges of the tail's out-strength and the head's in-strength (or degrees); edges count alike."""
    s = strength(edges, *by)
    out, into = ("out_strength", "in_strength") if weighted else ("out_degree", "in_degree")
    tails = s.select(*by, F.col("id").alias("from_id"), F.col(out).cast("double").alias("x"))
    heads = s.select(*by, F.col("id").alias("to_id"), F.col(into).cast("double").alias("y"))
    both = edges.join(tails, [*by, "from_id"]).join(heads, [*by, "to_id"])
    return both.groupBy(*by).agg(pearson(F.col("x"), F.col("y")).alias("assortativity"))


def loyalty(moves: DataFrame, period: str) -> DataFrame:
    """period_a, period_b, loyalty: of the edges of one period, the share that another has too; 0 where none."""
    edges = moves.filter("from_id <> to_id").select(period, "from_id", "to_id").distinct()
    size = edges.groupBy(period).agg(F.count("*").alias("n"))
    # Every edge's periods, at most as many as there are periods, meet in pairs.
    lists = edges.groupBy("from_id", "to_id").agg(F.collect_set(period).alias("ps"))
    common = lists.select(F.explode("ps").alias("period_a"), "ps").select("period_a", F.explode("ps").alias("period_b")).groupBy("period_a", "period_b").agg(F.count("*").alias("shared"))
    every = size.select(F.lit(1).alias("k"), period).groupBy("k").agg(F.collect_set(period).alias("ps"))
    grid = every.select(F.explode("ps").alias("period_a"), "ps").select("period_a", F.explode("ps").alias("period_b"))
    full = grid.join(common, ["period_a", "period_b"], "left").join(size.withColumnRenamed(period, "period_a"), "period_a")
    return full.select("period_a", "period_b", (F.coalesce("shared", F.lit(0)) / F.col("n")).alias("loyalty"))


def density(edges: DataFrame, *by: str) -> DataFrame:
    """nodes, edges and density: edges over possible ordered pairs."""
    n = endpoints(edges, *by).groupBy(*by).agg(F.count("*").alias("nodes"))
    e = edges.groupBy(*by).agg(F.count("*").alias("edges"))
    return n.join(e, list(by)).select(*by, "nodes", "edges", F.try_divide(F.col("edges").cast("double"), F.col("nodes") * (F.col("nodes") - 1)).alias("density"))


def degree_ccdf(edges: DataFrame) -> DataFrame:
    """way (all, in, out), degree, nodes of that degree, share of nodes of at least that degree."""
    s = strength(edges)
    ways = F.array(*(F.struct(F.lit(w).alias("way"), d.cast("bigint").alias("degree")) for w, d in (("all", F.col("in_degree") + F.col("out_degree")), ("in", F.col("in_degree")), ("out", F.col("out_degree")))))
    counts = s.select(F.explode(ways).alias("w")).select("w.*").groupBy("way", "degree").agg(F.count("*").alias("nodes"))
    down = Window.partitionBy("way").orderBy(F.col("degree").desc())
    return counts.select("way", "degree", "nodes", (F.sum("nodes").over(down) / F.sum("nodes").over(Window.partitionBy("way"))).alias("ccdf"))


def reciprocity(edges: DataFrame, *by: str) -> DataFrame:
    """Share of edges whose reverse is an edge too."""
    back = edges.select(*by, F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.lit(1).alias("back"))
    return edges.join(back, [*by, "from_id", "to_id"], "left").groupBy(*by).agg((F.count("back") / F.count("*")).alias("reciprocity"))


def undirected(edges: DataFrame, *by: str) -> DataFrame:
    """u < v: distinct pairs, whatever the direction."""
    return edges.select(*by, F.least("from_id", "to_id").alias("u"), F.greatest("from_id", "to_id").alias("v")).filter("u < v").distinct()


def transitivity(edges: DataFrame, *by: str) -> DataFrame:
    """triangles, triples and transitivity (3 triangles / connected triples) of the undirected network.

    Edges point from the node of lower degree to that of higher, so wedges are opened at nodes with few such edges and a
    hub's neighbours never meet in pairs.
    """
    pairs = undirected(edges, *by)
    degree = pairs.select(*by, F.explode(F.array("u", "v")).alias("id")).groupBy(*by, "id").agg(F.count("*").alias("d"))
    ends = pairs.join(degree.select(*by, F.col("id").alias("u"), F.col("d").alias("du")), [*by, "u"]).join(degree.select(*by, F.col("id").alias("v"), F.col("d").alias("dv")), [*by, "v"])
    low = F.col("du") <= F.col("dv")
    arcs = ends.select(*by, F.when(low, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("b"))
    wedges = arcs.join(arcs.select(*by, "a", F.col("b").alias("c")), [*by, "a"]).filter("b < c")
    closed = wedges.select(*by, F.col("b").alias("u"), F.col("c").alias("v")).join(pairs, [*by, "u", "v"])
    triples = degree.groupBy(*by).agg(F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("triples"))
    if not by:
        n = closed.count()
        return triples.select(F.lit(n).cast("bigint").alias("triangles"), "triples", F.try_divide(F.lit(3.0 * n), F.col("triples")).alias("transitivity"))
    triangles = closed.groupBy(*by).agg(F.count("*").alias("triangles"))
    full = triples.join(triangles, list(by), "left").fillna(0, ["triangles"])
    return full.select(*by, "triangles", "triples", F.try_divide(F.col("triangles") * 3.0, F.col("triples")).alias("transitivity"))


def jaccard(edges: DataFrame, *by: str, digits: int | None = None) -> DataFrame:
    """a < b, jaccard: shared neighbours over all neighbours of both (undirected); pairs without shared ones are left out.

    Edges may be repeated. Pairs come from the tasks that find them, without being moved (``shared``).
    """
    return shared.jaccard(edges, by, digits)


def isolated_share(edges: DataFrame, *by: str) -> DataFrame:
    """share: of the active nodes, those whose mean Jaccard similarity with others is 0.

    Such a node shares no neighbour with any other: all its neighbours have it as their only one. So degrees suffice, no pairs are made.
    """
    pairs = undirected(edges, *by)
    near = pairs.select(*by, F.col("u").alias("id"), F.col("v").alias("n")).unionAll(pairs.select(*by, F.col("v").alias("id"), F.col("u").alias("n")))
    degree = near.groupBy(*by, F.col("id").alias("n")).agg(F.count("*").alias("d"))
    most = near.join(degree, [*by, "n"]).groupBy(*by, "id").agg(F.max("d").alias("d"))
    return most.groupBy(*by).agg((F.count_if(F.col("d") == 1) / F.count("*")).alias("isolated_share"))


def degree_medians(edges: DataFrame, *by: str) -> DataFrame:
    """way (all, in, out) and the median degree of the active nodes."""
    s = strength(edges, *by)
    ways = F.array(*(F.struct(F.lit(w).alias("way"), d.cast("bigint").alias("degree")) for w, d in (("all", F.col("in_degree") + F.col("out_degree")), ("in", F.col("in_degree")), ("out", F.col("out_degree")))))
    return quantiles(s.select(*by, F.explode(ways).alias("w")).select(*by, "w.*"), [*by, "way"], "degree", {"median": 0.5})


def component_sizes(components: DataFrame, *by: str) -> DataFrame:
    """How many components, and their largest, median and 99 % size; connected: only one."""
    sizes = cut(components.groupBy(*by, "component").agg(F.count("*").alias("size")))
    q = quantiles(sizes, list(by), "size", {"median": 0.5, "q99": 0.99})
    return sizes.groupBy(*by).agg(F.count("*").alias("components"), F.max("size").alias("largest"), (F.count("*") == 1).alias("connected")).join(q, list(by)).select(*by, "components", "largest", "median", "q99", "connected")


def normalised_betweenness(measures: DataFrame, *by: str) -> DataFrame:
    """Betweenness over the (n - 1)(n - 2) ordered pairs of other nodes; null in networks of fewer than three nodes."""
    n = F.count("*").over(Window.partitionBy(*by))
    return measures.withColumn("betweenness", F.try_divide(F.col("betweenness"), (n - 1) * (n - 2)))


def distances(measures: DataFrame, *by: str) -> DataFrame:
    """mean_distance over ordered pairs of different nodes joined by a path, and diameter; null where there is no path."""
    return measures.groupBy(*by).agg(F.try_divide(F.sum("total"), F.sum("reached")).alias("mean_distance"), F.max("farthest").alias("diameter"))


def random_edges(spark: SparkSession, nodes: int, edges: int, seed: int = 1) -> DataFrame:
    """A random directed network of so many nodes and about so many distinct edges, to compare measures with: from_id, to_id, weight."""
    if nodes < 2:
        raise ValueError("at least two nodes are needed")
    a = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("a")), F.lit(nodes))
    step = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("b")), F.lit(nodes - 1)) + 1
    return spark.range(edges).select(a.cast("string").alias("from_id"), F.pmod(a + step, F.lit(nodes)).cast("string").alias("to_id"), F.lit(1.0).alias("weight")).distinct()
