"""Iteration to a fixpoint over tables: reachability, components, closures.

Every loop ends when a round changes nothing; none has a number of rounds. Only what a round adds is written to the
shared folder; what is known is the union of these deltas, compacted now and then.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, stored
from . import digraphs
from .network import endpoints

#: Deltas that are kept apart before they are merged into one table.
DELTAS = 8
#: Steps that are taken between two looks at whether anything is left: a job for each would cost more than the steps.
STEPS = 3


def _compact(deltas: list[DataFrame], keys: list[str], least: str | None = None) -> list[DataFrame]:
    """The same deltas, merged into one table if they have become many; of equal keys the least value counts."""
    if len(deltas) < DELTAS:
        return deltas
    every = reduce(DataFrame.unionAll, deltas)
    return [cut(every.groupBy(*keys).agg(F.min(least).alias(least)) if least else every)]


def earliest_arrivals(moves: DataFrame, backward: bool = False, sources: DataFrame | None = None, by: tuple[str, ...] = (), step: int = 1) -> DataFrame:
    """source, node and the earliest day by which a movement chain from source can have brought something there.

    A chain's next movement leaves ``step`` days after the last or later. A source holds what it has from the start
    (null arrival). ``backward`` follows movements against their direction and time. Semi-naive: each round extends only
    the pairs whose arrival improved; rounds are cut from their lineage in the shared folder. One pair per source and
    node is kept, so memory is the size of the result.
    """
    sign = -1 if backward else 1
    a, b = ("to_id", "from_id") if backward else ("from_id", "to_id")
    hops = moves.filter("from_id <> to_id and date is not null").select(*by, F.col(a).alias("u"), F.col(b).alias("v"), (F.unix_date("date") * sign).alias("t")).distinct()
    hops = cut(hops)
    nodes = endpoints(moves, *by).withColumnRenamed("id", "source")
    if sources is not None:
        nodes = nodes.join(sources.select("source").distinct(), "source", "left_semi").select(*by, "source")
    own = nodes.select(*by, "source", F.col("source").alias("node"), F.lit(None).cast("int").alias("t"))
    pair = [*by, "source", "node"]
    front = cut(hops.join(nodes.withColumnRenamed("source", "u"), [*by, "u"]).groupBy(*by, F.col("u").alias("source"), F.col("v").alias("node")).agg(F.min("t").alias("t")))
    deltas = [front]
    known = lambda: reduce(DataFrame.unionAll, deltas).groupBy(*pair).agg(F.min("t").alias("t"))
    while not front.isEmpty():  # ends: arrivals only get earlier, and there are as many days as movements have
        near = front.select(*by, "source", F.col("node").alias("u"), F.col("t").alias("at"))
        found = near.join(hops, [*by, "u"]).filter((F.col("t") >= F.col("at") + step) & (F.col("v") != F.col("source"))).groupBy(*by, "source", F.col("v").alias("node")).agg(F.min("t").alias("new"))
        front = cut(found.join(known(), pair, "left").filter(F.col("t").isNull() | (F.col("new") < F.col("t"))).select(*pair, F.col("new").alias("t")))
        deltas = _compact([*deltas, front], pair, "t")
    return own.unionAll(known().filter("source <> node").withColumn("t", F.col("t") * sign))


def arrival_tree(moves: DataFrame, sources: DataFrame) -> DataFrame:
    """source, node, arrival, via: the earliest day of each node reached and the node it comes from then (the least of several)."""
    known = cut(earliest_arrivals(moves, sources=sources))
    hops = moves.filter("from_id <> to_id").select(F.col("from_id").alias("via"), F.col("to_id").alias("node"), F.unix_date("date").alias("t")).distinct()
    last = known.filter("t is not null").join(hops, ["node", "t"])
    before = known.select("source", F.col("node").alias("via"), F.coalesce("t", F.lit(-(2**31))).alias("had"))
    return last.join(before, ["source", "via"]).filter("had < t").groupBy("source", "node", F.date_from_unix_date("t").alias("arrival")).agg(F.min("via").alias("via"))


def _arcs(edges: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, u, v: distinct directed edges between different nodes."""
    return edges.filter("from_id <> to_id").select(*by, F.col("from_id").alias("u"), F.col("to_id").alias("v")).distinct()


def links(edges: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, u, v: distinct directed edges; what is only on one side of an edge, or moves to itself, stands as a row to itself."""
    return edges.select(*by, F.coalesce("from_id", "to_id").alias("u"), F.coalesce("to_id", "from_id").alias("v")).filter("u is not null").distinct()


def closure(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """source, node: all pairs joined by a directed path, every node with itself.

    The result is pairs by its nature. Semi-naive: a round joins only the pairs that the last one added with what is
    known, so path lengths double each round and no pair is extended twice.
    """
    pairs = _arcs(edges, by).select(*by, F.col("u").alias("source"), F.col("v").alias("node"))
    nodes = endpoints(edges, *by)
    front = cut(pairs)
    deltas = [front]
    while not front.isEmpty():
        known = reduce(DataFrame.unionAll, deltas)
        ahead = front.select(*by, "source", F.col("node").alias("mid")).join(known.select(*by, F.col("source").alias("mid"), "node"), [*by, "mid"])
        behind = known.select(*by, "source", F.col("node").alias("mid")).join(front.select(*by, F.col("source").alias("mid"), "node"), [*by, "mid"])
        both = [d.select(*by, "source", "node").filter("source <> node") for d in (ahead, behind)]
        front = cut(both[0].unionAll(both[1]).distinct().join(known, [*by, "source", "node"], "left_anti"))
        deltas = _compact([*deltas, front], [*by, "source", "node"])
    return reduce(DataFrame.unionAll, deltas).unionAll(nodes.select(*by, F.col("id").alias("source"), F.col("id").alias("node")))


def reach_sizes(edges: DataFrame, by: tuple[str, ...] = (), most: int = digraphs.LARGEST) -> DataFrame:
    """id, reach: how many nodes a directed path leads to, the node itself included.

    A network of at most ``most`` distinct edges is searched by one task without pairs being listed; those of larger ones are.
    """
    if not by:
        return reach_sizes(edges.withColumn("__all", F.lit(1)), ("__all",), most).drop("__all")
    held, large = digraphs.divided(stored(links(edges, by), "links"), by, most)
    found = digraphs.reach_sizes(held, by)
    if large is None:
        return found
    pairs = closure(large.withColumnsRenamed({"u": "from_id", "v": "to_id"}), by)
    return found.unionAll(pairs.groupBy(*by, F.col("source").alias("id")).agg(F.count("*").alias("reach")))


def reachable(arcs: DataFrame, seeds: DataFrame, by: tuple[str, ...] = (), backward: bool = False, most: int = digraphs.LARGEST) -> DataFrame:
    """by, root, id: what each root reaches along arcs (by, u, v), or what reaches it; roots (by, root) themselves included.

    A network of at most ``most`` arcs is searched by one task. The arcs are read several times, so they should be stored.
    """
    if not by:
        return reachable(arcs.withColumn("__all", F.lit(1)), seeds.withColumn("__all", F.lit(1)), ("__all",), backward, most).drop("__all")
    seeds = seeds.select(*by, "root")
    held, large = digraphs.divided(arcs.select(*by, F.col("v" if backward else "u").alias("u"), F.col("u" if backward else "v").alias("v")), by, most)
    if large is None:
        return digraphs.from_roots(held, seeds, by)
    seeds, large = cut(seeds.distinct()), cut(large)
    rest = large.select(*by).distinct()
    at_rest = lambda how: seeds.alias("s").join(rest.alias("r"), [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by], how)
    return digraphs.from_roots(held, at_rest("left_anti"), by).unionAll(_reachable_as_tables(large, at_rest("left_semi"), by))


def _reachable_as_tables(arcs: DataFrame, seeds: DataFrame, by: tuple[str, ...]) -> DataFrame:
    hops = arcs.select(*by, F.col("u").alias("id"), F.col("v").alias("next"))
    front = cut(seeds.select(*by, "root", F.col("root").alias("id")).distinct())
    deltas = [front]
    while not front.isEmpty():
        found, ahead = None, front
        for _ in range(STEPS):
            ahead = ahead.join(hops, [*by, "id"]).select(*by, "root", F.col("next").alias("id")).distinct()
            found = ahead if found is None else found.unionAll(ahead)
        front = cut(found.distinct().join(reduce(DataFrame.unionAll, deltas), [*by, "root", "id"], "left_anti"))
        deltas = _compact([*deltas, front], [*by, "root", "id"])
    return reduce(DataFrame.unionAll, deltas)


def weak_components(edges: DataFrame, nodes: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """id, component (its least id): connected when directions don't count.

    Contraction: every node is hooked to the neighbour of least hash (itself, if none is lower), trees of hooks become
    single nodes, and the edges left between those go into the next round. The graph shrinks by a share each round, so
    all rounds together cost little more than the first, and hooks by hash keep the trees shallow whatever the ids.
    Nodes without edges are components of their own.
    """
    every = endpoints(edges, *by)
    every = every if nodes is None else every.unionAll(nodes.select(*by, "id")).distinct()
    arcs = edges.filter("from_id <> to_id").select(*by, F.least("from_id", "to_id").alias("u"), F.greatest("from_id", "to_id").alias("v")).distinct()
    live, maps = cut(arcs), []
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("c"))
    while not live.isEmpty():
        both = live.select(*by, "u", "v").unionAll(live.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy(*by, F.col("u").alias("id")).agg(F.min(rank("v")).alias("low"))
        roots = cut(hooks.select(*by, "id", F.least(F.col("low"), rank("id"))["c"].alias("root")))
        moved = roots
        while not moved.isEmpty():  # pointers are followed two at a time until all are at a root
            for _ in range(2):
                up = roots.select(*by, F.col("id").alias("root"), F.col("root").alias("higher"))
                roots = roots.join(up, [*by, "root"]).select(*by, "id", F.col("higher").alias("root"), (F.col("root") != F.col("higher")).alias("moved"))
            roots = cut(roots)
            moved, roots = roots.filter("moved"), roots.drop("moved")
        maps.append(roots)
        ends = [roots.select(*by, F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "uv"]
        live = cut(live.join(ends[0], [*by, "u"]).join(ends[1], [*by, "v"]).select(*by, F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).filter("u <> v").distinct())
    roots = None
    for m in reversed(maps):  # from the smallest graph to the whole one
        roots = m if roots is None else m.join(roots.select(*by, F.col("id").alias("root"), F.col("root").alias("last")), [*by, "root"], "left").select(*by, "id", F.coalesce("last", "root").alias("root"))
    if roots is None:
        return every.select(*by, "id", F.col("id").alias("component"))
    placed = cut(every.join(roots, [*by, "id"], "left").select(*by, "id", F.coalesce("root", "id").alias("root")))
    least = placed.groupBy(*by, "root").agg(F.min("id").alias("component"))
    return placed.join(least, [*by, "root"]).select(*by, "id", "component")


def strong_components(edges: DataFrame, by: tuple[str, ...] = (), most: int = digraphs.LARGEST) -> DataFrame:
    """id, component (its least id): nodes that reach each other.

    A network of at most ``most`` distinct edges is searched by one task, in time that follows its edges; rounds over
    tables, as many as paths are long, are for larger ones only.
    """
    if not by:
        return strong_components(edges.withColumn("__all", F.lit(1)), ("__all",), most).drop("__all")
    held, large = digraphs.divided(stored(links(edges, by), "links"), by, most)
    found = digraphs.strong(held, by)
    return found if large is None else found.unionAll(_strong_as_tables(large, by, most))


def _strong_as_tables(links: DataFrame, by: tuple[str, ...], most: int) -> DataFrame:
    """The same by rounds.

    Nodes without an edge in or out are components of their own and are trimmed until none is left. Of the others each
    takes the least node that reaches it as its colour; of a colour, those that reach that node are a component. They
    are taken out and the rest, edges within a colour only, goes round again. No pairs of nodes are made.
    """
    edges = links.withColumnsRenamed({"u": "from_id", "v": "to_id"})
    live, done = cut(_arcs(edges, by)), []
    colour_of = lambda colours, c: colours.select(*by, F.col("id").alias(c), F.col("colour").alias(f"{c}_colour"))
    while not live.isEmpty():
        size = -1
        while size != (size := live.count()):
            for _ in range(STEPS):
                live = live.join(live.select(*by, F.col("u").alias("v")).distinct(), [*by, "v"], "left_semi").join(live.select(*by, F.col("v").alias("u")).distinct(), [*by, "u"], "left_semi").select(*by, "u", "v")
            live = cut(live)
        if not size:
            break
        nodes = live.select(*by, F.explode(F.array("u", "v")).alias("id")).distinct()
        colours = cut(nodes.withColumn("colour", F.col("id")))
        front = colours
        while not front.isEmpty():
            sent, ahead = None, front
            for _ in range(STEPS):
                ahead = ahead.select(*by, F.col("id").alias("u"), "colour").join(live, [*by, "u"]).groupBy(*by, F.col("v").alias("id")).agg(F.min("colour").alias("colour"))
                sent = ahead if sent is None else sent.unionAll(ahead)
            sent = sent.groupBy(*by, "id").agg(F.min("colour").alias("low"))
            step = cut(colours.join(sent, [*by, "id"], "left").select(*by, "id", F.least("colour", "low").alias("colour"), F.coalesce(F.col("low") < F.col("colour"), F.lit(False)).alias("moved")))
            colours, front = step.drop("moved"), step.filter("moved").drop("moved")
        within = cut(live.join(colour_of(colours, "u"), [*by, "u"]).join(colour_of(colours, "v"), [*by, "v"]).filter("u_colour = v_colour").select(*by, "u", "v"))
        found = cut(reachable(within, colours.filter("id = colour").select(*by, F.col("id").alias("root")), by, backward=True, most=most))
        done.append(found.select(*by, "id", F.col("root").alias("component")))
        gone = found.select(*by, "id")
        live = cut(within.join(gone.withColumnRenamed("id", "u"), [*by, "u"], "left_anti").join(gone.withColumnRenamed("id", "v"), [*by, "v"], "left_anti").select(*by, "u", "v"))
    every = endpoints(edges, *by)
    if not done:
        return every.select(*by, "id", F.col("id").alias("component"))
    large = reduce(DataFrame.unionAll, done)
    return every.join(large, [*by, "id"], "left").select(*by, "id", F.coalesce("component", "id").alias("component"))


def giant_components(edges: DataFrame, by: tuple[str, ...] = (), most: int = digraphs.LARGEST) -> DataFrame:
    """Sizes of the largest strong component (of equal ones that with the least id), and of what reaches it or is reached from it from outside.

    Networks of at most ``most`` distinct edges are searched by one task each, larger ones in rounds over tables.
    """
    if not by:
        return giant_components(edges.withColumn("__all", F.lit(1)), ("__all",), most).drop("__all")
    held, large = digraphs.divided(stored(links(edges, by), "links"), by, most)
    joined = digraphs.giant(held, by)
    if large is not None:
        joined = joined.unionByName(_giant_as_tables(large, by, most))
    size = lambda c: (F.col(c) / F.col("active")).alias
    sized = joined.withColumn("gic", F.col("reaching") - F.col("gscc")).withColumn("goc", F.col("reached") - F.col("gscc"))
    return sized.select(*by, "active", "gscc", "gic", "goc", size("gscc")("gscc_share"), size("gic")("gic_share"), size("goc")("goc_share"))


def _giant_as_tables(links: DataFrame, by: tuple[str, ...], most: int) -> DataFrame:
    strong = cut(_strong_as_tables(links, by, most))
    sizes = strong.groupBy(*by, "component").agg(F.count("*").alias("size"))
    # The largest and, of equal ones, the least.
    root = cut(sizes.groupBy(*by).agg(F.max("size").alias("gscc")).join(sizes, list(by)).filter("size = gscc").groupBy(*by, "gscc").agg(F.min("component").alias("root")))
    # Whoever reaches the root reaches the whole component, and the other way round.
    arcs = links.filter("u <> v")
    into = reachable(arcs, root, by, True, most).groupBy(*by).agg(F.count("*").alias("reaching"))
    outof = reachable(arcs, root, by, False, most).groupBy(*by).agg(F.count("*").alias("reached"))
    active = strong.groupBy(*by).agg(F.count("*").alias("active"))
    return root.join(into, list(by)).join(outof, list(by)).join(active, list(by)).select(*by, "active", "gscc", "reaching", "reached")
