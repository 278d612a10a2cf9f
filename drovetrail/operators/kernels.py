"""Measures by shortest paths and power iteration: many small networks side by side, one group of rows each."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .network import endpoints
from .stats import bounded

#: Path lengths that differ by less than this share are equal.
TIE = 1e-9
#: Most edges of a network that one task holds.
LARGEST = 5_000_000


def _graph(g: pd.DataFrame, directed: bool = True) -> tuple[list[str], list[list[tuple[int, float]]]]:
    ids = sorted(set(g["from_id"]) | set(g["to_id"]))
    at = {x: i for i, x in enumerate(ids)}
    near: list[dict[int, float]] = [{} for _ in ids]
    for a, b, w in zip(g["from_id"], g["to_id"], g["length"], strict=True):
        i, j = at[a], at[b]
        for x, y in ((i, j), (j, i))[: 1 if directed else 2]:
            near[x][y] = min(w, near[x].get(y, w))
    return ids, [sorted(n.items()) for n in near]


def shortest_paths(near: list[list[tuple[int, float]]], s: int) -> tuple[list[int], dict[int, float], dict[int, float], dict[int, list[int]]]:
    """From s: nodes by distance, distances, numbers of shortest paths and predecessors on them (Dijkstra), of reached nodes only."""
    dist: dict[int, float] = {}
    best, paths, before = {s: 0.0}, {s: 1.0}, {s: []}
    order, heap = [], [(0.0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in dist:
            continue
        dist[u] = d
        order.append(u)
        for v, w in near[u]:
            new = d + w
            if v in dist and dist[v] < new - TIE * max(new, 1.0):
                continue
            old = best.get(v)
            if old is None or new < old - TIE * max(old, 1.0):
                best[v], paths[v], before[v] = new, paths[u], [u]
                heapq.heappush(heap, (new, v))
            elif abs(new - old) <= TIE * max(old, 1.0) and v not in dist:
                paths[v] += paths[u]
                before[v].append(u)
    return order, dist, paths, before


def centralities(g: pd.DataFrame, directed: bool = True) -> pd.DataFrame:
    """id, betweenness (fractional over equally short paths), closeness (1 / sum of distances to reached nodes), reached, total."""
    ids, near = _graph(g, directed)
    between, rows = [0.0] * len(ids), []
    for s in range(len(ids)):
        order, dist, paths, before = shortest_paths(near, s)
        share = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before[v]:
                share[u] += paths[u] / paths[v] * (1 + share[v])
            if v != s:
                between[v] += share[v]
        total = sum(dist[v] for v in order)
        rows.append((ids[s], 1 / total if total > 0 else None, len(order) - 1, total, max(dist[v] for v in order)))
    out = pd.DataFrame(rows, columns=["id", "closeness", "reached", "total", "farthest"])
    out.insert(1, "betweenness", [b if directed else b / 2 for b in between])
    return out


def pagerank(g: pd.DataFrame, damping: float = 0.85, rounds: int = 200, tolerance: float = 1e-12) -> pd.DataFrame:
    """id, pagerank: in proportion to weights, mass of nodes without outgoing edges spread evenly; sums to 1."""
    ids = sorted(set(g["from_id"]) | set(g["to_id"]))
    at, n = {x: i for i, x in enumerate(ids)}, len(ids)
    out, edges = [0.0] * n, defaultdict(float)
    for a, b, w in zip(g["from_id"], g["to_id"], g["weight"], strict=True):
        edges[at[a], at[b]] += w
        out[at[a]] += w
    rank = [1 / n] * n
    for _ in range(rounds):
        idle = sum(r for r, o in zip(rank, out, strict=True) if o == 0)
        new = [(1 - damping + damping * idle) / n] * n
        for (i, j), w in edges.items():
            new[j] += damping * rank[i] * w / out[i]
        moved, rank = sum(abs(x - y) for x, y in zip(rank, new, strict=True)), new
        if moved < tolerance:
            break
    return pd.DataFrame({"id": ids, "pagerank": rank})


def _grouped(edges: DataFrame, by: list[str], kernel, schema: str, most: int) -> DataFrame:
    kinds = ", ".join(f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in by)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out = kernel(g)
        for i, (c, k) in enumerate(zip(by, key, strict=True)):
            out.insert(i, c, [k] * len(out))
        return out

    return bounded(cut(edges), by, most, "networks").groupBy(*by).applyInPandas(run, f"{kinds}, {schema}")


def path_measures(edges: DataFrame, by: list[str], directed: bool = True, weighted: bool = True, most: int = LARGEST) -> DataFrame:
    """Betweenness, closeness and distances of every node of every network.

    Each network (one group) is held by one task, so this is for periods and variants, not for one network of all data:
    ValueError if one has more than ``most`` edges, as paths from every node take nodes times edges.
    An edge's length is the network's mean weight over its own (1 if unweighted); weights must be above 0.
    """

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g[g["weight"] > 0]
        return centralities(g.assign(length=g["weight"].mean() / g["weight"] if weighted else 1.0), directed)

    return _grouped(edges.select(*by, "from_id", "to_id", "weight"), by, kernel, "id string, betweenness double, closeness double, reached bigint, total double, farthest double", most)


def page_ranks(edges: DataFrame, by: list[str], damping: float = 0.85, rounds: int = 200, tolerance: float = 1e-12, most: int = LARGEST) -> DataFrame:
    """PageRank of every node of every network, by iteration until ranks move by less than the tolerance in all.

    Networks of at most ``most`` edges are held by a task each; if one is larger, all of them iterate as tables.
    """
    own = cut(edges.select(*by, "from_id", "to_id", "weight"))
    largest = own.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if largest <= most:
        return _grouped(own, by, lambda g: pagerank(g, damping, rounds, tolerance), "id string, pagerank double", most)
    return _ranks_as_tables(own, by, damping, rounds, tolerance)


def _ranks_as_tables(edges: DataFrame, by: list[str], damping: float, rounds: int, tolerance: float) -> DataFrame:
    out = edges.groupBy(*by, "from_id").agg(F.sum("weight").alias("out"))
    shares = cut(edges.groupBy(*by, "from_id", "to_id").agg(F.sum("weight").alias("w")).join(out, [*by, "from_id"]).select(*by, F.col("from_id").alias("id"), "to_id", (F.col("w") / F.col("out")).alias("share")))
    nodes = endpoints(edges, *by)
    size = nodes.groupBy(*by).agg(F.count("*").alias("size"))
    placed = cut(nodes.join(size, by).join(out.select(*by, F.col("from_id").alias("id"), F.lit(False).alias("idle")), [*by, "id"], "left").select(*by, "id", "size", F.coalesce("idle", F.lit(True)).alias("idle")))
    rank = placed.select(*by, "id", (1.0 / F.col("size")).alias("rank"))
    for _ in range(rounds):
        held = placed.join(rank, [*by, "id"])
        idle = held.groupBy(*by).agg(F.sum(F.when(F.col("idle"), F.col("rank")).otherwise(0.0)).alias("lost"))
        given = shares.join(rank, [*by, "id"]).groupBy(*by, F.col("to_id").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        new = held.join(idle, by).join(given, [*by, "id"], "left").select(*by, "id", F.col("rank").alias("old"), ((1 - damping + damping * F.col("lost")) / F.col("size") + damping * F.coalesce("given", F.lit(0.0))).alias("rank"))
        new = cut(new)
        moved = new.groupBy(*by).agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("d")).agg(F.max("d").alias("d")).first()["d"] or 0.0
        rank = new.drop("old")
        if moved < tolerance:
            break
    return rank.select(*by, "id", F.col("rank").alias("pagerank"))
