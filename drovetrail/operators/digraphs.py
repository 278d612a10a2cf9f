"""Directed networks that one task holds: components and reach by searches through arrays, whatever the length of paths.

Networks are rows (by, u, v); a node without arcs is a row from itself to itself. ``fixpoint`` gives the networks of up to
LARGEST such rows to tasks of their own and takes larger ones round by round as tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Most rows of a network that one task holds.
LARGEST = 1 << 21
#: Rounds of trimming go on while each removes this share of the arcs at least, so that all together cost a few times the first.
TRIMMED = 0.05


def divided(links: DataFrame, by: tuple[str, ...], most: int) -> tuple[DataFrame, DataFrame | None]:
    """The networks of at most ``most`` rows, and the larger ones, if there are any."""
    large = links.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(*by)
    large = large.sparkSession.createDataFrame(rows, large.schema) if (rows := large.collect()) else None  # at most all rows over ``most``
    if large is None:
        return links, None
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    pick = lambda how: links.alias("l").join(F.broadcast(large.alias("r")), same, how)
    return pick("left_anti"), pick("left_semi")


def numbered(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The ids in ascending order, and u and v as their places in it."""
    ends = [t.column(c) for c in ("u", "v")]
    ids = pc.unique(pa.chunked_array([x for e in ends for x in e.chunks], ends[0].type))
    ids = ids.take(pc.sort_indices(ids))
    u, v = (pc.index_in(e, ids).to_numpy().astype(np.int64) for e in ends)
    return ids, u, v


def lists(n: int, u: np.ndarray, v: np.ndarray) -> tuple[list[int], list[int]]:
    """Where each node's arcs begin, and their heads."""
    return np.concatenate([[0], np.cumsum(np.bincount(u, minlength=n))]).tolist(), v[np.argsort(u, kind="stable")].tolist()


def in_turn(n: int, u: np.ndarray, v: np.ndarray) -> tuple[list[int], int]:
    """Each node's strong component, numbered so that arcs between components lead to lower numbers, and how many there are.

    Gabow's search by paths, without recursion.
    """
    starts, heads = lists(n, u, v)
    ahead, met, own, seen, made = starts[:-1], [0] * n, [-1] * n, 0, 0
    for s in range(n):
        if met[s]:
            continue
        met[s] = seen = seen + 1
        path, open_, bounds = [s], [s], [s]
        while path:
            x = path[-1]
            if (i := ahead[x]) < starts[x + 1]:
                ahead[x] = i + 1
                y = heads[i]
                if not met[y]:
                    met[y] = seen = seen + 1
                    path.append(y)
                    open_.append(y)
                    bounds.append(y)
                elif own[y] < 0:
                    while met[bounds[-1]] > met[y]:
                        bounds.pop()
            else:
                path.pop()
                if bounds[-1] == x:
                    bounds.pop()
                    y = -1
                    while y != x:
                        own[y := open_.pop()] = made
                    made += 1
    return own, made


def least_of_strong(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's strong component. Nodes without an arc in or out are trimmed first, as long as that goes fast."""
    least, arcs = np.arange(n), (u != v)
    u, v = u[arcs], v[arcs]
    while len(u):
        to, of = np.zeros(n, bool), np.zeros(n, bool)
        to[v], of[u] = True, True
        kept = to[u] & of[v]
        u, v, before = u[kept], v[kept], len(u)
        if len(u) > (1 - TRIMMED) * before or len(u) < n // 64:
            break
    if len(u):
        nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        own, made = in_turn(len(nodes), ends[: len(u)], ends[len(u) :])
        low = np.full(made, n)
        np.minimum.at(low, own, nodes)
        least[nodes] = low[own]
    return least


def reached(starts: list[int], heads: list[int], root: int, seen: bytearray | None = None) -> list[int]:
    """What root reaches, itself first. ``seen`` is a byte of 0 for each node, and is so again afterwards."""
    seen, found = bytearray(len(starts) - 1) if seen is None else seen, [root]
    seen[root] = 1
    for x in found:
        for y in heads[starts[x] : starts[x + 1]]:
            if not seen[y]:
                seen[y] = 1
                found.append(y)
    for x in found:
        seen[x] = 0
    return found


def per_network(links: DataFrame, by: tuple[str, ...], fields: list[StructField], kernel: Callable[[pa.Table], dict[str, pa.Array]]) -> DataFrame:
    """by and what the kernel makes of each network."""
    schema = StructType([links.schema[c] for c in by] + fields)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        out = kernel(t)
        n = len(next(iter(out.values())))
        return pa.table({**{c: pa.repeat(k, n) for c, k in zip(by, key, strict=True)}, **out})

    return links.groupBy(*by).applyInArrow(run, schema)


def strong(links: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, id, component (its least id)."""

    def kernel(t: pa.Table) -> dict[str, pa.Array]:
        ids, u, v = numbered(t)
        return {"id": ids, "component": ids.take(pa.array(least_of_strong(len(ids), u, v)))}

    kind = links.schema["u"].dataType
    return per_network(links, by, [StructField("id", kind), StructField("component", kind)], kernel)


def giant(links: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, active, gscc (nodes of the largest strong component, of equal ones that with the least id), reaching and reached (from or to it, itself included)."""

    def kernel(t: pa.Table) -> dict[str, pa.Array]:
        ids, u, v = numbered(t)
        n = len(ids)
        sizes = np.bincount(least_of_strong(n, u, v), minlength=n)
        root = int(np.argmax(sizes))
        row = {"active": n, "gscc": int(sizes[root]), "reaching": len(reached(*lists(n, v, u), root)), "reached": len(reached(*lists(n, u, v), root))}
        return {c: pa.array([x], pa.int64()) for c, x in row.items()}

    return per_network(links, by, [StructField(c, LongType()) for c in ("active", "gscc", "reaching", "reached")], kernel)


def from_roots(links: DataFrame, seeds: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, root, id: what each of the seeds (by, root) reaches, itself included."""
    kind = links.schema["u"].dataType
    schema = StructType([links.schema[c] for c in by] + [StructField("root", kind), StructField("id", kind)])

    def run(key: tuple, t: pa.Table, s: pa.Table) -> pa.Table:
        roots = pc.unique(s.column("root"))
        if not len(roots):
            t = t.slice(0, 0)
        ids, u, v = numbered(t.select(["u", "v"]))
        at = pc.index_in(roots, ids).to_pylist()
        starts, heads = lists(len(ids), u, v)
        seen = bytearray(len(ids))
        found = [(k, reached(starts, heads, i, seen)) for k, i in enumerate(at) if i is not None]
        alone = roots.filter(pa.array([i is None for i in at], pa.bool_()))  # seeds that have no arcs
        root = roots.take(pa.array(np.repeat([k for k, _ in found], [len(x) for _, x in found]).astype(np.int64)))
        id_ = ids.take(pa.array([i for _, x in found for i in x], pa.int64()))
        columns = {"root": pa.chunked_array([root, alone], roots.type), "id": pa.chunked_array([id_, alone], roots.type)}
        return pa.table({**{c: pa.repeat(k, len(columns["id"])) for c, k in zip(by, key, strict=True)}, **columns})

    return links.groupBy(*by).cogroup(seeds.groupBy(*by)).applyInArrow(run, schema)


def reach_sizes_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How many nodes each node reaches, itself included.

    Strong components count as one. In each weakly connected part the largest of them is its hub: whatever reaches the
    hub reaches all that the hub does, and only what it reaches beside that is searched for. A node with a single way on
    has one more than that; only where ways part, sets are searched, one source at a time. Time is thus at most that of
    all pairs; memory follows the arcs.
    """
    own, made = in_turn(n, u, v)
    own = np.array(own)
    size = np.bincount(own, minlength=made)
    cu, cv = own[u], own[v]
    pairs = np.unique((cu * made + cv)[cu != cv])
    cu, cv = pairs // made, pairs % made
    starts, heads = lists(made, cu, cv)  # arcs lead to lower numbers
    part = list(range(made))

    def top(x: int) -> int:
        while part[x] != x:
            part[x] = x = part[part[x]]
        return x

    for a, b in zip(cu.tolist(), cv.tolist(), strict=True):
        part[top(a)] = top(b)
    tops = np.array([top(c) for c in range(made)])
    hubs = np.zeros(made, bool)
    hubs[list({int(tops[c]): c for c in np.argsort(size, kind="stable").tolist()}.values())] = True  # the last of a part is its largest
    below, above = hubs.tolist(), hubs.tolist()
    for c in range(made - 1, -1, -1):
        if below[c]:
            for y in heads[starts[c] : starts[c + 1]]:
                below[y] = True
    for c in range(made):
        above[c] = above[c] or any(above[y] for y in heads[starts[c] : starts[c + 1]])
    under = np.array(below)
    held = np.bincount(tops[under], weights=size[under], minlength=made)[tops].astype(np.int64).tolist()  # what the hub of the part reaches
    sizes, met = size.tolist(), [-1] * made

    def search(ahead: list[list[int]], wanted: list[bool]) -> list[int]:
        """Nodes in what each wanted component reaches by these ways."""
        found = [0] * made
        for c in range(made):
            if not wanted[c]:
                continue
            if len(ahead[c]) < 2:
                found[c] = sizes[c] + sum(found[y] for y in ahead[c])
                continue
            met[c], path, total = c, [c], 0
            for x in path:
                total += sizes[x]
                for y in ahead[x]:
                    if met[y] != c:
                        met[y] = c
                        path.append(y)
            found[c] = total
        met[:] = [-1] * made
        return found

    ways = [heads[starts[c] : starts[c + 1]] for c in range(made)]
    whole = search([[] if a else w for w, a in zip(ways, above, strict=True)], [not a for a in above])
    beside = search([[y for y in w if not below[y]] for w in ways], [not b for b in below])
    reach = [held[c] if below[c] and above[c] else held[c] + beside[c] if above[c] else whole[c] for c in range(made)]
    return np.array(reach, np.int64)[own] if n else np.zeros(0, np.int64)


def reach_sizes(links: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, id, reach: how many nodes each reaches, itself included."""

    def kernel(t: pa.Table) -> dict[str, pa.Array]:
        ids, u, v = numbered(t)
        return {"id": ids, "reach": pa.array(reach_sizes_of(len(ids), u, v))}

    return per_network(links, by, [StructField("id", links.schema["u"].dataType), StructField("reach", LongType())], kernel)
