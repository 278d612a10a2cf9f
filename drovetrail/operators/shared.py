"""Pairs of nodes that share neighbours, found without moving pairs.

Pairs are far more than edges, so they are not shuffled. Every node's list of neighbours is built once, ids are divided
into blocks by their order, and of each list only what lies in two blocks goes to the task of these two, which counts its
pairs and returns them at once. A list is thus sent to at most as many tasks as there are pairs of the blocks that it touches.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from ..runtime import stored

#: Neighbours in lists that a block has on average, at most: a task holds those of two blocks.
BLOCK = 1 << 22
#: Blocks there are at least, for the sake of work side by side, unless they would hold less than BLOCK / LEAST.
FEWEST, LEAST = 8, 64
#: Partitions for each block, at most; one with several pairs of blocks takes them in turn.
APART = 8
#: Nodes for each block from which its bounds are estimated; they decide on balance, never on results.
LOOKED_AT = 200
#: Neighbours of lists that are packed together, and pairs that are counted together.
PACKED, COUNTED = 1 << 22, 1 << 19


def _place(x: object) -> object:
    """Order of ids in blocks: short ones first, so that numbered ids stand by their numbers and neighbours near each other."""
    return (len(b := x.encode()), b) if isinstance(x, str) else x


def _sorted(ids: pa.Array) -> pa.Array:
    """In the order of ``_place``."""
    if not (pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type)):
        return ids.take(pc.sort_indices(ids))
    return ids.take(pc.sort_indices(pa.table({"n": pc.binary_length(ids), "id": ids}), sort_keys=[("n", "ascending"), ("id", "ascending")]))


def _joined(arrays: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([a.cast(kind) for a in arrays]) if arrays else pa.array([], kind)


def _packed(**columns: pa.Array | np.ndarray) -> bytes:
    """Columns of different lengths, compressed; whole numbers as narrow as they go."""
    out = {}
    for name, c in columns.items():
        if isinstance(c, np.ndarray):
            top = int(c.max(initial=0))
            c = pa.array(c.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64))
        out[name] = pa.LargeListArray.from_arrays(pa.array([0, len(c)], pa.int64()), c)
    batch, sink = pa.record_batch(out), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(data).read_next_batch()
    return {name: batch.column(name).flatten() for name in batch.schema.names}


def neighbour_lists(edges: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, n, ids: every node's distinct neighbours, whatever the direction; edges may be repeated."""
    ends = edges.filter("from_id <> to_id").select(*by, F.explode(F.array(*(F.struct(F.col(a).alias("n"), F.col(b).alias("id")) for a, b in (("from_id", "to_id"), ("to_id", "from_id"))))).alias("e")).select(*by, "e.n", "e.id")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]  # a partition has all rows of its nodes
        if parts:
            t = pa.Table.from_batches(parts).group_by([*by, "n"], use_threads=False).aggregate([("id", "distinct")])
            yield from t.select([*by, "n", "id_distinct"]).rename_columns([*by, "n", "ids"]).to_batches(max_chunksize=10_000)

    kind = ends.schema["id"].dataType
    return ends.repartition(*by, "n").mapInArrow(gather, StructType([*(ends.schema[c] for c in by), StructField("n", kind), StructField("ids", ArrayType(kind))]))


def _dealt(rows: pa.Table, bounds: list) -> Iterator[tuple[int, int, bytes]]:
    """Blocks i <= j and, packed, what lies in both of the lists of one network; the sizes of lists go to all tasks of their node's block."""
    lists, n = rows.column("ids").combine_chunks(), rows.column("n").combine_chunks()
    values, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    blocks = len(bounds) + 1

    def cuts(ids: pa.Array) -> np.ndarray:
        """Where each block begins in ids, which are in order, and the end."""
        inner = [bisect.bisect_left(range(len(ids)), b, key=lambda k: _place(ids[k].as_py())) for b in bounds]
        return np.array([0, *inner, len(ids)])

    order = _sorted(n)
    degree, at = lengths[pc.index_in(order, n).to_numpy()], cuts(order)
    for i in range(blocks):
        if at[i] < at[i + 1]:
            sizes = _packed(ids=order.slice(at[i], at[i + 1] - at[i]), sizes=degree[at[i] : at[i + 1]])
            yield from ((min(i, j), max(i, j), sizes) for j in range(blocks))
    ids = _sorted(pc.unique(values))
    codes, row = pc.index_in(values, ids).to_numpy().astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
    block = np.searchsorted(cuts(ids)[1:-1], codes, side="right")
    own = [np.flatnonzero(block == i) for i in range(blocks)]
    own = [(row[k], codes[k]) for k in own]
    count = [np.bincount(r, minlength=len(lengths)) for r, _ in own]
    for i in range(blocks):
        for j in range(i, blocks):
            both = count[i] > 1 if i == j else (count[i] > 0) & (count[j] > 0)
            if not both.any():
                continue
            sides = [own[k][1][both[own[k][0]]] for k in ((i,) if i == j else (i, j))]
            used, local = np.unique(np.concatenate(sides), return_inverse=True)
            x = local[: len(sides[0])]
            yield i, j, _packed(ids=ids.take(pa.array(used)), x=x, x_lengths=count[i][both], y=local[len(x) :], y_lengths=count[j][both] if j > i else np.zeros(0, np.int64))


def _pairs(parts: list[dict[str, pa.Array]], kind: pa.DataType) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """a < b, how many neighbours they share and how many either has, of one task's parts, some at a time."""
    lists, sizes = [p for p in parts if "x" in p], [p for p in parts if "sizes" in p]
    parts.clear()  # nothing is held twice
    if not lists:
        return
    ids = pc.unique(_joined([p["ids"] for p in lists], kind))
    ids = ids.take(pc.sort_indices(ids))
    n, degree = len(ids), np.zeros(len(ids), np.int64)
    for p in sizes:
        at = pc.index_in(p["ids"], ids)
        here = at.is_valid().to_numpy(zero_copy_only=False)
        degree[at.drop_null().to_numpy()] = p["sizes"].to_numpy()[here]
    lengths = [np.concatenate([p[c].to_numpy().astype(np.int64) for p in lists]) for c in ("x_lengths", "y_lengths")]
    whole = np.int32 if max(int(k.sum()) for k in lengths) < 1 << 31 else np.int64
    x, y = [], []
    while lists:
        p = lists.pop(0)
        own = pc.index_in(p["ids"], ids).to_numpy().astype(np.int32)
        x.append(own[p["x"].to_numpy()])
        y.append(own[p["y"].to_numpy()])
    x, y, ends = np.concatenate(x), np.concatenate(y), np.cumsum(lengths[0]).astype(whole)
    row = np.repeat(np.arange(len(ends), dtype=whole), lengths[0])
    if len(y):  # two blocks: every member of the one meets those of the other in its list
        first, many = (np.cumsum(lengths[1]) - lengths[1]).astype(whole)[row], lengths[1].astype(whole)[row]
    else:  # one block: every member meets those after it
        keys = row.astype(np.int64) * n
        keys += x
        keys.sort()
        x = y = (keys % n).astype(np.int32)
        del keys
        first = np.arange(1, len(x) + 1, dtype=whole)
        many = ends[row] - first
    del row
    order = np.argsort(x, kind="stable")
    x, first, many = x[order], first[order], many[order]
    del order
    starts = np.flatnonzero(np.diff(x, prepend=-1))  # of each member's lists
    total = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
    upto = total[np.append(starts[1:], len(x))]

    def met(lo: int, hi: int) -> np.ndarray:
        """Whom the members from lo to hi meet."""
        return y[np.repeat(first[lo:hi] - (total[lo:hi] - total[lo]), many[lo:hi]) + np.arange(total[hi] - total[lo])]

    g = 0
    while g < len(starts):
        lo, begun = starts[g], total[starts[g]]
        h = min(max(g + 1, int(np.searchsorted(upto, begun + COUNTED, side="right"))), g + max(1, (1 << 32) // n))
        hi = starts[h] if h < len(starts) else len(x)
        if total[hi] - begun > COUNTED:  # a single member with very many: counted piece by piece
            each, k = np.zeros(n, np.int64), lo
            while k < hi:
                m = min(hi, max(k + 1, int(np.searchsorted(total, total[k] + COUNTED, side="right")) - 1))
                each += np.bincount(met(k, m), minlength=n)
                k = m
            b = np.flatnonzero(each)
            a, shared = np.full(len(b), x[lo]), each[b]
        else:
            members = x[starts[g:h]]
            keys = np.repeat((np.arange(h - g) * n).astype(np.uint32), np.diff(total[np.append(starts[g:h], hi)]))
            keys += met(lo, hi).astype(np.uint32)
            keys.sort()
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            shared, keys = np.diff(np.append(at, len(keys))), keys[at]
            a = keys // np.uint32(n)
            b = (keys - a * np.uint32(n)).astype(np.int64)
            a = members[a]
        g = h
        either = degree[a] + degree[b] - shared
        for k in range(0, len(a), COUNTED):
            u, v = a[k : k + COUNTED], b[k : k + COUNTED]
            yield ids.take(pa.array(np.minimum(u, v))), ids.take(pa.array(np.maximum(u, v))), shared[k : k + COUNTED], either[k : k + COUNTED]


def _share(shared: np.ndarray, either: np.ndarray, digits: int | None) -> np.ndarray:
    """shared / either, rounded half up by whole numbers if digits are given."""
    if digits is None:
        return shared / either
    return (2 * 10**digits * shared + either) // (2 * either) / 10.0**digits


def jaccard(edges: DataFrame, by: tuple[str, ...] = (), digits: int | None = None, most: int = BLOCK) -> DataFrame:
    """by, a < b, jaccard of all pairs that share neighbours; edges may be repeated. Blocks have about ``most`` neighbours in lists."""
    lists = stored(neighbour_lists(edges, by), "lists")
    sizes = lists.select(*by, "n", F.size("ids").cast("long").alias("d"))
    network = sizes.groupBy(*by).agg(F.sum("d").alias("d"), F.count("*").alias("n"))
    largest = network.agg(F.max("d").alias("d"), F.sum("n").alias("n")).first()
    held = largest["d"] or 1
    blocks, bounds = max(-(-held // most), min(FEWEST, -(-held * LEAST // most))), []
    if blocks > 1:
        every = max(1, largest["n"] // (LOOKED_AT * blocks))
        seen = sorted(((_place(r["n"]), r["d"]) for r in sizes.filter(F.pmod(F.xxhash64("n"), F.lit(every)) == 0).select("n", "d").collect()), key=lambda r: r[0])
        shares = np.cumsum([d for _, d in seen]) if seen else np.zeros(0)
        bounds = sorted({seen[int(np.searchsorted(shares, shares[-1] * k / blocks))][0] for k in range(1, blocks)}) if seen else []
    blocks = len(bounds) + 1
    tasks = min(blocks * (blocks + 1) // 2, APART * blocks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            keys = list(zip(*(t.column(c).to_pylist() for c in by), strict=True)) if by else [()] * len(t)
            own: dict[tuple, list[int]] = {}
            for k, key in enumerate(keys):
                own.setdefault(key, []).append(k)
            for key, at in own.items():
                for i, j, data in _dealt(t if len(own) == 1 else t.take(pa.array(at)), bounds):
                    yield pa.record_batch({**{c: pa.array([x], t.schema.field(c).type) for c, x in zip(by, key, strict=True)}, "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "data": pa.array([data], pa.binary())})

        held, many = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                many += len(b.column("ids").flatten())
            if many >= PACKED:
                yield from send(held)
                held, many = [], 0
        if held:
            yield from send(held)

    kind = lists.schema["n"].dataType
    keys = [lists.schema[c] for c in by]
    dealt = lists.mapInArrow(deal, StructType([*keys, StructField("i", IntegerType()), StructField("j", IntegerType()), StructField("data", BinaryType())]))
    # Pairs of a block with itself, which have most to do, come first.
    apart, count = F.col("j") - F.col("i"), F.lit(blocks)
    number = apart * count - (apart * (apart - 1) / 2).cast("int") + F.col("i") + (F.pmod(F.xxhash64(*by), F.lit(tasks)) if by else F.lit(0))
    at = [*by, "i", "j"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(key: tuple, parts: list[dict[str, pa.Array]], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
            kept = parts[0]["ids"].type
            for a, b, shared, either in _pairs(parts, kept):
                same = {c: pa.array([x], t).take(pa.array(np.zeros(len(a), np.int64))) for c, x, t in zip(by, key, types, strict=False)}
                yield pa.record_batch({**same, "a": a, "b": b, "jaccard": pa.array(_share(shared, either, digits))})

        key, parts, types = None, [], []
        for t in batches:  # sorted by at
            types = [t.schema.field(c).type for c in by]
            for *now, data in zip(*(t.column(c).to_pylist() for c in (*at, "data")), strict=True):
                if parts and now != key:
                    yield from flush(key, parts, types)
                    parts = []
                key = now
                parts.append(_unpacked(data))
        if parts:
            yield from flush(key, parts, types)

    placed = dealt.repartitionById(tasks, F.pmod(number, F.lit(tasks)).cast("int")).sortWithinPartitions(*at)
    return placed.mapInArrow(find, StructType([*keys, StructField("a", kind), StructField("b", kind), StructField("jaccard", DoubleType())]))
