"""Per-key results when a few keys hold most rows: tree aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import fresh, rounds_needed

#: States that a later round combines by the same kind of function.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def tree_aggregate(rows: DataFrame, keys: list[str], states: dict[str, tuple[str, Column]], total: int | None = None, chunk_rows: int = 65_536, fan_in: int = 64) -> DataFrame:
    """Aggregate by keys in rounds, so that no reducer gets all partial states of a frequent key.

    Round 0 cuts every input partition into chunks of ``chunk_rows`` rows and combines them locally (map side; the
    shuffle is by key and chunk, so a hot key is as wide as the input). Each further round merges the states of
    ``fan_in`` chunks, until one state per key is left; there are about log_fan_in(chunks) rounds. ``total`` is how many
    rows there are about (they are counted if it isn't given). It sets the number of rounds only: chunks get leaves of
    the tree by a hash, so whatever it is and however the input is partitioned, the last round has one state per key.

    ``states`` maps result columns to (count | sum | min | max, column); a count of a literal counts rows. Null keys form
    a group, as in any aggregation; an empty input gives an empty result.
    """
    node = fresh("node")
    rounds = rounds_needed(math.ceil((rows.count() if total is None else total) / chunk_rows), fan_in)
    at = F.monotonically_increasing_id()
    chunk = F.struct(F.shiftright(at, 33), F.floor(at.bitwiseAND(2**33 - 1) / chunk_rows))
    local = rows.withColumn(node, F.pmod(F.xxhash64(chunk), F.lit(fan_in**rounds)))
    first = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    merged = local.groupBy(*keys, node).agg(*(first[kind](c).alias(name) for name, (kind, c) in states.items()))
    for _ in range(rounds):
        merged = merged.withColumn(node, F.floor(F.col(node) / fan_in)).groupBy(*keys, node).agg(*(MERGE[kind](name).alias(name) for name, (kind, _) in states.items()))
    return merged.drop(node)


def long_keys(df: DataFrame, fields: list[str], key_of, *others: Column) -> DataFrame:
    """One row per row and non-null key: ref_field, key and the other columns."""
    pairs = F.array(*(F.struct(F.lit(f).alias("ref_field"), key_of(F.col(f)).alias("key")) for f in fields))
    return df.select(F.explode(pairs).alias("r"), *others).select("r.*", *(c for c in df.select(*others).columns)).filter("key is not null")


def heavy_keys(per_key: DataFrame, total: int, share: float, count: str = "n") -> DataFrame:
    """The keys that hold at least this share of all rows."""
    return per_key.filter(F.col(count) >= F.lit(total * share))
