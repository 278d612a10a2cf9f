"""Movement tables as static and temporal networks: plain tables of nodes, edges and spells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Movements have the columns from_id, to_id, date, weight and any others; holdings have id and any others.


def endpoints(moves: DataFrame, *by: str) -> DataFrame:
    """Distinct ids that movements start or end at, within the given columns."""
    return moves.select(*by, F.explode(F.array("from_id", "to_id")).alias("id")).filter("id is not null").distinct()


def harmonise(moves: DataFrame, holdings: DataFrame | None, keep_idle: bool = False) -> DataFrame:
    """Nodes of the network: holdings with their attributes and ``active``; moving ids that holdings lack have nulls.

    Idle holdings are left out unless ``keep_idle``.
    """
    moving = endpoints(moves).withColumn("active", F.lit(True))
    if holdings is None:
        return moving
    nodes = holdings.join(moving, "id", "full" if keep_idle else "right")
    return nodes.withColumn("active", F.coalesce("active", F.lit(False)))


def missing_ids(moves: DataFrame, holdings: DataFrame) -> DataFrame:
    """Moving ids that the holdings lack."""
    return endpoints(moves).join(holdings.select("id").distinct(), "id", "left_anti")


def idle_ids(moves: DataFrame, holdings: DataFrame) -> DataFrame:
    """Holdings without movements."""
    return holdings.select("id").distinct().join(endpoints(moves), "id", "left_anti")


def duplicate_ids(holdings: DataFrame) -> DataFrame:
    return holdings.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_moves(moves: DataFrame, columns: list[str]) -> DataFrame:
    return moves.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def edge_spells(moves: DataFrame) -> DataFrame:
    """Instantaneous spells of edges (days since 1970), without self-moves, further columns kept."""
    day = F.unix_date("date")
    others = [c for c in moves.columns if c not in ("from_id", "to_id", "date")]
    return moves.filter("from_id <> to_id").select(day.alias("onset"), day.alias("terminus"), F.col("from_id").alias("tail"), F.col("to_id").alias("head"), *others)


def vertex_spells(moves: DataFrame) -> DataFrame:
    """Instantaneous spells of nodes: one for each node and day with a movement."""
    spells = endpoints(moves.filter("date is not null").withColumn("onset", F.unix_date("date")), "onset")
    return spells.select("onset", F.col("onset").alias("terminus"), F.col("id").alias("vertex"))


def simplify(moves: DataFrame, *by: str) -> DataFrame:
    """One edge per pair: self-moves dropped, weights summed."""
    return moves.filter("from_id <> to_id").groupBy(*by, "from_id", "to_id").agg(F.sum("weight").alias("weight"))


def simplify_stats(moves: DataFrame, *by: str) -> DataFrame:
    """One edge per pair with the mean and median of its weights."""
    return moves.filter("from_id <> to_id").groupBy(*by, "from_id", "to_id").agg(F.avg("weight").alias("mean_weight"), F.percentile("weight", 0.5).alias("median_weight"), F.count("*").alias("moves"))


def collapse(moves: DataFrame, *by: str) -> DataFrame:
    """A static snapshot: distinct edges with their earliest weight (the least of equal dates)."""
    edges = moves.filter("from_id <> to_id").groupBy(*by, "from_id", "to_id", "date").agg(F.min("weight").alias("weight"))
    return edges.groupBy(*by, "from_id", "to_id").agg(F.min_by("weight", "date").alias("weight"), F.min("date").alias("first_date"), F.count("*").alias("days"))


def in_period(moves: DataFrame, start: str, end: str) -> DataFrame:
    """Movements from start up to end, which is not included."""
    return moves.filter((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date")))


def on_date(moves: DataFrame, date: str) -> DataFrame:
    """The movements of one day."""
    return moves.filter(F.col("date") == F.lit(date).cast("date"))


def real_moves(moves: DataFrame) -> DataFrame:
    """Movements between different holdings; such with an unknown end are none."""
    return moves.filter("from_id <> to_id")


def self_moves(moves: DataFrame) -> DataFrame:
    """Movements from a holding to itself."""
    return moves.filter("from_id = to_id")


def weight_between(moves: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Movements of a weight above 0 from low to high, both included; null weights are left out."""
    within = F.col("weight") > 0
    within = within if low is None else within & (F.col("weight") >= low)
    return moves.filter(within if high is None else within & (F.col("weight") <= high))


def _by_position(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The first columns under the names of their roles, whatever they are called; others of these names move aside."""
    if len(df.columns) < len(names):
        raise ValueError(f"at least {len(names)} columns are needed: {', '.join(names)}")
    rest = [f"{c}_" if c in names else c for c in df.columns[len(names) :]]
    return df.toDF(*names, *rest)


def _with_unique_ids(holdings: DataFrame) -> DataFrame:
    """Holdings by position (the first column is the id); ValueError if ids are repeated or missing."""
    named = _by_position(holdings, ("id",))
    bad = named.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").agg(F.count("*").alias("k"), F.min("id").alias("id")).first()
    if bad["k"]:
        raise ValueError(f"{bad['k']} ids of holdings are repeated or missing, such as {bad['id']}")
    return named


def static_network(moves: DataFrame, holdings: DataFrame | None = None, keep_idle: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, the holdings' columns, active) and edges (from_id, to_id, date, weight, further columns) of a static network.

    Columns have their roles by position: origin, destination, date and weight of movements, the id of holdings. Ids of
    holdings must be unique (ValueError). Every movement is an edge, self-moves too; those with an unknown end are left out.
    """
    edges = _by_position(moves, ("from_id", "to_id", "date", "weight")).filter("from_id is not null and to_id is not null")
    return harmonise(edges, None if holdings is None else _with_unique_ids(holdings), keep_idle), edges


def temporal_network(moves: DataFrame, holdings: DataFrame | None = None, keep_idle: bool = False) -> dict[str, DataFrame]:
    """A temporal network as tables: vertices (vertex, id, the holdings' columns, active), edge_spells, vertex_spells and key (id, vertex).

    Vertices are numbered from 1; ids that are these numbers already keep them. Edge spells (onset, terminus, tail, head,
    further columns) have no self-moves and no movements without day. Roles by position and checks as for a static network.
    """
    from .privacy import pseudonym_key

    nodes, edges = static_network(moves, holdings, keep_idle)
    ids = nodes.select("id")
    if consecutive_ids(ids, "id").first()["consecutive"]:
        key = ids.select("id", F.col("id").cast("bigint").alias("vertex"))
    else:
        key = pseudonym_key(ids, "id").select(F.col("old_id").alias("id"), F.col("new_id").cast("bigint").alias("vertex"))
    number = lambda df, c: df.join(key.select(F.col("id").alias(c), F.col("vertex").alias("__v")), c).drop(c).withColumnRenamed("__v", c)
    spells = edge_spells(edges.filter("date is not null"))
    columns = spells.columns
    return {
        "vertices": nodes.join(key, "id").select("vertex", *nodes.columns),
        "edge_spells": number(number(spells, "tail"), "head").select(*columns),
        "vertex_spells": number(vertex_spells(edges), "vertex").select("onset", "terminus", "vertex"),
        "key": key,
    }


def renumbered(moves: DataFrame, holdings: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Movements and nodes under consecutive numbers (as text) instead of ids, and the key (old_id, new_id)."""
    from .privacy import pseudonym_key, replace_ids

    nodes, edges = static_network(moves, holdings, keep_idle=True)
    key = pseudonym_key(nodes, "id")
    return replace_ids(edges, ["from_id", "to_id"], key), replace_ids(nodes, ["id"], key), key


def split_network(moves: DataFrame, period: str, nodes: DataFrame | None = None, keep_idle: bool = False) -> tuple[DataFrame, DataFrame]:
    """Networks of all periods side by side: nodes (period, id, active) and edges (the movements with a period).

    With ``keep_idle`` every node (of ``nodes``, or of any period) is in every period, idle ones too. The periods, which the
    calendar bounds, are sent to all executors.
    """
    edges = moves.filter(F.col(period).isNotNull())
    active = endpoints(edges, period).withColumn("active", F.lit(True))
    if not keep_idle:
        return active, edges
    periods = [r[0] for r in edges.select(period).distinct().orderBy(period).collect()]
    every = endpoints(edges) if nodes is None else endpoints(edges).unionAll(nodes.select("id")).distinct()
    if not periods:
        return active, edges
    grid = every.withColumn(period, F.explode(F.array(*map(F.lit, periods)))).select(period, "id")
    return grid.join(active, [period, "id"], "left").select(period, "id", F.coalesce("active", F.lit(False)).alias("active")), edges


def consecutive_ids(ids: DataFrame, id_col: str) -> DataFrame:
    """One row: whether the ids are exactly the numbers from 1 to their count."""
    number = F.when(F.col(id_col).rlike("^[0-9]{1,18}$"), F.col(id_col)).cast("bigint")
    return ids.agg(
        F.coalesce((F.count("*") == F.count_distinct(number)) & (F.min(number) == 1) & (F.max(number) == F.count("*")), F.lit(False)).alias("consecutive")
    )
