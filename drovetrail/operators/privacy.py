"""Pseudonyms for identifiers; jittered and rounded dates and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dateunits import floor_date
from ..functions.noise import STEPS, draw


def jitter_dates(moves: DataFrame, reach: int, key: str, date: str = "date", seed: int = 1) -> DataFrame:
    """Move dates by a whole number of days from -reach to reach, uniform among those that stay within the dates' range.

    Null dates stay null; rows of equal key get equal noise. ValueError unless reach is a whole number above 0.
    """
    if not isinstance(reach, int) or isinstance(reach, bool) or reach < 1:
        raise ValueError("the range of days must be a whole number above 0")
    span = moves.agg(F.min(date).alias("lo"), F.max(date).alias("hi")).first()
    if span["lo"] is None:
        return moves
    low = F.greatest(F.lit(-reach), F.date_diff(F.lit(span["lo"]), F.col(date)))
    high = F.least(F.lit(reach), F.date_diff(F.lit(span["hi"]), F.col(date)))
    u = draw(F.col(key), seed, "date") / F.lit(float(STEPS))
    moved = F.date_add(date, (low + F.floor(u * (high - low + 1))).cast("int"))
    return moves.withColumn(date, F.when(F.col(date).isNotNull(), moved))


def jitter_weights(moves: DataFrame, reach: float, key: str, column: str = "weight", seed: int = 1) -> DataFrame:
    """Move weights by a number from -reach to reach, uniform among those that leave the weight above 0; null stays null.

    A weight of -reach or less can't be moved above 0: the job fails.
    """
    if not reach > 0:
        raise ValueError("the range must be above 0")
    w = F.col(column)
    low = F.greatest(F.lit(float(-reach)), -w)
    u = (draw(F.col(key), seed, "weight") + 1) / F.lit(float(STEPS))
    moved = w + low + u * (F.lit(float(reach)) - low)
    fail = F.raise_error(F.lit(f"{column} can't be jittered above 0 within {reach}")).cast("double")
    return moves.withColumn(column, F.when(w.isNull(), None).when(w <= -reach, fail).otherwise(moved))


def round_weights(moves: DataFrame, unit: float, column: str = "weight") -> DataFrame:
    """Round to multiples of unit (halves to even), but never below unit; null stays null."""
    if not unit > 0:
        raise ValueError("the unit must be above 0")
    rounded = F.bround(F.col(column) / F.lit(float(unit))) * F.lit(float(unit))
    return moves.withColumn(column, F.when(F.col(column).isNotNull(), F.greatest(rounded, F.lit(float(unit)))))


def round_dates(moves: DataFrame, unit: str, week_start: int = 7, sum_weight: bool = True, aggregates: dict[str, Column] | None = None, cols: tuple[str, str, str, str] = ("from_id", "to_id", "date", "weight")) -> DataFrame:
    """Floor dates to a unit and aggregate movements of equal from, to and date.

    With ``sum_weight`` the weight is summed; ``aggregates`` are further columns over the rows of a group, which see the
    raw weight. Null ids or dates form groups of their own.
    """
    start, end, date, weight = cols
    made = {name: c.alias(name) for name, c in (aggregates or {}).items()}
    if sum_weight:
        made = {weight: F.sum(weight).alias(weight)} | made
    floored = moves.withColumn(date, floor_date(F.col(date), unit, week_start))
    grouped = floored.groupBy(start, end, date)
    return grouped.agg(*made.values()) if made else grouped.agg(F.count("*")).select(start, end, date)


def pseudonym_key(ids: DataFrame, id_col: str, prefix: str = "", start: int = 1, seed: int = 1) -> DataFrame:
    """old_id, new_id: consecutive numbers in random order behind a prefix; null ids get none.

    Ids are ordered by a hash and numbered within ranges of it, which are offset by the counts of the ranges before, so
    no single task sorts them all.
    """
    hashed = ids.select(F.col(id_col).cast("string").alias("old_id")).dropna().distinct().withColumn("h", F.md5(F.concat_ws("|", "old_id", F.lit(str(seed)), F.lit("key"))))
    hashed = hashed.withColumn("slice", F.substring("h", 1, 2))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most 256 slices: their counts fit one task and every executor.
    offsets = hashed.groupBy("slice").agg(F.count("*").alias("n")).select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = hashed.join(F.broadcast(offsets), "slice").withColumn("i", F.row_number().over(Window.partitionBy("slice").orderBy("h", "old_id")) + F.col("before"))
    return numbered.select("old_id", F.concat(F.lit(prefix), (F.col("i") + (start - 1)).cast("string")).alias("new_id"))


def extend_key(key: DataFrame, ids: DataFrame, id_col: str, prefix: str = "", seed: int = 1) -> DataFrame:
    """The key with further pseudonyms for ids it lacks, numbered on from its length."""
    unseen = ids.select(F.col(id_col).cast("string").alias("old_id")).join(key, "old_id", "left_anti")
    return key.unionAll(pseudonym_key(unseen, "old_id", prefix, key.count() + 1, seed))


def replace_ids(df: DataFrame, columns: list[str], key: DataFrame) -> DataFrame:
    """Replace ids by their pseudonyms; those the key lacks become null. The key is broadcast only if it is known to be small."""
    order = df.columns
    for c in columns:
        df = df.join(key.select(F.col("old_id").alias(c), F.col("new_id").alias("__new")), c, "left").drop(c).withColumnRenamed("__new", c)
    return df.select(*order)


def pseudonymise(moves: DataFrame, columns: list[str], prefix: str = "", key: DataFrame | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The data under pseudonyms and the key, which is made, or extended where a given one lacks ids."""
    ids = moves.select(F.explode(F.array(*columns)).alias("id")).distinct()
    key = pseudonym_key(ids, "id", prefix, seed=seed) if key is None else extend_key(key, ids, "id", prefix, seed)
    return replace_ids(moves, columns, key), key
