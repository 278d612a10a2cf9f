"""References to records that do not exist, are gone, or arrive later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, salted_lookup

#: Microseconds of the stretches of time into which the versions of a key are split.
DAY = 86_400_000_000
#: Spans that travel with their key as a list; keys with more are looked up by key and day, row by row.
INLINE = 64
_FAR = 2**62


def validity_spans(parents: DataFrame, key: Column, start: str, end: str) -> DataFrame:
    """The spans [a, b) in which some row of a key is valid, disjoint: key, a, b, versions (how many starts the key has).

    Copies of a key are reduced before the shuffle to one row per start. A key is valid from a start up to the greatest
    end so far, or the next start: running maxima, taken within each day of a key and carried over its days, so that
    neither a list nor a task holds all versions of a key. A row without start is never valid and gives no span.
    """
    spans = parents.select(key.alias("key"), F.unix_micros(start).alias("a"), F.coalesce(F.unix_micros(end), F.lit(_FAR)).alias("b")).filter("key is not null and a is not null")
    spans = spans.groupBy("key", "a").agg(F.max("b").alias("b")).withColumn("day", F.floor(F.col("a") / DAY))
    days = spans.groupBy("key", "day").agg(F.max("b").alias("top"), F.min("a").alias("first"), F.count("*").alias("n"))
    over_days = Window.partitionBy("key").orderBy("day")
    carried = days.select(
        "key", "day", F.max("top").over(over_days.rowsBetween(Window.unboundedPreceding, -1)).alias("base"),
        F.lead("first").over(over_days).alias("next_day"), F.sum("n").over(Window.partitionBy("key")).alias("versions"),
    )
    in_day = Window.partitionBy("key", "day").orderBy("a")
    running = spans.withColumn("top", F.max("b").over(in_day.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("a").over(in_day))
    full = running.join(carried, ["key", "day"])
    until = F.least(F.greatest("top", "base"), F.coalesce("next", "next_day", F.lit(_FAR)))
    return full.select("key", "a", until.alias("b"), "versions").filter("b > a")


def orphan_references(
    children: DataFrame,
    parents: DataFrame,
    refs: list[str],
    row_id: str,
    seen_at: str,
    parent_key: Column,
    start: str,
    end: str,
    key_of=lambda c: c,
) -> DataFrame:
    """References for which no parent row of the same key is valid when the child is seen.

    Parent and child keys are put into one long form with a tag and grouped by key. Each group gets a parent flag, the
    parent's first start and the number of its references (pre-aggregated before the shuffle, so a key that holds a
    third of all rows is one partial row per task). Groups without parent flag are orphans whole; in the others each
    reference is held against the spans in which the key is valid. The groups come back to the references through a
    lookup that spreads frequent keys over many tasks; up to INLINE spans of a key travel with it, references to keys
    with more versions meet their spans by key and day.

    Result: row_id, ref_field, key, period (UTC month of seen_at), reason (missing, later, deleted). A null reference is
    no reference. A reference whose key can't be read (``key_of`` gives null) is missing. A row never seen (null time)
    has a null period and is ``missing`` or, if its key exists, ``deleted``. Repeated rows come out repeatedly, an empty
    parent table makes every reference missing; further columns are ignored, whatever their names.
    """
    pairs = F.array(*(F.when(F.col(r).isNotNull(), F.struct(F.lit(r).alias("ref_field"), key_of(F.col(r)).alias("key"))) for r in refs))
    long = children.select(F.col(row_id).alias("row_id"), F.unix_micros(seen_at).alias("at"), F.explode(F.array_compact(pairs)).alias("r")).select("row_id", "at", "r.*")
    spans = validity_spans(parents, parent_key, start, end)
    null, few = F.lit(None).cast("bigint"), F.col("versions") <= INLINE
    child = long.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    own = parents.select(parent_key.alias("key"), F.unix_micros(start).alias("first")).filter("key is not null").groupBy("key").agg(F.min("first").alias("first"))
    tagged = child.select("key", "n", F.lit(False).alias("parent"), null.alias("first"), null.alias("a"), null.alias("b"), F.lit(False).alias("many"))
    tagged = tagged.unionAll(own.select("key", F.lit(0).cast("bigint"), F.lit(True), "first", null, null, F.lit(False)))
    tagged = tagged.unionAll(spans.filter(few).select("key", F.lit(0).cast("bigint"), F.lit(True), null, "a", "b", F.lit(False)))
    tagged = tagged.unionAll(spans.filter(~few).select("key", F.lit(0).cast("bigint"), F.lit(True), null, null, null, F.lit(True)).distinct())
    groups = cut(
        tagged.groupBy("key").agg(
            F.sum("n").alias("n"), F.max("parent").alias("parent"), F.min("first").alias("first"), F.max("many").alias("many"),
            F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "b"))).alias("spans"),
        ).filter("n > 0")
    )
    found = salted_lookup(long, groups, "key", F.col("row_id"), "n")
    within = F.exists("spans", lambda s: (s["a"] <= F.col("at")) & (F.col("at") < s["b"]))
    orphans = found.filter(~F.coalesce(within, F.lit(False))).drop("spans")
    if not groups.filter("many").isEmpty():
        last = F.floor(F.greatest(F.col("a"), F.least(F.col("b"), F.lit(children.agg(F.max(F.unix_micros(seen_at))).first()[0] or 0)) - 1) / DAY)
        by_day = spans.filter(~few).select("key", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / DAY), last)).alias("day"))
        dated = orphans.filter("many").withColumn("day", F.floor(F.col("at") / DAY)).alias("r")
        inside = (F.col("r.key") == F.col("s.key")) & (F.col("r.day") == F.col("s.day")) & (F.col("s.a") <= F.col("r.at")) & (F.col("r.at") < F.col("s.b"))
        orphans = orphans.filter(~F.coalesce("many", F.lit(False))).unionAll(dated.join(by_day.alias("s"), inside, "left_anti").drop("day"))
    return orphans.select(
        "row_id",
        "ref_field",
        "key",
        F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("period"),
        F.when(F.col("parent").isNull() | ~F.col("parent"), "missing").when(F.col("first") > F.col("at"), "later").otherwise("deleted").alias("reason"),
    )


def orphan_report(orphans: DataFrame, parent: str) -> DataFrame:
    """Orphan references per parent table, referring field, period and reason."""
    return orphans.groupBy(F.lit(parent).alias("parent_table"), "ref_field", "period", "reason").agg(F.count("*").alias("n_refs"), F.count_distinct("key").alias("n_keys"))
