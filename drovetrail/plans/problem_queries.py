"""The pN_ queries of the general problems over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timestamps as T
from ..functions.digits import nine_digits
from ..operators import faults, heavy, instants, nearby, references, trailing
from ..runtime import cut
from . import problem_sql

MOVEMENTS, HOLDINGS, AREAS, LINES, SWEDEN = "example_movement_data", "example_holding_data", "example_admin_areas", "movement_lines", "sweden"
ZONES = {MOVEMENTS: "Europe/London", SWEDEN: "Europe/Stockholm"}
REFS = ["departure_cph", "dest_cph"]
SHARE = 0.03
NEAR_M = 150.0
#: Usable coordinates (degrees).
LON, LAT = (-9.0, 3.0), (49.0, 61.0)
#: Fields of a raw record: how many, and the places of departure_date and qty_pigs.
COLUMNS, DATE_AT, QUANTITY_AT = 19, 5, 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(
        table(spark, d, MOVEMENTS), table(spark, d, HOLDINGS), REFS, "row_id", "received_at", nine_digits(F.col("cph")), "loaded_at", "deleted_at", nine_digits
    ).select("row_id", "ref_field", "period", "reason")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    found = references.orphan_references(
        table(spark, d, MOVEMENTS), table(spark, d, HOLDINGS), REFS, "row_id", "received_at", nine_digits(F.col("cph")), "loaded_at", "deleted_at", nine_digits
    )
    return references.orphan_report(found, HOLDINGS)


def _mixed_values(spark: SparkSession, d: str) -> DataFrame:
    moved = {"lot_date": r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "departure_date": r"^[0-9]{8}$"}
    swedish = {"Avfärdsdatum": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"}
    return instants.union([
        instants.read_values(table(spark, d, MOVEMENTS), MOVEMENTS, moved, "row_id", "received_at", ZONES[MOVEMENTS]),
        instants.read_values(table(spark, d, SWEDEN), SWEDEN, swedish, "row_id", None, ZONES[SWEDEN], six_digits=True),
    ])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.align(cut(_mixed_values(spark, d)), ZONES)


def p2_zone_fit(spark: SparkSession, d: str) -> DataFrame:
    """Of each source, month and offset history: zone-less values and how many of them the history leaves out of line."""
    return instants.zone_fit(cut(_mixed_values(spark, d)), ZONES)


def _holding_states(spark: SparkSession, d: str, *others: Column, **states: tuple[str, Column]) -> tuple[DataFrame, int]:
    """States per field and holding, and the number of movements (from the tables' footers)."""
    moves = table(spark, d, MOVEMENTS)
    total = moves.count()
    long = heavy.long_keys(moves, REFS, nine_digits, *others)
    return heavy.tree_aggregate(long, ["ref_field", "key"], {"n": ("count", F.lit(1)), **states}, len(REFS) * total), total


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    states, total = _holding_states(spark, d)
    return heavy.heavy_keys(states, total, SHARE).select("ref_field", F.col("key").alias("cph"))


def p3_per_holding(spark: SparkSession, d: str) -> DataFrame:
    states, total = _holding_states(spark, d, F.col("qty_pigs"), pigs=("sum", T.quantity(F.col("qty_pigs"))))
    return states.select("ref_field", F.col("key").alias("cph"), "n", "pigs", (F.col("n") >= F.lit(total * SHARE)).alias("heavy"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, LINES)
    parts = faults.structure(F.col("raw_line"), F.col("delim"), COLUMNS, {"date": DATE_AT, "quantity": QUANTITY_AT})
    raw = lines.select(F.lit(LINES).alias("src_table"), F.col("line_id").alias("rec_id"), *(c.alias(n) for n, c in parts.items()))
    loaded = table(spark, d, MOVEMENTS).select(F.lit(MOVEMENTS).alias("src_table"), F.col("row_id").alias("rec_id"), F.lit(None).cast("string").alias("fault"), F.col("departure_date").alias("date"), F.col("qty_pigs").alias("quantity"))
    return raw.unionAll(loaded)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return faults.judged_rows(_records(spark, d), ZONES[MOVEMENTS]).filter("reason is not null").select("src_table", "rec_id", "reason")


def p4_valid(spark: SparkSession, d: str) -> DataFrame:
    """The records that stay usable, with what was read of them."""
    good = faults.judged_rows(_records(spark, d), ZONES[MOVEMENTS]).filter("reason is null")
    return good.select("src_table", "rec_id", F.trim("date").alias("departure_date"), T.quantity(F.col("quantity")).alias("qty_pigs"))


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary of invalid values with their reasons and how many sound records hold them."""
    return faults.invalid_values(faults.long_values(_records(spark, d)), ZONES[MOVEMENTS]).select("check", "value", "reason", "n")


def _daily_pigs(spark: SparkSession, d: str) -> DataFrame:
    """Pigs sent off: cph, day, pigs, each movement_reference once (its copy of lowest row_id). The movements are read once."""
    at = F.col("departure_date")
    moves = table(spark, d, MOVEMENTS).filter(~T.is_missing(at)).select("row_id", "movement_reference", nine_digits(F.col("departure_cph")).cast("bigint").alias("k"), "departure_date", T.quantity(F.col("qty_pigs")).alias("pigs"))
    moves = moves.filter("k is not null and pigs is not null")
    # Days written in plain form are read by a built-in; only other values are looked at in Python.
    iso = F.concat_ws("-", F.substring(at, 1, 4), F.substring(at, 5, 2), F.substring(at, 7, 2))
    plain = at.rlike(r"^[0-9]{8}$")
    moves = moves.select("row_id", "movement_reference", "k", "pigs", F.when(plain & (at >= "00010101"), iso.try_cast("date")).alias("day"), F.when(~plain, at).alias("other"))
    read = T.read_instants(moves, "other", "t", ZONES[MOVEMENTS])
    local = F.to_date(F.from_utc_timestamp(F.timestamp_micros("t_micros"), ZONES[MOVEMENTS]))
    both = read.select("row_id", "movement_reference", "k", "pigs", F.coalesce("day", local).alias("day")).filter("day is not null")
    once = both.groupBy("movement_reference", F.when(F.col("movement_reference").isNull(), F.col("row_id")).alias("own")).agg(*(F.min_by(c, "row_id").alias(c) for c in ("k", "day", "pigs")))
    return once.select("k", "day", "pigs")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    days = trailing.trailing_totals(_daily_pigs(spark, d), "k", "day", "pigs", [7, 30], F.col("total_7") >= 1000)
    return days.select(F.lpad(F.col("k").cast("string"), 9, "0").alias("cph"), F.date_format("day", "yyyy-MM-dd").alias("day"), "total_7", "total_30")


def p5_spans(spark: SparkSession, d: str) -> DataFrame:
    """Totals of all holdings and days, as spans of days of equal totals."""
    spans = trailing.trailing_spans(_daily_pigs(spark, d), "k", "day", "pigs", [7, 30])
    return spans.select(F.lpad(F.col("k").cast("string"), 9, "0").alias("cph"), "first_day", "last_day", "total_7", "total_30", *(F.round(f"average_{n}", 6).alias(f"average_{n}") for n in (7, 30)))


def _places(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("coordinates")
    return (
        table(spark, d, HOLDINGS).select(nine_digits(F.col("cph")).alias("cph"), at["lon"].alias("lon"), at["lat"].alias("lat"))
        .filter(F.col("cph").isNotNull() & F.col("lon").between(*LON) & F.col("lat").between(*LAT)).distinct()
    )


def _near(places: DataFrame) -> DataFrame:
    return nearby.near_pairs(places, "cph", "lon", "lat", NEAR_M, LAT[1])


def _inside(places: DataFrame, areas: DataFrame) -> DataFrame:
    return nearby.locate(places, areas, "area_id", "ring", "lon", "lat").select("cph", F.col("region").alias("area_id")).distinct()


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    return _near(cut(_places(spark, d)))


def p6_near_places(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of places close together, without their holdings: those are in p6_place_members."""
    return nearby.near_places(cut(_places(spark, d)).select("lon", "lat").distinct(), "lon", "lat", NEAR_M, LAT[1])


def p6_place_members(spark: SparkSession, d: str) -> DataFrame:
    """Each holding with its place and how many holdings share it."""
    places = _places(spark, d)
    return places.join(places.groupBy("lon", "lat").agg(F.count("*").alias("holdings")), ["lon", "lat"])


def p6_inside(spark: SparkSession, d: str) -> DataFrame:
    return _inside(cut(_places(spark, d)), table(spark, d, AREAS))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    places = cut(_places(spark, d))
    near = _near(places).select(F.lit("near").alias("kind"), "key_a", "key_b")
    return near.unionAll(_inside(places, table(spark, d, AREAS)).select(F.lit("inside").alias("kind"), F.col("cph").alias("key_a"), F.col("area_id").cast("string").alias("key_b")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_report, p2_found, p2_zone_fit, p3_found, p3_per_holding, p4_found, p4_valid, p4_reasons, p5_found, p5_spans, p6_found, p6_near, p6_near_places, p6_place_members, p6_inside)
}

_REFS = """refs AS (
  SELECT row_id, received_at, 'departure_cph' AS ref_field, departure_cph AS cph FROM example_movement_data WHERE departure_cph IS NOT NULL
  UNION ALL SELECT row_id, received_at, 'dest_cph', dest_cph FROM example_movement_data WHERE dest_cph IS NOT NULL),
keyed AS (SELECT *, CASE WHEN length(regexp_replace(cph, '[^0-9]', '', 'g')) = 9 THEN regexp_replace(cph, '[^0-9]', '', 'g') END AS k FROM refs),
parents AS (SELECT regexp_replace(cph, '[^0-9]', '', 'g') AS k, loaded_at, deleted_at FROM example_holding_data
  WHERE length(regexp_replace(cph, '[^0-9]', '', 'g')) = 9),
judged AS (SELECT r.row_id, r.ref_field, r.received_at, r.k, count(p.k) AS n,
    count(*) FILTER (WHERE p.loaded_at <= r.received_at AND (p.deleted_at IS NULL OR r.received_at < p.deleted_at)) AS n_valid,
    count(*) FILTER (WHERE p.loaded_at > r.received_at) AS n_later
  FROM keyed r LEFT JOIN parents p ON r.k = p.k GROUP BY ALL),
orphans AS (SELECT row_id, ref_field, k, strftime(received_at AT TIME ZONE 'UTC', '%Y-%m') AS period,
    CASE WHEN n = 0 THEN 'missing' WHEN n = n_later THEN 'later' ELSE 'deleted' END AS reason FROM judged WHERE n_valid = 0)"""
_PLACES = """places AS (SELECT DISTINCT regexp_replace(cph, '[^0-9]', '', 'g') AS cph, coordinates.lon AS lon, coordinates.lat AS lat FROM example_holding_data
  WHERE length(regexp_replace(cph, '[^0-9]', '', 'g')) = 9 AND coordinates.lon BETWEEN -9 AND 3 AND coordinates.lat BETWEEN 49 AND 61)"""

_METRES = "2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_NEAR = f"pairs AS (SELECT DISTINCT a.cph AS key_a, b.cph AS key_b FROM places a JOIN places b ON a.cph < b.cph AND b.lat BETWEEN a.lat - 0.00136 AND a.lat + 0.00136 AND {_METRES} <= 150)"
_INSIDE = """corners AS (SELECT area_id, unnest(range(1, len(ring))) AS i, ring FROM example_admin_areas),
edges AS (SELECT area_id, ring[i].lon AS x1, ring[i].lat AS y1, ring[i + 1].lon AS x2, ring[i + 1].lat AS y2 FROM corners),
inside AS (SELECT p.cph, p.lon, p.lat, e.area_id FROM places p JOIN edges e ON (e.x1 <= p.lon) <> (e.x2 <= p.lon) AND e.y1 + (e.y2 - e.y1) / (e.x2 - e.x1) * (p.lon - e.x1) <= p.lat
  GROUP BY ALL HAVING count(*) % 2 = 1)"""

ORACLE: dict[str, str] = {
    "p1_found": f"WITH {_REFS} SELECT row_id, ref_field, period, reason FROM orphans",
    "p1_report": f"WITH {_REFS} SELECT 'example_holding_data' AS parent_table, ref_field, period, reason, count(*) AS n_refs, count(DISTINCT k) AS n_keys FROM orphans GROUP BY ALL",
    "p3_found": f"WITH {_REFS}, n AS (SELECT ref_field, k AS cph, count(*) AS n FROM keyed WHERE k IS NOT NULL GROUP BY ALL) SELECT ref_field, cph FROM n WHERE n >= 0.03 * (SELECT count(*) FROM example_movement_data)",
    "p3_per_holding": """WITH q AS (SELECT *, CASE WHEN regexp_full_match(qty_pigs, '[ \\t]*[0-9]+([.]0+)?[ \\t]*') THEN CAST(regexp_extract(qty_pigs, '[0-9]+') AS BIGINT) END AS pigs FROM example_movement_data),
r AS (SELECT 'departure_cph' AS ref_field, regexp_replace(departure_cph, '[^0-9]', '', 'g') AS cph, pigs FROM q UNION ALL SELECT 'dest_cph', regexp_replace(dest_cph, '[^0-9]', '', 'g'), pigs FROM q)
SELECT ref_field, cph, count(*) AS n, CAST(sum(pigs) AS BIGINT) AS pigs, count(*) >= 0.03 * (SELECT count(*) FROM example_movement_data) AS heavy FROM r WHERE length(cph) = 9 GROUP BY ALL""",
    "p6_found": f"WITH {_PLACES}, {_NEAR}, {_INSIDE} SELECT 'near' AS kind, key_a, key_b FROM pairs UNION ALL SELECT DISTINCT 'inside', cph, CAST(area_id AS VARCHAR) FROM inside",
    "p6_near": f"WITH {_PLACES}, {_NEAR} SELECT * FROM pairs",
    "p6_inside": f"WITH {_PLACES}, {_INSIDE} SELECT DISTINCT cph, area_id FROM inside",
    "p6_near_places": f"""WITH {_PLACES}, spots AS (SELECT DISTINCT lon, lat FROM places)
SELECT a.lon AS xa, a.lat AS ya, b.lon AS xb, b.lat AS yb FROM spots a JOIN spots b ON (a.lon, a.lat) < (b.lon, b.lat) AND b.lat BETWEEN a.lat - 0.00136 AND a.lat + 0.00136 AND {_METRES} <= 150""",
    "p6_place_members": f"WITH {_PLACES} SELECT cph, lon, lat, count(*) OVER (PARTITION BY lon, lat) AS holdings FROM places",
    **problem_sql.ORACLE,
}
