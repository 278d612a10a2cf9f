"""Timestamps of mixed form, precision and zone as one UTC instant; missing zones estimated from ingestion times or sequence order."""

from __future__ import annotations

import bisect
import datetime
import zoneinfo
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timestamps as T

#: Of histories with the same offsets in the months at hand, the first of these names is given, else the first by name.
PREFERRED = ("UTC", "Europe/London", "Europe/Stockholm", "Europe/Helsinki", "America/New_York", "Asia/Kolkata")
#: Another history than the declared one is chosen for a stretch of months only if it saves violations of this share of
#: its values, of this many, and of this many times their root (what chance may do).
MARGIN, LEAST, CHANCE = 0.05, 30.0, 6.0
#: Months with fewer values of a stated zone say nothing.
REFERENCES = 20
#: Offsets are told apart by quarters of an hour; these are the least and the greatest, and what counts as beyond them.
QUARTER_H, OFFSETS, BEYOND = 900_000_000, range(-48, 57), 64
#: Neighbours in sequence are looked for within so many consecutive row numbers.
SEQUENCE = 1 << 20

Histories = dict[str, list[tuple[datetime.date | None, str]]]


def read_values(df: DataFrame, source: str, fields: dict[str, str | None], row_id: str, ingested: str | None, zone: str, six_digits: bool = False) -> DataFrame:
    """The valid values of some columns: src_table, field, row_id, wall, offset, timed, seen (ingestion, microseconds).

    ``fields`` maps columns to a pattern of their plain form, values in which are left out (None: none). The table is
    read once for all of them.
    """
    seen = F.unix_micros(ingested) if ingested else F.lit(None).cast("bigint")
    plain = lambda f, p: F.lit(False) if p is None else F.col(f).rlike(p)
    each = F.array(*(F.when(~T.is_missing(F.col(f)) & ~plain(f, p), F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))) for f, p in fields.items()))
    rows = df.select(F.lit(source).alias("src_table"), F.col(row_id).alias("row_id"), seen.alias("seen"), F.explode(F.array_compact(each)).alias("v")).select("src_table", "row_id", "seen", "v.*")
    rows = T.read_instants(rows, "value", "t", zone, six_digits)
    return rows.filter(F.col("t_state") == T.VALID).select("src_table", "field", "row_id", F.col("t_wall").alias("wall"), F.col("t_offset").alias("offset"), F.col("t_timed").alias("timed"), "seen")


def _quarters(micros: Column) -> Column:
    """So many quarters of an hour, rounded up, at most BEYOND either way."""
    return F.least(F.greatest(F.ceil(micros / QUARTER_H), F.lit(-BEYOND)), F.lit(BEYOND)).cast("int")


def _day(wall: Column) -> Column:
    return F.floor(wall / F.lit(86_400_000_000)).cast("int")


def ingestion_limits(values: DataFrame) -> DataFrame:
    """How zone-less values with an ingestion time lie to the lags of those that state their zone: src_table, field, day, mode, c, n.

    The lags of stated values, their shortest usual one (0.5 %) and their quartiles, are taken for each month, as lags
    may have seasons. Under an offset below ``c[i]`` (quarters of an hour) a value's lag is under the i-th of these.
    """
    timed = values.filter(F.col("timed") & F.col("seen").isNotNull()).withColumn("month", F.trunc(F.date_from_unix_date(_day(F.col("wall"))), "month"))
    # One row for each column and month: bounded by the calendar, so small enough for every executor.
    stated = timed.filter(F.col("offset").isNotNull()).groupBy("src_table", "field", "month").agg(
        F.percentile_approx(F.col("seen") - F.col("wall") + F.col("offset").cast("bigint") * 60_000_000, [0.005, 0.25, 0.5, 0.75], 1000).alias("q"), F.count("*").alias("n_ref")
    ).filter(F.col("n_ref") >= REFERENCES)
    silent = timed.filter(F.col("offset").isNull()).join(F.broadcast(stated), ["src_table", "field", "month"])
    c = F.transform("q", lambda q: _quarters(q - F.col("seen") + F.col("wall")))
    return silent.groupBy("src_table", "field", _day(F.col("wall")).alias("day"), F.lit("lag").alias("mode"), c.alias("c")).agg(F.count("*").alias("n"))


def sequence_limits(values: DataFrame) -> DataFrame:
    """How zone-less values without an ingestion time lie to their neighbours in sequence (by row number): as above.

    Neighbours are the last stated instant before and the first after. Under an offset below ``c[0]`` a value would come
    after the next one, under one from ``c[1]`` on before the last one.
    """
    timed = values.filter(F.col("timed") & F.col("seen").isNull())
    stated = F.when(F.col("offset").isNotNull(), F.col("wall") - F.col("offset").cast("bigint") * 60_000_000)
    block = Window.partitionBy("src_table", "field", F.floor(F.col("row_id") / SEQUENCE))
    # Both ways the frame grows from row to row, so a block is gone through once.
    nearest = lambda order: F.last(stated, ignorenulls=True).over(block.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    last, after = nearest(F.col("row_id")), nearest(F.col("row_id").desc())
    placed = timed.withColumns({"last": last, "after": after}).filter(F.col("offset").isNull())
    c = F.array(F.coalesce(_quarters(F.col("wall") - F.col("after")), F.lit(-BEYOND)), F.coalesce(F.floor((F.col("wall") - F.col("last")) / QUARTER_H) + 1, F.lit(BEYOND)))
    c = F.transform(c, lambda x: F.least(F.greatest(x, F.lit(-BEYOND)), F.lit(BEYOND)).cast("int"))
    return placed.groupBy("src_table", "field", _day(F.col("wall")).alias("day"), F.lit("order").alias("mode"), c.alias("c")).agg(F.count("*").alias("n"))


def _month(day: int) -> datetime.date:
    return (datetime.date(1970, 1, 1) + datetime.timedelta(day)).replace(day=1)


def _offsets(zone: str, days: list[int]) -> tuple[int, ...]:
    """Quarters of an hour east of UTC at noon of each of the ascending days; where a month's ends agree it has one offset."""
    at = lambda d: T.local_offset((d * 24 + 12) * 3_600_000_000, zoneinfo.ZoneInfo(zone)) // 900
    out, i = [], 0
    while i < len(days):
        j = bisect.bisect_left(days, (_month(days[i]) + datetime.timedelta(32)).replace(day=1).toordinal() - datetime.date(1970, 1, 1).toordinal())
        first, last = at(days[i]), at(days[j - 1])
        out += [first] * (j - i) if first == last else [at(d) for d in days[i:j]]
        i = j
    return tuple(out)


def histories(days: list[int], declared: tuple[str, ...] = ()) -> dict[str, tuple[int, ...]]:
    """Every different offset history of the time zone database over some days: one name of it, and its offsets."""
    names = [*dict.fromkeys([*declared, *PREFERRED]), *sorted(zoneinfo.available_timezones())]
    out: dict[tuple[int, ...], str] = {}
    for name in names:
        try:
            out.setdefault(_offsets(name, days), name)
        except (ValueError, OSError):  # entries of the database that are no zones
            continue
    return {name: offsets for offsets, name in out.items()}


def zone_fit(values: DataFrame, declared: dict[str, str]) -> DataFrame:
    """How well each offset history aligns the zone-less values of a source: src_table, month, zone, n, violations.

    Values are aligned with their ingestion times where a source has them: a value violates a history if by it the record
    came in sooner than records of stated zone do; further violations are the rows that would have to move for the same
    shares to lie under the quartiles of the lags, so that a wrong summer time shows. A source without ingestion times
    is aligned by sequence: a value violates a history if by it, it isn't between its neighbours of stated zone. All
    histories of the time zone database are tried. What is collected for that are counts by day and offset, which are
    bounded by the calendar (at most 105 offsets a day and column), not by rows.
    """
    limits = ingestion_limits(values).unionAll(sequence_limits(values))
    under = lambda i: F.sum(F.when(F.col("o") < F.get("c", F.lit(i)), F.col("n")).otherwise(0)).cast("double")
    each = limits.withColumn("o", F.explode(F.array(*map(F.lit, OFFSETS))))
    days = each.groupBy("src_table", "field", "day", "mode", "o").agg(F.sum("n").cast("double").alias("n"), *(under(i).alias(f"u{i}") for i in range(4))).toPandas()
    spark, out = values.sparkSession, []
    for source, own in days.groupby("src_table"):
        every = sorted(set(own["day"].astype(int)))
        place = {d: i for i, d in enumerate(every)}
        months = np.array([_month(d).toordinal() for d in every])
        firsts, at = np.unique(months, return_inverse=True)
        tables = []
        for (field, mode), g in own.groupby(["field", "mode"]):
            t = np.zeros((len(every), len(OFFSETS), 5))
            t[g["day"].astype(int).map(place), g["o"] - OFFSETS.start] = g[["n", "u0", "u1", "u2", "u3"]].to_numpy(float)
            tables.append((mode, t))
        for zone, offsets in histories(every, (declared[source],)).items():
            o = np.array(offsets) - OFFSETS.start
            n, bad = np.zeros(len(firsts)), np.zeros(len(firsts))
            for mode, t in tables:
                rows = np.zeros((len(firsts), 5))
                np.add.at(rows, at, t[np.arange(len(every)), np.clip(o, 0, len(OFFSETS) - 1)])
                n += rows[:, 0]
                if mode == "lag":
                    bad += rows[:, 1] + sum(np.abs(rows[:, i + 2] - rows[:, 0] * s) for i, s in enumerate((0.25, 0.5, 0.75)))
                else:
                    bad += rows[:, 1] + rows[:, 0] - rows[:, 2]
            out += [(source, datetime.date.fromordinal(int(m)), zone, int(k), float(b)) for m, k, b in zip(firsts, n, bad, strict=True)]
    return _table(spark, out)


def _table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "src_table string, month date, zone string, n bigint, violations double")


def _best_path(cost: np.ndarray, change: float) -> list[int]:
    """For each month (row) the column such that the sum of costs and of changes between months is least."""
    total, back = cost[0], []
    for row in cost[1:]:
        best = int(total.argmin())
        stay = total <= total[best] + change
        back.append(np.where(stay, np.arange(len(total)), best))
        total = np.where(stay, total, total[best] + change) + row
    path = [int(total.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def choose_zones(fit: DataFrame, declared: dict[str, str]) -> Histories:
    """The histories of each source, as (first month, zone) from the first on: those of fewest violations, which may change in time.

    Every change costs as much as it has to save. The declared zone stands where nothing else is clearly better, before
    the first month and for sources that can't be aligned. Reads one row per source, month and history.
    """
    chosen: Histories = {source: [(None, zone)] for source, zone in declared.items()}
    rows = fit.toPandas()
    for source, zone in declared.items():
        own = rows[rows["src_table"] == source]
        if not len(own):
            continue
        costs = own.pivot(index="month", columns="zone", values="violations").sort_index()
        costs = costs[[zone, *(z for z in costs.columns if z != zone)]]
        n = own.drop_duplicates("month").set_index("month")["n"].reindex(costs.index).to_numpy(float)
        needed = lambda k: max(LEAST, MARGIN * k, CHANCE * k**0.5)
        table, months = costs.to_numpy(float), list(costs.index)
        path = _best_path(table, needed(n.mean()))
        start, segments = 0, []
        for i in range(1, len(path) + 1):
            if i == len(path) or path[i] != path[start]:
                saved = (table[start:i, 0] - table[start:i, path[start]]).sum()
                segments.append((months[start], costs.columns[path[start] if saved > needed(n[start:i].sum()) else 0]))
                start = i
        # A zone that holds from the first month on is taken to have held before.
        segments[0] = (None, segments[0][1])
        chosen[source] = [s for k, s in enumerate(segments) if k == 0 or s[1] != segments[k - 1][1]]
    return chosen


def to_instants(values: DataFrame, zones: Histories) -> DataFrame:
    """src_table, row_id, field, utc_micros: zone-less values by the history of their source."""
    micros = F.lit(None).cast("bigint")
    for source, segments in zones.items():
        own = T.instant(F.col("wall"), F.col("offset"), segments[0][1])
        for first, zone in segments[1:]:
            since = (first - datetime.date(1970, 1, 1)).days * 86_400_000_000
            own = F.when(F.col("wall") >= since, T.instant(F.col("wall"), F.col("offset"), zone)).otherwise(own)
        micros = F.when(F.col("src_table") == source, own).otherwise(micros)
    return values.select("src_table", "row_id", "field", micros.alias("utc_micros"))


def align(values: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Values (of any number of sources) as instants, zone-less ones by the histories chosen for their sources."""
    return to_instants(values, choose_zones(zone_fit(values, declared), declared))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)
