"""The readings of dates that TESTDATA.md fixes."""

import datetime

import pytest
from drovetrail.functions import timestamps as T
from drovetrail.operators import instants
from pyspark.sql import functions as F

UTC = datetime.UTC
LONDON = {
    "20230601": "2023-05-31T23:00", "01/02/2023": "2023-02-01T00:00", "1.2.23": "2023-02-01T00:00", "2023-W01-1": "2023-01-02T00:00", "2023-032": "2023-02-01T00:00",
    "2023-10-29 01:30": "2023-10-29T00:30", "2023-03-26 01:30": "2023-03-26T01:30", "2023-10-29 01:30:00 GMT": "2023-10-29T01:30", "2023-07-01 10:00 BST": "2023-07-01T09:00",
    "01/07/2023 12:05 AM": "2023-06-30T23:05", "01/07/2023 12:05 PM": "2023-07-01T11:05", "Jan 5, 2023 03:04:05": "2023-01-05T03:04:05", "5th March 2023": "2023-03-05T00:00",
    "den 3 maj 2023 kl 10:20": "2023-05-03T09:20", "2023-01-05 kl. 10.20": "2023-01-05T10:20", "Thu, 05 Jan 2023 23:15:50 +0000": "2023-01-05T23:15:50", "2023-01-01T14:25:22+0200": "2023-01-01T12:25:22",
    "2022-12-31 19:42:29 -05:00": "2023-01-01T00:42:29", "20230101T025224Z": "2023-01-01T02:52:24", "202301010916": "2023-01-01T09:16", "20230101124326": "2023-01-01T12:43:26",
    "1672531794": "2023-01-01T00:09:54", "1672534251820": "2023-01-01T00:50:51.820", "2023-01-01T00:36:57.419335493Z": "2023-01-01T00:36:57.419335", "2023-07-01T05:02:21[Europe/Stockholm]": "2023-07-01T03:02:21",
    "23/8 2023": "2023-08-22T23:00", "2024-01-05T10:00:00[Europe/Budapest]": "2024-01-05T09:00", "2024-07-05 10:00[America/New_York]": "2024-07-05T14:00", "2024-01-05 10:00[Etc/GMT+5]": "2024-01-05T15:00",
    "Monday 5 january 2024": "2024-01-05T00:00", "tors. 5 januari 2023": "2023-01-05T00:00", "Måndag den 5 juni 2023 kl 10:00": "2023-06-05T09:00", "lördag 7 januari 2023": "2023-01-07T00:00", "2024-02-29": "2024-02-29T00:00", " 20230105 ": "2023-01-05T00:00",
}
INVALID = ["20230230", "2023-02-29", "31/06/2023", "2O230101", "2023-01-01T25:31:52Z", "202301016", "2023011", "230101", "pending", "??/01/2023", "2023-W54-1", "2023-366", "01 Smarch 2023", "0000-01-01", "2023-01-01 10:61", "13:00 PM", "2023-01-01 10:00 +99:00", " ", "x" * 100_000, "01/01/2023 13:05 PM", "1234567890123456", "monkey 5 january 2024", "2024-01-05 10:00[Europe/Atlantis]", "2024-01-05 10:00[posixrules]"]


def test_forms(spark):
    rows = [(k, v) for k, v in LONDON.items()] + [(k, None) for k in INVALID]
    got = T.read_instants(spark.createDataFrame(rows, "v string, want string"), "v", "t", "Europe/London").collect()
    for r in got:
        if r["want"] is None:
            assert (r["t_state"], r["t_micros"]) == ("invalid", None), r["v"][:50]
        else:
            want = datetime.datetime.fromisoformat(r["want"]).replace(tzinfo=UTC)
            assert r["t_state"] == "valid" and r["t_micros"] == round(want.timestamp() * 1_000_000), r


def test_missing_six_digits_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",), ("NA",), ("230410",), ("NA ",)], "v string")
    got = [(r["t_state"], r["t_micros"]) for r in T.read_instants(df, "v", "t", "Europe/Stockholm", six_digits=True).collect()]
    assert [s for s, _ in got] == ["missing"] * 3 + ["valid", "invalid"]
    assert got[3][1] == 1681077600000000
    assert T.read_instants(df.limit(0), "v", "t", "UTC").count() == 0


def source(spark, said, n=4000, step=7_800_000_000):
    """Rows whose odd values state their zone and whose even ones are local by ``said`` (a column of the instant), received up to hours later."""
    base = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") * step + 1_672_531_200_000_000).alias("at"), (F.pmod(F.xxhash64("id"), F.lit(20_000_000_000)) + 3_600_000_000).alias("lag"))
    local = F.date_format(said(F.timestamp_micros("at")), "yyyy-MM-dd HH:mm:ss")
    zoned = F.concat(F.date_format(F.timestamp_micros("at"), "yyyy-MM-dd HH:mm:ss"), F.lit("Z"))
    return base, base.select("row_id", F.when(F.col("row_id") % 2 == 0, local).otherwise(zoned).alias("v"), F.timestamp_micros(F.col("at") + F.col("lag")).alias("seen"))


@pytest.mark.parametrize("ingested", ["seen", None])
@pytest.mark.parametrize("zone", ["UTC", "Europe/Stockholm", "America/Sao_Paulo", "Asia/Kathmandu"])
def test_zone_is_estimated(spark, zone, ingested):
    """Zone-less times of a source that really follow another history than the declared one are found out, by ingestion times or by sequence."""
    # Neighbours in sequence tell offsets apart by no more than the time between them.
    base, df = source(spark, lambda t: F.from_utc_timestamp(t, zone), *(() if ingested else (60_000, 600_000_000)))
    values = instants.read_values(df, "s", {"v": None}, "row_id", ingested, "Europe/London").cache()
    declared = {"s": "Europe/London"}
    chosen = instants.choose_zones(instants.zone_fit(values, declared), declared)
    assert len(chosen["s"]) == 1
    off = instants.to_instants(values, chosen).join(base, "row_id").filter(F.abs(F.col("utc_micros") - F.col("at")) >= 1_000_000)
    # Only local times that occur twice are ambiguous.
    assert off.count() <= 6


def test_zone_that_changes_in_time_and_declared_zone_that_holds(spark):
    early = F.timestamp_micros(F.lit(1_688_169_600_000_000))  # 2023-07-01
    _, changed = source(spark, lambda t: F.when(t < early, F.from_utc_timestamp(t, "Europe/London")).otherwise(F.from_utc_timestamp(t, "Asia/Tokyo")))
    base, right = source(spark, lambda t: F.from_utc_timestamp(t, "Europe/London"))
    declared = {"s": "Europe/London", "r": "Europe/London", "none": "UTC"}
    values = instants.read_values(changed, "s", {"v": None}, "row_id", "seen", "UTC").unionAll(instants.read_values(right, "r", {"v": None}, "row_id", "seen", "UTC"))
    chosen = instants.choose_zones(instants.zone_fit(values, declared), declared)
    assert chosen["r"] == [(None, "Europe/London")] and chosen["none"] == [(None, "UTC")]
    assert [first for first, _ in chosen["s"]] == [None, datetime.date(2023, 7, 1)] and chosen["s"][0][1] == "Europe/London"  # the second is any zone like Tokyo's
    off = instants.to_instants(values.filter("src_table = 's'"), chosen).join(base, "row_id").filter(F.abs(F.col("utc_micros") - F.col("at")) >= 1_000_000)
    assert off.count() <= 8


def test_sequence_without_order_keeps_the_declared_zone(spark):
    base, df = source(spark, lambda t: F.from_utc_timestamp(t, "Europe/Stockholm"))
    shuffled = df.withColumn("row_id", F.pmod(F.xxhash64("row_id"), F.lit(10**6)))
    declared = {"s": "Europe/Stockholm"}
    values = instants.read_values(shuffled, "s", {"v": None}, "row_id", None, "UTC")
    assert instants.choose_zones(instants.zone_fit(values, declared), declared) == {"s": [(None, "Europe/Stockholm")]}
    assert instants.choose_zones(instants.zone_fit(values.limit(0), declared), declared) == {"s": [(None, "Europe/Stockholm")]}


def test_quantities(spark):
    rows = [("12", 12), (" 7 ", 7), ("3.0", 3), ("0001", 1), ("3.", None), ("1,277", None), ("-4", None), ("NaN", None), ("1e2", None), ("", None), (None, None), ("9" * 30, None), ("٣", None), ("5.50", None)]
    got = spark.createDataFrame(rows, "v string, want bigint").withColumn("q", T.quantity(F.col("v"))).collect()
    assert [(r["v"], r["q"]) for r in got] == rows


def test_values_of_any_length_are_read():
    short = T.read_text("2024-03-05T10:20:30.123456Z", False)
    assert short[0] == T.VALID
    assert T.read_text("2024-03-05T10:20:30.123456" + "7" * 200 + "Z", False) == short
    assert T.read_text("2024-03-05" + "x" * 200, False)[0] != T.VALID
