"""The operators of the general problems against plain versions, with nulls, ties, repeats, empty tables and clashing names."""

import csv
import datetime as dt
import io
import random
from collections import Counter, defaultdict

import pytest
from drovetrail.functions.digits import nine_digits
from drovetrail.operators import faults, heavy, nearby, references, trailing
from drovetrail.runtime import salted_lookup
from pyspark.sql import functions as F


def test_orphans_by_brute_force(spark):
    rnd, t0 = random.Random(1), dt.datetime(2023, 1, 1)
    day = lambda n: t0 + dt.timedelta(days=n)
    keys = [f"{i:09d}" for i in range(30)]
    parents = [(f"{k[:2]}/{k[2:5]}/{k[5:]}", day(a := rnd.randrange(60)), rnd.choice([None, day(a + rnd.randrange(20))])) for k in keys[:20] for _ in range(rnd.randrange(1, 4))] + [(None, day(0), None), ("123", day(0), None)]
    children = [(i, rnd.choice([*keys, keys[0], keys[0], None, "", "12/3", " 00-000-0001"]), rnd.choice(keys), day(rnd.randrange(80)), "x") for i in range(500)]
    c = spark.createDataFrame(children, "row_id bigint, a string, b string, seen timestamp, key string")
    p = spark.createDataFrame(parents, "cph string, a timestamp, b timestamp")
    got = references.orphan_references(c, p, ["a", "b"], "row_id", "seen", nine_digits(F.col("cph")), "a", "b", nine_digits)

    def nine(x):
        d = "".join(ch for ch in x if ch.isdigit())
        return d if len(d) == 9 else None

    want = []
    for i, a, b, seen, _ in children:
        for f, v in (("a", a), ("b", b)):
            if v is None:
                continue
            own = [(s, e) for cph, s, e in parents if cph and nine(cph) and nine(cph) == nine(v)]
            if any(s <= seen and (e is None or seen < e) for s, e in own):
                continue
            want.append((i, f, seen.strftime("%Y-%m"), "missing" if not own else "later" if all(s > seen for s, _ in own) else "deleted"))
    assert sorted(map(tuple, got.select("row_id", "ref_field", "period", "reason").collect())) == sorted(want)
    report = references.orphan_report(got, "parents").agg(F.sum("n_refs")).first()[0]
    assert report == len(want)
    alone = references.orphan_references(c, p.limit(0), ["a"], "row_id", "seen", nine_digits(F.col("cph")), "a", "b", nine_digits)
    assert {r["reason"] for r in alone.collect()} == {"missing"}
    assert references.orphan_references(c.limit(0), p, ["a"], "row_id", "seen", nine_digits(F.col("cph")), "a", "b", nine_digits).count() == 0


def test_keys_of_many_versions(spark):
    """A key with more versions than travel with it, some of them on one day."""
    rnd, t0 = random.Random(21), dt.datetime(2023, 1, 1)
    at = lambda n: t0 + dt.timedelta(hours=n)
    parents = [(f"{k:09d}", at(a := rnd.randrange(2000)), rnd.choice([at(a + rnd.randrange(40)), at(a + 500) if rnd.random() < 0.02 else at(a + 1)])) for k in (1, 2) for _ in range(150)]
    parents += [("000000003", at(1990), None), ("000000001", None, None)]
    children = [(i, f"{rnd.randrange(1, 5):09d}", at(rnd.randrange(2100))) for i in range(800)]
    c, p = spark.createDataFrame(children, "row_id bigint, a string, seen timestamp"), spark.createDataFrame(parents, "cph string, a timestamp, b timestamp")
    got = references.orphan_references(c, p, ["a"], "row_id", "seen", F.col("cph"), "a", "b")
    want = []
    for i, k, seen in children:
        own = [(s, e) for x, s, e in parents if x == k]
        if not any(s is not None and s <= seen and (e is None or seen < e) for s, e in own):
            want.append((i, "missing" if not own else "later" if min(s for s, _ in own if s) > seen else "deleted"))
    assert sorted(map(tuple, got.select("row_id", "reason").collect())) == sorted(want) and len({r for _, r in want}) == 3
    spans = references.validity_spans(p, F.col("cph"), "a", "b").orderBy("key", "a").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(spans, spans[1:], strict=False) if x["key"] == y["key"]) and max(r["versions"] for r in spans) > references.INLINE


def test_one_key_with_most_rows_is_spread(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.upper("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = salted_lookup(rows, table, "k", F.col("id"), "n", rows_per_task=500).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r["n"] for r in got) == 20_000 and max(r["n"] for r in got) < 3_000


def test_salted_lookup_spreads_and_keeps_rows(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k is not null and k <> 'k7'").withColumn("v", F.upper("k"))
    got = salted_lookup(rows, table, "k", F.col("id"), "n", rows_per_task=100)
    assert got.columns == ["k", "id", "v"] and got.count() == 3000
    assert got.filter("v is null and k is not null and k <> 'k7'").count() == 0 and got.filter("k is null or k = 'k7'").filter("v is not null").count() == 0


def test_tree_aggregate(spark):
    rows = spark.range(5000, numPartitions=7).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 == 0, None).otherwise((F.col("id") % 40).cast("string")).alias("k"), "id")
    states = {"n": ("count", F.lit(1)), "s": ("sum", F.col("id")), "lo": ("min", F.col("id")), "hi": ("max", F.col("id"))}
    got = {r["k"]: tuple(r)[1:] for r in heavy.tree_aggregate(rows, ["k"], states, chunk_rows=100, fan_in=3).collect()}
    assert {r["k"]: tuple(r)[1:] for r in heavy.tree_aggregate(rows.repartition(3), ["k"], states, total=1, chunk_rows=10, fan_in=2).collect()} == got
    want = {r["k"]: tuple(r)[1:] for r in rows.groupBy("k").agg(F.count("*"), F.sum("id"), F.min("id"), F.max("id")).collect()}
    assert got == want
    assert heavy.tree_aggregate(rows.limit(0), ["k"], states).count() == 0
    assert [r["k"] for r in heavy.heavy_keys(heavy.tree_aggregate(rows, ["k"], {"n": ("count", F.lit(1))}), 5000, 0.1).collect()] == ["hot"]


def _plain_fault(raw, delim):
    """Structure of a record, read character by character."""
    if raw is None:
        return "column_count", []
    fields, i, n = [], 0, len(raw)
    while True:
        if i < n and raw[i] == '"':
            i, out = i + 1, ""
            while True:
                if i >= n:
                    return "quoting", []
                if raw[i] == '"' and i + 1 < n and raw[i + 1] == '"':
                    out, i = out + '"', i + 2
                elif raw[i] == '"':
                    i += 1
                    break
                else:
                    out, i = out + raw[i], i + 1
            if i < n and raw[i] != delim:
                return "quoting", []
        else:
            j = raw.find(delim, i)
            j = n if j < 0 else j
            out, i = raw[i:j], j
            if '"' in out:
                return "quoting", []
        fields.append(out)
        if i >= n:
            return None, fields
        i += 1


def test_structure_of_records(spark):
    rnd = random.Random(2)
    lines = [(k, "".join(rnd.choice('a",;\n\u0001\u0002b ') for _ in range(rnd.randrange(12))), rnd.choice(",;|")) for k in range(3000)]
    lines += [(5000, None, ","), (5001, '"' + "x" * 300_000 + '""' * 1000 + '",b,c', ","), (5002, ",,", ","), (5003, "", ";")]
    parts = faults.structure(F.col("raw"), F.col("delim"), 3, {"x": 1, "z": 3})
    got = spark.createDataFrame(lines, "k int, raw string, delim string").select("k", *(c.alias(n) for n, c in parts.items())).collect()
    by = {k: (raw, d) for k, raw, d in lines}
    for r in got:
        fault, fields = _plain_fault(*by[r["k"]])
        fault = fault or (None if len(fields) == 3 else "column_count")
        assert r["fault"] == fault, by[r["k"]]
        if fault is None:
            assert [r["x"], r["z"]] == [fields[0], fields[2]], by[r["k"]]


def test_good_csv_is_sound(spark):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(['a "b"', "c,d", "e\nf"])
    parts = faults.structure(F.lit(out.getvalue()), F.lit(","), 3, {"x": 1, "y": 2, "z": 3})
    assert tuple(spark.range(1).select(*parts.values()).first()) == (None, 'a "b"', "c,d", "e\nf")


def test_faulty_rows(spark):
    rows = [("t", 1, None, "20230101", "5"), ("t", 2, None, "20230230", "x"), ("t", 3, None, None, "1e3"), ("t", 4, "quoting", None, None), ("t", 5, None, "NA", ""), ("t", 6, None, "5 Jan 2023", " 7.0 "), ("u", 2, None, "soon", "5"), ("t", 7, None, "00000101", "5")]
    df = spark.createDataFrame(rows, "src_table string, rec_id bigint, fault string, date string, quantity string")
    good = faults.judged_rows(df, "Europe/London").filter("reason is null").collect()
    assert sorted((r["src_table"], r["rec_id"], r["date"], r["quantity"]) for r in good) == [("t", 1, "20230101", "5"), ("t", 5, "NA", ""), ("t", 6, "5 Jan 2023", " 7.0 ")]
    for sent in (100, 0):
        found = faults.judged_rows(df, "Europe/London", sent).filter("reason is not null").select("src_table", "rec_id", "reason")
    got = sorted(map(tuple, found.collect()))
    assert got == [("t", 2, "bad_date"), ("t", 3, "bad_quantity"), ("t", 4, "quoting"), ("t", 7, "bad_date"), ("u", 2, "bad_date")]
    assert faults.judged_rows(df.limit(0), "Europe/London").count() == 0


def test_trailing_totals(spark):
    rnd, d0 = random.Random(3), dt.date(2024, 2, 20)
    rows = [(rnd.choice("abc"), d0 + dt.timedelta(rnd.choice([0, 1, 6, 7, 8, 29, 30, 31, 60])), rnd.randrange(5)) for _ in range(40)] + [(None, d0, 5), ("a", None, 5), ("b", d0, None)]
    got = {(r[0], r[1]): tuple(r)[2:] for r in trailing.trailing_totals(spark.createDataFrame(rows, "e string, d date, v bigint"), "e", "d", "v", [7, 30]).collect()}
    assert all(a == t / 7 and b == u / 30 for t, u, a, b in got.values())
    got = {k: v[:2] for k, v in got.items()}
    sums = defaultdict(Counter)
    for e, d, v in rows:
        if e and d and v is not None:
            sums[e][d] += v
    want = {}
    for e, c in sums.items():
        day = min(c)
        while day < max(c) + dt.timedelta(30):
            want[e, day] = tuple(sum(v for d, v in c.items() if day - dt.timedelta(n) < d <= day) for n in (7, 30))
            day += dt.timedelta(1)
    assert got == want
    some = trailing.trailing_totals(spark.createDataFrame(rows, "e string, d date, v bigint"), "e", "d", "v", [7, 30], F.col("total_7") >= 9)
    assert {(r[0], r[1]) for r in some.collect()} == {k for k, v in want.items() if v[0] >= 9}


@pytest.mark.parametrize(("x0", "metres", "cell"), [(-2.0, 150.0, 2048), (-2.0, 150.0, 3), (179.99, 150.0, 2048), (179.0, 9_000_000.0, 2048)])
def test_near_pairs(spark, monkeypatch, x0, metres, cell):
    """Also with crowded cells, across the 180th meridian, and where few columns go round the globe."""
    import math

    monkeypatch.setattr(nearby.near_places, "__defaults__", (cell,))
    rnd = random.Random(4)
    pts = [(f"p{i}", (x0 + rnd.random() * 0.02 + 180) % 360 - 180, 60.9 + rnd.random() * 0.01) for i in range(300)]
    pts += [("twin1", x0, 60.9), ("twin2", x0, 60.9), ("twin2", x0, 60.9), (None, x0, 60.9), ("nowhere", None, 60.9), ("west", -179.999, 60.9), ("east", 179.9999, 60.9)]
    got = [tuple(r) for r in nearby.near_pairs(spark.createDataFrame(pts, "k string, x double, y double"), "k", "x", "y", metres, 61.0).collect()]

    def far(a, b):
        (x, y), (u, v) = (map(math.radians, p[1:]) for p in (a, b))
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    good = [p for p in pts if None not in p]
    assert len(got) == len(set(got)) and set(got) == {(a[0], b[0]) for a in good for b in good if a[0] < b[0] and far(a, b) <= metres}


def test_locate_in_concave_regions_with_junctions(spark):
    rings = [(1, [(0, 0), (4, 0), (4, 4), (2, 1.5), (0, 4), (0, 0)]), (2, [(0, 4), (2, 1.5), (4, 4), (0, 4)]), (3, [(4, 0), (6, 0), (6, 2), (4, 2), (4, 0)]), (4, [(4, 2), (6, 2), (6, 4), (4, 4), (4, 2)]), (5, None), (6, [])]
    regions = spark.createDataFrame([(i, None if r is None else [{"lon": float(x), "lat": float(y)} for x, y in r]) for i, r in rings], "area int, ring array<struct<lon:double,lat:double>>")
    rnd = random.Random(5)
    pts = [(i, rnd.uniform(-1, 7), rnd.uniform(-1, 5)) for i in range(2000)]

    def inside(x, y, ring):
        return sum((a[0] <= x) != (b[0] <= x) and a[1] + (b[1] - a[1]) / (b[0] - a[0]) * (x - a[0]) <= y for a, b in zip(ring, ring[1:], strict=False)) % 2 == 1

    df = spark.createDataFrame([*pts, (9000, None, 1.0)], "region int, lon double, lat double").withColumnRenamed("region", "pid")
    got = {(r["pid"], r["region"]) for r in nearby.locate(df, regions, "area", "ring", "lon", "lat", 0.7).collect()}
    assert got == {(i, k) for i, x, y in pts for k, ring in rings if ring and inside(x, y, ring)}
    assert {(r["pid"], r["region"]) for r in nearby.locate(df, regions, "area", "ring", "lon", "lat").collect()} == got
    assert nearby.locate(df, regions.limit(0), "area", "ring", "lon", "lat").count() == 0
    assert nearby.locate(df.limit(0), regions, "area", "ring", "lon", "lat", 0.7).count() == 0


def test_locate_where_a_multiple_of_the_width_is_rounded_up(spark):
    """17, 34 and 39 times 0.05 lie right of 0.85, 1.7 and 1.95, which are in those columns."""
    square = lambda a, b: [{"lon": x, "lat": y} for x, y in ((a, 50.0), (b, 50.0), (b, 52.0), (a, 52.0), (a, 50.0))]
    regions = spark.createDataFrame([(1, square(-1.0, 0.85)), (2, square(0.85, 1.9)), (3, square(1.9, 3.0))], "area int, ring array<struct<lon:double,lat:double>>")
    rnd = random.Random(6)
    xs = [0.85, 1.7, 1.95, *(k / 100 for k in range(-120, 320)), *(rnd.uniform(-1.2, 3.2) for _ in range(200))]
    pts = spark.createDataFrame([(i, x, 51.0) for i, x in enumerate(xs)], "pid int, lon double, lat double")
    got = {(r["pid"], r["region"]) for r in nearby.locate(pts, regions, "area", "ring", "lon", "lat", 0.05).collect()}
    assert got == {(i, k) for i, x in enumerate(xs) for k, a, b in ((1, -1.0, 0.85), (2, 0.85, 1.9), (3, 1.9, 3.0)) if a <= x < b}
