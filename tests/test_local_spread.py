"""Local spread and near pairs against all pairs."""

import math
import random

from drovetrail.operators import nearby, transmission


def metres(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * nearby.EARTH_RADIUS * math.asin(math.sqrt(min(h, 1.0)))


def tier_of(m):
    return next((p for low, high, p in transmission.LOCAL_TIERS if low <= m < (high or math.inf)), 0.0)


def test_local_spread_by_all_pairs_without_moving_pairs(spark):
    rnd = random.Random(2)
    at = {f"h{k:03d}": (rnd.uniform(-0.04, 0.04), rnd.uniform(54.0, 54.05)) for k in range(250)} | {"e": (180.0, 54.0), "w": (-179.999, 54.001), "same": (0.0, 54.0), "place": (0.0, 54.0)}
    rows = [(k, *p) for k, p in at.items()] + [("same", 0.0, 54.0), ("none", None, 54.0), (None, 0.0, 54.0)]
    got = transmission.local_spread(spark.createDataFrame(rows, "id string, lon double, lat double"))
    want = {(a, b, p) for a in at for b in at if a != b and (p := tier_of(metres(at[a], at[b]))) > 0}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and ("e", "w", 0.006) in want
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan  # pairs leave the join that finds them


def test_near_pairs_where_few_columns_go_round_the_globe(spark):
    rnd = random.Random(3)
    at = {f"h{k:02d}": (rnd.uniform(-180, 180), rnd.uniform(-80, 80)) for k in range(60)}
    df = spark.createDataFrame([(k, *p) for k, p in at.items()], "id string, lon double, lat double")
    for reach in (300_000.0, 1_500_000.0, 5_000_000.0, 30_000_000.0):
        got = [tuple(r) for r in nearby.near_pairs(df, "id", "lon", "lat", reach, 80.0).collect()]
        assert sorted(got) == sorted((a, b) for a in at for b in at if a < b and metres(at[a], at[b]) <= reach)
