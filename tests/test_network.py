"""Network operators on small hand-made graphs."""

import datetime as dt
import itertools
import math
import random

import pandas as pd
import pytest
from drovetrail.functions import dateunits
from drovetrail.operators import fixpoint, kernels, network, privacy, ranks, static, stats, temporal, trace, transmission
from pyspark.sql import functions as F

D0 = dt.date(2020, 1, 1)


def moves(spark, rows):
    """(from, to, day, weight) -> movements."""
    return spark.createDataFrame([(a, b, D0 + dt.timedelta(d), float(w), f"r{i}") for i, (a, b, d, w) in enumerate(rows)], "from_id string, to_id string, date date, weight double, ref string")


CYCLE = [("r", "a", 0, 1), ("a", "b", 1, 2), ("b", "r", 2, 3)]


def test_tracing_never_returns_to_the_root(spark):
    roots = trace.roots_table(spark, ["r"], trace.windows(t_end=["2020-01-10"], days=[30]))
    got = {tuple(r)[1:4] + (r["distance"],) for r in trace.trace(moves(spark, CYCLE), roots).collect()}
    assert got == {("out", "r", "a", 1), ("out", "a", "b", 2), ("in", "a", "b", 2), ("in", "b", "r", 1)}


def test_tracing_same_day_duplicates_windows_and_none(spark):
    m = moves(spark, [("r", "a", 0, 1), ("a", "b", 0, 1), ("r", "a", 0, 1), ("r", "a", 5, 1), ("b", "c", 40, 1), ("x", "x", 0, 1)])
    roots = trace.roots_table(spark, ["r", "zz"], trace.windows(t_end=["2020-01-10"], days=[9]))
    chains = trace.trace(m, roots)
    assert {(r["source"], r["destination"], r["date"].day) for r in chains.collect()} == {("r", "a", 1), ("r", "a", 6), ("a", "b", 1)}
    assert trace.traced_moves(chains, m).count() == 4
    assert trace.trace(m, roots, 1).count() == 2
    hold = spark.createDataFrame([("a", "farm"), ("b", None)], "id string, type string")
    assert {(r["id"], r["direction"], r["type"]) for r in trace.traced_holdings(chains, hold).collect()} == {("r", "root", None), ("a", "out", "farm"), ("b", "out", None)}
    assert trace.trace(m, trace.roots_table(spark, ["zz"], trace.windows(t_end=["2020-01-10"], days=[9]))).count() == 0


@pytest.mark.parametrize("args", [{}, {"t_end": ["2020-01-01"]}, {"t_end": ["2020-01-01"], "days": [-1]}, {"t_end": [5], "days": [3]}, {"in_begin": ["2020-01-01"]}, {"t_end": ["2020-01-01"], "days": [1], "in_begin": ["2020-01-01"]}, {"in_begin": ["2020-01-02"], "in_end": ["2020-01-01"], "out_begin": ["2020-01-01"], "out_end": ["2020-01-01"]}])
def test_window_arguments(args):
    with pytest.raises(ValueError):
        trace.windows(**args)


def test_reach_takes_a_day_per_move(spark):
    m = moves(spark, [("a", "b", 0, 1), ("b", "c", 0, 1), ("b", "d", 1, 1), ("d", "a", 2, 1), ("e", "e", 0, 1)])
    assert {r["id"]: r["reach"] for r in temporal.reach(m).collect()} == {"a": 3, "b": 4, "c": 1, "d": 2, "e": 1}
    back = {r["id"]: r["reach"] for r in temporal.reach(m, backward=True).collect()}
    assert sum(back.values()) == 11 and back["e"] == 1
    assert temporal.reach(m.limit(0)).count() == 0


def test_components_of_a_bowtie(spark):
    m = moves(spark, [("i", "a", 0, 1), ("a", "b", 0, 1), ("b", "c", 0, 1), ("c", "a", 0, 1), ("c", "o", 0, 1), ("o", "p", 0, 1), ("x", "y", 0, 1)])
    r = fixpoint.giant_components(m).first()
    assert (r["active"], r["gscc"], r["gic"], r["goc"]) == (8, 3, 1, 2)
    weak = {x["id"]: x["component"] for x in fixpoint.weak_components(m).collect()}
    assert weak == dict.fromkeys("iabcop", "a") | dict.fromkeys("xy", "x")
    path = moves(spark, [(f"n{i:03d}", f"n{i + 1:03d}", 0, 1) for i in range(70)])
    assert fixpoint.weak_components(path).select("component").distinct().count() == 1


def floyd(edges, n):
    """All distances and path counts by enumeration of simple paths."""
    best, count, through = {}, {}, dict.fromkeys(n, 0.0)
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
    for s in n:
        paths = {}
        stack = [(s, 0.0, (s,))]
        while stack:
            u, d, p = stack.pop()
            if u != s:
                paths.setdefault(u, []).append((d, p))
            stack += [(v, d + w, (*p, v)) for v, w in near.get(u, ()) if v not in p]
        for t, ps in paths.items():
            best[s, t] = min(d for d, _ in ps)
            short = [p for d, p in ps if abs(d - best[s, t]) < 1e-9]
            count[s, t] = len(short)
            for p in short:
                for v in p[1:-1]:
                    through[v] += 1 / len(short)
    return best, through


def test_path_measures_by_enumeration():
    rnd = random.Random(1)
    for _ in range(15):
        n = list("abcdef")
        edges = [(a, b, float(rnd.choice([1, 1, 2]))) for a, b in itertools.permutations(n, 2) if rnd.random() < 0.4]
        best, through = floyd(edges, n)
        got = kernels.centralities(pd.DataFrame(edges, columns=["from_id", "to_id", "length"])).set_index("id")
        for v in got.index:
            dist = [d for (s, _), d in best.items() if s == v]
            assert math.isclose(got.loc[v, "betweenness"], through[v], abs_tol=1e-9)
            assert math.isclose(got.loc[v, "total"], sum(dist)) and got.loc[v, "reached"] == len(dist)


def test_pagerank_sums_to_one_and_is_a_fixpoint():
    g = pd.DataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("c", "d", 3.0)], columns=["from_id", "to_id", "weight"])
    r = kernels.pagerank(g).set_index("id")["pagerank"]
    base = 0.15 / 4 + 0.85 * r["d"] / 4
    assert math.isclose(r.sum(), 1) and math.isclose(r["d"], base + 0.85 * r["c"] * 0.75) and math.isclose(r["b"], base + 0.85 * r["a"])


def test_tau_and_signed_rank():
    rnd = random.Random(2)
    for _ in range(20):
        x, y = ([rnd.randrange(6) for _ in range(15)] for _ in range(2))
        sign = lambda v: (v > 0) - (v < 0)
        c = [(sign(x[i] - x[j]), sign(y[i] - y[j])) for i, j in itertools.combinations(range(15), 2)]
        want = sum(a * b for a, b in c) / math.sqrt(sum(a * a for a, _ in c) * sum(b * b for _, b in c))
        assert math.isclose(stats.tau_b(x, y), want, abs_tol=1e-12)
    assert stats.tau_b([1, 1], [1, 2]) is None
    v, p = stats.signed_rank([1.0, 2.0, 3.0, -0.5])
    assert v == 9.0 and p == 0.25
    ranks = range(1, 9)
    d = [3.1, -1.2, 2.3, 5.5, -0.7, 4.4, 6.1, 0.3]
    w = stats.signed_rank(d)[0]
    ways = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=8)]
    assert math.isclose(stats.signed_rank(d)[1], min(1, 2 * min(sum(x <= w for x in ways), sum(x >= w for x in ways)) / 256))
    assert stats.signed_rank([0.0, 0.0]) == (0.0, None) and 0 < stats.signed_rank([1.0] * 5 + [-1.0])[1] < 1
    assert stats.magnitudes(5) == [] and stats.magnitudes(250) == [5, 10, 50, 100]


def test_rounding_and_jitter_bounds(spark):
    m = moves(spark, [("a", "b", d, w) for d, w in ((0, 0.2), (3, 5), (9, 15), (30, 25), (31, 100))]).unionByName(moves(spark, [("a", "b", 1, 1)]).withColumns({"weight": F.lit(None).cast("double"), "ref": F.lit("none")}))
    got = sorted(r["weight"] for r in privacy.round_weights(m, 10.0).dropna().collect())
    assert got == [10.0, 10.0, 20.0, 20.0, 100.0] and privacy.round_weights(m, 10.0).filter("weight is null").count() == 1
    for seed in range(5):
        j = privacy.jitter_weights(m.dropna().filter("weight > 0"), 3.0, "ref", seed=seed).join(m.select("ref", F.col("weight").alias("w")), "ref").collect()
        assert all(r["weight"] > 0 and abs(r["weight"] - r["w"]) <= 3 for r in j)
        d = privacy.jitter_dates(m, 7, "ref", seed=seed).join(m.select("ref", F.col("date").alias("d")), "ref").collect()
        assert all(abs((r["date"] - r["d"]).days) <= 7 and D0 <= r["date"] <= D0 + dt.timedelta(31) for r in d)
    with pytest.raises(ValueError):
        privacy.jitter_dates(m, 0, "ref")
    with pytest.raises(ValueError):
        privacy.round_dates(m, "2 weeks")


def test_pseudonyms_are_one_to_one(spark):
    m = moves(spark, CYCLE)
    out, key = privacy.pseudonymise(m, ["from_id", "to_id"], "P")
    pairs = dict(map(tuple, key.collect()))
    assert sorted(pairs) == ["a", "b", "r"] and sorted(pairs.values()) == ["P1", "P2", "P3"]
    assert {(r["from_id"], r["to_id"]) for r in out.collect()} == {(pairs[a], pairs[b]) for a, b, *_ in CYCLE}
    more = privacy.extend_key(key, spark.createDataFrame([("new",), ("a",), (None,)], "id string"), "id", "P")
    assert dict(map(tuple, more.collect())) == pairs | {"new": "P4"}
    assert network.consecutive_ids(spark.createDataFrame([("2",), ("1",)], "i string"), "i").first()[0] and not network.consecutive_ids(spark.createDataFrame([("1",), ("x",)], "i string"), "i").first()[0]


def test_floors_and_periods(spark):
    day = F.lit("2024-12-31").cast("date")
    got = spark.range(1).select(*(dateunits.floor_date(day, u, w).alias(f"c{i}") for i, (u, w) in enumerate([("week", 7), ("week", 1), ("week", 3), ("season", 7), ("bimonth", 7), ("halfyear", 7), ("10 days", 7), ("3 years", 7)]))).first()
    assert [str(x) for x in got] == ["2024-12-29", "2024-12-30", "2024-12-25", "2024-12-01", "2024-11-01", "2024-07-01", "2024-12-31", "2022-01-01"]
    p = dateunits.periods(moves(spark, [("a", "b", 5, 1), ("a", "b", 70, 1)]), "date", "month").collect()
    assert [(r["period"], str(r["start"]), str(r["end"])) for r in p] == [(1, "2020-01-01", "2020-02-01"), (2, "2020-02-01", "2020-03-01"), (3, "2020-03-01", "2020-04-01")]
    with pytest.raises(ValueError):
        dateunits.parse_unit("0 days")


def test_assortativity_without_variance_is_null_and_empty_networks(spark):
    e = network.simplify(moves(spark, [("a", "b", 0, 1), ("b", "a", 0, 1)]).withColumn("p", F.lit(1)), "p")
    assert static.assortativity(e, "p").first()["assortativity"] is None
    none = moves(spark, CYCLE).limit(0)
    assert temporal.summary(none, "month").count() == 0 and fixpoint.weak_components(none).count() == 0 and static.loyalty(none.withColumn("p", F.lit(1)), "p").count() == 0


def test_transmission(spark):
    a = spark.createDataFrame([("x", "y", 0.5), ("x", "x", 0.9)], "i string, j string, p double")
    b = spark.createDataFrame([("x", "y", 0.5), ("y", "z", 1.0)], "i string, j string, p double")
    assert {(r["i"], r["j"]): r["p"] for r in transmission.combine_routes([a, b]).collect()} == {("x", "y"): 0.75, ("y", "z"): 1.0}
    m = transmission.contact_matrix(moves(spark, [("x", "y", 0, 31)]), spark.createDataFrame([("x", 0.0, 50.0), ("y", 0.0, 50.0005), ("far", 1.0, 50.0)], "id string, lon double, lat double"), q=0.5)
    assert {(r["i"], r["j"]): round(r["p"], 6) for r in m.collect()} == {("x", "y"): 0.55, ("y", "x"): 0.1}


@pytest.mark.parametrize("n", [7, 250])
def test_chains_are_followed_to_their_end(spark, n):
    """However long: no number of rounds cuts them."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    m = moves(spark, [(f"n{i:03d}", f"n{i + 1:03d}", i, 1) for i in range(n)]).coalesce(1)
    some = spark.createDataFrame([("n000",)], "source string")
    assert fixpoint.earliest_arrivals(m, sources=some).count() == n + 1
    assert fixpoint.closure(m).count() == (n + 1) * (n + 2) // 2
    assert {r["component"] for r in fixpoint.weak_components(m).collect()} == {"n000"}
    roots = trace.roots_table(spark, ["n000"], trace.windows(t_end=["2021-01-10"], days=[400]))
    assert sorted(r["distance"] for r in trace.trace(m, roots).collect()) == list(range(1, n + 1))
    assert trace.trace(m, roots, 0).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_components_by_brute_force(spark):
    rnd = random.Random(4)
    for n, k in ((25, 30), (40, 40), (6, 0)):
        rows = [(f"v{rnd.randrange(n)}", f"v{rnd.randrange(n)}", 0, 1) for _ in range(k)] + [("x", "x", 0, 1)]
        near = {v: {v} for r in rows for v in r[:2]}
        for a, b, *_ in rows:
            near[a].add(b)
        for m in near:  # Warshall
            for a in near:
                if m in near[a]:
                    near[a] |= near[m]
        m = moves(spark, rows).withColumn("p", F.lit(1)).coalesce(1)
        assert {(r["source"], r["node"]) for r in fixpoint.closure(m, ("p",)).collect()} == {(a, b) for a in near for b in near[a]}
        strong = {a: min(b for b in near[a] if a in near[b]) for a in near}
        assert {r["id"]: r["component"] for r in fixpoint.strong_components(m, ("p",)).collect()} == strong
        weak = {a: {b for b in near if b in near[a] or a in near[b]} for a in near}
        for m_ in weak:
            for a in weak:
                if m_ in weak[a]:
                    weak[a] |= weak[m_]
        assert {r["id"]: r["component"] for r in fixpoint.weak_components(m, by=("p",)).collect()} == {a: min(c) for a, c in weak.items()}
        most = max(sorted(strong.values()), key=lambda c: (list(strong.values()).count(c), [-ord(x) for x in c]))
        r = fixpoint.giant_components(m, ("p",)).first()
        size = list(strong.values()).count(most)
        assert (r["active"], r["gscc"]) == (len(near), size)
        best = min(c for c in strong.values() if list(strong.values()).count(c) == size)
        assert (r["gic"], r["goc"]) == (sum(best in near[a] for a in near) - size, len(near[best]) - size)


def test_quantiles_and_ranks(spark):
    import numpy as np

    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(30)])) for _ in range(700)] + [("one", 5), ("none", None)]
    df = spark.createDataFrame([(g, None if v is None else float(v), f"i{k}") for k, (g, v) in enumerate(rows)], "g string, v double, id string")
    got = {r["g"]: (r["q"], r["m"]) for r in ranks.quantiles(df, ["g"], "v", {"q": 0.13, "m": 0.5}).collect()}
    values = {g: [v for x, v in rows if x == g and v is not None] for g in {g for g, _ in rows}}
    assert set(got) == {g for g, v in values.items() if v} and all(np.allclose(got[g], np.quantile(values[g], [0.13, 0.5])) for g in got)
    assert ranks.quantiles(df.filter("g = 'a'"), [], "v", {"m": 0.5}).first()["m"] == np.quantile(values["a"], 0.5) and ranks.quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0
    for r in ranks.average_ranks(df, ["g"], "v", "rank").collect():
        higher, equal = sum(v > (r["v"] or 0) for v in values[r["g"]]), sum(v == r["v"] for v in values[r["g"]])
        assert r["rank"] == (None if r["v"] is None else higher + (equal + 1) / 2)
    assert [r["v"] for r in ranks.top_rows(df.filter("g = 'one' or g = 'a'"), "v", 2, "id").collect()] == [29.0, 29.0]
    small = spark.createDataFrame([("10", 3.0), ("9", 1.0), ("x", 2.0)], "id string, v double")
    assert ranks.nth_largest(small, "v", 2, "id").first()["id"] == "x" and ranks.nth_largest(small, "v", 4, "id").count() == 0
    assert [r["id"] for r in ranks.in_numeric_order(small, "id").collect()] == ["9", "10", "x"]


def test_network_constructors(spark):
    m = moves(spark, [*CYCLE, ("b", "b", 3, 1), (None, "a", 1, 1)]).withColumnRenamed("from_id", "origin")
    hold = spark.createDataFrame([("a", "farm"), ("idle", "farm")], "cph string, kind string")
    nodes, edges = network.static_network(m, hold)
    assert {(r["id"], r["kind"], r["active"]) for r in nodes.collect()} == {("a", "farm", True), ("b", None, True), ("r", None, True)} and edges.count() == 4 and edges.columns[0] == "from_id"
    assert network.static_network(m, hold, keep_idle=True)[0].count() == 4 and network.static_network(m)[0].count() == 3
    with pytest.raises(ValueError, match="repeated"):
        network.static_network(m, hold.unionAll(hold))
    with pytest.raises(ValueError, match="columns"):
        network.static_network(m.select("origin"))
    t = network.temporal_network(m, hold, keep_idle=True)
    key = {r["id"]: r["vertex"] for r in t["key"].collect()}
    assert sorted(key.values()) == [1, 2, 3, 4] and {r["vertex"]: r["kind"] for r in t["vertices"].collect()}[key["idle"]] == "farm"
    assert {(r["tail"], r["head"], r["ref"]) for r in t["edge_spells"].collect()} == {(key[a], key[b], f"r{i}") for i, (a, b, *_) in enumerate(CYCLE)} and t["vertex_spells"].count() == 7
    numbers = network.temporal_network(moves(spark, [("1", "2", 0, 1), ("2", "3", 1, 1)]))
    assert {(r["id"], r["vertex"]) for r in numbers["key"].collect()} == {("1", 1), ("2", 2), ("3", 3)}
    moved, held, key = network.renumbered(m, hold)
    names = dict(map(tuple, key.collect()))
    assert {(r["from_id"], r["to_id"]) for r in moved.collect()} == {(names[a], names[b]) for a, b, *_ in [*CYCLE, ("b", "b")]} and {r["id"] for r in held.collect()} == set(names.values()) == {"1", "2", "3", "4"}
    split = network.split_network(moves(spark, CYCLE).withColumn("p", F.col("date")), "p", keep_idle=True)[0]
    assert split.count() == 9 and split.filter("active").count() == 6 and network.split_network(moves(spark, CYCLE).withColumn("p", F.col("date")), "p")[0].count() == 6
    assert network.on_date(m.withColumnRenamed("origin", "from_id"), "2020-01-02").count() == 2 and network.weight_between(moves(spark, CYCLE), 2, 3).count() == 2
    assert network.real_moves(moves(spark, CYCLE)).count() == 3 and network.self_moves(moves(spark, [("b", "b", 3, 1)])).count() == 1


def test_tracing_in_one_call(spark):
    m = moves(spark, [("r", "a", 0, 1), ("a", "b", 1, 2), ("b", "a", 2, 1), ("b", "r", 2, 3), ("z", "r", 0, 1), ("q", "w", 9, 1)])
    hold = spark.createDataFrame([("a", "farm")], "id string, type string")
    with pytest.warns(UserWarning, match="repeatedly"):
        got = trace.trace_contacts(m, hold, ["r", "r", "w"], t_end=["2020-01-05"], days=[30])
    counts = {(r["root"], r["direction"]): (r["movements"], r["holdings"], r["farthest"]) for r in got.counts.collect()}
    assert counts == {("r", "out"): (2, 2, 2), ("r", "in"): (3, 3, 2), ("w", "in"): (0, 0, None), ("w", "out"): (0, 0, None)}
    assert got.areas_in is None and got.moves.filter("ref is null").count() == 0
    with pytest.warns(UserWarning, match="no contact chains"):
        assert trace.trace_contacts(m, hold, ["w"], t_end=["2020-01-05"], days=[3]) is None
    for bad in ({"roots": []}, {"roots": ["r"], "fast": True, "max_distance": 2}):
        with pytest.raises(ValueError):
            trace.trace_contacts(m, hold, t_end=["2020-01-05"], days=[30], **bad)
    areas_of = spark.createDataFrame([("r", 1), ("a", 2), ("b", 1)], "id string, area_id int")
    got = trace.trace_contacts(m, hold, ["r"], t_end=["2020-01-05"], days=[30], areas_of=areas_of, areas=areas_of.select("area_id").distinct(), fast=True)
    assert {(r["source"], r["destination"]) for r in got.chains.filter("direction = 'out'").collect()} == {("r", "a"), ("a", "b"), ("b", "a")}
    assert {r["area_id"]: r["moves"] for r in got.areas_in.collect()} == {1: 2, 2: 2}
    assert spark.range(1).select(trace.width_label(F.lit(4.0))).first()[0] == "100 to 999"


def test_fast_tracing_misses_nothing(spark):
    rnd = random.Random(8)
    m = moves(spark, [(f"v{rnd.randrange(12)}", f"v{rnd.randrange(12)}", rnd.randrange(8), 1) for _ in range(40)])
    roots = trace.roots_table(spark, ["v0", "v1"], trace.windows(t_end=["2020-01-07"], days=[6]))
    exact = {tuple(r) for r in trace.trace(m, roots).drop("distance").distinct().collect()}
    fast = {tuple(r) for r in trace.trace_fast(m, roots).collect()}
    ends = lambda rows: {(r[0], r[1], r[3] if r[1] == "out" else r[2]) for r in rows}
    assert exact <= fast and ends(exact) == ends(fast)


def test_ranks_as_tables_and_bounds(spark):
    rnd = random.Random(3)
    e = spark.createDataFrame([(p, f"v{rnd.randrange(9)}", f"v{rnd.randrange(9, 14)}" if rnd.random() < 0.3 else f"v{rnd.randrange(9)}", rnd.random()) for p in (1, 2) for _ in range(25)], "p int, from_id string, to_id string, weight double").coalesce(1)
    small = {(r["p"], r["id"]): r["pagerank"] for r in kernels.page_ranks(e, ["p"], tolerance=1e-7).collect()}
    large = {(r["p"], r["id"]): r["pagerank"] for r in kernels.page_ranks(e, ["p"], tolerance=1e-7, most=1).collect()}
    assert small.keys() == large.keys() and all(math.isclose(small[k], large[k], abs_tol=1e-6) for k in small)
    with pytest.raises(ValueError, match="largest group"):
        kernels.path_measures(e, ["p"], most=3)
    x = [rnd.randrange(50) for _ in range(3000)]
    y = [a + rnd.randrange(40) for a in x]
    a, b = (pd.Series(v).to_numpy() for v in (x, y))
    s = [(((a[i] - a) > 0) * 2 - 1) * (a[i] != a) for i in range(len(a))], [(((b[i] - b) > 0) * 2 - 1) * (b[i] != b) for i in range(len(b))]
    want = sum((u * v).sum() for u, v in zip(*s, strict=True)) / math.sqrt(sum(abs(u).sum() for u in s[0]) * sum(abs(v).sum() for v in s[1]))
    assert math.isclose(stats.tau_b(x, y), want)


def test_dates_of_variants(spark):
    m = moves(spark, [("a", "b", d, 1) for d in (0, 5, 30, 31)])
    made = stats.date_variants(m, "ref", [3, 10], ["month"], 2)
    assert made.count() == 4 * (1 + 2 * 2 + 1) and made.filter("treatment = 'rounded' and day(date) <> 1").count() == 0
    off = made.filter("treatment = 'jittered'").join(m.select("ref", F.col("date").alias("d")), "ref").collect()
    assert all(abs((r["date"] - r["d"]).days) <= int(r["amount"]) and D0 <= r["date"] <= D0 + dt.timedelta(31) for r in off) and any(r["date"] != r["d"] for r in off)
    assert stats.kept_treatments(made, ["true"]).count() == 4
    with pytest.raises(ValueError):
        stats.date_variants(m, "ref", [0], [], 1)


def test_profile_medians_isolated(spark):
    m = moves(spark, [*CYCLE, ("x", "y", 40, 1), ("x", "z", 41, 1), ("r", "r", 0, 1)])
    got = {(r["unit"], str(r["period"])): (r["active"], r["edges"], r["median_degree"], r["gscc_share"]) for r in temporal.aggregation_profile(m, ["month", "year"]).collect()}
    assert got == {("month", "2020-01-01"): (3, 3, 2.0, 1.0), ("month", "2020-02-01"): (3, 2, 1.0, 1 / 3), ("year", "2020-01-01"): (6, 5, 2.0, 0.5)}
    e = network.simplify(m.withColumn("p", F.lit(1)), "p")
    assert static.isolated_share(e, "p").first()["isolated_share"] == 1 / 6
    assert {r["way"]: r["median"] for r in static.degree_medians(e, "p").collect()} == {"all": 2.0, "in": 1.0, "out": 1.0}
    box = stats.box_stats(m.withColumn("g", F.lit(1)), "weight", "g").first()
    assert (box["low"], box["median"], box["high"]) == (1.0, 1.0, 3.0)
    assert {(r["bin"], r["n"]) for r in stats.histogram(m, "weight", 2.0).collect()} == {(0.0, 4), (2.0, 2)}
    t = spark.createDataFrame([(1, "x", 2.0), (1, "y", 3.0), (2, "x", 5.12345)], "k int, name string, value double")
    w = stats.wide(t, ["k"], "name", "value", ["x", "y"])
    assert {tuple(r) for r in stats.long(w, ["k"], ["x", "y"]).collect()} == {tuple(r) for r in t.collect()} | {(2, "y", None)}
    assert {r["value"] for r in stats.rounded(t).collect()} == {2.0, 3.0, 5.123} and stats.heat_map(t, "k", "name", "value").count() == 3


def test_matrix_checks_and_numbers(spark):
    m = moves(spark, [("x", "y", 0, 31)])
    good = spark.createDataFrame([("y", "z", 0.5)], "i string, j string, p double")
    matrix, key = transmission.numbered_matrix(transmission.contact_matrix(m, q=0.5, others=[good]), spark.createDataFrame([("alone",)], "id string"))
    assert {r["new_id"] for r in key.collect()} == {"1", "2", "3", "4"} and matrix.count() == 2
    for bad in ([("y", "z", 1.5)], [("y", None, 0.5)], [("y", "z", 0.5), ("y", "z", 0.5)]):
        with pytest.raises(ValueError, match="table 1"):
            transmission.contact_matrix(m, others=[spark.createDataFrame(bad, "i string, j string, p double")])
    with pytest.raises(ValueError, match="lacks"):
        transmission.contact_matrix(m, others=[good.drop("p")])
