"""Queries over all movements against brute force, on small order tables that span several quarters."""

import datetime as dt
import random

import __spark_entry__ as entry
import duckdb
import pytest
from test_network import floyd
from test_oracles import rows_of

LINE = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_shipdate date, l_quantity double"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The folder and the movements (from, to, day, weight): about 330 over five quarters, none of them all of the data."""
    rnd, d = random.Random(11), str(tmp_path_factory.mktemp("whole"))
    orders = [(i, rnd.randrange(1, 30)) for i in range(110)]
    lines = [(o, n, rnd.randrange(1, 40), 1, dt.date(1997, 8, 1) + dt.timedelta(rnd.randrange(400)), float(rnd.randrange(1, 50))) for o, _ in orders for n in range(3)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(lines, LINE).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, f"t{k % 3}", k) for k in range(1, 60)], "p_partkey bigint, p_type string, p_size int").write.parquet(f"{d}/part.parquet")
    ring = lambda x, y: [(x, y), (x + 3.0, y), (x + 3.0, y + 4.0), (x, y + 4.0), (x, y)]
    spark.createDataFrame([("a", ring(-6.0, 50.0)), ("b", ring(-3.0, 50.0)), ("c", ring(-6.0, 54.0))], "area_id string, ring array<struct<lon:double,lat:double>>").write.parquet(f"{d}/example_admin_areas.parquet")
    customer = dict(orders)
    return d, [(f"H{p}", f"H{customer[o]}", day, w) for o, _, p, _, day, w in lines]


def by_quarter(rows):
    out = {}
    for r in rows:
        out.setdefault(dt.date(r[2].year, (r[2].month - 1) // 3 * 3 + 1, 1), []).append(r)
    return out


def arrivals(rows, source):
    """Earliest day of each node reached by movements of ascending days; the source has None."""
    at = {source: dt.date.min}
    for day in sorted({r[2] for r in rows}):
        new = {b for a, b, d, _ in rows if d == day and a in at and at[a] < day}
        at |= {b: day for b in new if b not in at}
    return {n: None if n == source else t for n, t in at.items()}


def closed(rows, backward=False):
    """Every node's set of nodes joined by a directed path, itself included."""
    near = {}
    for a, b, *_ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set())
    out = {}
    for s in near:
        seen, stack = {s}, [s]
        while stack:
            new = near[stack.pop()] - seen
            seen |= new
            stack += new
        out[s] = seen
    return out


def got(spark, d, name):
    rows = [tuple(r) for r in entry.queries()[name](spark, d).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_reach_of_every_quarter(spark, tables):
    d, rows = tables
    parts = by_quarter(rows)
    assert len(parts) > 4
    pairs = {q: {s: set(arrivals(m, s)) for s in {x for r in m for x in r[:2]}} for q, m in parts.items()}
    forward = {(q, s, len(n)) for q, p in pairs.items() for s, n in p.items()}
    assert got(spark, d, "fwd_reach") == forward
    assert got(spark, d, "bwd_reach") == {(q, t, sum(t in n for n in p.values())) for q, p in pairs.items() for t in p}
    assert {(r[0], r[3]) for r in got(spark, d, "reach_summary")} == {(q, max(len(n) for n in p.values())) for q, p in pairs.items()}


def test_closures_of_every_quarter(spark, tables):
    d, rows = tables
    paths = {q: closed(m) for q, m in by_quarter(rows).items()}
    assert got(spark, d, "static_reach") == {(q, s, len(n)) for q, p in paths.items() for s, n in p.items()}
    assert got(spark, d, "in_subcomponent") == {(q, s) for q, p in paths.items() for s, n in p.items() if "H10" in n}
    strong = {(q, s, min(t for t in n if s in p[t])) for q, p in paths.items() for s, n in p.items()}
    assert got(spark, d, "strong_components") == strong
    giant = {(r[0], r[1], r[2]) for r in got(spark, d, "giant_components")}
    assert giant == {(q, len(p), max(sum(s in p[t] for t in n) for s, n in p.items())) for q, p in paths.items()}


def test_components_and_arrivals_over_all_movements(spark, tables):
    d, rows = tables
    weak = closed(rows + [(b, a, *x) for a, b, *x in rows])
    assert got(spark, d, "weak_components_whole") == {(s, min(n)) for s, n in weak.items()}
    assert {r[1:3] for r in got(spark, d, "component_sizes_whole")} == {(len({min(n) for n in weak.values()}), max(map(len, weak.values())))}
    known = {s: arrivals(rows, s) for s in ("H10", "H55", "H77", "H121") if s in weak}
    assert got(spark, d, "earliest_arrival") == {(s, n, t) for s, at in known.items() for n, t in at.items()} and known
    had = lambda at, n: n in at and (at[n] or dt.date.min)
    tree = {(s, n, t, min(a for a, b, day, _ in rows if (b, day) == (n, t) and a != b and had(at, a) and had(at, a) < t)) for s, at in known.items() for n, t in at.items() if t}
    assert got(spark, d, "arrival_tree") == tree


def test_geojson_has_all_movements(spark, tables):
    d, rows = tables
    assert entry.queries()["move_geojson"](spark, d).count() == len(rows)


@pytest.mark.parametrize("name", ["harmonise_active", "harmonise_all", "idle_ids", "admin_in", "admin_out", "move_lines", "seir_events", "jaccard", "earliest_arrival", "arrival_tree", "component_sizes"])
def test_whole_query_equals_sql(spark, tables, name):
    d, rows = tables
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "example_admin_areas"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, d)
    cur = con.execute(entry.oracle_sql()[name])
    want = cur.fetchall()
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], want) and want


def monthly_lengths(rows, fold):
    """Every month's edges between different holdings with their summed weights."""
    out = {}
    for a, b, day, w in rows:
        u, v = (f"H{int(x[1:]) % 50}" if fold else x for x in (a, b))
        if u != v:
            edges = out.setdefault(day.replace(day=1), {})
            edges[u, v] = edges.get((u, v), 0.0) + w
    return out


def both_ways(edges):
    return sorted({e for a, b, w in edges for e in ((a, b, w), (b, a, w))})


@pytest.mark.parametrize("fold", [True, False])
def test_path_measures_of_every_month(spark, tables, fold):
    d, rows = tables
    months, name = monthly_lengths(rows, fold), (lambda n: n if fold else f"{n}_holdings")
    assert len(months) > 12
    want, between, near, apart, weighted = set(), set(), set(), set(), set()
    for month, edges in months.items():
        ids, mean = sorted({x for e in edges for x in e}), sum(edges.values()) / len(edges)
        long, through = floyd([(a, b, mean / w) for (a, b), w in edges.items()], ids)
        hops, passed = floyd([(a, b, 1.0) for a, b in edges], ids)
        around, _ = floyd(both_ways([(a, b, 1.0) for a, b in edges]), ids)
        total = lambda dist, v: sum(x for (s, _), x in dist.items() if s == v)
        want |= {(month, v, round(through[v], 6), round(total(long, v), 6)) for v in ids}
        between |= {(month, v, round(passed[v] / ((len(ids) - 1) * (len(ids) - 2)), 6)) for v in ids}
        near |= {(month, v, round(1 / total(around, v), 6)) for v in ids}
        apart.add((month, round(sum(hops.values()) / len(hops), 6), max(hops.values())))
        weighted.add((month, round(sum(long.values()) / len(long), 6)))
    read = lambda q, *cols: {tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols) for r in entry.queries()[q](spark, d).collect()}
    assert read(name("path_measures"), "period", "id", "betweenness", "total") == want
    assert read(name("betweenness_norm"), "period", "id", "betweenness") == between
    assert read(name("closeness"), "period", "id", "closeness") == near
    assert read(name("distances"), "period", "mean_distance", "diameter") == apart
    assert read(name("mean_weighted_distance"), "period", "mean_distance") == weighted
    ranks = {}
    for r in entry.queries()[name("pagerank")](spark, d).collect():
        ranks[r["period"]] = ranks.get(r["period"], 0) + r["pagerank"]
    assert set(ranks) == set(months) and all(abs(x - 1) < 1e-9 for x in ranks.values())
    assert read(name("kendall_strength"), "period") == {(m,) for m in months}
