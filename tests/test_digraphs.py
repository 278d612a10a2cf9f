"""Networks that are searched by one task each, and the same as tables."""

import random

import pytest
from drovetrail.operators import fixpoint
from drovetrail.plans import network_queries
from pyspark.sql import functions as F


def edges(spark, rows):
    return spark.createDataFrame(rows, "p int, from_id string, to_id string").coalesce(1)


def jobs_of(spark, make):
    """Rows, and the number of jobs that they took."""
    spark.sparkContext.setJobGroup(make.__qualname__, "counted")
    try:
        rows = make().collect()
        return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(make.__qualname__))
    finally:
        spark.sparkContext.setJobGroup("other", "other")


@pytest.fixture(scope="module")
def mixed():
    """(p, from, to): random networks with cycles, moves to the same holding, one-sided and repeated rows; p -> reached ids by id."""
    rnd, rows = random.Random(8), []
    for p, n, k in ((1, 60, 66), (2, 30, 60), (3, 40, 30)):
        rows += [(p, f"v{rnd.randrange(n)}", f"v{rnd.randrange(n)}") for _ in range(k)]
    rows += [(4, "x", "x"), (5, None, "y"), (5, "z", None), (5, None, None), (6, "a", "b"), (6, "a", "b"), (6, "b", "a"), (6, "c", "d"), (6, "d", "c"), (6, "b", "c")]
    near = {}
    for p, a, b in rows:
        own = near.setdefault(p, {})
        for x in {a, b} - {None}:
            own.setdefault(x, {x})
        if a and b:
            own[a].add(b)
    for own in near.values():
        for m in own:
            for a in own:
                if m in own[a]:
                    own[a] |= own[m]
    return rows, near


@pytest.mark.parametrize("most", [1 << 21, 50, 0])
def test_giant_components_in_tasks_and_as_tables(spark, mixed, most):
    rows, near = mixed
    got = {r["p"]: tuple(r)[1:5] for r in fixpoint.giant_components(edges(spark, rows), ("p",), most).collect()}
    for p, own in near.items():
        strong = {a: [b for b in own[a] if a in own[b]] for a in own}
        root = min(own, key=lambda a: (-len(strong[a]), min(strong[a])))
        size = len(strong[root])
        assert got[p] == (len(own), size, sum(root in own[a] for a in own) - size, len(own[root]) - size)
    assert set(got) == set(near)


def test_giant_components_take_no_more_jobs_for_longer_paths(spark):
    ring = lambda n: edges(spark, [(1, f"n{i:04d}", f"n{(i + 1) % n:04d}") for i in range(n)] + [(1, f"t{i:04d}", f"t{i + 1:04d}") for i in range(n)])
    (row,), jobs = jobs_of(spark, lambda: fixpoint.giant_components(ring(400), ("p",)))
    assert (row["active"], row["gscc"], row["gic"], row["goc"]) == (801, 400, 0, 0)
    assert jobs < 12
    assert fixpoint.giant_components(ring(5).drop("p")).select("active", "gscc").first() == (11, 5)
    assert fixpoint.giant_components(ring(5).filter(F.lit(False)), ("p",)).count() == 0


@pytest.mark.parametrize("most", [1 << 21, 50, 0])
def test_reach_sizes_in_tasks_and_as_tables(spark, mixed, most):
    rows, near = mixed
    got = [tuple(r) for r in fixpoint.reach_sizes(edges(spark, rows), ("p",), most).collect()]
    assert sorted(got) == sorted((p, a, len(n)) for p, own in near.items() for a, n in own.items())


def test_reach_sizes_take_no_more_jobs_for_longer_paths(spark):
    n = 400
    rows = [(1, f"n{i:04d}", f"n{i + 1:04d}") for i in range(n)]
    got, jobs = jobs_of(spark, lambda: fixpoint.reach_sizes(edges(spark, rows), ("p",)))
    assert {(r["id"], r["reach"]) for r in got} == {(f"n{i:04d}", n + 1 - i) for i in range(n + 1)}
    assert jobs < 12


@pytest.mark.parametrize("most", [1 << 21, 50, 0])
def test_reachable_in_tasks_and_as_tables(spark, mixed, most):
    rows, near = mixed
    links = fixpoint.links(edges(spark, rows), ("p",)).cache()
    roots = [(1, "v3"), (1, "v7"), (1, "v3"), (2, "v5"), (5, "y"), (6, "b"), (7, "none"), (1, "none")]
    seeds = spark.createDataFrame(roots, "p int, root string")
    for backward in (False, True):
        got = [tuple(r) for r in fixpoint.reachable(links, seeds, ("p",), backward, most).collect()]
        found = lambda p, r: [x for x, n in near.get(p, {}).items() if (r in n if backward else x in near[p].get(r, ()))]  # noqa: E731, B023
        assert sorted(got) == sorted((p, r, x) for p, r in set(roots) for x in found(p, r) or [r])


def test_in_subcomponent_takes_no_more_jobs_for_longer_paths(spark):
    rows = [(1, f"n{i:04d}", f"n{i + 1:04d}") for i in range(400)] + [(1, "n0400", "H10"), (1, "H10", "after"), (2, "a", "b"), (3, "H10", "H10"), (4, None, "H10")]
    got, jobs = jobs_of(spark, lambda: network_queries.in_subcomponent(edges(spark, rows), "p"))
    assert {tuple(r) for r in got} == {(1, f"n{i:04d}") for i in range(401)} | {(1, "H10"), (3, "H10"), (4, "H10")} and len(got) == 404
    assert jobs < 12


@pytest.mark.parametrize("most", [1 << 21, 50, 0])
def test_strong_components_in_tasks_and_as_tables(spark, mixed, most):
    rows, near = mixed
    got = [tuple(r) for r in fixpoint.strong_components(edges(spark, rows), ("p",), most).collect()]
    assert sorted(got) == sorted((p, a, min(b for b in n if a in own[b])) for p, own in near.items() for a, n in own.items())


def test_strong_components_take_no_more_jobs_for_longer_paths(spark):
    rows = [(1, f"n{i:04d}", f"n{(i + 1) % 400:04d}") for i in range(400)] + [(1, f"t{i:04d}", f"t{i + 1:04d}") for i in range(400)]
    got, jobs = jobs_of(spark, lambda: fixpoint.strong_components(edges(spark, rows), ("p",)))
    assert {(r["id"], r["component"]) for r in got} == {(f"n{i:04d}", "n0000") for i in range(400)} | {(f"t{i:04d}", f"t{i:04d}") for i in range(401)}
    assert jobs < 12
