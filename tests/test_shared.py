"""Pairs of nodes that share neighbours, found in tasks for two blocks of ids each."""

import random
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal
from itertools import combinations

import numpy as np
import pytest
from drovetrail.operators import shared, static


def edges(spark, rows, kind="string"):
    return spark.createDataFrame(rows, f"p int, from_id {kind}, to_id {kind}")


def of_all_pairs(rows):
    """(p, a, b, shared, either) of all pairs with shared neighbours, and the distinct neighbours of each node."""
    near = {}
    for p, a, b in rows:
        if a is not None and b is not None and a != b:
            near.setdefault((p, a), set()).add(b)
            near.setdefault((p, b), set()).add(a)
    return [(p, a, b, len(near[p, a] & near[p, b]), len(near[p, a] | near[p, b])) for (p, a), (q, b) in combinations(sorted(near), 2) if p == q and near[p, a] & near[p, b]]


@pytest.mark.parametrize(("most", "counted", "kind"), [(1 << 22, 1 << 19, "string"), (100, 1 << 19, "string"), (100, 5, "bigint")])
def test_jaccard_of_all_pairs(spark, monkeypatch, most, counted, kind):
    monkeypatch.setattr(shared, "COUNTED", counted)
    rnd, name = random.Random(5), (lambda k: f"H{k}") if kind == "string" else int
    rows = [(p, name(rnd.randrange(n)), name(rnd.randrange(n))) for p, n, k in ((1, 120, 200), (2, 30, 90), (3, 9, 40)) for _ in range(k)]
    rows += [(4, name(0), name(k)) for k in range(1, 40)] + [(5, None, name(1)), (5, name(1), None), (6, name(7), name(7)), (7, name(1), name(2)), (7, name(2), name(1))]
    want = sorted((p, a, b, s / n) for p, a, b, s, n in of_all_pairs(rows))
    assert sorted(map(tuple, shared.jaccard(edges(spark, rows, kind), ("p",), most=most).collect())) == want
    one = [(1, a, b) for p, a, b in rows]
    assert sorted(map(tuple, shared.jaccard(edges(spark, one, kind).drop("p"), most=most).collect())) == sorted((a, b, s / n) for _, a, b, s, n in of_all_pairs(one))
    assert static.jaccard(edges(spark, [(6, name(7), name(7))], kind), "p").count() == 0


def test_pairs_are_not_moved(spark):
    n = 1000
    rows = [(1, "hub", f"n{k}") for k in range(n)]
    store = spark.sparkContext._jsc.sc().statusStore()

    def moved():
        executors = store.executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    df, before = edges(spark, rows), moved()
    assert Counter(r["jaccard"] for r in static.jaccard(df).toLocalIterator()) == {1.0: n * (n - 1) // 2}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert moved() - before < n * (n - 1) // 2  # less than a byte for each pair


def test_shares_are_rounded_half_up():
    s, n = np.array([(s, n) for n in range(1, 700) for s in range(1, n + 1)]).T
    want = [float(Decimal(repr(a / b)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for a, b in zip(s.tolist(), n.tolist(), strict=True)]
    assert shared._share(s, n, 6).tolist() == want
