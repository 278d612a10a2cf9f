"""Queries against their SQL on the smallest tables, where those are at hand."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = [
    "summary_month", "summary_quarter", "summary_28d", "round_dates_season", "round_dates_aggs", "jitter_dates", "jitter_weights", "pseudonym_key_extend", "harmonise_all", "snapshot_collapse", "grids",
    "fwd_reach", "bwd_reach", "giant_components", "weak_components", "trace", "strength_gm_rank", "strength_assortativity", "loyalty", "transitivity", "kendall_strength", "local_spread", "combine_routes", "effect_experiment",
    "admin_in", "p1_found", "p1_report", "p3_found", "p3_per_holding", "p6_found", "p6_near_places", "p6_place_members", "p2_found", "p4_found", "p4_valid", "p5_found", "trace_fast", "date_experiment", "degree_medians", "isolated_share", "step_quantiles", "max_node_overlap", "closeness", "strong_components",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return round(float(x), 6) if type(x).__name__ == "Decimal" else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "period"
