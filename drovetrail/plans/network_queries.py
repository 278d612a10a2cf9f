"""Queries of the movement-network operators over the order tables read as movements, and the same as SQL.

An order line is a movement from holding H<part> to holding H<customer> on its shipping day; parts are the holdings.
The dense form folds holdings into 50, so that edges repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dateunits import floor_date, label, periods
from ..operators import fixpoint, kernels, nearby, network, privacy, ranks, static, stats, temporal, trace, transmission
from ..runtime import stored
from ..sources.delimited import from_table, guess_types
from ..sources.sinks import geojson

QUARTER = ("1998-01-01", "1998-04-01")
ROOTS = ["H10", "H55", "H77", "H121"]
DAYS = 6  # digits to which averages and shares are rounded before they are compared


def moves(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    day = F.col("l_shipdate").cast("date")
    ref = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), day.cast("string"))
    return lines.join(orders, "l_orderkey").select(
        F.concat(F.lit("H"), F.col("l_partkey").cast("string")).alias("from_id"), F.concat(F.lit("H"), F.col("o_custkey").cast("string")).alias("to_id"),
        day.alias("date"), F.col("l_quantity").cast("double").alias("weight"), F.col("l_orderkey").alias("batch_no"), ref.alias("ref"),
    )


def dense(spark: SparkSession, d: str) -> DataFrame:
    fold = lambda c: F.concat(F.lit("H"), (F.substring(c, 2, 20).cast("bigint") % 50).cast("string"))
    return moves(spark, d).withColumns({"from_id": fold("from_id"), "to_id": fold("to_id")})


def holdings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return spark.read.parquet(f"{d}/part.parquet").select(
        F.concat(F.lit("H"), k.cast("string")).alias("id"), F.col("p_type").alias("type"), F.col("p_size").cast("double").alias("herd_size"),
        (F.lit(-6.0) + (k * 37 % 1000) / F.lit(125.0)).alias("lon"), (F.lit(50.0) + (k * 73 % 1000) / F.lit(125.0)).alias("lat"),
    )


def quarter(spark: SparkSession, d: str) -> DataFrame:
    return network.in_period(moves(spark, d), *QUARTER)


def quarters(spark: SparkSession, d: str) -> DataFrame:
    """All movements with a day, each in the network of its quarter (``period``)."""
    return moves(spark, d).filter("date is not null").withColumn("period", F.trunc("date", "quarter"))


def monthly(df: DataFrame) -> DataFrame:
    return df.withColumn("period", F.trunc("date", "month"))


def dense_edges(spark: SparkSession, d: str) -> DataFrame:
    return network.simplify(monthly(dense(spark, d)), "period")


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to DAYS digits, other columns as they are."""
    return df.select(*(F.round(c, DAYS).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


def chains(spark: SparkSession, d: str, max_distance: int | None = None) -> DataFrame:
    roots = trace.roots_table(spark, ROOTS, trace.windows(t_end=["1998-03-31"], days=[75]))
    return trace.trace(moves(spark, d), roots, max_distance)


def holding_areas(spark: SparkSession, d: str) -> DataFrame:
    areas = spark.read.parquet(f"{d}/example_admin_areas.parquet")
    return nearby.locate(holdings(spark, d).select("id", "lon", "lat"), areas, "area_id", "ring", "lon", "lat").select("id", F.col("region").alias("area_id"))


def area_totals(spark: SparkSession, d: str, side: str) -> DataFrame:
    areas = spark.read.parquet(f"{d}/example_admin_areas.parquet").select("area_id")
    return trace.area_totals(moves(spark, d), holding_areas(spark, d), areas, side)


def lines(spark: SparkSession, d: str) -> DataFrame:
    found = trace.move_lines(moves(spark, d), holdings(spark, d))
    return found.select("ref", F.round(F.col("line")[0]["lon"], 6).alias("lon_a"), F.round(F.col("line")[0]["lat"], 6).alias("lat_a"), F.round(F.col("line")[1]["lon"], 6).alias("lon_b"), F.round(F.col("line")[1]["lat"], 6).alias("lat_b"))


def kendall(spark: SparkSession, d: str, of: Callable[[SparkSession, str], DataFrame] = dense) -> DataFrame:
    ranks = static.strength_rank(network.simplify(monthly(of(spark, d)), "period"), "period").select("period", "id", F.col("rank").alias("x"))
    other = static.strength_rank(network.simplify(monthly(privacy.round_weights(of(spark, d), 20.0)), "period"), "period").select("period", "id", F.col("rank").alias("y"))
    return rounded(stats.kendall(ranks.join(other, ["period", "id"]), ["period"], "x", "y"))


def experiment(spark: SparkSession, d: str) -> DataFrame:
    made = stats.variants(dense(spark, d).withColumn("period", F.trunc("date", "quarter")), "ref", [5.0, 20.0], [10.0, 25.0], 2)
    by = ["treatment", "amount", "sim", "period"]
    edges = network.simplify(made, *by)
    mean = edges.groupBy(*by).agg(F.avg("weight").alias("mean_weight"))
    return rounded(mean.join(static.assortativity(edges, *by), by))


def degree_query(way: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: temporal.temporal_degree(monthly(moves(s, d)), way, "period")


def reach_query(backward: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: temporal.reach(quarters(s, d), backward, "period")


def root_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r,) for r in ROOTS], "source string")


def in_subcomponent(df: DataFrame, *by: str) -> DataFrame:
    """by, source: what reaches H10, searched from there; no row where H10 has no movement."""
    links = stored(fixpoint.links(df, by), "links")
    seeds = links.filter("u = 'H10' or v = 'H10'").select(*by, F.lit("H10").alias("root")).distinct()
    return fixpoint.reachable(links, seeds, by, backward=True).select(*by, F.col("id").alias("source"))


def local_pairs(spark: SparkSession, d: str) -> DataFrame:
    place = spark.read.parquet(f"{d}/example_holding_data.parquet").select(F.regexp_replace("cph", "[^0-9]", "").alias("id"), F.col("coordinates.lon").alias("lon"), F.col("coordinates.lat").alias("lat"))
    return place.filter("length(id) = 9 and lon between -9 and 3 and lat between 49 and 61").distinct()


def moves_spread(spark: SparkSession, d: str) -> DataFrame:
    return transmission.movement_spread(moves(spark, d), 0.3)


def distance_components(spark: SparkSession, d: str) -> DataFrame:
    """The largest weak component when holdings up to a distance apart are joined, for several distances."""
    places = local_pairs(spark, d)
    pairs = None
    for metres in (150.0, 500.0, 1000.0):
        p = nearby.near_pairs(places, "id", "lon", "lat", metres, 61.0).select(F.lit(metres).alias("metres"), F.col("key_a").alias("from_id"), F.col("key_b").alias("to_id"))
        pairs = p if pairs is None else pairs.unionAll(p)
    sizes = fixpoint.weak_components(pairs, by=("metres",)).groupBy("metres", "component").agg(F.count("*").alias("size"))
    return sizes.groupBy("metres").agg(F.max("size").alias("largest"))


def all_months(spark: SparkSession, d: str, directed: bool = True, weighted: bool = True) -> DataFrame:
    return kernels.path_measures(dense_edges(spark, d), ["period"], directed, weighted)


def holding_edges(spark: SparkSession, d: str) -> DataFrame:
    """The network of every month between holdings as they are."""
    return network.simplify(monthly(moves(spark, d)), "period")


def holding_paths(spark: SparkSession, d: str, directed: bool = True, weighted: bool = True) -> DataFrame:
    return kernels.path_measures(holding_edges(spark, d), ["period"], directed, weighted)


def _max_nodes(df: DataFrame) -> DataFrame:
    degree = temporal.temporal_degree(monthly(df), "all", "period")
    return temporal.summarise_nodes(degree, "degree", {"most": F.max}, "period", name_nodes=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"summary_{u}": (lambda s, d, u=u: rounded(temporal.summary(moves(s, d), u))) for u in ("month", "quarter", "year")},
    **{f"summary_{n}d": (lambda s, d, n=n: rounded(temporal.grid_summary(moves(s, d), n))) for n in (1, 7, 14, 28, 84)},
    "weight_sixnum": lambda s, d: rounded(temporal.six_numbers(moves(s, d).withColumn("label", label(F.col("date"), "quarter")), "label")),
    **{f"round_dates_{n}": (lambda s, d, u=u, w=w: privacy.round_dates(moves(s, d), u, w)) for n, u, w in (("week_sun", "week", 7), ("week_mon", "week", 1), ("month", "month", 7), ("bimonth", "bimonth", 7), ("quarter", "quarter", 7), ("season", "season", 7), ("halfyear", "halfyear", 7), ("year", "year", 7), ("10days", "10 days", 7), ("2years", "2 years", 7))},
    "round_dates_aggs": lambda s, d: privacy.round_dates(dense(s, d), "month", aggregates={"n": F.count("*"), "least": F.min("weight"), "batches": F.count_distinct("batch_no"), "q90": F.percentile("weight", 0.9)}),
    "round_dates_nosum": lambda s, d: privacy.round_dates(dense(s, d), "quarter", sum_weight=False, aggregates={"first_batch": F.min("batch_no")}),
    "round_weights": lambda s, d: privacy.round_weights(moves(s, d), 20.0).select("ref", "weight"),
    "jitter_dates": lambda s, d: privacy.jitter_dates(moves(s, d), 5, "ref").select("ref", "date"),
    "jitter_weights": lambda s, d: rounded(privacy.jitter_weights(moves(s, d), 10.0, "ref").select("ref", "weight")),
    "pseudonymise": lambda s, d: privacy.pseudonymise(moves(s, d), ["from_id", "to_id"], "FARM")[0].select("ref", "from_id", "to_id"),
    "pseudonym_key_extend": lambda s, d: privacy.extend_key(privacy.pseudonym_key(holdings(s, d), "id", "N"), network.endpoints(moves(s, d)).unionAll(s.range(50).select(F.concat(F.lit("X"), "id").alias("id"))), "id", "N"),
    "harmonise_active": lambda s, d: network.harmonise(moves(s, d), holdings(s, d)).select("id", "type", "herd_size", "active"),
    "harmonise_all": lambda s, d: network.harmonise(moves(s, d), holdings(s, d), keep_idle=True).select("id", "type", "herd_size", "active"),
    "missing_ids": lambda s, d: network.missing_ids(moves(s, d), holdings(s, d).filter("herd_size > 25")),
    "idle_ids": lambda s, d: network.idle_ids(moves(s, d), holdings(s, d)),
    "self_moves": lambda s, d: moves(s, d).filter("from_id = to_id").select("ref", "from_id", "weight"),
    "dup_moves": lambda s, d: network.duplicate_moves(dense(s, d), ["from_id", "to_id", "date"]),
    "heavy_moves": lambda s, d: moves(s, d).filter(F.col("weight").between(45, 50) & (F.col("weight") > 0)).select("ref"),
    "in_period": lambda s, d: quarter(s, d).select("ref", "date"),
    "simplify_month": lambda s, d: dense_edges(s, d),
    "simplify_stats": lambda s, d: rounded(network.simplify_stats(dense(s, d))),
    "snapshot_collapse": lambda s, d: network.collapse(monthly(dense(s, d)), "period"),
    "edge_spells": lambda s, d: network.edge_spells(moves(s, d)).select("onset", "terminus", "tail", "head", "ref"),
    "vertex_spells": lambda s, d: network.vertex_spells(moves(s, d)),
    "periods_28d": lambda s, d: periods(moves(s, d), "date", "28 days"),
    "periods_quarter": lambda s, d: periods(moves(s, d), "date", "quarter"),
    "split_periods": lambda s, d: monthly(moves(s, d)).groupBy("period").agg(F.count("*").alias("moves"), F.sum("weight").alias("weight"), F.min("date").alias("first_date")),
    "grids": lambda s, d: temporal.grids(moves(s, d)),
    "consecutive_ids": lambda s, d: network.consecutive_ids(privacy.pseudonym_key(holdings(s, d), "id").select("new_id"), "new_id"),
    "temporal_degree": degree_query("all"), "temporal_indegree": degree_query("in"), "temporal_outdegree": degree_query("out"),
    "degree_stats": lambda s, d: rounded(temporal.summarise_nodes(temporal.temporal_degree(monthly(dense(s, d)), "all", "period"), "degree", {"median": 0.5, "mean": F.avg, "most": F.max}, "period", name_nodes=True).withColumn("max_nodes", F.array_join("max_nodes", ","))),
    "fwd_reach": reach_query(False), "bwd_reach": reach_query(True),
    "reach_summary": lambda s, d: rounded(temporal.summarise_nodes(temporal.reach(quarters(s, d), False, "period"), "reach", {"median": 0.5, "mean": F.avg, "most": F.max}, "period")),
    "earliest_arrival": lambda s, d: fixpoint.earliest_arrivals(moves(s, d), sources=root_rows(s)).select("source", "node", F.date_from_unix_date("t").alias("arrival")),
    "strength": lambda s, d: static.strength(dense_edges(s, d), "period"),
    "strength_gm_rank": lambda s, d: rounded(static.strength_rank(dense_edges(s, d), "period")),
    "strength_assortativity": lambda s, d: rounded(static.assortativity(dense_edges(s, d), "period")),
    "degree_assortativity": lambda s, d: rounded(static.assortativity(network.simplify(monthly(moves(s, d)), "period"), "period", weighted=False)),
    "loyalty": lambda s, d: rounded(static.loyalty(monthly(dense(s, d)), "period")),
    "density": lambda s, d: rounded(static.density(network.simplify(monthly(moves(s, d)), "period"), "period")),
    "degree_ccdf": lambda s, d: rounded(static.degree_ccdf(network.simplify(moves(s, d)))),
    "reciprocity": lambda s, d: rounded(static.reciprocity(dense_edges(s, d), "period")),
    "transitivity": lambda s, d: rounded(static.transitivity(dense_edges(s, d), "period")),
    "jaccard": lambda s, d: static.jaccard(moves(s, d), digits=DAYS),
    "weak_components": lambda s, d: fixpoint.weak_components(quarters(s, d), by=("period",)),
    "component_sizes": lambda s, d: rounded(static.component_sizes(fixpoint.weak_components(quarters(s, d), by=("period",)), "period")),
    "giant_components": lambda s, d: rounded(fixpoint.giant_components(quarters(s, d), ("period",))),
    "strong_components": lambda s, d: fixpoint.strong_components(quarters(s, d), ("period",)),
    "static_reach": lambda s, d: fixpoint.reach_sizes(quarters(s, d), ("period",)),
    "in_subcomponent": lambda s, d: in_subcomponent(quarters(s, d), "period"),
    "distance_components": distance_components,
    "trace": lambda s, d: chains(s, d),
    "trace_maxdist": lambda s, d: chains(s, d, 2),
    "trace_moves": lambda s, d: trace.traced_moves(chains(s, d), moves(s, d)).select("root", "direction", "ref"),
    "trace_holdings": lambda s, d: trace.traced_holdings(chains(s, d), holdings(s, d)).select("id", "root", "direction", "type"),
    "admin_in": lambda s, d: area_totals(s, d, "to_area"), "admin_out": lambda s, d: area_totals(s, d, "from_area"),
    "move_lines": lines,
    "move_geojson": lambda s, d: geojson(trace.move_lines(moves(s, d), holdings(s, d)), "line", ["ref", "weight"]),
    "parallel_offsets": lambda s, d: trace.parallel_offsets(dense(s, d), ["date", "ref"]).select("ref", "edge_no", "width", "offset"),
    "kendall_strength": kendall,
    "pagerank": lambda s, d: kernels.page_ranks(dense_edges(s, d), ["period"]),
    "path_measures": lambda s, d: all_months(s, d),
    "avg_daily_weight": lambda s, d: transmission.average_daily_weight(dense(s, d)).withColumn("daily", F.round("daily", 9)),
    "movement_spread": lambda s, d: moves_spread(s, d).withColumn("p", F.round("p", 9)),
    "local_spread": lambda s, d: transmission.local_spread(local_pairs(s, d)),
    "combine_routes": lambda s, d: transmission.combine_routes([moves_spread(s, d), moves_spread(s, d).select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("p") / 2).alias("p"))]).withColumn("p", F.round("p", 9)),
    "local_tiers": lambda s, d: s.createDataFrame(list(transmission.LOCAL_TIERS), "lower double, upper double, probability double"),
    "infected_at_start": lambda s, d: transmission.infected_at_start(holdings(s, d), share=0.1),
    "effect_experiment": experiment,
    "effect_mean_sims": lambda s, d: rounded(stats.mean_over_sims(experiment(s, d), "mean_weight", "treatment", "amount", "period")),
    "top_holdings": lambda s, d: moves(s, d).groupBy("to_id").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "to_id").limit(40),
    "largest_herd": lambda s, d: holdings(s, d).groupBy("type").agg(F.max_by("id", F.struct("herd_size", "id")).alias("id"), F.max("herd_size").alias("herd_size")),
    "season_counts": lambda s, d: moves(s, d).groupBy(floor_date(F.col("date"), "season").alias("season")).agg(F.count("*").alias("moves")),
    "arrival_tree": lambda s, d: fixpoint.arrival_tree(moves(s, d), root_rows(s)),
    "betweenness_norm": lambda s, d: static.normalised_betweenness(all_months(s, d, weighted=False), "period").select("period", "id", "betweenness"),
    "closeness": lambda s, d: all_months(s, d, directed=False, weighted=False).select("period", "id", "closeness"),
    "distances": lambda s, d: rounded(static.distances(all_months(s, d, weighted=False), "period")),
    "mean_weighted_distance": lambda s, d: rounded(static.distances(all_months(s, d), "period").select("period", "mean_distance")),
    "random_reciprocity": lambda s, d: static.reciprocity(static.random_edges(s, 500, 5000).withColumn("network", F.lit("random")), "network"),
    "max_node_overlap": lambda s, d: stats.overlap_share(_max_nodes(privacy.jitter_dates(dense(s, d), 15, "ref")).withColumn("treatment", F.lit("jittered")), _max_nodes(dense(s, d)), "max_nodes", "period", "treatment"),
    "popup_text": lambda s, d: trace.popup_text(trace.traced_holdings(chains(s, d), holdings(s, d)), ["type"]),
    "seir_events": lambda s, d: transmission.seir_events(moves(s, d), privacy.pseudonym_key(network.endpoints(moves(s, d)), "id")),
    "seir_nodes": lambda s, d: transmission.seir_nodes(transmission.infected_at_start(holdings(s, d), share=0.1), privacy.pseudonym_key(holdings(s, d), "id")),
    "movement_types": lambda s, d: guess_types(from_table(s.read.parquet(f"{d}/example_movement_data.parquet").select("row_id", "qty_doa", "lot_no")), ["row_id", "qty_doa", "lot_no"], "."),
    "weight_box": lambda s, d: rounded(stats.box_stats(monthly(moves(s, d)), "weight", "period")),
}

# All movements as one network, where recursion in SQL is too slow to hold them against, and networks between holdings as they are.
QUERIES |= {
    "weak_components_whole": lambda s, d: fixpoint.weak_components(moves(s, d)),
    "component_sizes_whole": lambda s, d: rounded(static.component_sizes(fixpoint.weak_components(moves(s, d)).withColumn("net", F.lit(1)), "net")),
    "path_measures_holdings": lambda s, d: holding_paths(s, d),
    "betweenness_norm_holdings": lambda s, d: static.normalised_betweenness(holding_paths(s, d, weighted=False), "period").select("period", "id", "betweenness"),
    "closeness_holdings": lambda s, d: holding_paths(s, d, directed=False, weighted=False).select("period", "id", "closeness"),
    "distances_holdings": lambda s, d: rounded(static.distances(holding_paths(s, d, weighted=False), "period")),
    "mean_weighted_distance_holdings": lambda s, d: rounded(static.distances(holding_paths(s, d), "period").select("period", "mean_distance")),
    "pagerank_holdings": lambda s, d: kernels.page_ranks(holding_edges(s, d), ["period"]),
    "kendall_strength_holdings": lambda s, d: kendall(s, d, moves),
}


def states(spark: SparkSession, d: str) -> DataFrame:
    """Made-up states of a compartment model: 40 nodes, rows numbered through steps and nodes, a simulation per supplier."""
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.select(line.alias("sim"), k.alias("row"), (k % 3 == 0).cast("int").alias("I"), (k % 5 == 0).cast("int").alias("R"))


def date_experiment(spark: SparkSession, d: str) -> DataFrame:
    """Temporal degrees of monthly networks under jittered and rounded dates."""
    made = stats.date_variants(dense(spark, d), "ref", [7, 30], ["week", "quarter"], 2)
    by = ["treatment", "amount", "sim", "period"]
    degree = temporal.temporal_degree(monthly(made), "all", *by)
    return rounded(degree.groupBy(*by).agg(F.avg("degree").alias("mean_degree"), F.max("degree").alias("most"), F.count("*").alias("nodes")))


def contacts(spark: SparkSession, d: str, fast: bool = False) -> trace.Contacts | None:
    return trace.trace_contacts(moves(spark, d), holdings(spark, d), ROOTS, t_end=["1998-03-31"], days=[75], fast=fast)


def split(spark: SparkSession, d: str, keep_idle: bool) -> DataFrame:
    return network.split_network(dense(spark, d).withColumn("period", F.trunc("date", "quarter")), "period", keep_idle=keep_idle)[0]


QUERIES |= {
    "date_experiment": date_experiment,
    "isolated_share": lambda s, d: rounded(static.isolated_share(holding_edges(s, d), "period")),
    "degree_medians": lambda s, d: static.degree_medians(holding_edges(s, d), "period"),
    "aggregation_profile": lambda s, d: rounded(temporal.aggregation_profile(dense(s, d), ["week", "month", "bimonth", "quarter", "halfyear", "year"])),
    "trace_fast": lambda s, d: contacts(s, d, fast=True).chains,
    "trace_counts": lambda s, d: contacts(s, d).counts,
    "static_network": lambda s, d: network.static_network(moves(s, d), holdings(s, d), keep_idle=True)[0].select("id", "type", "active"),
    "temporal_network": lambda s, d: network.temporal_network(moves(s, d), holdings(s, d))["edge_spells"].groupBy("onset").agg(F.count("*").alias("spells"), F.count_distinct("tail", "head").alias("edges")),
    "renumbered": lambda s, d: network.renumbered(moves(s, d), holdings(s, d))[1].select("id", "type", "active"),
    "split_active": lambda s, d: split(s, d, False), "split_all": lambda s, d: split(s, d, True),
    "on_date": lambda s, d: network.on_date(moves(s, d), "1997-05-05").select("ref", "weight"),
    "weight_between": lambda s, d: network.weight_between(moves(s, d), 10, 20).select("ref"),
    "nth_holding": lambda s, d: ranks.nth_largest(moves(s, d).groupBy("to_id").agg(F.sum("weight").alias("weight")), "weight", 8, "to_id"),
    "numeric_order": lambda s, d: ranks.in_numeric_order(privacy.pseudonym_key(holdings(s, d), "id").select("new_id"), "new_id"),
    "average_ranks": lambda s, d: ranks.average_ranks(moves(s, d).groupBy("to_id").agg(F.count("*").alias("moves")), [], "moves", "rank"),
    "width_labels": lambda s, d: moves(s, d).select("ref", trace.width_label(F.pow(F.lit(2.0), F.floor(F.log10("weight")))).alias("label")),
    "weight_histogram": lambda s, d: stats.histogram(monthly(moves(s, d)), "weight", 5.0, "period"),
    "heat_map": lambda s, d: rounded(stats.heat_map(moves(s, d).select(F.year("date").alias("year"), F.month("date").alias("month"), "weight"), "year", "month", "weight")),
    "wide_weights": lambda s, d: stats.wide(moves(s, d).groupBy(F.year("date").alias("year"), F.concat(F.lit("q"), F.quarter("date")).alias("quarter")).agg(F.sum("weight").alias("weight")), ["year"], "quarter", "weight", ["q1", "q2", "q3", "q4"]),
    "kept_treatments": lambda s, d: stats.kept_treatments(stats.variants(dense(s, d), "ref", [5.0], [10.0], 1), ["true", "rounded"]).groupBy("treatment").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")),
    "cumulative_infected": lambda s, d: stats.cumulative_infected(states(s, d), 40, "sim"),
    "step_quantiles": lambda s, d: rounded(stats.step_quantiles(stats.cumulative_infected(states(s, d), 40, "sim"), 40)),
    "wilcoxon_strength": lambda s, d: rounded(stats.wilcoxon(static.strength(dense_edges(s, d), "period"), ["period"], "out_strength", "in_strength")),
}

_M = """moves AS (SELECT concat('H', l_partkey) AS from_id, concat('H', o_custkey) AS to_id, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS DOUBLE) AS weight,
  l_orderkey AS batch_no, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS ref, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
real AS (SELECT * FROM moves WHERE from_id <> to_id),
quarters AS (SELECT *, CAST(date_trunc('quarter', date) AS DATE) AS period FROM moves),
dense AS (SELECT concat('H', l_partkey % 50) AS from_id, concat('H', o_custkey % 50) AS to_id, date, weight, batch_no, ref, CAST(date_trunc('month', date) AS DATE) AS period FROM moves),
edges AS (SELECT period, from_id, to_id, sum(weight) AS weight FROM dense WHERE from_id <> to_id GROUP BY ALL),
holdings AS (SELECT concat('H', p_partkey) AS id, p_type AS type, CAST(p_size AS DOUBLE) AS herd_size, -6.0 + (p_partkey * 37 % 1000) / 125.0 AS lon, 50.0 + (p_partkey * 73 % 1000) / 125.0 AS lat FROM part)"""


def _activity(start: str, weights: bool) -> str:
    w = """, w AS (SELECT period, min(weight) AS w_min, quantile_cont(weight, 0.25) AS w_q1, quantile_cont(weight, 0.5) AS w_median, avg(weight) AS w_mean, quantile_cont(weight, 0.75) AS w_q3, max(weight) AS w_max
  FROM p WHERE from_id <> to_id GROUP BY period)""" if weights else ""
    cols = ", w_min, w_q1, w_median, round(w_mean, 6) AS w_mean, w_q3, w_max" if weights else ""
    return f"""WITH {_M}, p AS (SELECT *, CAST({start} AS DATE) AS period FROM moves),
ends AS (SELECT period, from_id AS id FROM p UNION SELECT period, to_id FROM p),
a AS (SELECT period, count(*) AS holdings_active FROM ends GROUP BY period),
e AS (SELECT period, count(*) AS movements, count(DISTINCT (from_id, to_id)) AS edges FROM p WHERE from_id <> to_id GROUP BY period),
t AS (SELECT (SELECT count(DISTINCT id) FROM ends) AS n, (SELECT count(*) FROM real) AS m, (SELECT count(DISTINCT (from_id, to_id)) FROM real) AS k){w}
SELECT a.period, holdings_active, round(holdings_active / n, 6) AS holdings_share, coalesce(movements, 0) AS movements, round(coalesce(movements, 0) / m, 6) AS movements_share,
  coalesce(edges, 0) AS edges, round(coalesce(edges, 0) / k, 6) AS edges_share, round(coalesce(edges, 0) / (n * (n - 1)), 6) AS density{cols}
FROM a LEFT JOIN e ON a.period = e.period {'LEFT JOIN w ON a.period = w.period' if weights else ''} CROSS JOIN t"""


def _rounded_dates(floor: str) -> str:
    return f"WITH {_M} SELECT from_id, to_id, CAST({floor} AS DATE) AS date, sum(weight) AS weight FROM moves GROUP BY ALL"


def _u(key: str, use: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', {key}, '1', '{use}')), 1, 8)) AS UBIGINT)"


_ENDS = "ends AS (SELECT from_id AS id FROM {0} UNION SELECT to_id FROM {0})"
_DEGREE = "SELECT e.period, e.id, coalesce(n, 0) AS degree FROM ends e LEFT JOIN (SELECT period, id, count(*) AS n FROM sides GROUP BY ALL) s ON e.period = s.period AND e.id = s.id"
_DAYS = f"""WITH {_M}, pm AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS period FROM moves), ends AS (SELECT period, from_id AS id FROM pm UNION SELECT period, to_id FROM pm),
days AS (SELECT DISTINCT period, date, from_id, to_id FROM pm WHERE from_id <> to_id)"""
_REACH = """WITH RECURSIVE {m}, hops AS (SELECT DISTINCT period, {a} AS u, {b} AS v, {sign}CAST(date - DATE '1970-01-01' AS INTEGER) AS t FROM quarters WHERE from_id <> to_id),
r AS (SELECT period, u AS source, v AS node, t FROM hops UNION SELECT r.period, r.source, h.v, h.t FROM r JOIN hops h ON r.period = h.period AND r.node = h.u AND h.t > r.t),
nodes AS (SELECT period, from_id AS id FROM quarters UNION SELECT period, to_id FROM quarters), pairs AS (SELECT period, source, node FROM r UNION SELECT period, id, id FROM nodes)"""
_FWD = _REACH.format(m=_M, a="from_id", b="to_id", sign="")
_BWD = _REACH.format(m=_M, a="to_id", b="from_id", sign="-")
_CLOSURE = f"""WITH RECURSIVE {_M}, nodes AS (SELECT period, from_id AS id FROM quarters UNION SELECT period, to_id FROM quarters), arcs AS (SELECT DISTINCT period, from_id AS u, to_id AS v FROM quarters WHERE from_id <> to_id),
c AS (SELECT period, id AS source, id AS node FROM nodes UNION SELECT c.period, c.source, a.v FROM c JOIN arcs a ON c.period = a.period AND c.node = a.u)"""
_SCC = ", s AS (SELECT c.period, c.source AS id, min(c.node) AS component FROM c JOIN c b ON c.period = b.period AND c.source = b.node AND c.node = b.source GROUP BY ALL)"
_WCC = f"""WITH RECURSIVE {_M}, arcs AS (SELECT period, from_id AS u, to_id AS v FROM quarters UNION SELECT period, to_id, from_id FROM quarters), c AS (SELECT period, u AS source, u AS node FROM arcs UNION SELECT c.period, c.source, a.v FROM c JOIN arcs a ON c.period = a.period AND c.node = a.u),
w AS (SELECT period, source AS id, min(node) AS component FROM c GROUP BY ALL)"""
_STRENGTH = """st AS (SELECT period, id, sum(o) AS out_strength, sum(i) AS in_strength, CAST(sum(od) AS BIGINT) AS out_degree, CAST(sum(idg) AS BIGINT) AS in_degree FROM
  (SELECT period, from_id AS id, weight AS o, 0.0 AS i, 1 AS od, 0 AS idg FROM {0} UNION ALL SELECT period, to_id, 0.0, weight, 0, 1 FROM {0}) GROUP BY ALL)"""


def _assortativity(edges: str, x: str, y: str) -> str:
    return f"""xy AS (SELECT e.*, CAST(a.{x} AS DOUBLE) AS x, CAST(b.{y} AS DOUBLE) AS y FROM {edges} e JOIN st a ON e.period = a.period AND e.from_id = a.id JOIN st b ON e.period = b.period AND e.to_id = b.id)"""


_TRACE = f"""WITH RECURSIVE {_M}, roots AS (SELECT unnest(['H10', 'H55', 'H77', 'H121']) AS root),
h AS (SELECT DISTINCT from_id, to_id, CAST(date - DATE '1970-01-01' AS INTEGER) AS t FROM real WHERE date >= DATE '1998-01-15' AND date <= DATE '1998-03-31'),
hops AS (SELECT 'out' AS direction, from_id AS u, to_id AS v, t FROM h UNION ALL SELECT 'in', to_id, from_id, -t FROM h),
s AS (SELECT root, direction, root AS node, -1000000 AS at, [root] AS path, 1 AS distance FROM roots CROSS JOIN (SELECT unnest(['in', 'out']) AS direction)
  UNION ALL SELECT s.root, s.direction, h.v, min(h.t), list_append(s.path, h.v), s.distance + 1 FROM s JOIN hops h ON s.direction = h.direction AND s.node = h.u AND h.t >= s.at AND NOT list_contains(s.path, h.v) GROUP BY s.root, s.direction, h.v, s.path, s.distance),
found AS (SELECT DISTINCT s.root, s.direction, CASE WHEN s.direction = 'out' THEN h.u ELSE h.v END AS source, CASE WHEN s.direction = 'out' THEN h.v ELSE h.u END AS destination, DATE '1970-01-01' + abs(h.t) AS date, s.distance
  FROM s JOIN hops h ON s.direction = h.direction AND s.node = h.u AND h.t >= s.at AND NOT list_contains(s.path, h.v))"""
_AREAS = f"""WITH {_M}, corners AS (SELECT area_id, unnest(range(1, len(ring))) AS i, ring FROM example_admin_areas), sides AS (SELECT area_id, ring[i].lon AS x1, ring[i].lat AS y1, ring[i + 1].lon AS x2, ring[i + 1].lat AS y2 FROM corners),
ha AS (SELECT p.id, e.area_id FROM holdings p JOIN sides e ON (e.x1 <= p.lon) <> (e.x2 <= p.lon) AND e.y1 + (e.y2 - e.y1) / (e.x2 - e.x1) * (p.lon - e.x1) <= p.lat GROUP BY ALL HAVING count(*) % 2 = 1),
b AS (SELECT f.area_id AS from_area, t.area_id AS to_area, weight FROM moves q JOIN ha f ON q.from_id = f.id JOIN ha t ON q.to_id = t.id WHERE f.area_id <> t.area_id)"""
_SPREAD = "d AS (SELECT from_id AS i, to_id AS j, 1 - pow(0.7, sum(weight) / (SELECT CAST(last_day(max(date)) - date_trunc('month', min(date))::DATE + 1 AS DOUBLE) FROM moves)) AS p FROM moves WHERE from_id <> to_id GROUP BY ALL)"
_KEY = "key AS (SELECT id AS old_id, concat('{1}', row_number() OVER (ORDER BY md5(concat_ws('|', id, '1', 'key')), id)) AS new_id FROM ({0}))"
_VARIANTS = f"""WITH {_M}, grid AS (SELECT 'true' AS treatment, 0.0::DOUBLE AS amount, 0 AS sim UNION ALL SELECT 'jittered', a, s FROM (SELECT unnest([5.0::DOUBLE, 20.0::DOUBLE]) AS a) CROSS JOIN (SELECT unnest([1, 2]) AS s) UNION ALL SELECT 'rounded', unnest([10.0::DOUBLE, 25.0::DOUBLE]), 0),
v AS (SELECT treatment, amount, sim, CAST(date_trunc('quarter', date) AS DATE) AS period, from_id, to_id, CASE treatment WHEN 'true' THEN weight
  WHEN 'rounded' THEN greatest(round_even(weight / amount, 0) * amount, amount) ELSE weight + greatest(-amount, -weight) + (({_u("concat_ws('|', ref, amount, sim)", 'weight')} + 1) / 4294967296.0) * (amount - greatest(-amount, -weight)) END AS weight FROM dense CROSS JOIN grid),
ve AS (SELECT treatment, amount, sim, period, from_id, to_id, sum(weight) AS weight FROM v WHERE from_id <> to_id GROUP BY ALL),
o AS (SELECT treatment, amount, sim, period, from_id AS id, sum(weight) AS x FROM ve GROUP BY ALL), n AS (SELECT treatment, amount, sim, period, to_id AS id, sum(weight) AS y FROM ve GROUP BY ALL),
r AS (SELECT ve.treatment, ve.amount, ve.sim, ve.period, round(avg(weight), 6) AS mean_weight, round(corr(x, y), 6) AS assortativity FROM ve
  JOIN o ON ve.treatment = o.treatment AND ve.amount = o.amount AND ve.sim = o.sim AND ve.period = o.period AND ve.from_id = o.id JOIN n ON ve.treatment = n.treatment AND ve.amount = n.amount AND ve.sim = n.sim AND ve.period = n.period AND ve.to_id = n.id GROUP BY ALL)"""
_RANKS = """(SELECT period, id, rank() OVER (PARTITION BY period ORDER BY gm DESC) + (count(*) OVER (PARTITION BY period, gm) - 1) / 2.0 AS r FROM (SELECT period, id, sqrt(sum(i) * sum(o)) AS gm FROM
  (SELECT period, from_id AS id, w AS o, 0.0 AS i FROM {0} UNION ALL SELECT period, to_id, 0.0, w FROM {0}) GROUP BY ALL))"""
_ARRIVAL = f"""WITH RECURSIVE {_M}, hops AS (SELECT DISTINCT from_id AS u, to_id AS v, CAST(date - DATE '1970-01-01' AS INTEGER) AS t FROM real), roots AS (SELECT DISTINCT id FROM (SELECT from_id AS id FROM moves UNION SELECT to_id FROM moves) WHERE id IN ('H10', 'H55', 'H77', 'H121')),
r AS (SELECT u AS source, v AS node, t FROM hops WHERE u IN (SELECT id FROM roots) UNION SELECT r.source, h.v, h.t FROM r JOIN hops h ON r.node = h.u AND h.t > r.t),
known AS (SELECT source, node, min(t) AS t FROM r WHERE source <> node GROUP BY ALL UNION ALL SELECT id, id, NULL FROM roots)"""
# Walks of up to 49 edges: the folded months have at most 50 nodes.
_WALKS = """ids AS (SELECT period, u AS id FROM arcs UNION SELECT period, v FROM arcs), b AS (SELECT period, id AS source, id AS node, 0 AS n FROM ids UNION SELECT b.period, b.source, a.v, b.n + 1 FROM b JOIN arcs a ON b.period = a.period AND b.node = a.u WHERE b.n < 49),
f AS (SELECT period, source, node, min(n) AS n FROM b WHERE source <> node GROUP BY ALL)"""
_BFS = f"WITH RECURSIVE {_M}, arcs AS (SELECT period, from_id AS u, to_id AS v FROM edges), {_WALKS}"

ORACLE: dict[str, str] = {
    "arrival_tree": f"""{_ARRIVAL} SELECT k.source, k.node, DATE '1970-01-01' + k.t AS arrival, min(h.u) AS via
FROM known k JOIN hops h ON k.node = h.v AND k.t = h.t JOIN known b ON b.source = k.source AND b.node = h.u AND coalesce(b.t, -1) < k.t WHERE k.t IS NOT NULL GROUP BY ALL""",
    "closeness": f"WITH RECURSIVE {_M}, arcs AS (SELECT period, from_id AS u, to_id AS v FROM edges UNION SELECT period, to_id, from_id FROM edges), {_WALKS} SELECT period, source AS id, CAST(1 AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS closeness FROM f GROUP BY ALL",
    "distances": f"{_BFS} SELECT period, round(avg(n), 6) AS mean_distance, CAST(max(n) AS DOUBLE) AS diameter FROM f GROUP BY period",
    "popup_text": f"{_TRACE}, e AS (SELECT DISTINCT root, direction, CASE WHEN direction = 'out' THEN destination ELSE source END AS id FROM found UNION SELECT DISTINCT root, 'root', root FROM found) SELECT e.id, direction, concat_ws('<br>', CASE direction WHEN 'root' THEN 'Root holding' WHEN 'in' THEN 'Ingoing contact' ELSE 'Outgoing contact' END, e.id, CASE WHEN type IS NOT NULL THEN concat('type: ', type) END) AS text FROM e LEFT JOIN holdings h ON e.id = h.id WHERE direction = 'root' OR e.id <> root",
    "seir_events": f"WITH {_M}, {_ENDS.format('moves')}, {_KEY.format('SELECT id FROM ends', '')} SELECT 'extTrans' AS event, CAST(date - (SELECT min(date) FROM moves) + 1 AS INTEGER) AS time, CAST(a.new_id AS INTEGER) AS node, CAST(b.new_id AS INTEGER) AS dest, CAST(weight AS INTEGER) AS n, 0.0::DOUBLE AS proportion, 1 AS \"select\", 0 AS shift FROM moves JOIN key a ON from_id = a.old_id JOIN key b ON to_id = b.old_id WHERE from_id <> to_id",
    "seir_nodes": f"WITH {_M}, {_KEY.format('SELECT DISTINCT id FROM holdings', '')}, i AS (SELECT id, CASE WHEN {_u('id', 'infected')} < {int(0.1 * 2**32)} THEN 1 ELSE 0 END AS x FROM holdings) SELECT CAST(new_id AS INTEGER) AS node, 1 - x AS S, 0 AS E, x AS I, 0 AS R FROM i JOIN key ON id = old_id",
    "movement_types": "SELECT CAST(row_id AS DOUBLE) AS row_id, CAST(qty_doa AS DOUBLE) AS qty_doa, lot_no FROM example_movement_data",
    **{f"summary_{u}": _activity(f"date_trunc('{u}', date)", True) for u in ("month", "quarter", "year")},
    **{f"summary_{n}d": _activity(f"(SELECT date_trunc('month', min(date))::DATE FROM moves) + CAST(floor((date - (SELECT date_trunc('month', min(date))::DATE FROM moves)) / {n}) AS INTEGER) * {n}", False) for n in (1, 7, 14, 28, 84)},
    "weight_sixnum": f"WITH {_M} SELECT concat('Q', quarter(date), ' ', year(date)) AS label, min(weight) AS w_min, quantile_cont(weight, 0.25) AS w_q1, quantile_cont(weight, 0.5) AS w_median, round(avg(weight), 6) AS w_mean, quantile_cont(weight, 0.75) AS w_q3, max(weight) AS w_max FROM moves GROUP BY 1",
    "round_dates_week_sun": _rounded_dates("date - CAST(dayofweek(date) AS INTEGER)"),
    "round_dates_week_mon": _rounded_dates("date_trunc('week', date)"),
    "round_dates_month": _rounded_dates("date_trunc('month', date)"),
    "round_dates_bimonth": _rounded_dates("make_date(year(date), ((month(date) - 1) // 2) * 2 + 1, 1)"),
    "round_dates_quarter": _rounded_dates("date_trunc('quarter', date)"),
    "round_dates_season": _rounded_dates("date_trunc('quarter', date + INTERVAL 1 MONTH) - INTERVAL 1 MONTH"),
    "round_dates_halfyear": _rounded_dates("make_date(year(date), ((month(date) - 1) // 6) * 6 + 1, 1)"),
    "round_dates_year": _rounded_dates("date_trunc('year', date)"),
    "round_dates_10days": _rounded_dates("make_date(year(date), month(date), ((day(date) - 1) // 10) * 10 + 1)"),
    "round_dates_2years": _rounded_dates("make_date((year(date) // 2) * 2, 1, 1)"),
    "round_dates_aggs": f"WITH {_M} SELECT from_id, to_id, period AS date, sum(weight) AS weight, count(*) AS n, min(weight) AS least, count(DISTINCT batch_no) AS batches, quantile_cont(weight, 0.9) AS q90 FROM dense GROUP BY ALL",
    "round_dates_nosum": f"WITH {_M} SELECT from_id, to_id, CAST(date_trunc('quarter', date) AS DATE) AS date, min(batch_no) AS first_batch FROM dense GROUP BY ALL",
    "round_weights": f"WITH {_M} SELECT ref, greatest(round_even(weight / 20.0, 0) * 20.0, 20.0) AS weight FROM moves",
    "jitter_dates": f"WITH {_M}, s AS (SELECT min(date) AS a, max(date) AS b FROM moves), j AS (SELECT ref, date, greatest(-5, a - date) AS lo, least(5, b - date) AS hi FROM moves CROSS JOIN s) SELECT ref, date + CAST(lo + floor(({_u('ref', 'date')} / 4294967296.0) * (hi - lo + 1)) AS INTEGER) AS date FROM j",
    "jitter_weights": f"WITH {_M} SELECT ref, round(weight + greatest(-10.0::DOUBLE, -weight) + (({_u('ref', 'weight')} + 1) / 4294967296.0) * (10.0 - greatest(-10.0::DOUBLE, -weight)), 6) AS weight FROM moves",
    "pseudonymise": f"WITH {_M}, {_ENDS.format('moves')}, {_KEY.format('SELECT id FROM ends', 'FARM')} SELECT ref, a.new_id AS from_id, b.new_id AS to_id FROM moves JOIN key a ON from_id = a.old_id JOIN key b ON to_id = b.old_id",
    "pseudonym_key_extend": f"""WITH {_M}, {_ENDS.format('moves')}, {_KEY.format('SELECT DISTINCT id FROM holdings', 'N')}, u AS (SELECT id FROM (SELECT id FROM ends UNION SELECT concat('X', range) FROM range(50)) WHERE id NOT IN (SELECT old_id FROM key))
SELECT * FROM key UNION ALL SELECT id, concat('N', (SELECT count(*) FROM key) + row_number() OVER (ORDER BY md5(concat_ws('|', id, '1', 'key')), id)) FROM u""",
    "harmonise_active": f"WITH {_M}, {_ENDS.format('moves')} SELECT e.id, type, herd_size, TRUE AS active FROM ends e LEFT JOIN holdings h ON e.id = h.id",
    "harmonise_all": f"WITH {_M}, {_ENDS.format('moves')} SELECT coalesce(e.id, h.id) AS id, type, herd_size, e.id IS NOT NULL AS active FROM ends e FULL JOIN holdings h ON e.id = h.id",
    "missing_ids": f"WITH {_M}, {_ENDS.format('moves')} SELECT id FROM ends WHERE id NOT IN (SELECT id FROM holdings WHERE herd_size > 25)",
    "idle_ids": f"WITH {_M}, {_ENDS.format('moves')} SELECT DISTINCT id FROM holdings WHERE id NOT IN (SELECT id FROM ends)",
    "self_moves": f"WITH {_M} SELECT ref, from_id, weight FROM moves WHERE from_id = to_id",
    "dup_moves": f"WITH {_M} SELECT from_id, to_id, date, count(*) AS n FROM dense GROUP BY ALL HAVING count(*) > 1",
    "heavy_moves": f"WITH {_M} SELECT ref FROM moves WHERE weight BETWEEN 45 AND 50",
    "in_period": f"WITH {_M} SELECT ref, date FROM moves WHERE date >= DATE '1998-01-01' AND date < DATE '1998-04-01'",
    "simplify_month": f"WITH {_M} SELECT * FROM edges",
    "simplify_stats": f"WITH {_M} SELECT from_id, to_id, round(avg(weight), 6) AS mean_weight, quantile_cont(weight, 0.5) AS median_weight, count(*) AS moves FROM dense WHERE from_id <> to_id GROUP BY ALL",
    "snapshot_collapse": f"WITH {_M} SELECT period, from_id, to_id, first(weight ORDER BY date, weight) AS weight, min(date) AS first_date, count(DISTINCT date) AS days FROM dense WHERE from_id <> to_id GROUP BY ALL",
    "edge_spells": f"WITH {_M} SELECT CAST(date - DATE '1970-01-01' AS INTEGER) AS onset, CAST(date - DATE '1970-01-01' AS INTEGER) AS terminus, from_id AS tail, to_id AS head, ref FROM real",
    "vertex_spells": f"WITH {_M} SELECT onset, onset AS terminus, vertex FROM (SELECT CAST(date - DATE '1970-01-01' AS INTEGER) AS onset, from_id AS vertex FROM moves UNION SELECT CAST(date - DATE '1970-01-01' AS INTEGER), to_id FROM moves)",
    "periods_28d": f"WITH {_M}, s AS (SELECT min(date) AS a, max(date) AS b FROM moves) SELECT CAST(i + 1 AS INTEGER) AS period, a + CAST(i * 28 AS INTEGER) AS start, a + CAST(i * 28 + 28 AS INTEGER) AS \"end\" FROM s CROSS JOIN range(1000) t(i) WHERE a + CAST(i * 28 AS INTEGER) <= b",
    "periods_quarter": f"WITH {_M}, s AS (SELECT date_trunc('quarter', min(date))::DATE AS a, max(date) AS b FROM moves), g AS (SELECT CAST(i + 1 AS INTEGER) AS period, CAST(a + to_months(CAST(i * 3 AS INTEGER)) AS DATE) AS start, b FROM s CROSS JOIN range(200) t(i)) SELECT period, start, CAST(start + INTERVAL 3 MONTH AS DATE) AS \"end\" FROM g WHERE start <= b",
    "split_periods": f"WITH {_M} SELECT CAST(date_trunc('month', date) AS DATE) AS period, count(*) AS moves, sum(weight) AS weight, min(date) AS first_date FROM moves GROUP BY 1",
    "grids": f"""WITH {_M}, s AS (SELECT date_trunc('month', min(date))::DATE AS a, last_day(max(date)) AS b FROM moves),
n AS (SELECT unnest([1, 7, 14, 28, 84]) AS n), u AS (SELECT * FROM (VALUES ('month', 1), ('quarter', 3), ('year', 12)) t(grid, k))
SELECT CASE WHEN n = 1 THEN 'daily' ELSE concat(n, 'days') END AS grid, a + CAST(i * n AS INTEGER) AS start FROM s CROSS JOIN n CROSS JOIN range(5000) t(i) WHERE a + CAST(i * n AS INTEGER) <= b
UNION ALL SELECT grid, CAST(date_trunc(grid, a) + to_months(CAST(i * k AS INTEGER)) AS DATE) FROM s CROSS JOIN u CROSS JOIN range(200) t(i) WHERE CAST(date_trunc(grid, a) + to_months(CAST(i * k AS INTEGER)) AS DATE) <= b""",
    "consecutive_ids": "SELECT TRUE AS consecutive",
    "temporal_degree": f"{_DAYS}, sides AS (SELECT period, from_id AS id FROM days UNION ALL SELECT period, to_id FROM days) {_DEGREE}",
    "temporal_indegree": f"{_DAYS}, sides AS (SELECT period, to_id AS id FROM days) {_DEGREE}",
    "temporal_outdegree": f"{_DAYS}, sides AS (SELECT period, from_id AS id FROM days) {_DEGREE}",
    "degree_stats": f"""WITH {_M}, ends AS (SELECT period, from_id AS id FROM dense UNION SELECT period, to_id FROM dense), days AS (SELECT DISTINCT period, date, from_id, to_id FROM dense WHERE from_id <> to_id),
sides AS (SELECT period, from_id AS id FROM days UNION ALL SELECT period, to_id FROM days), d AS ({_DEGREE}), m AS (SELECT *, max(degree) OVER (PARTITION BY period) AS top FROM d)
SELECT period, quantile_cont(CAST(degree AS DOUBLE), 0.5) AS median, round(avg(degree), 6) AS mean, max(degree) AS most, string_agg(id, ',' ORDER BY id) FILTER (WHERE degree = top) AS max_nodes FROM m GROUP BY period""",
    "fwd_reach": f"{_FWD} SELECT period, source AS id, count(*) AS reach FROM pairs GROUP BY ALL",
    "bwd_reach": f"{_BWD} SELECT period, source AS id, count(*) AS reach FROM pairs GROUP BY ALL",
    "reach_summary": f"{_FWD}, n AS (SELECT period, source, CAST(count(*) AS DOUBLE) AS reach FROM pairs GROUP BY ALL) SELECT period, quantile_cont(reach, 0.5) AS median, round(avg(reach), 6) AS mean, CAST(max(reach) AS BIGINT) AS most FROM n GROUP BY period",
    "earliest_arrival": f"{_ARRIVAL} SELECT source, node, CASE WHEN t IS NOT NULL THEN DATE '1970-01-01' + t END AS arrival FROM known",
    "strength": f"WITH {_M}, {_STRENGTH.format('edges')} SELECT * FROM st",
    "strength_gm_rank": f"WITH {_M}, {_STRENGTH.format('edges')}, g AS (SELECT period, id, sqrt(in_strength * out_strength) AS gm FROM st) SELECT period, id, round(gm, 6) AS gm, rank() OVER (PARTITION BY period ORDER BY gm DESC) + (count(*) OVER (PARTITION BY period, gm) - 1) / 2 AS rank FROM g",
    "strength_assortativity": f"WITH {_M}, {_STRENGTH.format('edges')}, {_assortativity('edges', 'out_strength', 'in_strength')} SELECT period, round(corr(x, y), 6) AS assortativity FROM xy GROUP BY period",
    "degree_assortativity": f"WITH {_M}, sparse AS (SELECT CAST(date_trunc('month', date) AS DATE) AS period, from_id, to_id, sum(weight) AS weight FROM real GROUP BY ALL), {_STRENGTH.format('sparse')}, {_assortativity('sparse', 'out_degree', 'in_degree')} SELECT period, round(corr(x, y), 6) AS assortativity FROM xy GROUP BY period",
    "loyalty": f"WITH {_M}, n AS (SELECT period, count(*) AS n FROM edges GROUP BY period), c AS (SELECT a.period AS pa, b.period AS pb, count(*) AS c FROM edges a JOIN edges b ON a.from_id = b.from_id AND a.to_id = b.to_id GROUP BY ALL) SELECT x.period AS period_a, y.period AS period_b, round(coalesce(c, 0) / x.n, 6) AS loyalty FROM n x CROSS JOIN n y LEFT JOIN c ON pa = x.period AND pb = y.period",
    "density": f"WITH {_M}, e AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS period, from_id, to_id FROM real), v AS (SELECT period, count(*) AS nodes FROM (SELECT period, from_id FROM e UNION SELECT period, to_id FROM e) GROUP BY period) SELECT v.period, nodes, k AS edges, round(k / (nodes * (nodes - 1)), 6) AS density FROM v JOIN (SELECT period, count(*) AS k FROM e GROUP BY period) e USING (period)",
    "degree_ccdf": f"""WITH {_M}, e AS (SELECT DISTINCT from_id, to_id FROM real), s AS (SELECT id, sum(o) AS o, sum(i) AS i FROM (SELECT from_id AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT to_id, 0, 1 FROM e) GROUP BY id),
w AS (SELECT 'all' AS way, CAST(o + i AS BIGINT) AS degree FROM s UNION ALL SELECT 'in', CAST(i AS BIGINT) FROM s UNION ALL SELECT 'out', CAST(o AS BIGINT) FROM s), c AS (SELECT way, degree, count(*) AS nodes FROM w GROUP BY ALL)
SELECT way, degree, nodes, round(sum(nodes) OVER (PARTITION BY way ORDER BY degree DESC) / sum(nodes) OVER (PARTITION BY way), 6) AS ccdf FROM c""",
    "reciprocity": f"WITH {_M} SELECT a.period, round(count(b.from_id) / count(*), 6) AS reciprocity FROM edges a LEFT JOIN edges b ON a.period = b.period AND a.from_id = b.to_id AND a.to_id = b.from_id GROUP BY a.period",
    "transitivity": f"""WITH {_M}, u AS (SELECT DISTINCT period, least(from_id, to_id) AS u, greatest(from_id, to_id) AS v FROM edges), d AS (SELECT period, id, count(*) AS d FROM (SELECT period, u AS id FROM u UNION ALL SELECT period, v FROM u) GROUP BY ALL),
t AS (SELECT a.period, count(*) AS triangles FROM u a JOIN u b ON a.period = b.period AND a.v = b.u JOIN u c ON a.period = c.period AND c.u = a.u AND c.v = b.v GROUP BY a.period), k AS (SELECT period, sum(d * (d - 1) / 2) AS triples FROM d GROUP BY period)
SELECT k.period, coalesce(triangles, 0) AS triangles, triples, round(coalesce(triangles, 0) * 3.0 / triples, 6) AS transitivity FROM k LEFT JOIN t USING (period)""",
    "jaccard": f"""WITH {_M}, n AS (SELECT from_id AS id, to_id AS n FROM moves WHERE from_id <> to_id UNION SELECT to_id, from_id FROM moves WHERE from_id <> to_id), d AS (SELECT id, count(*) AS d FROM n GROUP BY id),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS s FROM n x JOIN n y ON x.n = y.n AND x.id < y.id GROUP BY ALL) SELECT a, b, round(s / (p.d + q.d - s), 6) AS jaccard FROM c JOIN d p ON a = p.id JOIN d q ON b = q.id""",
    "weak_components": f"{_WCC} SELECT * FROM w",
    "component_sizes": f"{_WCC}, z AS (SELECT period, component, count(*) AS size FROM w GROUP BY ALL) SELECT period, count(*) AS components, max(size) AS largest, quantile_cont(CAST(size AS DOUBLE), 0.5) AS median, round(quantile_cont(CAST(size AS DOUBLE), 0.99), 6) AS q99, count(*) = 1 AS connected FROM z GROUP BY period",
    "giant_components": f"""{_CLOSURE}{_SCC}, z AS (SELECT period, component, count(*) AS size FROM s GROUP BY ALL), g AS (SELECT DISTINCT ON (period) period, component, size FROM z ORDER BY period, size DESC, component),
a AS (SELECT period, count(*) AS active FROM nodes GROUP BY period), i AS (SELECT g.period, count(*) - any_value(size) AS gic FROM g JOIN c ON g.period = c.period AND c.node = g.component GROUP BY g.period), o AS (SELECT g.period, count(*) - any_value(size) AS goc FROM g JOIN c ON g.period = c.period AND c.source = g.component GROUP BY g.period)
SELECT period, active, size AS gscc, gic, goc, round(size / active, 6) AS gscc_share, round(gic / active, 6) AS gic_share, round(goc / active, 6) AS goc_share FROM g JOIN a USING (period) JOIN i USING (period) JOIN o USING (period)""",
    "strong_components": f"{_CLOSURE}{_SCC} SELECT * FROM s",
    "static_reach": f"{_CLOSURE} SELECT period, source AS id, count(*) AS reach FROM c GROUP BY ALL",
    "in_subcomponent": f"{_CLOSURE} SELECT period, source FROM c WHERE node = 'H10'",
    "trace": f"{_TRACE} SELECT * FROM found",
    "trace_maxdist": f"{_TRACE} SELECT * FROM found WHERE distance <= 2",
    "trace_moves": f"{_TRACE}, on_chain AS (SELECT DISTINCT root, direction, source, destination, date FROM found) SELECT root, direction, ref FROM on_chain f JOIN moves m ON f.source = m.from_id AND f.destination = m.to_id AND f.date = m.date",
    "trace_holdings": f"{_TRACE}, e AS (SELECT DISTINCT root, direction, CASE WHEN direction = 'out' THEN destination ELSE source END AS id FROM found UNION SELECT DISTINCT root, 'root', root FROM found) SELECT e.id, root, direction, type FROM e LEFT JOIN holdings h ON e.id = h.id WHERE direction = 'root' OR e.id <> root",
    "admin_in": f"{_AREAS} SELECT a.area_id, weight, moves FROM example_admin_areas a LEFT JOIN (SELECT to_area, sum(weight) AS weight, count(*) AS moves FROM b GROUP BY 1) s ON a.area_id = s.to_area",
    "admin_out": f"{_AREAS} SELECT a.area_id, weight, moves FROM example_admin_areas a LEFT JOIN (SELECT from_area, sum(weight) AS weight, count(*) AS moves FROM b GROUP BY 1) s ON a.area_id = s.from_area",
    "move_lines": f"WITH {_M} SELECT ref, round(a.lon, 6) AS lon_a, round(a.lat, 6) AS lat_a, round(b.lon, 6) AS lon_b, round(b.lat, 6) AS lat_b FROM moves JOIN holdings a ON from_id = a.id JOIN holdings b ON to_id = b.id",
    "parallel_offsets": f"WITH {_M}, w AS (SELECT *, pow(2.0, floor(log10(weight))) AS width FROM dense) SELECT ref, CAST(row_number() OVER o AS INTEGER) AS edge_no, width, -(sum(width + 1) OVER (o ROWS UNBOUNDED PRECEDING) - (width + 1) / 2) AS \"offset\" FROM w WINDOW o AS (PARTITION BY from_id, to_id ORDER BY date, ref)",
    "kendall_strength": f"""WITH {_M}, e1 AS (SELECT period, from_id, to_id, sum(weight) AS w FROM dense WHERE from_id <> to_id GROUP BY ALL), e2 AS (SELECT period, from_id, to_id, sum(greatest(round_even(weight / 20.0, 0) * 20.0, 20.0)) AS w FROM dense WHERE from_id <> to_id GROUP BY ALL),
x AS {_RANKS.format('e1')}, y AS {_RANKS.format('e2')}, xy AS (SELECT x.period, x.id, x.r AS x, y.r AS y FROM x JOIN y USING (period, id)),
s AS (SELECT a.period, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS c, sum(abs(sign(a.x - b.x))) AS nx, sum(abs(sign(a.y - b.y))) AS ny FROM xy a JOIN xy b ON a.period = b.period AND a.id < b.id GROUP BY a.period) SELECT period, round(c / sqrt(nx * ny), 6) AS tau FROM s""",
    "avg_daily_weight": f"WITH {_M} SELECT from_id, to_id, round(sum(weight) / (SELECT CAST(last_day(max(date)) - date_trunc('month', min(date))::DATE + 1 AS DOUBLE) FROM moves), 9) AS daily FROM dense GROUP BY ALL",
    "movement_spread": f"WITH {_M}, {_SPREAD} SELECT i, j, round(p, 9) AS p FROM d",
    "combine_routes": f"WITH {_M}, {_SPREAD}, r AS (SELECT i, j, p FROM d UNION ALL SELECT j, i, p / 2 FROM d) SELECT i, j, round(1 - product(1 - p), 9) AS p FROM r GROUP BY i, j",
    "local_spread": """WITH places AS (SELECT DISTINCT regexp_replace(cph, '[^0-9]', '', 'g') AS id, coordinates.lon AS lon, coordinates.lat AS lat FROM example_holding_data WHERE length(regexp_replace(cph, '[^0-9]', '', 'g')) = 9 AND coordinates.lon BETWEEN -9 AND 3 AND coordinates.lat BETWEEN 49 AND 61),
d AS (SELECT a.id AS i, b.id AS j, 2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS m FROM places a JOIN places b ON a.id <> b.id AND b.lat BETWEEN a.lat - 0.019 AND a.lat + 0.019)
SELECT i, j, CASE WHEN m < 100 THEN 0.1::DOUBLE WHEN m < 500 THEN 0.006::DOUBLE WHEN m < 1000 THEN 0.002::DOUBLE ELSE 0.000015::DOUBLE END AS p FROM d WHERE m < 2000""",
    "local_tiers": "SELECT * FROM (VALUES (0.0::DOUBLE, 100.0::DOUBLE, 0.1::DOUBLE), (100, 500, 0.006), (500, 1000, 0.002), (1000, 2000, 0.000015), (2000, NULL, 0)) t(lower, upper, probability)",
    "infected_at_start": f"WITH {_M} SELECT id, CASE WHEN {_u('id', 'infected')} < {int(0.1 * 2**32)} THEN 1 ELSE 0 END AS infected FROM holdings",
    "effect_experiment": f"{_VARIANTS} SELECT * FROM r",
    "effect_mean_sims": f"{_VARIANTS} SELECT treatment, amount, period, round(avg(mean_weight), 6) AS mean_weight FROM r GROUP BY ALL",
    "top_holdings": f"WITH {_M} SELECT to_id, sum(weight) AS weight FROM moves GROUP BY to_id ORDER BY weight DESC, to_id LIMIT 40",
    "largest_herd": f"WITH {_M} SELECT type, arg_max(id, (herd_size, id)) AS id, max(herd_size) AS herd_size FROM holdings GROUP BY type",
    "season_counts": f"WITH {_M} SELECT CAST(date_trunc('quarter', date + INTERVAL 1 MONTH) - INTERVAL 1 MONTH AS DATE) AS season, count(*) AS moves FROM moves GROUP BY 1",
    "weight_box": f"WITH {_M} SELECT CAST(date_trunc('month', date) AS DATE) AS period, min(weight) AS low, quantile_cont(weight, 0.25) AS q1, quantile_cont(weight, 0.5) AS median, quantile_cont(weight, 0.75) AS q3, max(weight) AS high, round(avg(weight), 6) AS mean FROM moves GROUP BY 1",
}

_SPARSE = "sparse AS (SELECT CAST(date_trunc('month', date) AS DATE) AS period, from_id, to_id, sum(weight) AS weight FROM real GROUP BY ALL)"
_FAST = f"""WITH RECURSIVE {_M}, roots AS (SELECT unnest(['H10', 'H55', 'H77', 'H121']) AS root),
h AS (SELECT DISTINCT from_id, to_id, CAST(date - DATE '1970-01-01' AS INTEGER) AS t FROM real WHERE date >= DATE '1998-01-15' AND date <= DATE '1998-03-31'),
hops AS (SELECT 'out' AS direction, from_id AS u, to_id AS v, t FROM h UNION ALL SELECT 'in', to_id, from_id, -t FROM h),
s AS (SELECT root, direction, root AS node, -1000000 AS at FROM roots CROSS JOIN (SELECT unnest(['in', 'out']) AS direction)
  UNION SELECT s.root, s.direction, h.v, h.t FROM s JOIN hops h ON s.direction = h.direction AND s.node = h.u AND h.t >= s.at AND h.v <> s.root)
SELECT DISTINCT s.root, s.direction, CASE WHEN s.direction = 'out' THEN h.u ELSE h.v END AS source, CASE WHEN s.direction = 'out' THEN h.v ELSE h.u END AS destination, DATE '1970-01-01' + abs(h.t) AS date
FROM s JOIN hops h ON s.direction = h.direction AND s.node = h.u AND h.t >= s.at AND h.v <> s.root"""
_STATES = "st AS (SELECT l_linenumber AS sim, CAST(ceil(l_orderkey / 40) AS BIGINT) AS step, sum(CAST(l_orderkey % 3 = 0 AS INTEGER) + CAST(l_orderkey % 5 = 0 AS INTEGER)) AS infected FROM lineitem GROUP BY ALL)"
_DATES = f"""WITH {_M}, span AS (SELECT min(date) AS lo, max(date) AS hi FROM dense), grid AS (SELECT 'true' AS treatment, '0' AS amount, 0 AS sim, 0 AS reach UNION ALL SELECT 'jittered', CAST(a AS VARCHAR), s, a FROM (SELECT unnest([7, 30]) AS a) CROSS JOIN (SELECT unnest([1, 2]) AS s) UNION ALL SELECT 'rounded', unnest(['week', 'quarter']), 0, 0),
g AS (SELECT d.*, grid.*, greatest(-reach, lo - date) AS low, least(reach, hi - date) AS high FROM dense d CROSS JOIN grid CROSS JOIN span),
v AS (SELECT treatment, amount, sim, from_id, to_id, CASE WHEN treatment = 'jittered' THEN date + CAST(low + floor(({_u("concat_ws('|', ref, amount, sim)", 'date')} / 4294967296.0) * (high - low + 1)) AS INTEGER)
  WHEN amount = 'week' THEN date - CAST(dayofweek(date) AS INTEGER) WHEN amount = 'quarter' THEN CAST(date_trunc('quarter', date) AS DATE) ELSE date END AS date FROM g),
m AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS period FROM v), days AS (SELECT DISTINCT treatment, amount, sim, period, date, from_id, to_id FROM m WHERE from_id <> to_id),
n AS (SELECT treatment, amount, sim, period, id, count(*) AS degree FROM (SELECT *, from_id AS id FROM days UNION ALL SELECT *, to_id FROM days) GROUP BY ALL),
e AS (SELECT treatment, amount, sim, period, from_id AS id FROM m UNION SELECT treatment, amount, sim, period, to_id FROM m)
SELECT treatment, amount, sim, period, round(avg(coalesce(degree, 0)), 6) AS mean_degree, max(coalesce(degree, 0)) AS most, count(*) AS nodes FROM e LEFT JOIN n USING (treatment, amount, sim, period, id) GROUP BY ALL"""
_TOP = "d AS (SELECT period, id, count(*) AS degree FROM (SELECT period, date, from_id AS id FROM days UNION ALL SELECT period, date, to_id FROM days) GROUP BY ALL), m AS (SELECT period, list(id) AS ids FROM (SELECT *, max(degree) OVER (PARTITION BY period) AS top FROM d) WHERE degree = top GROUP BY period)"

ORACLE |= {
    "date_experiment": _DATES,
    "isolated_share": f"""WITH {_M}, u AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS period, least(from_id, to_id) AS u, greatest(from_id, to_id) AS v FROM real), n AS (SELECT period, u AS id, v AS n FROM u UNION ALL SELECT period, v, u FROM u),
d AS (SELECT period, id, count(*) AS d FROM n GROUP BY ALL), t AS (SELECT n.period, n.id, max(d.d) AS most FROM n JOIN d ON n.period = d.period AND n.n = d.id GROUP BY ALL) SELECT period, round(count(*) FILTER (most = 1) / count(*), 6) AS isolated_share FROM t GROUP BY period""",
    "degree_medians": f"""WITH {_M}, {_SPARSE}, {_STRENGTH.format('sparse')}, w AS (SELECT period, 'all' AS way, in_degree + out_degree AS degree FROM st UNION ALL SELECT period, 'in', in_degree FROM st UNION ALL SELECT period, 'out', out_degree FROM st)
SELECT period, way, quantile_cont(CAST(degree AS DOUBLE), 0.5) AS median FROM w GROUP BY ALL""",
    "trace_fast": _FAST,
    "trace_counts": f"""{_TRACE}, e AS (SELECT *, CASE WHEN direction = 'out' THEN destination ELSE source END AS id FROM found), b AS (SELECT root, direction FROM roots CROSS JOIN (SELECT unnest(['in', 'out']) AS direction))
SELECT b.root, b.direction, count(DISTINCT (source, destination, date)) FILTER (source IS NOT NULL) AS movements, count(DISTINCT id) FILTER (id <> b.root) AS holdings, max(distance) AS farthest FROM b LEFT JOIN e ON b.root = e.root AND b.direction = e.direction GROUP BY ALL""",
    "static_network": f"WITH {_M}, {_ENDS.format('moves')} SELECT coalesce(e.id, h.id) AS id, type, e.id IS NOT NULL AS active FROM ends e FULL JOIN holdings h ON e.id = h.id",
    "temporal_network": f"WITH {_M} SELECT CAST(date - DATE '1970-01-01' AS INTEGER) AS onset, count(*) AS spells, count(DISTINCT (from_id, to_id)) AS edges FROM real GROUP BY 1",
    "renumbered": f"WITH {_M}, {_ENDS.format('moves')}, {_KEY.format('SELECT id FROM ends UNION SELECT id FROM holdings', '')} SELECT new_id AS id, type, e.id IS NOT NULL AS active FROM key LEFT JOIN holdings h ON old_id = h.id LEFT JOIN ends e ON old_id = e.id",
    "split_active": f"WITH {_M}, q AS (SELECT *, CAST(date_trunc('quarter', date) AS DATE) AS p FROM dense) SELECT p AS period, from_id AS id, TRUE AS active FROM q UNION SELECT p, to_id, TRUE FROM q",
    "split_all": f"WITH {_M}, q AS (SELECT *, CAST(date_trunc('quarter', date) AS DATE) AS p FROM dense), e AS (SELECT p, from_id AS id FROM q UNION SELECT p, to_id FROM q) SELECT x.p AS period, y.id, e.id IS NOT NULL AS active FROM (SELECT DISTINCT p FROM q) x CROSS JOIN (SELECT DISTINCT id FROM e) y LEFT JOIN e ON e.p = x.p AND e.id = y.id",
    "on_date": f"WITH {_M} SELECT ref, weight FROM moves WHERE date = DATE '1997-05-05'",
    "weight_between": f"WITH {_M} SELECT ref FROM moves WHERE weight BETWEEN 10 AND 20",
    "nth_holding": f"WITH {_M} SELECT to_id, sum(weight) AS weight FROM moves GROUP BY to_id ORDER BY weight DESC, to_id LIMIT 1 OFFSET 7",
    "numeric_order": "SELECT CAST(row_number() OVER () AS VARCHAR) AS new_id FROM (SELECT DISTINCT p_partkey FROM part)",
    "average_ranks": f"WITH {_M}, n AS (SELECT to_id, count(*) AS moves FROM moves GROUP BY to_id) SELECT to_id, moves, rank() OVER (ORDER BY moves DESC) + (count(*) OVER (PARTITION BY moves) - 1) / 2 AS rank FROM n",
    "width_labels": f"WITH {_M} SELECT ref, concat(CAST(pow(10, floor(log10(weight))) AS BIGINT), ' to ', CAST(pow(10, floor(log10(weight)) + 1) AS BIGINT) - 1) AS label FROM moves",
    "weight_histogram": f"WITH {_M} SELECT CAST(date_trunc('month', date) AS DATE) AS period, floor(weight / 5.0) * 5.0 AS bin, count(*) AS n FROM moves GROUP BY ALL",
    "heat_map": f"WITH {_M} SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, round(avg(weight), 6) AS weight FROM moves GROUP BY ALL",
    "wide_weights": f"WITH {_M} SELECT CAST(year(date) AS INTEGER) AS year, {', '.join(f'sum(weight) FILTER (quarter(date) = {q}) AS q{q}' for q in (1, 2, 3, 4))} FROM moves GROUP BY 1",
    "kept_treatments": f"WITH {_M} SELECT 'true' AS treatment, sum(weight) AS weight, count(*) AS n FROM dense UNION ALL SELECT 'rounded', sum(greatest(round_even(weight / 10.0, 0) * 10.0, 10.0)), count(*) FROM dense",
    "cumulative_infected": f"WITH {_STATES} SELECT sim, step, CAST(infected AS BIGINT) AS infected FROM st",
    "step_quantiles": f"WITH {_STATES}, p AS (SELECT step, infected * 100.0 / 40 AS x FROM st) SELECT step, min(x) AS low, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, max(x) AS high, round(avg(x), 6) AS mean FROM (SELECT step, CAST(x AS DOUBLE) AS x FROM p) GROUP BY step",
    "max_node_overlap": f"""WITH {_M}, s AS (SELECT min(date) AS a, max(date) AS b FROM dense), j AS (SELECT from_id, to_id, date + CAST(greatest(-15, a - date) + floor(({_u('ref', 'date')} / 4294967296.0) * (least(15, b - date) - greatest(-15, a - date) + 1)) AS INTEGER) AS date FROM dense CROSS JOIN s),
one AS (WITH days AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS period, date, from_id, to_id FROM j WHERE from_id <> to_id), {_TOP} SELECT * FROM m), two AS (WITH days AS (SELECT DISTINCT period, date, from_id, to_id FROM dense WHERE from_id <> to_id), {_TOP} SELECT * FROM m)
SELECT 'jittered' AS treatment, avg(CAST(list_has_any(one.ids, two.ids) AS INTEGER)) AS overlap_share FROM one JOIN two USING (period)""",
}
