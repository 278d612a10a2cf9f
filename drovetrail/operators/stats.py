"""Statistics over variants of a network, and the experiment that makes the variants."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dateunits import floor_date
from ..functions.noise import STEPS, draw
from ..runtime import cut
from .ranks import quantiles


def variants(moves: DataFrame, key: str, jitters: list[float], rounds: list[float], sims: int, seed: int = 1) -> DataFrame:
    """All variants of the weights in one table: treatment (true, jittered, rounded), amount, sim and the changed weight.

    One projection over the movements; noise by key, amount and simulation.
    """
    grid = [("true", 0.0, 0), *(("jittered", float(a), s) for a in jitters for s in range(1, sims + 1)), *(("rounded", float(a), 0) for a in rounds)]
    kinds = F.array(*(F.struct(F.lit(t).alias("treatment"), F.lit(a).alias("amount"), F.lit(s).alias("sim")) for t, a, s in grid))
    each = moves.withColumn("v", F.explode(kinds)).select(*moves.columns, "v.*")
    w, a = F.col("weight"), F.col("amount")
    u = (draw(F.concat_ws("|", key, "amount", "sim"), seed, "weight") + 1) / F.lit(float(STEPS))
    low = F.greatest(-a, -w)
    rounded = F.greatest(F.bround(F.try_divide(w, a)) * a, a)
    return each.withColumn("weight", F.when(F.col("treatment") == "jittered", w + low + u * (a - low)).when(F.col("treatment") == "rounded", rounded).otherwise(w))


def date_variants(moves: DataFrame, key: str, jitters: list[int], units: list[str], sims: int, seed: int = 1) -> DataFrame:
    """All variants of the dates in one table: treatment (true, jittered, rounded), amount (days or unit, as text), sim and the changed date.

    Jittered dates stay within the dates' range, uniformly among the whole numbers of days that allow it; rounded ones are the first
    of their unit. One projection over the movements; noise by key, amount and simulation.
    """
    if any(not isinstance(j, int) or isinstance(j, bool) or j < 1 for j in jitters):
        raise ValueError("ranges of days must be whole numbers above 0")
    grid = [("true", "0", 0, 0), *(("jittered", str(j), s, j) for j in jitters for s in range(1, sims + 1)), *(("rounded", u, 0, 0) for u in units)]
    kinds = F.array(*(F.struct(F.lit(t).alias("treatment"), F.lit(a).alias("amount"), F.lit(s).alias("sim"), F.lit(r).alias("__reach")) for t, a, s, r in grid))
    span = moves.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    each = moves.filter("date is not null").withColumn("v", F.explode(kinds)).select(*moves.columns, "v.*")
    reach, date = F.col("__reach"), F.col("date")
    low, high = F.greatest(-reach, F.date_diff(F.lit(span["lo"]).cast("date"), date)), F.least(reach, F.date_diff(F.lit(span["hi"]).cast("date"), date))
    u = draw(F.concat_ws("|", key, "amount", "sim"), seed, "date") / F.lit(float(STEPS))
    moved = F.date_add(date, (low + F.floor(u * (high - low + 1))).cast("int"))
    floors = date
    for unit in units:
        floors = F.when((F.col("treatment") == "rounded") & (F.col("amount") == unit), floor_date(date, unit)).otherwise(floors)
    return each.withColumn("date", F.when(F.col("treatment") == "jittered", moved).otherwise(floors)).drop("__reach")


def mean_over_sims(values: DataFrame, value: str, *by: str) -> DataFrame:
    return values.groupBy(*by).agg(F.avg(value).alias(value))


#: Most values of one group that a test takes: a group is held by one task.
LARGEST = 20_000_000


def _exchanges(y: np.ndarray) -> int:
    """Pairs in descending order, by merging runs of double length each time; all runs at once."""
    n = len(y)
    rank, at, swaps, w = np.unique(y, return_inverse=True)[1].astype(np.int64), np.arange(n), 0, 1
    while w < n:
        run, left = at // (2 * w), (at // w) % 2 == 0
        key = run * (n + 1) + rank
        ordered = np.sort(key[left])
        right = key[~left]
        ends = np.searchsorted(ordered, (run[~left] + 1) * (n + 1))
        swaps += int((ends - np.searchsorted(ordered, right, "right")).sum())
        w *= 2
    return swaps


def tau_b(x, y) -> float | None:
    """Kendall's tau-b in n log n: discordant pairs are the exchanges of a merge sort; None if either is constant."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    ties = lambda k: sum(int(c) * (int(c) - 1) // 2 for c in k)
    counts = lambda v: np.unique(v, axis=0, return_counts=True)[1]
    pairs, tx, ty, txy = n * (n - 1) // 2, ties(counts(x)), ties(counts(y)), ties(counts(np.stack((x, y), 1)))
    if pairs in (tx, ty):
        return None
    discordant = _exchanges(y[np.lexsort((y, x))])
    return (pairs - tx - ty + txy - 2 * discordant) / math.sqrt((pairs - tx) * (pairs - ty))


def bounded(df: DataFrame, by: list[str], most: int, what: str) -> DataFrame:
    """The same rows; ValueError if a group has more of them than one task is meant to hold. Counts are taken before the shuffle."""
    n = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if n > most:
        raise ValueError(f"{what}: the largest group has {n} rows, more than the {most} that one task takes; split it or raise the bound")
    return df


def kendall(pairs: DataFrame, by: list[str], x: str, y: str, most: int = LARGEST) -> DataFrame:
    """tau of two values of the same nodes, per group; a group is one network's nodes, at most ``most`` (ValueError)."""
    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, tau_b(g[x], g[y])]], columns=[*by, "tau"])

    rows = cut(pairs.select(*by, x, y).dropna(subset=[x, y]))
    return bounded(rows, by, most, "kendall").groupBy(*by).applyInPandas(run, f"{kinds}, tau double")


def signed_rank(differences: list[float], alternative: str = "two-sided") -> tuple[float, float | None]:
    """Wilcoxon's V and p: exact below 50 differences without ties or zeros, else normal with continuity correction."""
    zeros = any(d == 0 for d in differences)
    d = [x for x in differences if x != 0]
    n = len(d)
    if not n:
        return 0.0, None
    ranks = pd.Series([abs(x) for x in d]).rank()
    v = float(sum(r for r, x in zip(ranks, d, strict=True) if x > 0))
    tied = len({abs(x) for x in d}) < n
    if n < 50 and not tied and not zeros:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        lower = sum(ways[: int(v) + 1]) / 2**n
        upper = sum(ways[int(v) :]) / 2**n
    else:
        z = v - n * (n + 1) / 4
        sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - sum(k**3 - k for k in ranks.value_counts()) / 48)
        if sd == 0:
            return v, None
        phi = lambda t: 0.5 * math.erfc(-t / math.sqrt(2))
        shift = {"two-sided": math.copysign(0.5, z) if z else 0.0, "greater": 0.5, "less": -0.5}[alternative]
        lower, upper = phi((z - shift) / sd), 1 - phi((z - shift) / sd)
    return v, {"two-sided": min(1.0, 2 * min(lower, upper)), "greater": upper, "less": lower}[alternative]


def wilcoxon(pairs: DataFrame, by: list[str], x: str, y: str, alternative: str = "two-sided", most: int = LARGEST) -> DataFrame:
    """v, p of the paired test of x against y, per group of at most ``most`` pairs (ValueError)."""
    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, *signed_rank(list(g[x] - g[y]), alternative)]], columns=[*by, "v", "p"])

    rows = cut(pairs.select(*by, x, y).dropna(subset=[x, y]))
    return bounded(rows, by, most, "wilcoxon").groupBy(*by).applyInPandas(run, f"{kinds}, v double, p double")


def stars(p: Column) -> Column:
    """Marks of significance."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, ".").otherwise("")


def box_stats(values: DataFrame, value: str, *by: str) -> DataFrame:
    """The numbers behind a box plot."""
    counts = cut(values.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")))
    ends = counts.groupBy(*by).agg(F.min("v").alias("low"), F.max("v").alias("high"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    return ends.join(quantiles(counts, list(by), "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, "n"), list(by)).select(*by, "low", "q1", "median", "q3", "high", "mean")


def histogram(values: DataFrame, value: str, width: float, *by: str) -> DataFrame:
    """bin (its lower end) and n: the numbers behind violins and bars; bins are multiples of a width."""
    if not width > 0:
        raise ValueError("the width of bins must be above 0")
    return values.filter(F.col(value).isNotNull()).groupBy(*by, (F.floor(F.col(value) / F.lit(float(width))) * F.lit(float(width))).alias("bin")).agg(F.count("*").alias("n"))


def heat_map(values: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """row, column and the mean of a value: the cells of a heat map, in long form."""
    return values.groupBy(row, column).agg(F.avg(value).alias(value))


def wide(values: DataFrame, by: list[str], names: str, value: str, columns: list[str]) -> DataFrame:
    """Long to wide: a column for each of the given names, null where a group lacks it (the first of several values by order)."""
    return values.groupBy(*by).pivot(names, columns).agg(F.min(value))


def long(values: DataFrame, by: list[str], columns: list[str], names: str = "name", value: str = "value") -> DataFrame:
    """Wide to long: a row for each of the given columns; nulls stay."""
    return values.unpivot(list(by), columns, names, value)


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    """Doubles to so many digits (halves to even), other columns as they are."""
    return df.select(*(F.bround(F.col(f"`{c}`"), digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def kept_treatments(values: DataFrame, treatments: list[str]) -> DataFrame:
    """The rows of some treatments of an experiment."""
    return values.filter(F.col("treatment").isin(treatments))


def magnitudes(x: float) -> list[int]:
    """5, 10, 50, 100 and so on up to the order of magnitude of x; empty below 10."""
    top = math.floor(math.log10(x)) if x >= 10 else 0
    return [v for e in range(1, top + 1) for v in (10**e // 2, 10**e)]


def overlap_share(variants: DataFrame, true: DataFrame, ids: str, period: str, *by: str) -> DataFrame:
    """Per variant: the share of periods in which its set of ids meets that of the true data (both as arrays)."""
    met = variants.select(*by, period, F.col(ids).alias("a")).join(true.select(period, F.col(ids).alias("b")), period)
    return met.groupBy(*by).agg(F.avg(F.arrays_overlap("a", "b").cast("int")).alias("overlap_share"))


def cumulative_infected(states: DataFrame, n_nodes: int, *by: str) -> DataFrame:
    """step and infected: rows numbered from 1 (``row``) hold a node's I and R; every n_nodes rows are a step."""
    step = F.ceil(F.col("row") / F.lit(n_nodes))
    return states.groupBy(*by, step.alias("step")).agg(F.sum(F.col("I") + F.col("R")).alias("infected"))


def step_quantiles(infected: DataFrame, n_nodes: int) -> DataFrame:
    """Over simulations, per step: min, quartiles, mean and max as percent of nodes."""
    return box_stats(infected.withColumn("percent", F.col("infected") * 100.0 / n_nodes), "percent", "step")
