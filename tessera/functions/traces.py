"""Reward traces, tails and planning horizons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trace_le(a: Column, b: Column) -> Column:
    """Lexicographic at most; a prefix is at most what it begins."""
    return a <= b


def mass(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def trace_advantage(a: Column, b: Column) -> Column:
    """1, 0 or -1 as b is lexicographically below, equal to or above a; with NaN the difference of masses."""
    odd = F.exists(a, F.isnan) | F.exists(b, F.isnan)
    return F.when(odd, mass(a) - mass(b)).when(a == b, 0.0).when(b < a, 1.0).otherwise(-1.0)


def lex_score(trace: Column, most: Column) -> Column:
    """The trace as digits to base 2 max(most, 1) + 1, the first step highest."""
    base = 2 * F.greatest(most, F.lit(1.0)) + 1
    return F.aggregate(trace, F.lit(0.0), lambda s, x: s * base + x)


def feasible_horizon(n: Column, h: Column, budget: Column) -> Column:
    """The largest k up to h with n^1 + ... + n^k within budget; at least 1."""
    n, budget = n.cast("double"), budget.cast("double")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("power"), F.lit(0).alias("k"))

    def step(s, i):
        power = s["power"] * n
        total = s["sum"] + power
        return F.struct(total.alias("sum"), power.alias("power"), F.when(total <= budget, i).otherwise(s["k"]).alias("k"))

    return F.greatest(F.lit(1), F.aggregate(F.sequence(F.lit(1), F.greatest(h, F.lit(1))), start, step)["k"])


def tail_stats(values: Column) -> Column:
    """Of an array: cvar10, worst, p10, mean, n over the k = max(1, n div 10) smallest; null if empty."""
    s = F.sort_array(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x)))
    n = F.size(s)
    k = F.greatest(F.lit(1), (n / 10).cast("int"))
    low = F.aggregate(F.slice(s, F.lit(1), k), F.lit(0.0), lambda a, x: a + x) / k
    return F.when(n > 0, F.struct(low.alias("cvar10"), F.get(s, F.lit(0)).alias("worst"), F.get(s, k - 1).alias("p10"), (mass(s) / n).alias("mean"), n.alias("n")))
