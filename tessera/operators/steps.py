"""Search steps of many lineages at once: all open bits' candidates in one job a wave, then gate, guard and advance.

A lineage's policy is a list of bits, each a predicate of a pool, by number; its payoff at an observation is a function of
the bits' code.  What the pool says of each observation is evaluated and written once, as the bits of one integer.  A wave
then is one aggregation over these: the payoff of the policy with one bit replaced by one candidate, for every bit and
candidate, by lineage.  All else is columns of a row per lineage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import predicate
from ..storage import written
from .lineage import EPSILON

#: Predicates that a pool may have: the bits of a long, without its sign.
MOST = 62


def observed(observations: DataFrame, lineage: str, pool: list, keep: dict[str, Column], vector: str = "embedding") -> DataFrame:
    """lineage, truths (which of the pool's predicates hold, the first one lowest) and the columns to keep."""
    if len(pool) > MOST:
        raise ValueError(f"a pool has {MOST} predicates at most")
    bit = lambda k, t: F.when(predicate(t, vector), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    truths = reduce(lambda a, b: a + b, (bit(k, t) for k, t in enumerate(pool)))
    return written(observations.select(F.col(lineage).alias("lineage"), truths.alias("truths"), *(c.alias(n) for n, c in keep.items())), "observed")


def _holds(number: Column) -> Column:
    return F.expr("truths").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), number)) != 0


def _coded(rows: DataFrame, state: DataFrame, bits: int) -> DataFrame:
    """Observations with the code of their lineage's policy."""
    joined = rows.join(state.select("lineage", "terms"), "lineage")
    code = reduce(lambda a, b: a + b, (F.when(_holds(F.get("terms", F.lit(b))), 1 << b).otherwise(0) for b in range(bits)))
    return joined.withColumn("code", code)


def scores(rows: DataFrame, state: DataFrame, candidates: int, bits: int, payoff: Callable[[Column], Column]) -> DataFrame:
    """lineage, now (what its policy has), s (by bit and candidate: what it would have)."""
    coded = _coded(rows, state, bits)
    without = lambda b: F.col("code").bitwiseAND(F.lit((1 << bits) - 1 - (1 << b)))
    sides = {f"{side}{b}": payoff(without(b) + (side == "y") * (1 << b)) for b in range(bits) for side in "ny"}
    told = coded.select("lineage", "truths", payoff(F.col("code")).alias("now"), *(c.alias(n) for n, c in sides.items()))
    each = lambda b: ", ".join(f"sum(CASE WHEN truths & {1 << c}L <> 0 THEN y{b} ELSE n{b} END)" for c in range(candidates))
    return told.groupBy("lineage").agg(F.sum("now").alias("now"), F.expr(f"array({', '.join(f'array({each(b)})' for b in range(bits))})").alias("s"))


def wave(rows: DataFrame, state: DataFrame, candidates: int, bits: int, payoff: Callable[[Column], Column], epsilon: float = EPSILON, places: int = 9) -> DataFrame:
    """The state after a parallel wave.

    Each open bit proposes its best candidate (ties go to the first).  All were scored at the same version, so the first
    that passes the gate is committed, the others that improve are stale and stay open, and a wave without any saturates.
    A lineage without a best has none to pass but its baseline, which is its first wave's policy, and stays.
    """
    found = state.join(scores(rows, state, candidates, bits, payoff), "lineage")
    found = found.withColumns({"baseline": F.coalesce("baseline", F.round("now", places)), "best": F.coalesce("best", F.round("now", places))})
    found = found.withColumn("top", F.expr(f"transform(s, r -> array_max(transform(r, (v, c) -> struct(round(v, {places}) AS r, -c AS c))))"))
    is_open = F.transform("settled", lambda x: ~x)
    better = F.zip_with(is_open, "top", lambda o, t: o & (t["r"] > F.col("best") + epsilon))
    found = found.withColumns({"better": better, "n_open": F.size(F.filter(is_open, lambda o: o))})
    found = found.withColumns({"n_better": F.size(F.filter("better", lambda x: x)), "at": F.array_position("better", True).cast("int") - 1})
    live, took = ~F.col("saturated"), ~F.col("saturated") & (F.col("n_better") > 0)
    put = lambda c, v: F.when(took, F.transform(c, lambda x, i: F.when(i == F.col("at"), v).otherwise(x))).otherwise(F.col(c))
    return found.select(
        "lineage",
        put("terms", -F.get("top", F.col("at"))["c"]).alias("terms"),
        put("settled", F.lit(True)).alias("settled"),
        (F.col("version") + took.cast("int")).alias("version"),
        F.when(took, F.get("top", F.col("at"))["r"]).otherwise(F.col("best")).alias("best"),
        "baseline",
        (F.col("commits") + took.cast("int")).alias("commits"),
        (F.col("stale") + F.when(took, F.col("n_better") - 1).otherwise(0)).alias("stale"),
        (F.col("idle") + F.when(live, F.col("n_open") - F.col("n_better")).otherwise(0)).alias("idle"),
        (F.col("saturated") | (F.col("n_better") == 0)).alias("saturated"),
    )


def validated(rows: DataFrame, state: DataFrame, bits: int, payoff: Callable[[Column], Column], name: str, places: int = 9) -> DataFrame:
    """lineage and its policy's mean payoff."""
    return _coded(rows, state, bits).groupBy("lineage").agg(F.round(F.avg(payoff(F.col("code"))), places).alias(name))


def search(train: DataFrame, held: DataFrame, candidates: int, bits: int, payoff: Callable[[Column], Column], rounds: int, waves: int, epsilon: float = EPSILON) -> DataFrame:
    """All lineages of `train` through all rounds: a row per lineage and round with what it did.

    A round validates on `held`, has up to `waves` waves until every lineage is saturated, validates again, and puts a
    lineage's policy back, as a new version, if its commits made validation worse.  Then the lineage goes on to the next
    round or is completed.  Policies begin with the pool's first predicate at each bit.
    """
    zero = F.lit(0)
    state = train.select("lineage").distinct().select("lineage", F.array_repeat(F.lit(0), bits).alias("terms"), zero.alias("version"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("double").alias("baseline"))
    log = None
    for n in range(1, rounds + 1):
        start = written(state, "policies")
        now = start.select("*", F.array_repeat(F.lit(False), bits).alias("settled"), zero.alias("commits"), zero.alias("stale"), zero.alias("idle"), F.lit(False).alias("saturated"))
        for _ in range(waves):
            now = written(wave(train, now, candidates, bits, payoff, epsilon), "wave")
            if now.filter("NOT saturated").isEmpty():
                break
        old = start.join(validated(held, start, bits, payoff, "before"), "lineage", "left").select("lineage", "before", F.col("terms").alias("old_terms"), F.col("best").alias("old_best"))
        both = now.join(old, "lineage").join(validated(held, now, bits, payoff, "after"), "lineage", "left")
        both = both.withColumn("reverted", F.coalesce((F.col("commits") > 0) & (F.col("after") < F.col("before") - epsilon), F.lit(False)))
        back = lambda a, b: F.when(F.col("reverted"), a).otherwise(F.col(b))
        both = both.withColumns({"terms": back(F.col("old_terms"), "terms"), "best": back(F.coalesce("old_best", "baseline"), "best"), "version": back(F.col("version") + 1, "version")})
        last = F.lit(n == rounds)
        told = written(both.select("lineage", F.lit(n).alias("round"), "before", "after", "commits", "stale", "idle", "saturated", "reverted", "version", "best", "baseline", "terms", F.when(last, "completed").otherwise("running").alias("status"), F.when(last, n).otherwise(n + 1).alias("next_round")), "steps")
        log = told if log is None else log.unionByName(told)
        state = told.select("lineage", "terms", "version", "best", "baseline")
    return log
