"""Episodes: folds over steps, regret, value iteration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(steps: DataFrame, episode: str, order: str, reward: Column, done: Column) -> DataFrame:
    """Each episode's return up to and with its first terminating step, and the steps taken.

    The first terminating step is an aggregate, so no episode is sorted in one place.
    """
    ends = steps.groupBy(F.col(episode).alias("_e")).agg(F.min(F.when(done, F.col(order))).alias("_end"))
    live = steps.join(ends, F.col(episode) == F.col("_e")).filter(F.col("_end").isNull() | (F.col(order) <= F.col("_end")))
    return live.groupBy(episode).agg(F.sum(reward).alias("ret"), F.count(F.lit(1)).alias("steps"))


def sampled(steps: DataFrame, episode: str, order: str, done: Column, stride: int) -> DataFrame:
    """Every stride-th step before and at the end of an episode, steps counted from 0."""
    w = Window.partitionBy(episode).orderBy(order)
    return steps.withColumn("step", F.row_number().over(w) - 1).withColumn("_over", F.coalesce(F.max(done.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter((F.col("_over") == 0) & (F.col("step") % stride == 0)).drop("_over")


def best_bit(own: Column, flips: list[Column], epsilon: float = 0.0) -> tuple[Column, Column]:
    """(regret, bit): how much the best single flip gains, and the first bit that gives it; -1 if none does."""
    best = F.greatest(*flips) if len(flips) > 1 else flips[0]
    first = reduce(lambda rest, k: F.when(flips[k] == best, F.lit(k)).otherwise(rest), range(len(flips) - 1, -1, -1), F.lit(-1))
    return F.greatest(best - own, F.lit(0.0)), F.when(best > own + epsilon, first).otherwise(F.lit(-1)).cast("bigint")


def value_iteration(moves: DataFrame, depth: int, bottom: float = 0.0) -> DataFrame:
    """state, value: the best immediate reward that can be had `depth` steps on, never less than bottom.

    moves: state, next_state, reward, done.  A step that ends the episode is worth bottom.  Each round is one join and
    one aggregate on the state; depth is small and fixed, so the plan stays a plan.  States are equal if their keys
    are: round components first (state_key).
    """
    floor = F.lit(float(bottom))
    value = moves.groupBy("state").agg(F.greatest(floor, F.max("reward")).alias("value"))
    for _ in range(depth):
        ahead = moves.join(value.select(F.col("state").alias("next_state"), F.col("value").alias("ahead")), "next_state", "left")
        worth = F.when(F.col("done"), floor).otherwise(F.coalesce("ahead", floor))
        value = ahead.groupBy("state").agg(F.greatest(floor, F.max(worth)).alias("value"))
    return value


def state_key(components: list[Column], decimals: int = 3) -> Column:
    """A state's components rounded and joined."""
    return F.concat_ws(",", *(F.round(c, decimals).cast("string") for c in components))


def lookahead(starts: DataFrame, moves: DataFrame, policy: DataFrame, steps: int, cycle: list[int] | None = None, hold: int = 1) -> DataFrame:
    """starts (id, branch, state, action) with `total`: the rewards of the first action and of steps - 1 more.

    moves: state, action, next_state, reward, done.  After the first step the policy (state, action) goes on, or a cycle
    of actions, each held for some steps, whatever the state.  A step that ends the episode is the last to count.
    """
    live = starts.select("id", "branch", "state", "action", F.lit(0.0).alias("total"), F.lit(False).alias("over"))
    for t in range(max(1, steps)):
        if t:
            live = live.drop("action")
            live = live.withColumn("action", F.lit(cycle[(t - 1) // max(1, hold) % len(cycle)])) if cycle else live.join(policy, "state", "left")
        taken = live.join(moves, ["state", "action"], "left")
        goes = ~F.col("over") & F.col("reward").isNotNull()
        live = taken.select("id", "branch", F.when(goes, F.col("next_state")).otherwise(F.col("state")).alias("state"), "action", (F.col("total") + F.when(goes, F.col("reward")).otherwise(0.0)).alias("total"), (F.col("over") | F.coalesce(F.col("done"), F.lit(True))).alias("over"))
    return live.select("id", "branch", "total")


def branch_advantage(totals: DataFrame) -> DataFrame:
    """What branch 1 brings over branch 0: id, advantage."""
    of = lambda b: F.sum(F.when(F.col("branch") == b, F.col("total")))
    return totals.groupBy("id").agg((of(1) - of(0)).alias("advantage"))
