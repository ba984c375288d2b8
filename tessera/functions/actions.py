"""Bits to actions, action grids, environment rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decode(bits: list[Column], low: float, high: float) -> Column:
    """low + (high - low) x code / (2^n - 1), the first bit lowest.  Unrolled: no higher-order function."""
    code = reduce(lambda a, b: a + b, (b.cast("double") * float(1 << k) for k, b in enumerate(bits)))
    return F.lit(float(low)) + F.lit(float(high - low)) * code / F.lit(float((1 << len(bits)) - 1))


def grids(rows: DataFrame, levels: str, dims: str, most: int, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """For each row all actions of its number of even levels in its number of dimensions: the row, id, a0, a1, ... up to
    `most` dimensions, null beyond its own; the first dimension moves fastest."""
    n, d = F.col(levels).cast("bigint"), F.col(dims)
    each = rows.withColumn("id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.pow(n, d).cast("bigint") - 1)))
    step = F.when(n > 1, (high - low) / (n - 1)).otherwise(0.0)
    digit = lambda k: (F.floor(F.col("id") / F.pow(n, F.lit(k))).cast("bigint") % n).cast("double")
    return each.select("*", *(F.when(d > k, F.lit(float(low)) + digit(k) * step).alias(f"a{k}") for k in range(most)))


def codes(rows: DataFrame, bits: str) -> DataFrame:
    """For each row all settings of its number of bits: the row, code, bits_set (array, the lowest first)."""
    n = F.col(bits).cast("int")
    each = rows.withColumn("code", F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - 1)))
    return each.withColumn("bits_set", F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.call_function("shiftright", F.col("code"), k).bitwiseAND(F.lit(1)).cast("int")))


def _rest(array: Column, skip: int) -> Column:
    return F.slice(array, F.lit(skip + 1), F.greatest(F.size(array) - skip, F.lit(0)))


def _clipped(array: Column) -> Column:
    return F.transform(array, lambda x: F.greatest(F.lit(-10.0), F.least(F.lit(10.0), x)))


def _tip(state: dict) -> Column:
    """Height of the pole's tip, the second of its coordinates."""
    return F.get(state["tip"], F.lit(1))


#: What an agent sees, by name; a state has columns q and v (arrays) and, where a rule needs them, tip and force.
OBSERVATIONS = {
    "full": lambda s: F.concat(s["q"], s["v"]),
    "exclude_x": lambda s: F.concat(_rest(s["q"], 1), s["v"]),
    "exclude_xy": lambda s: F.concat(_rest(s["q"], 2), s["v"]),
    "idp": lambda s: F.concat(F.slice(s["q"], 1, 1), F.transform(_rest(s["q"], 1), F.sin), F.transform(_rest(s["q"], 1), F.cos), _clipped(s["v"]), _clipped(F.slice(s["force"], 1, 1))),
}


#: A reward is a sum of weighted terms: (weight, term, what the term takes).  Terms by name, of the states before and
#: after a step and the controls.
TERMS = {
    "speed": lambda s, t, u, at, dt: (F.get(t["q"], F.lit(at)) - F.get(s["q"], F.lit(at))) / F.lit(dt),
    "effort": lambda s, t, u: F.aggregate(u, F.lit(0.0), lambda a, x: a + x * x),
    "within": lambda s, t, u, at, lo, hi: F.get(t["q"], F.lit(at)).between(lo, hi).cast("double"),
    "upright": lambda s, t, u, above: F.when(_tip(t) <= above, 0.0).otherwise(1.0),
    "lean": lambda s, t, u, scale, goal: scale * F.get(t["tip"], F.lit(0)) * F.get(t["tip"], F.lit(0)) + (_tip(t) - goal) * (_tip(t) - goal),
    "spin": lambda s, t, u, weights: reduce(lambda a, b: a + b, (w * F.get(t["v"], F.lit(k)) * F.get(t["v"], F.lit(k)) for k, w in weights.items())),
}


def _moving(spec: dict) -> list[tuple]:
    """Way made, less the cost of control, and a bonus while the height is in its range."""
    given = lambda key: spec.get(key, REWARD_DEFAULTS[key])
    terms = [(given("forward_weight"), "speed", (int(given("x_index")), float(given("dt")))), (-given("ctrl_weight"), "effort", ())]
    if given("healthy_reward") and spec.get("z_idx") is not None:
        terms.append((given("healthy_reward"), "within", (int(spec["z_idx"]), float(spec["z_lo"]), float(spec["z_hi"]))))
    return terms


# The descriptor's keys of a moving body's reward, with their defaults.
REWARD_DEFAULTS = {"x_index": 0, "forward_weight": 1.0, "dt": 0.05, "ctrl_weight": 0.5, "healthy_reward": 0.0}
# A balanced pole's bonus, the height it needs and aims at, and the weights of lean and of its hinges' speeds.
BALANCED = [(10.0, "upright", (1.0,)), (-1.0, "lean", (0.01, 2.0)), (-1.0, "spin", ({1: 1e-3, 2: 5e-3},))]
# The names of rules, and those that a descriptor has if it says nothing.
REWARDS = {"locomotion": _moving, "idp": lambda spec: BALANCED}
USUAL = {"obs": "exclude_x", "reward": "locomotion", "terminated": "never"}


def _at(state: dict, spec: dict, key: str) -> Column:
    return F.get(state["q"], F.lit(int(spec[key])))


#: When an episode ends, by name: never; height out of a closed range; height or angle out of open ranges; tip at most 1.
ENDS = {
    "never": lambda spec, s: F.lit(False),
    "z_healthy": lambda spec, s: ~_at(s, spec, "z_idx").between(float(spec["z_lo"]), float(spec["z_hi"])),
    "z_angle": lambda spec, s: ~((_at(s, spec, "z_idx") > float(spec["z_lo"])) & (_at(s, spec, "z_idx") < float(spec["z_hi"])) & (_at(s, spec, "ang_idx") > float(spec["ang_lo"])) & (_at(s, spec, "ang_idx") < float(spec["ang_hi"]))),
    "idp_tip": lambda spec, s: _tip(s) <= 1.0,
}


class Environment:
    """A data-only descriptor compiled to columns.  Unknown rules are errors; what is left out has its default."""

    def __init__(self, spec: dict):
        rules = {part: {"type": usual, **(spec.get(part) or {})} for part, usual in USUAL.items()}
        for part, known in (("obs", OBSERVATIONS), ("reward", REWARDS), ("terminated", ENDS)):
            if rules[part]["type"] not in known:
                raise ValueError(f"unknown {part} type: {rules[part]['type']}")
        self.observation = OBSERVATIONS[rules["obs"]["type"]]
        self.terms = REWARDS[rules["reward"]["type"]](rules["reward"])
        self.ended = lambda state: ENDS[rules["terminated"]["type"]](rules["terminated"], state)

    def reward(self, before: dict, after: dict, ctrl: Column) -> Column:
        parts = (F.lit(float(weight)) * TERMS[name](before, after, ctrl, *takes) for weight, name, takes in self.terms)
        return reduce(lambda a, b: a + b, parts)
