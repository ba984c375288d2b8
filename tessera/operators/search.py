"""The search loop: propose predicates for bits, score them in one job, commit through the gate.

The driver holds the policy (a few dozen terms) and one row per scored candidate of a bit; observations stay
distributed.  A parallel pass scores all open bits against the version it began with, so that commits after the
first are stale and their bits stay open; a sequential pass looks at one bit after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import combinations
from random import Random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import identity, largest_index
from ..storage import written
from .aggregates import score_bit
from .lineage import EPSILON


@dataclass
class Policy:
    """A lineage's state: the terms, the version, the best reward and the audit of what changed."""

    terms: list
    version: int = 0
    best: float | None = None
    audit: list[dict] = field(default_factory=list)

    def offer(self, bit: int, term, reward: float, seen: int, baseline: float | None = None) -> str:
        """The commit gate: stale, no_improvement or committed."""
        if seen != self.version:
            return "stale"
        known = self.best if baseline is None else baseline
        if known is not None and not reward > known + EPSILON:
            return "no_improvement"
        self.audit.append({"version": self.version + 1, "bit_idx": bit, "prev_reward": self.best, "new_reward": reward, "before": list(self.terms)})
        self.terms[bit] = term
        self.version += 1
        self.best = reward if self.best is None else max(self.best, reward)
        return "committed"

    def guard(self, before: float, after: float, terms: list, commits: int) -> bool:
        """Put the old terms back, as a new version, if a pass that committed made validation worse."""
        if commits == 0 or not after < before - EPSILON:
            return False
        self.audit.append({"version": self.version + 1, "bit_idx": -1, "prev_reward": after, "new_reward": before, "before": list(self.terms)})
        self.terms, self.version = list(terms), self.version + 1
        return True


def atoms(dims: int, kinds: Iterable[str] = ("axis", "diag"), thresholds: Iterable[float] = (0.0,)) -> list:
    """Depth 0: all features of the kinds over so many coordinates."""
    out = []
    for kind in kinds:
        if kind in ("axis", "sin_axis", "cos_axis"):
            out += [["feat", [kind, i, t]] for i in range(dims) for t in thresholds]
        elif kind in ("diag", "sq_diag"):
            out += [["feat", [kind, i, j, c]] for i in range(dims) for j in range(dims) if i != j for c in (-1.0, 1.0)]
        elif kind == "prod":
            out += [["feat", [kind, i, j, t]] for i, j in combinations(range(dims), 2) for t in thresholds]
        else:
            raise ValueError(f"no enumeration of {kind}")
    return out


def combined(best: list) -> list:
    """Depth 1: and, or, and negations of the best terms."""
    return [["not", p] for p in best] + [[op, p, q] for p, q in combinations(best, 2) for op in ("and", "or")]


def candidates(terms: list, dims: int) -> tuple[list, list[dict]]:
    """Different terms that can be evaluated, and error rows for those that read beyond the observation."""
    good, errors, seen = [], [], set()
    for k, t in enumerate(terms):
        if largest_index(t) >= dims:
            errors.append({"idx": k, "error": f"coordinate {largest_index(t)} of {dims}"})
        elif identity(t) not in seen:
            seen.add(identity(t))
            good.append(t)
    return good, errors


def optimize_bit(observations: DataFrame, current, features: list, episode: str, value: Column, depth: int = 0, top_k: int = 3, batch: int = 500):
    """("improved", term, reward, baseline) or ("no_improvement",).  Candidates go in batches of so many columns."""

    def scores(terms):
        rows = []
        for a in range(0, len(terms), batch):
            got = score_bit(observations, terms[a : a + batch], current, episode, value).collect()  # a row per candidate
            rows += [(r["reward"], terms[a + r["idx"]], r["baseline"]) for r in got]
        return sorted(rows, key=lambda r: (-r[0], identity(r[1])))

    found = scores(features)
    if depth and found:
        found = sorted(found + scores(combined([t for _, t, _ in found[:top_k]])), key=lambda r: (-r[0], identity(r[1])))
    if not found or not found[0][0] > found[0][2] + EPSILON:
        return ("no_improvement",)
    return "improved", found[0][1], found[0][0], found[0][2]


def elites(states: DataFrame, descriptors: dict[str, tuple[str, float]], score: str, state_id: str) -> DataFrame:
    """Of each cell of the descriptors (column, cells per unit) the state that does worst: counterexamples that differ."""
    cells = [F.floor(F.col(c) * F.lit(n)).cast("bigint").alias(name) for name, (c, n) in descriptors.items()]
    return states.select(*cells, score, state_id).groupBy(*descriptors).agg(F.min_by(state_id, F.struct(score, state_id)).alias(state_id))


def spread(key: Column, *parts: Column) -> Column:
    """A number in [0, 1) that looks random, from texts: the same on every engine with MD5."""
    text = F.concat_ws(":", *(p.cast("string") for p in (key, *parts)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def archive(states: DataFrame, cells: int, score: Callable[[Column], Column], generations: int, seed: int = 0, step: float = 0.25, places: int = 9) -> DataFrame:
    """A quality-diversity archive after some generations: c0, c1, generation, id, score, x.

    states: id (text), x (array of numbers).  A cell, of which the first two numbers have `cells` a unit, holds the state
    of the lowest score (ties go to the least id).  Each generation every elite has one child, its numbers moved by up to
    half a step by a seeded hash of its id, and the archive takes the child if its cell is empty or held by a worse state,
    so that a cell's score never rises.  The archive is as large as it has cells, however many states there are.
    """
    cell = lambda k: F.floor(F.get("x", F.lit(k)) * cells).cast("bigint")

    def best(rows):
        held = F.min_by(F.struct("generation", "x"), F.struct("score", "id"))
        top = rows.withColumns({"c0": cell(0), "c1": cell(1)}).groupBy("c0", "c1").agg(F.min(F.struct("score", "id")).alias("m"), held.alias("h"))
        return written(top.select("c0", "c1", "h.generation", "m.id", "m.score", "h.x"), "archive")

    scored = lambda rows: rows.withColumn("score", F.round(score(F.col("x")), places) + 0.0)
    found = best(scored(states.select("id", "x", F.lit(0).alias("generation"))))
    for n in range(1, generations + 1):
        moved = F.transform("x", lambda v, i: F.round(v + F.lit(step) * (spread(F.lit(seed), F.lit(n), F.col("id"), i) - 0.5), places) + 0.0)
        children = found.select("id", moved.alias("x"), F.lit(n).alias("generation")).withColumn("id", F.concat("id", F.lit(f".{n}")))
        found = best(found.select("id", "x", "generation", "score").unionByName(scored(children)))
    return found


def crossed(a, b, rng: Random):
    """A child of two terms: one of them, both under a connective, or one with a part of the other in its place."""
    kind = rng.randrange(4)
    if kind < 2:
        return [("and", "or")[kind], a, b]
    if isinstance(a, list) and a[0] in ("and", "or", "not") and kind == 2:
        return [*a[:-1], b]
    return a


def mutated(term, features: list, rng: Random):
    """The term negated, or not any more, or with one of its parts replaced by a feature."""
    if not isinstance(term, list) or term[0] == "feat" or rng.random() < 0.3:
        return rng.choice(features) if rng.random() < 0.5 else ["not", term]
    if term[0] == "not":
        return term[1]
    k = rng.randrange(1, len(term))
    return [*term[:k], mutated(term[k], features, rng), *term[k + 1 :]]


def evolve_bit(score: Callable[[list], list[tuple[float, object, float]]], features: list, seed: int = 0, generations: int = 6, size: int = 24, depth: int = 4):
    """optimize_bit() by a genetic search: ("improved", term, reward, baseline) or ("no_improvement",).

    score(terms) is one job a generation and returns (reward, term, baseline) rows.  The better half of each generation
    lives on and has as many children; terms deeper than `depth` are not tried, and the same seed gives the same search.
    """
    rng = Random(seed)
    height = lambda t: 1 + max((height(x) for x in t[1:]), default=0) if isinstance(t, list) and t[0] in ("and", "or", "not") else 0
    known: dict[str, tuple[float, object, float]] = {}

    def ranked(terms):
        new = {identity(t): t for t in terms if height(t) <= depth and identity(t) not in known}
        if new:
            known.update((identity(r[1]), r) for r in score(list(new.values())))
        return sorted((known[identity(t)] for t in {identity(t): t for t in terms if height(t) <= depth}.values()), key=lambda r: (-r[0], identity(r[1])))

    alive = ranked(rng.sample(features, min(size, len(features))))
    for _ in range(generations):
        best = [t for _, t, _ in alive[: max(2, size // 2)]]
        if not best:
            break
        children = [mutated(crossed(rng.choice(best), rng.choice(best), rng), features, rng) for _ in range(size - len(best))]
        alive = ranked(best + children)
    if not alive or not alive[0][0] > alive[0][2] + EPSILON:
        return ("no_improvement",)
    return "improved", alive[0][1], alive[0][0], alive[0][2]


def run_pass(policy: Policy, bits: list[int], optimize: Callable[[object, int], tuple], parallel: bool) -> dict:
    """One pass over the open bits: the tally, and whether the policy is saturated."""
    tally = {"committed": 0, "stale": 0, "no_improvement": 0}
    seen = policy.version
    for bit in bits:
        if not parallel:
            seen = policy.version
        found = optimize(policy.terms[bit], bit)
        tally[policy.offer(bit, found[1], found[2], seen, found[3]) if found[0] == "improved" else "no_improvement"] += 1
    tally["saturated"] = tally["committed"] == 0 and (not parallel or tally["stale"] == 0)
    return tally


def cegar(policy: Policy, rounds: int, waves: int, open_bits: Callable[[Policy], list[int]], optimize, validate: Callable[[list], float], parallel: bool = True) -> list[dict]:
    """Rounds of: validate, up to `waves` passes until saturated, validate again, guard.  A row per round."""
    log = []
    for n in range(1, rounds + 1):
        before, terms, commits = validate(policy.terms), list(policy.terms), 0
        for _ in range(waves):
            tally = run_pass(policy, open_bits(policy), optimize, parallel)
            commits += tally["committed"]
            if tally["saturated"]:
                break
        after = validate(policy.terms)
        log.append({"round": n, "before": before, "after": after, "commits": commits, "reverted": policy.guard(before, after, terms, commits)})
    return log
