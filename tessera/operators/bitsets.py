"""Scores of many compound predicates in one scan: bitmaps of atoms, trees by bitwise operations.

A block of observations of one episode gives one packed bitmap per different feature.  The nodes of all candidates' trees,
equal ones once, are evaluated level by level as bitwise operations on these bitmaps, and a candidate's return is the
weighted population count of its bitmap: the sum of the observations' values over its set bits, by tables of the 256
sums that a byte can stand for.  So a feature is evaluated once an observation however many candidates have it, and a
candidate costs an observation an eighth of a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import POOL, identity, simplify
from ..storage import ship

#: Observations of a block; features that are evaluated, and candidates whose bitmaps are held, at a time.
BLOCK, ATOMS, HELD = 4096, 256, 8192
#: Candidates that go to all tasks at a time, some 20 bytes each: larger pools take one scan for each so many.
PASS = 1 << 20
#: Bytes of returns that a task holds before it hands them on.
RETURNS = 1 << 26
NOT, AND, OR = 1, 2, 3


@dataclass
class Programs:
    """Candidates as nodes: the two constants, then the features, then levels of (operation, left, right)."""

    kinds: list[str] = field(default_factory=list)
    #: For each feature the coordinates i, j, k and the numbers a, b, c.
    coordinates: list[tuple] = field(default_factory=list)
    numbers: list[tuple] = field(default_factory=list)
    #: Arrays op, left, right of the nodes of each level; nodes count on from the features.
    levels: list[tuple] = field(default_factory=list)
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of_terms(cls, terms: list) -> Programs:
        """From terms as predicates.predicate() takes them."""
        out, atoms, nodes = cls(), {}, {}

        def leaves(term):
            if isinstance(term, list) and term[0] == "feat":
                if identity(term) not in atoms:
                    atoms[identity(term)] = out._atom(term)
            elif isinstance(term, list):
                for t in term[1:]:
                    leaves(t)

        simple = [simplify(t) for t in terms]
        for t in simple:
            leaves(t)
        height: dict[int, int] = {}
        made: list[tuple] = []

        def node(term) -> tuple:
            if isinstance(term, str):
                return ("atom", int(term == "truep"))
            if term[0] == "feat":
                return ("atom", atoms[identity(term)])
            key = (("not", "and", "or").index(term[0]) + 1, *(node(t) for t in term[1:]))
            if key not in nodes:
                nodes[key] = len(made)
                height[nodes[key]] = 1 + max((height[x[1]] for x in key[1:] if x[0] == "node"), default=0)
                made.append(key)
            return ("node", nodes[key])

        roots = [node(t) for t in simple]
        order = sorted(range(len(made)), key=lambda n: height[n])
        first = 2 + len(out.kinds)
        place = {n: first + k for k, n in enumerate(order)}
        at = lambda x: x[1] if x[0] == "atom" else place[x[1]]
        for level in range(1, max(height.values(), default=0) + 1):
            mine = [made[n] for n in order if height[n] == level]
            out.levels.append(tuple(np.array(c, np.int64) for c in zip(*((m[0], at(m[1]), at(m[-1])) for m in mine), strict=True)))
        out.roots = np.array([at(r) for r in roots], np.int64)
        return out

    @classmethod
    def of_pool(cls, atoms: list, candidates: list | None = None) -> Programs:
        """From rows of predicates.POOL_SCHEMA, their idx from 0 on, and rows (op, left, right, negated) over them: op is
        `and` or `or`, and `negated` turns the right side round.  Without candidates, each feature is one."""
        out = cls()
        for r in sorted(atoms, key=lambda r: r["idx"]):
            out._row(r["kind"], [r[n] for n in "ijk"], [r[n] for n in "abc"])
        n = 2 + len(out.kinds)
        if candidates is None:
            out.roots = np.arange(2, n)
            return out
        op, left, right, negated = (np.array(c) for c in zip(*((AND if r["op"] == "and" else OR, 2 + r["left"], 2 + r["right"], r["negated"]) for r in candidates), strict=True))
        turned, where = np.unique(right[negated], return_inverse=True)
        right = right.copy()
        right[negated] = n + where
        out.levels = [(np.full(len(turned), NOT), turned, turned), (op, left, right)]
        out.roots = n + len(turned) + np.arange(len(op))
        return out

    def _row(self, kind, coordinates, numbers) -> int:
        self.kinds.append(kind)
        self.coordinates.append(tuple(-1 if x is None else int(x) for x in coordinates))
        self.numbers.append(tuple(np.nan if x is None else float(x) for x in numbers))
        return 1 + len(self.kinds)

    def _atom(self, term) -> int:
        kind, *args = term[1]
        given = dict(zip(POOL[kind], args, strict=True))
        return self._row(kind, [given.get(n) for n in "ijk"], [given.get(n) for n in "abc"])


def _kernels(kind: str, x, a, b, c):
    """What a kind says of the coordinates x(0), x(1), x(2); a comparison with a missing one (NaN) is false."""
    if kind == "axis":
        return x(0) < a
    if kind == "diag":
        return a * x(0) + x(1) < 0
    if kind == "sq_diag":
        return a * x(0) * x(0) + x(1) < 0
    if kind == "prod":
        return x(0) * x(1) < a
    if kind == "tridiag":
        return a * x(0) + b * x(1) + x(2) < 0
    if kind == "sin_axis":
        return np.sin(x(0)) < a
    if kind == "cos_axis":
        return np.cos(x(0)) < a
    if kind == "wavelet_box":
        return (x(0) >= a) & (x(0) < b)
    if kind == "wavelet_ricker":
        z = (x(0) - b) / np.where(a == 0, np.nan, a)  # no width: never
        return (1 - z * z) * np.exp(-(z * z) / 2) < c
    return np.zeros(x(0).shape, bool)


def bitmaps(x: np.ndarray, p: Programs) -> np.ndarray:
    """A row of packed bits over the observations for each constant and feature."""
    n, d = x.shape
    x = np.concatenate([x, np.full((n, 1), np.nan)], axis=1)
    out = np.zeros((2 + len(p.kinds), -(-n // 8)), np.uint8)
    out[1] = 255
    where, numbers = np.array(p.coordinates, np.int64).reshape(-1, 3), np.array(p.numbers, np.float64).reshape(-1, 3)
    where = np.where((where < 0) | (where > d), d, where)
    kinds = np.array(p.kinds)
    with np.errstate(all="ignore"):
        for kind in np.unique(kinds):
            mine = np.flatnonzero(kinds == kind)
            for at in range(0, len(mine), ATOMS):
                some = mine[at : at + ATOMS]
                hit = _kernels(str(kind), lambda k, some=some: x[:, where[some, k]], *numbers[some].T)
                out[2 + some] = np.packbits(hit, axis=0).T
    return out


#: The eight bits of each byte, as np.packbits orders them.
EIGHT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def counted(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each bitmap the sum of the values at its set bits."""
    padded = np.zeros(8 * bits.shape[1])
    padded[: len(values)] = values
    sums = padded.reshape(-1, 8) @ EIGHT.T  # by byte of the bitmap and its value
    place = np.arange(bits.shape[1])
    out = np.empty(len(bits))
    for at in range(0, len(bits), HELD):
        out[at : at + HELD] = sums[place, bits[at : at + HELD]].sum(axis=1)
    return out


def returns(x: np.ndarray, values: np.ndarray, p: Programs) -> np.ndarray:
    """For each candidate the sum of the values where it holds less that of the others."""
    bits = bitmaps(x, p)
    for op, left, right in p.levels:
        a = bits[left]
        made = np.where((op == NOT)[:, None], ~a, np.where((op == AND)[:, None], a & bits[right], a | bits[right]))
        bits = np.concatenate([bits, made])
    return 2 * counted(bits[p.roots], values) - values.sum()


def _scored(programs, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = programs.value
        held: dict = {}

        def told():
            for episode, r in held.items():
                for at in range(0, len(r), HELD):
                    yield pa.RecordBatch.from_arrays([pa.array([episode], kind), pa.array([at], pa.int64()), pa.array([r[at : at + HELD]], pa.list_(pa.float64()))], ["episode", "first", "returns"])
            held.clear()

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column("x")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            x = np.full((n, int(sizes.max())), np.nan)
            x[np.arange(x.shape[1]) < sizes[:, None]] = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            values = batch.column("v").fill_null(0.0).to_numpy(zero_copy_only=False)
            codes = batch.column("episode").dictionary_encode(null_encoding="encode")
            names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0, True])
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                name = names[code[order[a]]]
                for b in range(a, z, BLOCK):
                    some = order[b : min(z, b + BLOCK)]
                    r = returns(x[some], values[some], p)
                    held[name] = held[name] + r if name in held else r
                if len(held) * 8 * len(p.roots) > RETURNS:
                    yield from told()
        yield from told()

    return run


def score_programs(observations: DataFrame, programs: Programs, episode: str, value: Column, threshold: float = 0.0, vector: str = "embedding") -> DataFrame:
    """aggregates.score() of up to PASS candidates in one scan: idx, reward, landings.

    A null value counts as zero, a null coordinate as missing.  A task hands on a list of returns per episode; sums over
    (candidate, episode) and then over candidates are Spark's.
    """
    if len(programs.roots) > PASS:
        raise ValueError(f"more than {PASS} candidates: score them pass by pass")
    spark = observations.sparkSession
    ship(spark)
    seen = observations.select(F.col(episode).alias("episode"), value.cast("double").alias("v"), F.col(vector).alias("x"))
    kind = seen.schema["episode"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    shared = spark.sparkContext.broadcast(programs)
    lists = seen.mapInArrow(_scored(shared, to_arrow_type(kind)), f"episode {kind.simpleString()}, first long, returns array<double>")
    each = lists.select("episode", "first", F.posexplode("returns").alias("n", "r"))
    rets = each.groupBy((F.col("first") + F.col("n")).alias("idx"), "episode").agg(F.sum("r").alias("ret"))
    good = (F.col("ret") > threshold) & ~F.isnan("ret")
    return rets.groupBy("idx").agg(F.sum("ret").alias("reward"), F.count_if(good).alias("landings"))
