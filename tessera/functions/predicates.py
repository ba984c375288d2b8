"""Boolean predicates over observation arrays: JSON terms to Spark columns, or to SQL text for oracles.

A term is "truep", "falsep", null (true), ["feat", [kind, ...]], ["not", p], ["and", p, q] or ["or", p, q];
what is unknown is false.  Logic is two-valued: a kernel over a missing coordinate is false.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KERNELS: dict[str, Callable] = {}


def kernel(kind: str):
    """Register the SQL text of a feature kind; x(i) gives coordinate i as a double."""

    def add(f):
        KERNELS[kind] = f
        return f

    return add


def num(v) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


kernel("axis")(lambda x, i, t: f"{x(i)} < {num(t)}")
kernel("diag")(lambda x, i, j, c: f"{num(c)} * {x(i)} + {x(j)} < 0")
kernel("sq_diag")(lambda x, i, j, c: f"{num(c)} * {x(i)} * {x(i)} + {x(j)} < 0")
kernel("prod")(lambda x, i, j, t: f"{x(i)} * {x(j)} < {num(t)}")
kernel("tridiag")(lambda x, i, j, k, c, d: f"{num(c)} * {x(i)} + {num(d)} * {x(j)} + {x(k)} < 0")
kernel("sin_axis")(lambda x, i, t: f"sin({x(i)}) < {num(t)}")
kernel("cos_axis")(lambda x, i, t: f"cos({x(i)}) < {num(t)}")
kernel("wavelet_box")(lambda x, i, lo, hi: f"{x(i)} >= {num(lo)} AND {x(i)} < {num(hi)}")


@kernel("wavelet_ricker")
def _ricker(x, i, b, a, t):
    if a == 0:
        return "FALSE"
    z = f"(({x(i)} - {num(b)}) / {num(a)})"
    return f"(1 - {z} * {z}) * exp(-({z} * {z}) / 2) < {num(t)}"


def simplify(term):
    """The term without parts that can't matter; "truep" and "falsep" are the constants."""
    if term is None or term == "truep":
        return "truep"
    if isinstance(term, str) or not term:
        return "falsep"
    op, *args = term
    if op == "feat":
        return term if args and args[0] and args[0][0] in KERNELS else "falsep"
    if op == "not" and args:
        p = simplify(args[0])
        return {"truep": "falsep", "falsep": "truep"}.get(p, ["not", p]) if isinstance(p, str) else ["not", p]
    if op in ("and", "or") and len(args) == 2:
        p, q = map(simplify, args)
        stop, skip = ("falsep", "truep") if op == "and" else ("truep", "falsep")
        if stop in (p, q):
            return stop
        return q if p == skip else p if q == skip else [op, p, q]
    return "falsep"


def to_sql(term, x: Callable[[int], str]) -> str:
    term = simplify(term)
    if isinstance(term, str):
        return "TRUE" if term == "truep" else "FALSE"
    op, *args = term
    if op == "feat":
        return f"coalesce({KERNELS[args[0][0]](x, *args[0][1:])}, FALSE)"
    return f"(NOT {to_sql(args[0], x)})" if op == "not" else f"({to_sql(args[0], x)} {op.upper()} {to_sql(args[1], x)})"


def spark_x(column: str) -> Callable[[int], str]:
    return lambda i: f"CAST(get({column}, {int(i)}) AS DOUBLE)"


def duck_x(column: str) -> Callable[[int], str]:
    return lambda i: f"CAST({column}[{int(i) + 1}] AS DOUBLE)"


def predicate(term, column: str = "embedding") -> Column:
    """A term (or its JSON text) as a Boolean column: whole-stage code, no Python in the plan."""
    return F.expr(to_sql(json.loads(term) if isinstance(term, str) and term.startswith("[") else term, spark_x(column)))


def identity(term) -> str:
    """Canonical text: equal terms, equal text."""
    return json.dumps(term, sort_keys=True, separators=(",", ":"))


def largest_index(term) -> int:
    """The largest coordinate that a term reads; -1 if none."""
    if not isinstance(term, list):
        return -1
    if term[0] == "feat":
        kind, *args = term[1]
        return max(int(v) for v in args[: {"diag": 2, "sq_diag": 2, "prod": 2, "tridiag": 3}.get(kind, 1)])
    return max(map(largest_index, term[1:]))


def bits_code(terms: list, column: str = "embedding") -> Column:
    """The predicates' bits as one integer, the first predicate lowest."""
    return reduce(lambda a, b: a + b, (F.when(predicate(t, column), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k, t in enumerate(terms)))


#: Which coordinates (i, j, k) and numbers (a, b, c) of a pool's row each feature kind takes, in its order.
POOL = {"axis": "ia", "diag": "ija", "sq_diag": "ija", "prod": "ija", "tridiag": "ijkab", "sin_axis": "ia", "cos_axis": "ia", "wavelet_box": "iab", "wavelet_ricker": "ibac"}


def pooled(column: str = "embedding", at: str = "get({c}, {i})") -> str:
    """SQL text of a feature whose kind, coordinates and numbers are columns: one CASE for any number of candidates."""
    x = lambda name: "CAST(" + at.format(c=column, i=name) + " AS DOUBLE)"
    z = f"(({x('i')} - b) / a)"
    text = {
        "axis": f"{x('i')} < a",
        "diag": f"a * {x('i')} + {x('j')} < 0",
        "sq_diag": f"a * {x('i')} * {x('i')} + {x('j')} < 0",
        "prod": f"{x('i')} * {x('j')} < a",
        "tridiag": f"a * {x('i')} + b * {x('j')} + {x('k')} < 0",
        "sin_axis": f"sin({x('i')}) < a",
        "cos_axis": f"cos({x('i')}) < a",
        "wavelet_box": f"{x('i')} >= a AND {x('i')} < b",
        "wavelet_ricker": f"CASE WHEN a = 0 THEN FALSE ELSE (1 - {z} * {z}) * exp(-({z} * {z}) / 2) < c END",
    }
    return "coalesce(CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in text.items()) + " END, FALSE)"


def pool_row(idx: int, term: list) -> tuple:
    """A ["feat", [kind, ...]] as a pool's row: idx, kind, i, j, k, a, b, c."""
    kind, *args = term[1]
    given = dict(zip(POOL[kind], args, strict=True))
    return (idx, kind, *(int(given[n]) if n in given else None for n in "ijk"), *(float(given[n]) if n in given else None for n in "abc"))


POOL_SCHEMA = "idx bigint, kind string, i int, j int, k int, a double, b double, c double"
