"""Versioned lineages: commit gate, replay, guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import MOST, fold, numbered

EPSILON = 1e-9


def gate(proposals: DataFrame, key: str, order: str, reward: str, evaluated_at: str | None = None, epsilon: float = EPSILON, floor: str | None = None) -> DataFrame:
    """A lineage's proposals in order: outcome, version and best after each.

    Stale (made for another version) comes first, then no_improvement, else committed.  `floor` names the column of a
    baseline: the first one that a lineage has is what its first commit must pass.  The fold is serial in a lineage and
    parallel over lineages; only the version and the best go along.
    """
    kinds = dict(proposals.dtypes)
    rows = proposals.select(F.col(key), F.col(order).cast("bigint").alias("o"), F.col(reward).cast("double").alias("r"), (F.col(evaluated_at) if evaluated_at else F.lit(None)).cast("bigint").alias("e"), (F.col(floor) if floor else F.lit(None)).cast("double").alias("f"))
    name = rows.columns[0]

    def step(state, row):
        (version, best), (of, at, r, seen, base) = state, row
        if best is None:
            best = base
        if seen is not None and seen != version:
            said = "stale"
        elif r is not None and (best is None or r > best + epsilon):
            said, version, best = "committed", version + 1, r
        else:
            said = "no_improvement"
        return (version, best), (of, at, r, said, version, best)

    out = fold(rows, name, ["o", "r", "e"], lambda row: (0, None), step, f"k {kinds[key]}, o bigint, r double, outcome string, version bigint, best double")
    return out.select(F.col("k").alias(key), F.col("o").alias(order), F.col("r").alias(reward), "outcome", "version", "best")


def replayed(versions: DataFrame, key: str, version: str, bit: str, back: str, bits: int, ties: list[str] = ()) -> DataFrame:
    """key, state (by bit the version that last set it, -1 for none), versions, contiguous (they are 0, 1, 2, ...).

    A row sets its bit, or, where `back` holds, puts back what there was before the last row that set one.
    """
    rows = versions.select(key, version, bit, back, *ties)

    def step(state, row):
        now, old, n, whole = state
        if row[3]:
            now = old
        else:
            old, now = now, now[: row[2]] + (row[1],) + now[row[2] + 1 :]
        return (now, old, n + 1, whole and row[1] == n), None

    none = (-1,) * bits
    kind = dict(versions.dtypes)[key]
    return fold(rows, key, [version, *ties], lambda row: (none, none, 0, True), step, f"{key} {kind}, state array<bigint>, versions bigint, contiguous boolean", lambda k, s: (k, list(s[0]), s[2], s[3]))


def for_experiment(experiments: DataFrame, lineages: DataFrame, policy: str) -> DataFrame:
    """Experiments with their lineage's columns, and error where there is none."""
    found = experiments.join(lineages.withColumn("_there", F.lit(True)), policy, "left")
    return found.withColumn("error", F.when(F.col("_there").isNull(), "no lineage")).drop("_there")


def session_lists(sessions: DataFrame, key: str, session: str, at: str) -> DataFrame:
    """key, active (its newest session that is pending or running), last_run (the newest other), latest (the newest
    completed), status (the active one's, else the last run's, else `history`), completed, total.  Ties in time go to the
    greater session."""
    live, done = F.col("status").isin("pending", "running"), F.col("status") == "completed"
    order = lambda when: F.when(when, F.struct(at, session))
    each = F.struct(F.col(session).alias("s"), F.col("status").alias("t"))
    found = sessions.groupBy(key).agg(F.max_by(each, order(live)).alias("a"), F.max_by(each, order(~live)).alias("l"), F.max_by(each, order(done)).alias("c"), F.count_if(done).alias("completed"), F.count(F.lit(1)).alias("total"))
    return found.select(key, F.col("a.s").alias("active"), F.col("l.s").alias("last_run"), F.col("c.s").alias("latest"), F.coalesce("a.t", "l.t", F.lit("history")).alias("status"), "completed", "total")


def renumber(versions: DataFrame, key: str, order: list, most: int = MOST) -> DataFrame:
    """Versions numbered anew within their key, however many it has."""
    return numbered(versions, key, order, most)


def stale(average: Column, validated: Column, version: Column) -> Column:
    """A validation is stale if there is none, or if it is of an older version."""
    return average.isNull() | F.coalesce(validated < version, F.lit(True))


def reverts(passes: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """A new version with the old predicates for each pass that committed and made validation worse."""
    bad = passes.filter((F.col("after") < F.col("before") - epsilon) & (F.col("commits") > 0))
    return bad.withColumn("bit_idx", F.lit(-1).cast("bigint")).withColumn("version", F.col("version") + 1)


TRANSITIONS = {"pending": ("running", "failed", "cancelled"), "running": ("completed", "failed", "cancelled")}


def moved(status: str, to: str) -> str:
    """The next status; an ended one stays, what isn't allowed raises."""
    if status not in TRANSITIONS:
        return status
    if to not in TRANSITIONS[status]:
        raise ValueError(f"{status} can't become {to}")
    return to


def open_bits(settled: DataFrame, key: str, bit: str, n: int) -> DataFrame:
    """Of each lineage the bits of 0..n-1 that no row has settled."""
    had = settled.groupBy(key).agg(F.collect_set(bit).alias("had"))  # at most as many as there are bits
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    return had.select(key, F.explode(F.array_except(every, "had")).alias(bit))


def find_or_create(existing: DataFrame, submissions: DataFrame, keys: list[str], order: list) -> DataFrame:
    """submissions with `created`: true for the first of a key that no existing row has, which makes that row.

    All others find a row.
    """
    there = existing.select(*keys).distinct().withColumn("_there", F.lit(True))
    marked = submissions.join(there, keys, "left")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    return marked.withColumn("created", F.col("_there").isNull() & first).drop("_there")


def replace_rows(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """existing with the last of new rows of the same key in place of its own, and with what it lacks."""
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    return existing.join(last, keys, "left_anti").unionByName(last)


def moves_to(status: Column, to: Column) -> tuple[Column, Column]:
    """(next status, error): an ended status stays, what isn't allowed stays with an error."""
    ended = ~status.isin(*TRANSITIONS)
    allowed = F.lit(False)
    for name, nexts in TRANSITIONS.items():
        allowed = allowed | ((status == name) & to.isin(*nexts))
    error = F.when(~ended & ~allowed, F.concat(status, F.lit(" can't become "), to))
    return F.when(allowed, to).otherwise(status), error


def audit(gated: DataFrame, key: str, order: str) -> DataFrame:
    """What gate() commits, as audit rows to append: key, version, prev_reward, new_reward, delta (null at first)."""
    took = gated.filter(F.col("outcome") == "committed")
    last = F.lag("best").over(Window.partitionBy(key).orderBy(order))
    return took.select(key, "version", last.alias("prev_reward"), F.col("best").alias("new_reward"), (F.col("best") - last).alias("delta"))
