"""Row numbers, folds and selections within keys of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import ship, written

#: A key with more rows than this is spread over tasks.
MOST = 1 << 20


def _slots(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def crowded(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The keys with more than `most` rows and how many: at most a most-th of the rows, so small enough for all tasks."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)


def numbered(rows: DataFrame, key: str, order: list, most: int = MOST, name: str = "number") -> DataFrame:
    """rows with their number (from 1) within the key by a total order; a crowded key is in as many tasks as it fills.

    Crowded keys are sorted in ranges of (key, order) and written, each row with its place in its range.  A range's rows of
    a key count on from those of the ranges before it, which are prefix sums over a row per key and range.
    """
    plain = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint")
    many = crowded(rows, key, most).select(F.col(key).alias("_many"))
    if many.isEmpty():
        return rows.withColumn(name, plain)
    many = F.broadcast(many)
    same = F.col(key).eqNullSafe(F.col("_many"))
    few = rows.join(many, same, "left_anti").withColumn(name, plain)
    return few.unionByName(ranged(rows.join(many, same, "left_semi"), key, order, name))


def ranged(rows: DataFrame, key: str, order: list, name: str = "number") -> DataFrame:
    """numbered() by ranges, whatever the sizes of keys."""
    by = [F.col(key), *(F.col(o) if isinstance(o, str) else o for o in order)]
    put = rows.repartitionByRange(_slots(rows), *by).sortWithinPartitions(*by)
    put = written(put.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    parts = put.groupBy(F.col(key).alias("_key"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = parts.select("_key", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_base"))
    joined = put.join(bases, F.col(key).eqNullSafe(F.col("_key")) & (part == F.col("_part")))
    return joined.withColumn(name, (F.col("_at") - F.col("_first") + F.col("_base") + 1).cast("bigint")).select(*rows.columns, name)


def fold(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable, schema: str, end: Callable | None = None) -> DataFrame:
    """A serial fold along each key's rows in order, of any number: a task holds one state and one batch.

    start(row) gives the state before a key's first row; step(state, row) gives the next state and what to emit for the
    row (a tuple of `schema`, or None); end(key, state) what to emit for the key.  Rows are tuples of df's columns.
    Keys go to tasks by hash and come sorted, which spills; equal keys, null included, come one after the other.
    """
    spark = rows.sparkSession
    ship(spark)
    at = rows.columns.index(key)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, began = None, None, False

        def told(out):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not began or row[at] != now:
                    if began and end:
                        out.append(end(now, state))
                    now, state, began = row[at], start(row), True
                state, said = step(state, row)
                if said is not None:
                    out.append(said)
            if out:
                yield told(out)
        if began and end:
            yield told([end(now, state)])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


#: A sketch's quantiles, and its error as a part of the rows.
STEPS, ACCURACY = 256, 4096


def smallest(rows: DataFrame, key: str, value: str, ranks: DataFrame, most: int = MOST) -> DataFrame:
    """key, kth, less: the k-th smallest value of each key of `ranks` (key, k from 1 to the key's rows), and how many are
    smaller.  No key is sorted while it is large.

    The k-th value is between two quantiles of a mergeable sketch whose error is bounded; exact counts of both sides say
    so, and only what is between them is looked at again.  A pass leaves a 25th of the rows or less, so that passes are
    ceil(log(n / most) / log(25)) and two scans each; what is left at the end is ranked.  ranks has few keys: they go to
    all tasks.
    """
    inf = float("inf")
    v = F.col(value)
    seen = rows.select(F.col(key).alias("_k"), v.cast("double").alias("_v"))
    # what is looked at: values above lo up to hi, of which the rank-th is meant; `less` are below
    state = written(ranks.select(F.col(key).alias("_k"), F.col("k").cast("bigint").alias("rank"), F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"), F.lit(0).cast("bigint").alias("less"), F.lit(True).alias("open")), "brackets")
    inside = (F.col("_v") > F.col("lo")) & (F.col("_v") <= F.col("hi")) | (F.col("lo") == -inf) & (F.col("_v") == -inf)
    quantiles = F.array(*(F.lit(i / STEPS) for i in range(STEPS + 1)))
    while True:
        mine = seen.join(F.broadcast(state.filter("open")), "_k").filter(inside)
        sketched = mine.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.percentile_approx("_v", quantiles, F.lit(ACCURACY)).alias("q"))
        # the quantiles a step below and above the rank, or no bound beyond the first and last
        at = F.floor(F.col("rank") * STEPS / F.col("n")).cast("int")
        lo = F.when(at >= 2, F.get("q", at - 2)).otherwise(F.col("lo"))
        hi = F.when(at + 2 < STEPS, F.get("q", at + 2)).otherwise(F.col("hi"))
        closed = (F.col("n") <= most) | (F.col("low") == F.col("high"))
        new = state.filter("open").join(F.broadcast(sketched), "_k").select("_k", "rank", "less", "n", "high", F.when(closed, F.col("lo")).otherwise(lo).alias("lo"), F.when(closed, F.col("hi")).otherwise(hi).alias("hi"), F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"), closed.alias("closed"))
        new = written(new, "pivots")
        counted = seen.join(F.broadcast(new.filter("NOT closed")), "_k").filter((F.col("_v") > F.col("old_lo")) | (F.col("old_lo") == -inf)).filter(F.col("_v") <= F.col("old_hi"))
        sides = counted.groupBy("_k").agg(F.count_if((F.col("_v") <= F.col("lo")) & (F.col("lo") > F.col("old_lo"))).alias("under"), F.count_if(F.col("_v") <= F.col("hi")).alias("upto"))
        checked = new.join(F.broadcast(sides), "_k", "left").withColumns({"under": F.coalesce("under", F.lit(0)), "upto": F.coalesce("upto", "n")})
        right = (F.col("under") < F.col("rank")) & (F.col("rank") <= F.col("upto"))
        # a sketch that were wrong would leave the bracket as it was, for the ranking at the end
        moved = ~F.col("closed") & right & (F.col("upto") - F.col("under") < F.col("n"))
        pick = lambda a, b: F.when(moved, a).otherwise(b)
        after = checked.select("_k", pick(F.col("rank") - F.col("under"), F.col("rank")).alias("rank"), pick(F.col("lo"), F.col("old_lo")).alias("lo"), pick(F.col("hi"), F.col("old_hi")).alias("hi"), (F.col("less") + pick(F.col("under"), F.lit(0))).alias("less"), moved.alias("open"))
        state = written(state.filter("NOT open").unionByName(after), "brackets")
        if state.filter("open").isEmpty():
            break
    left = seen.join(F.broadcast(state), "_k").filter(inside).groupBy("_k", "rank", "less", "_v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("_k").orderBy("_v")
    upto = left.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = upto.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    return found.select(F.col("_k").alias(key), F.col("_v").alias("kth"), (F.col("less") + F.col("upto") - F.col("n")).alias("less"))
