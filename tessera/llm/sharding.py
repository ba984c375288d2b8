"""Shards of nearly equal bytes: the smallest feasible capacity of contiguous shards over ordered groups of equal texts.

Groups stand in the order of their texts' hashes and are never cut.  The capacity is found by binary search, each guess
checked by filling shards greedily.  The driver never sees the groups: it searches over *stretches* of them, at first one
per three hex digits of the hash, and one per group that is heavy (fewer than HEAVY of these).  Whether a shard could
end inside a stretch is unknown, so the search gives the least capacity that may be feasible and the least that surely
is; the few stretches in which a shard of a capacity between them might end are split by further digits, in one
aggregation, until the two are equal.  That is the exact minimum.

Nulls count as empty texts; ids may be null, repeated or tied; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, written

#: A group with more than this part of all bytes is a stretch of its own.
HEAVY = 1 << 14
#: Rows that are numbered together.
CELL_ROWS = 1 << 14
#: Hex digits of the first stretches, and how many more each split takes.
DIGITS, MORE = 3, 2


def facts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (bytes of the text and one), text_crc32, key (SHA-256 of the text)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("bigint") + 1
    return df.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("key"))


def _order(heavy: Column) -> Column:
    """Where a group stands: among those of its first digits the heavy ones come first."""
    return F.concat(F.substring("key", 1, DIGITS), F.when(heavy, "0").otherwise("1"), F.col("key"))


class Stretches:
    """Runs of groups in order: where each ends in bytes, how its groups' order keys begin, and if it is one group."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.rows = sorted(rows)
        self.ends = list(accumulate(r[1] for r in self.rows))
        self.total = self.ends[-1] if rows else 0

    def reach(self, x: int, inside: bool = False) -> int:
        """The last place up to x where a shard may end; inside: anywhere in a stretch of several groups."""
        i = bisect_right(self.ends, x)
        if inside and i < len(self.rows) and self.rows[i][2] > 1:
            return x
        return self.ends[i - 1] if i else 0

    def greedy(self, capacity: int, shards: int, inside: bool = False, start: int = 0) -> list[int]:
        """Where shards end that are filled one after the other."""
        out = [start]
        for _ in range(shards):
            out.append(self.reach(out[-1] + capacity, inside))
        return out[1:]

    def least(self, shards: int, start: int, stop: int, low: int, inside: bool = False) -> int:
        """The least capacity of `low` or more whose shards get from start to stop: a binary search."""
        high = max(low, stop - start)
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, shards, inside, start)[-1] >= stop:
                high = mid
            else:
                low = mid + 1
        return low

    def unsure(self, low: int, high: int, shards: int) -> list[str]:
        """The stretches of several groups in which a shard of a capacity from low to high might end."""
        first, last = [0, *self.greedy(low, shards)], [0, *self.greedy(high, shards, inside=True)]
        found: set[str] = set()
        for a, b in zip(first[:-1], last[:-1], strict=True):
            i, j = bisect_right(self.ends, a + low), bisect_right(self.ends, b + high)
            found |= {key for key, _, n in self.rows[i : j + 1] if n > 1}
        return sorted(found)

    def cuts(self, capacity: int, shards: int, start: int = 0, stop: int | None = None) -> list[int]:
        """Where shards of at most `capacity` end, with sizes as even as the known places allow.

        A group that alone fills the capacity and more than an even share gets a shard, and what is left and right of it
        is cut anew, each with the least capacity; elsewhere each shard ends near an even share of what is left.
        """
        stop = self.total if stop is None else stop
        if shards == 1 or start >= stop:
            return [stop] * shards
        i, j = bisect_right(self.ends, start), bisect_left(self.ends, stop)
        big = max(range(i, j + 1), key=lambda n: self.rows[n][1])
        weight = self.rows[big][1]
        if weight == capacity and weight * shards > stop - start and self.rows[big][2] == 1 and j > i:
            a, b = self.ends[big] - weight, self.ends[big]
            sides = []
            for left in range(int(a > start), shards - int(b < stop)):
                need = [self.least(n, x, y, -(-(y - x) // n)) if y > x else 0 for n, x, y in ((left, start, a), (shards - 1 - left, b, stop)) if n]
                sides.append((max(need, default=0), sum(need), left))
            if sides:
                left = min(sides)[2]
                before = self.cuts(self.least(left, start, a, -(-(a - start) // left)), left, start, a) if left else []
                right = shards - 1 - left
                after = self.cuts(self.least(right, b, stop, -(-(stop - b) // right)), right, b, stop) if right else []
                return [*before, b, *after]
        latest = self.greedy(capacity, shards, start=start)
        earliest = [stop]
        for late in reversed(latest[:-1]):  # what the shards after it can still hold
            earliest.append(min(late, self.ends[bisect_left(self.ends, earliest[-1] - capacity)]) if earliest[-1] - capacity > start else start)
        earliest.reverse()
        out, at = [], start
        for n in range(shards - 1):
            aim = at + (stop - at) // (shards - n)
            k = bisect_left(self.ends, aim)
            near = [self.ends[x] for x in (k - 1, k) if 0 <= x < len(self.ends)]
            best = min(near, key=lambda e: abs(e - aim))
            at = max(min(best, self.reach(at + capacity), stop), earliest[n], at)
            out.append(at)
        return [*out, stop]

    def key_at(self, end: int) -> str:
        """The order key from which on groups stand after this place."""
        i = bisect_right(self.ends, end)
        return self.rows[i][0] if i < len(self.rows) else "~"


def _stretches(groups: DataFrame, key: Column) -> list[tuple[str, int, int]]:
    return [(r["stretch"], r["weight"], r["n"]) for r in groups.groupBy(key.alias("stretch")).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).collect()]


def plan(groups: DataFrame, total: int, shards: int) -> tuple[int, list[str]]:
    """The least capacity, and the order keys at which the second shard and those after it begin.

    groups: okey and weight.  What is collected is bounded: HEAVY groups and 16 to the power of DIGITS stretches, then
    16 to the power of MORE for each stretch in which a shard might end, a few dozen a pass where no group is heavy.
    """
    heavy = F.substring("okey", DIGITS + 1, 1) == "0"
    rows = _stretches(groups, F.when(heavy, F.col("okey")).otherwise(F.substring("okey", 1, DIGITS + 1)))
    while True:
        s = Stretches(rows)
        floor = max([-(-total // shards), *(w for _, w, n in rows if n == 1)])
        low = s.least(shards, 0, total, floor, inside=True)
        high = s.least(shards, 0, total, low)
        if low == high:
            return low, [s.key_at(c) for c in s.cuts(low, shards)[:-1]]
        split = s.unsure(low, high, shards)
        rows = [r for r in rows if r[0] not in set(split)]
        for digits in {len(k) for k in split}:
            some = [k for k in split if len(k) == digits]
            rows += _stretches(groups.filter(F.substring("okey", 1, digits).isin(some)), F.substring("okey", 1, digits + MORE))


def _planned(rows: DataFrame, total: int, shards: int) -> tuple[list[str], DataFrame]:
    """For facts(): the order keys at which shards begin, and the keys of the heavy groups (fewer than HEAVY)."""
    weighed = rows.groupBy("key").agg(F.sum("size").alias("weight"))
    heavy = F.col("weight") > total // HEAVY
    groups = written(weighed.select(_order(heavy).alias("okey"), "weight"), "shard-groups")
    listed = groups.filter(F.substring("okey", DIGITS + 1, 1) == "0").select(F.substring("okey", DIGITS + 2, 64).alias("key"), F.lit(True).alias("heavy"))
    return plan(groups, total, shards)[1], listed


def _shard(cuts: list[str]) -> Column:
    okey = _order(F.coalesce("heavy", F.lit(False)))
    return sum((F.when(okey >= cut, 1).otherwise(0) for cut in cuts), F.lit(0)).cast("int")


def assign(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard) of every row of df.

    Equal texts share a shard.  The largest shard is as small as contiguous shards over the groups' order can be.
    Numbers are given inside cells of rows dealt by hash, and each cell starts where the cells before it end; rows that are
    alike in all columns are one while they are counted.
    """
    rows = written(facts(df, id_col, text_col), "shard-facts")
    found = rows.agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")).first()
    cuts, heavy = _planned(rows, found["total"] or 0, shards)
    cell = F.pmod(F.xxhash64("doc_id", "key"), F.lit(max(1, found["n"] // CELL_ROWS)))
    same = ["shard", "cell", "doc_id", "size", "text_crc32", "key"]
    placed = rows.join(F.broadcast(heavy), "key", "left").withColumns({"shard": _shard(cuts), "cell": cell})
    alike = placed.groupBy(*same).agg(F.count(F.lit(1)).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = alike.groupBy("shard", "cell").agg(F.sum("n").alias("n"))
    bases = sums.select("shard", "cell", before(Window.partitionBy("shard").orderBy("cell")).alias("base"))
    own = alike.withColumn("first", before(Window.partitionBy("shard", "cell").orderBy("doc_id", "key")))
    numbered = own.join(bases, ["shard", "cell"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("first") + F.col("copy")).alias("slot"))


def digests(df: DataFrame) -> DataFrame:
    """assign() to eight shards, with the law that it follows."""
    return assign(df).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """df's rows as Parquet, a folder per shard (shard=0, shard=1, ...); no row is shuffled for it."""
    rows = written(facts(df, id_col, text_col), "shard-facts")
    cuts, heavy = _planned(rows, rows.agg(F.sum("size")).first()[0] or 0, shards)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = packed(df, key=F.sha2(text, 256)).join(F.broadcast(heavy), "key", "left")
    keyed.select("row.*", _shard(cuts).alias("shard")).write.partitionBy("shard").mode("overwrite").parquet(path)
