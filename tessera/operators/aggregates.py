"""Scores, summaries, groups and boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import predicate
from ..storage import written
from . import bitsets, numbering


def score(observations: DataFrame, candidates: list, episode: str, value: Column, threshold: float = 0.0, vector: str = "embedding") -> DataFrame:
    """A row per candidate: idx, reward (sum of its episodes' returns), landings (episodes above threshold).

    One scan: each candidate is a conditional sum by episode, so that a task sends a row per episode, and the few sums
    become rows at the end.  For hundreds of candidates or more, bitsets.score_programs().
    """
    return _scored(observations, candidates, episode, value, threshold, vector).drop("baseline")


def score_bit(observations: DataFrame, candidates: list, current, episode: str, value: Column, threshold: float = 0.0, vector: str = "embedding") -> DataFrame:
    """The candidates' scores beside that of the predicate in place, which is one more sum of the same pass."""
    both = _scored(observations, [current, *candidates], episode, value, threshold, vector)
    return both.filter("idx > 0").select((F.col("idx") - 1).alias("idx"), "reward", "landings", "baseline")


def _scored(observations, candidates, episode, value, threshold, vector) -> DataFrame:
    """idx, reward, landings, baseline (the first one's reward)."""
    seen = observations.select(F.col(episode).alias("_episode"), F.col(vector), value.alias("_v"))
    v = F.col("_v")
    sums = [F.sum(F.when(predicate(t, vector), v).otherwise(-v)).alias(f"r{i}") for i, t in enumerate(candidates)]
    returns = seen.groupBy("_episode").agg(*sums)
    good = lambda r: (F.col(r) > threshold) & ~F.isnan(r)
    parts = [F.sum(f"r{i}").alias(f"s{i}") for i in range(len(sums))] + [F.count_if(good(f"r{i}")).alias(f"l{i}") for i in range(len(sums))]
    totals = returns.agg(F.count(F.lit(1)).alias("_n"), *parts).filter("_n > 0")
    rows = [F.struct(F.lit(i).cast("bigint").alias("idx"), F.col(f"s{i}").alias("reward"), F.col(f"l{i}").alias("landings"), F.col("s0").alias("baseline")) for i in range(len(sums))]
    return totals.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def score_pool(observations: DataFrame, pool: DataFrame, size: int, episode: str, value: Column, threshold: float = 0.0, vector: str = "embedding", block: int = bitsets.PASS) -> DataFrame:
    """score() for a table of features (predicates.POOL_SCHEMA, idx from 0 to size - 1), however many: one scan for each
    `block` of them, which go to all tasks as columns of bounded size."""
    out = None
    for first in range(0, max(1, size), block):
        some = pool.filter(F.col("idx").between(first, first + block - 1)).collect()
        got = bitsets.score_programs(observations, bitsets.Programs.of_pool(some), episode, value, threshold, vector)
        got = got.withColumn("idx", F.col("idx") + first)
        out = got if out is None else out.unionByName(got)
    return out


def scorer(observations: DataFrame, episode: str, value: Column, fallback=None, **named):
    """A function of requests ({cmd, candidates, current}) that holds what to score on; others go to the fallback."""

    def run(request: dict) -> DataFrame:
        if request.get("cmd") == "score_bit":
            return score_bit(observations, request["candidates"], request["current"], episode, value, **named)
        if fallback is None:
            raise ValueError(f"can't score {request.get('cmd')}")
        return fallback(request)

    return run


def summary(results: DataFrame, key: str = "batch_id", position: str = "item_id") -> DataFrame:
    """best, baseline, n, sum, sum of squares, last time of each batch, from deliveries that count (the first of each
    chunk).  The baseline is the reward of the first chunk's first item by `position`, if it has one."""
    r = F.col("reward")
    first = F.min_by(r, F.when(F.col("chunk_index") == 0, F.col(position)))
    return results.groupBy(key).agg(F.max(r).alias("best"), first.alias("baseline"), F.count(r).alias("n"), F.sum(r).alias("total"), F.sum(r * r).alias("squares"), F.max("arrived").alias("last_at"))


def mean_sd(n: Column, total: Column, squares: Column) -> tuple[Column, Column]:
    """Population mean (null for none) and deviation (null for one or none)."""
    mean = F.when(n > 0, total / n)
    return mean, F.when(n > 1, F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0))))


def ratio(part: Column, whole: Column, empty: float = 1.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def contributions(results: DataFrame) -> DataFrame:
    """Upsert-accumulate per batch and worker."""
    return results.groupBy("batch_id", "worker_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("candidates").cast("bigint").alias("candidates"), F.min("arrived").alias("first_at"), F.max("arrived").alias("last_at"))


def leaderboard(completed: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Who has evaluated most, from completed chunks with their workers' names: one aggregate, no roll-up before it."""
    return completed.groupBy(name).agg(F.sum("candidates").cast("bigint").alias("candidates"), F.count(F.lit(1)).alias("chunks"), F.countDistinct("batch_id").alias("batches"), F.max("arrived").alias("last_at")).orderBy(F.desc("candidates"), name).limit(limit)


def logical(name: Column) -> Column:
    """A batch's logical name: without the part's number."""
    return F.regexp_replace(name, r"-part\d+$", "")


def logical_groups(batches: DataFrame) -> DataFrame:
    """Batches rolled up by environment and logical name (no name is a name of its own)."""
    first = F.min_by("batch_id", F.struct("inserted_at", "batch_id"))
    return batches.groupBy("env_name", logical(F.col("name")).alias("grp")).agg(
        F.count(F.lit(1)).alias("parts"),
        F.bool_and(F.col("status") == "completed").alias("all_done"),
        F.max("best_reward").alias("best"),
        first.alias("first_batch"),
        F.min("inserted_at").alias("first_at"),
        F.max("inserted_at").alias("last_at"),
        F.sum("total_chunks").alias("total_chunks"),
        F.sum("completed_chunks").alias("completed_chunks"),
        F.max("polled_at").alias("polled_at"),
    )


def surfaced(groups: DataFrame) -> DataFrame:
    """The group that an environment shows: the last polled (never counts as the epoch), then the newest."""
    order = F.struct(F.coalesce("polled_at", F.timestamp_seconds(F.lit(0))), "last_at", "grp")
    return groups.groupBy("env_name").agg(F.max_by("grp", order).alias("grp"))


def stitch(keys: list[DataFrame], parts: list[tuple[DataFrame, dict]], key: str) -> DataFrame:
    """All keys of any source, with each part's columns or their defaults."""
    out = keys[0].select(key)
    for k in keys[1:]:
        out = out.unionByName(k.select(key))
    out = out.distinct()
    for df, defaults in parts:
        out = out.join(df, key, "left").fillna(defaults)
    return out


def tails(rows: DataFrame, key: str, value: str, most: int = numbering.MOST) -> DataFrame:
    """cvar10, worst, p10, mean, n of each key's values, over the k = max(1, n div 10) smallest; nulls and NaN left out.

    A key of up to `most` rows is ranked.  Larger ones are never sorted: their k-th smallest value is selected by
    narrowing (numbering.smallest), and sums up to it do the rest, in all tasks that have rows of the key.
    """
    v = F.col(value)
    fine = rows.filter(v.isNotNull() & ~F.isnan(v)).select(key, value)
    many = numbering.crowded(fine, key, most)
    if many.isEmpty():
        return _ranked_tails(fine, key, value)
    ranks = written(many.withColumn("k", F.floor(F.col("n") / 10)), "ranks")
    found = numbering.smallest(fine, key, value, ranks, most).join(F.broadcast(ranks), key)
    low = fine.join(F.broadcast(found), key).groupBy(key, "k", "kth", "less").agg(F.coalesce(F.sum(F.when(v < F.col("kth"), v)), F.lit(0.0)).alias("below"), F.min(v).alias("worst"), F.avg(v).alias("mean"), F.count(F.lit(1)).alias("n"))
    large = low.select(key, ((F.col("below") + (F.col("k") - F.col("less")) * F.col("kth")) / F.col("k")).alias("cvar10"), "worst", F.col("kth").alias("p10"), "mean", "n")
    return _ranked_tails(fine.join(F.broadcast(ranks.select(key)), key, "left_anti"), key, value).unionByName(large)


def _ranked_tails(fine: DataFrame, key: str, value: str) -> DataFrame:
    v = F.col(value)
    ranked = fine.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(value)))
    sizes = fine.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") / 10)))
    low = F.when(F.col("i") <= F.col("k"), v)
    return ranked.join(sizes, key).groupBy(key).agg(F.avg(low).alias("cvar10"), F.min(v).alias("worst"), F.max(low).alias("p10"), F.avg(v).alias("mean"), F.max("n").alias("n"))


def payload(batches: DataFrame, completed: DataFrame, key: str, days: int, versions: int = 5) -> DataFrame:
    """One row per key with a batch in flight: its newest ones' results with mean and deviation, deliveries a day over
    the days before the last one, and the key's last versions, newest first.

    batches: batch_id, key, status, inserted_at; completed: deliveries that count.
    """
    live = batches.filter(F.col("status") != "completed")
    newest = live.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.desc("inserted_at")))).filter("_r = 1").select(key, "batch_id")
    mine = newest.join(completed, "batch_id", "left")
    last = F.max("arrived").over(Window.partitionBy(key))
    r = F.col("reward")
    recent = F.count_if(F.col("arrived") >= F.col("_last") - F.make_interval(days=F.lit(days))) / days
    found = mine.withColumn("_last", last).groupBy(key).agg(F.countDistinct("batch_id").alias("batches"), F.count(r).alias("n"), F.sum(r).alias("total"), F.sum(r * r).alias("squares"), recent.alias("rate"))
    mean, sd = mean_sd(F.col("n"), F.col("total"), F.col("squares"))
    placed = batches.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("inserted_at"), F.desc("batch_id")))).filter(F.col("_n") <= versions)
    lists = placed.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "batch_id"))), lambda x: x["batch_id"].cast("string")), ",").alias("versions"))
    return found.select(key, "batches", "n", mean.alias("mean"), sd.alias("sd"), "rate").join(lists, key)
