"""Chunking, claiming, completing and cancelling batches of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .numbering import MOST, numbered

PAGE = 500
CHUNK = 10
#: Job states that a cancelled batch's jobs leave.
WAITING = ("available", "retryable", "scheduled")


def chunk_plan(items: DataFrame, batch: str, order: str, size: int = CHUNK, most: int = MOST) -> DataFrame:
    """A row per chunk: batch, chunk_index, chunk_id, items (in order).  A batch of more than `most` items is numbered in
    as many tasks as it fills."""
    placed = numbered(items.select(F.col(batch).alias("batch_id"), F.col(order).alias("item")), "batch_id", ["item"], most)
    cut = placed.select("batch_id", "item", (F.col("number") - 1).alias("pos")).withColumn("chunk_index", F.expr(f"CAST(pos DIV {size} AS int)"))
    chunks = cut.groupBy("batch_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("x"))
    return chunks.select("batch_id", "chunk_index", F.concat(F.col("batch_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("x.item").alias("items"))


def submit(batches: DataFrame, items: DataFrame, size: int = CHUNK, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """What submitting leaves: the batches' rows (batch_id, total_chunks, status) and their chunks, as chunk_plan() has them.

    batches: batch_id and refused (its chunks can't be inserted); items: batch_id and item.  A batch without items is
    completed at once, a refused one is failed and has no chunks, the others are pending.
    """
    n = items.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    total = F.ceil(F.coalesce("n", F.lit(0)) / size).cast("bigint")
    counted = batches.join(n, "batch_id", "left").withColumn("total_chunks", total)
    status = F.when(F.col("total_chunks") == 0, "completed").when(F.col("refused"), "failed").otherwise("pending")
    rows = counted.withColumn("status", status)
    taken = items.join(rows.filter("status = 'pending'").select("batch_id"), "batch_id", "left_semi")
    return rows.select("batch_id", "total_chunks", "status"), chunk_plan(taken, "batch_id", "item", size, most)


def first_delivery(results: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert if absent: of each key's deliveries the first."""
    return results.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """What `new` adds to `existing`: the first of each key that is not there."""
    return first_delivery(new, keys, order).join(existing, keys, "left_anti")


def assemble(items: DataFrame, total: int, key: str = "batch_id") -> DataFrame:
    """Chunks whose items have all arrived: key, n, items in order of idx."""
    got = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "reward"))).alias("items"), F.count(F.lit(1)).alias("n"))
    return got.filter(F.col("n") >= total)


def pad(results: DataFrame, keys: DataFrame, total: int, key: str = "batch_id") -> DataFrame:
    """All of 0..total-1 for each key: what is missing becomes an error row."""
    slots = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("idx"))
    joined = slots.join(results.withColumn("_there", F.lit(True)), [key, "idx"], "left")
    return joined.withColumn("error", F.when(F.col("_there").isNull(), "missing result from oracle")).drop("_there")


def page(results: DataFrame, batch, after: int, size: int = PAGE) -> DataFrame:
    """Keyset page: the next chunks of a batch after an index."""
    return results.filter((F.col("batch_id") == batch) & (F.col("chunk_index") > after)).orderBy("chunk_index").limit(size)


def page_size(value, default: int = PAGE, most: int = 1000) -> int:
    """A request's limit: what is no integer from 1 to most becomes the default."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        return default
    return n if 1 <= n <= most else default


def reassemble(primary: DataFrame, legacy: DataFrame, key: str = "batch_id") -> DataFrame:
    """Items of batches in chunk order; batches that the primary lacks come from the legacy table."""
    rest = legacy.join(primary.select(key).distinct(), key, "left_anti")
    return primary.unionByName(rest).select(key, "chunk_index", F.posexplode("items").alias("pos", "item"))


def claim(jobs: DataFrame, capabilities: list[str] | None = None, k: int = 1) -> DataFrame:
    """Fair share: the k next jobs, batches taking turns; with capabilities, what the worker prefers first.

    A batch's jobs are ranked inside the batch and only its first k can be claimed, so the sort is small.
    """
    if capabilities is not None:
        caps = F.array(*map(F.lit, capabilities))
        adapter = F.coalesce("adapter", F.lit("mujoco"))
        jobs = jobs.filter(F.array_contains(caps, adapter)).withColumn("pref", F.array_position(caps, adapter))
    else:
        jobs = jobs.withColumn("pref", F.lit(1).cast("bigint"))
    rn = F.row_number().over(Window.partitionBy("batch_id").orderBy("scheduled_at", "id"))
    return jobs.withColumn("rn", rn).filter(F.col("rn") <= k).orderBy("pref", "priority", "rn", "id").limit(k)


def claim_all(jobs: DataFrame, workers: DataFrame, default: str = "mujoco", most: int = MOST) -> DataFrame:
    """What all workers' free slots get at once: worker_id, slot, pref, id.

    jobs: id, batch_id, priority, scheduled_at, adapter; workers: worker_id, slots, capabilities (preferred ones first).
    Slots claim in turn, all workers' first ones, then the second ones; a claim gets the next job of the first of its
    capabilities that has one left, in order of priority, place in the batch, id.  That is claiming one by one, found by
    deferred acceptance: claims ask for what they prefer, an adapter holds the earliest as far as its jobs go, the others
    ask for what they prefer next.  As all adapters prefer earlier claims, there are no more rounds than adapters, and one.
    """
    queued = jobs.select("id", "batch_id", "priority", "scheduled_at", F.coalesce("adapter", F.lit(default)).alias("adapter"))
    queued = numbered(queued.withColumn("_batch", F.struct("adapter", "batch_id")), "_batch", ["scheduled_at", "id"], most, "rn")
    queued = written(numbered(queued.select("adapter", "priority", "rn", "id"), "adapter", ["priority", "rn", "id"], most, "place"), "job-queue")
    room = queued.groupBy("adapter").agg(F.count(F.lit(1)).alias("room"))
    every = F.explode(F.sequence(F.lit(0), F.col("slots").cast("int") - 1))
    claims = workers.filter("slots > 0").select("worker_id", F.array_distinct("capabilities").alias("capabilities"), every.alias("slot")).withColumn("pref", F.lit(1))
    while True:
        asked = claims.withColumn("adapter", F.get("capabilities", F.col("pref") - 1)).filter("adapter IS NOT NULL")
        held = numbered(asked, "adapter", ["slot", "worker_id"], most, "place").join(room, "adapter", "left")
        held = written(held.withColumn("held", F.coalesce(F.col("place") <= F.col("room"), F.lit(False))), "claims")
        if held.filter("NOT held").isEmpty():
            return held.join(queued.select("adapter", "place", "id"), ["adapter", "place"]).select("worker_id", "slot", "pref", "id")
        claims = held.select("worker_id", "capabilities", "slot", (F.col("pref") + F.when(F.col("held"), 0).otherwise(1)).alias("pref"))


def cancel(batches: DataFrame, jobs: DataFrame, owners: DataFrame, also_executing: bool = False) -> tuple[DataFrame, DataFrame]:
    """Batches of the owners that are active, and their waiting jobs, turned to cancelled."""
    hit = batches.filter(F.col("status").isin("pending", "running")).join(owners, "experiment_id", "left_semi").select("batch_id")
    states = WAITING + (("executing",) if also_executing else ())
    marked = hit.withColumn("_hit", F.lit(True))
    b = batches.join(marked, "batch_id", "left").withColumn("status", F.when(F.col("_hit"), "cancelled").otherwise(F.col("status"))).drop("_hit")
    j = jobs.join(marked, "batch_id", "left").withColumn("state", F.when(F.col("_hit") & F.col("state").isin(*states), "cancelled").otherwise(F.col("state"))).drop("_hit")
    return b, j


def rescue(jobs: DataFrame, as_of: Column, seconds: int = 180) -> DataFrame:
    """Jobs that have been executing for longer than a lease become available."""
    late = (F.col("state") == "executing") & (F.col("attempted_at") < as_of - F.make_interval(secs=F.lit(seconds)))
    return jobs.withColumn("state", F.when(late, "available").otherwise(F.col("state")))


def paused(series: DataFrame, key: str, at: str, level: str, high: float, low: float) -> DataFrame:
    """Back-pressure with hysteresis: paused from above `high` until at or below `low`."""
    mark = F.when(F.col(level) > high, F.lit(True)).when(F.col(level) <= low, F.lit(False))
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("paused", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))


def split_names(name: str, n: int, most: int = 50_000) -> list[tuple[str, int, int]]:
    """Sub-batches (name, from, to) of at most `most` candidates; one keeps the name."""
    if n <= most:
        return [(name, 0, n)]
    return [(f"{name}-part{i}", a, min(n, a + most)) for i, a in enumerate(range(0, n, most))]


def split_batches(batches: DataFrame, name: str, n: str, most: int = 50_000) -> DataFrame:
    """split_names() for a table: sub-batches (name, first, last) of at most `most` candidates; one keeps the name."""
    parts = F.greatest(F.ceil(F.col(n) / most), F.lit(1)).cast("bigint")
    rows = batches.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    own = F.when(F.col(n) <= most, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-part"), F.col("part").cast("string")))
    return rows.select(own.alias("name"), (F.col("part") * most).alias("first"), F.least(F.col(n).cast("bigint"), (F.col("part") + 1) * most).alias("last"))


def complete(jobs: DataFrame, deliveries: DataFrame, keys: list[str], order: list) -> DataFrame:
    """deliveries with `outcome`: not_found without a job, already_completed if its job is or an earlier delivery was
    first, else completed.  jobs: keys and state."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    told = deliveries.withColumn("_first", first).join(jobs.select(*keys, F.col("state").alias("_state")), keys, "left")
    outcome = F.when(F.col("_state").isNull(), "not_found").when((F.col("_state") == "completed") | ~F.col("_first"), "already_completed").otherwise("completed")
    return told.withColumn("outcome", outcome).drop("_first", "_state")
