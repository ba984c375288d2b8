"""Health, progress, time left, and what the reapers pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import fold

#: Fixed values, in seconds.
STALL, SLOW, ORPHAN = 300, 3600, 1800


def batch_health(age: Column, polled_ago: Column) -> Column:
    never = F.when(age >= STALL, "no_poll_yet").otherwise("healthy")
    return F.when(polled_ago.isNull(), never).when(polled_ago > STALL, "stalled").otherwise("healthy")


def experiment_health(status: Column, waited: Column, beat_ago: Column, elapsed: Column, stuck: Column, alive: Column, accepted: Column, flowing: Column) -> Column:
    running = (
        F.when(beat_ago > STALL, "stalled")
        .when((elapsed > STALL) & stuck, F.when(alive, "idle").otherwise("paused"))
        .when((accepted == 0) & (elapsed > SLOW) & flowing, "slow")
        .otherwise("healthy")
    )
    return F.when(status == "pending", F.when(waited >= STALL, "idle").otherwise("healthy")).when(status == "running", running).otherwise("unknown")


def eta(dispatched: Column, n_bits: int, n_dispatched: Column, done: Column, pending: Column, rate: Column) -> Column:
    """Minutes' worth of seconds left at a rate per minute; null with nothing pending or no rate."""
    more = F.when((n_dispatched > 0) & (n_dispatched < n_bits), F.round((F.lit(n_bits) - n_dispatched) * dispatched / F.when(n_dispatched > 0, n_dispatched))).otherwise(0.0)
    left = F.greatest(dispatched + more.cast("bigint") - done, F.lit(0))
    return F.when((pending > 0) & (rate > 0), F.floor(left * 60 / F.when(rate > 0, rate)))


def progress(cegar: Column, it: Column, max_iters: Column, rounds: Column) -> Column:
    return F.greatest(F.lit(0), (cegar - 1) * max_iters + (it - 1)) / (rounds * max_iters)


def inactive(workers: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    late = (F.col("status") == "active") & (F.col("last_heartbeat_at") < as_of - F.make_interval(secs=F.lit(seconds)))
    return workers.withColumn("status", F.when(late, "inactive").otherwise(F.col("status")))


def stalled(experiments: DataFrame, live: DataFrame, as_of: Column, seconds: int = ORPHAN) -> DataFrame:
    """Active experiments not updated for long that no live job belongs to."""
    active = experiments.filter(F.col("status").isin("pending", "running"))
    old = active.filter(F.col("updated_at") < as_of - F.make_interval(secs=F.lit(seconds)))
    return old.join(live, "experiment_id", "left_anti")


def orphans(batches: DataFrame, ended: DataFrame) -> DataFrame:
    return batches.filter(F.col("status").isin("pending", "running")).join(ended, "experiment_id", "left_semi")


def unowned(batches: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    """Active batches of no experiment that were never polled, or long ago."""
    old = F.col("polled_at").isNull() | (F.col("polled_at") < as_of - F.make_interval(secs=F.lit(seconds)))
    return batches.filter(F.col("experiment_id").isNull() & F.col("status").isin("pending", "running") & old)


#: Workers whose end for good fails their experiment.
MASTERS = ("ExperimentBootstrap", "ExperimentController")
#: Fixed values, in seconds: idle time that counts as a pause while no worker is there, as a stall, and a batch's most.
GRACE, TIMEOUT, DEADLINE = 30, 7200, 30 * 86400


def discarded(jobs: DataFrame, experiments: DataFrame, masters: tuple = MASTERS) -> DataFrame:
    """An event for each job that ran out of attempts: job_id, experiment_id, message.

    jobs: job_id, worker, state, attempt, reason, experiment_id.  A master's job fails its experiment (and says so) unless
    that has ended or isn't known; other workers' jobs are events without an experiment.
    """
    gone = jobs.filter(F.col("state") == "discard").withColumn("reason", F.substring("reason", 1, 500))
    master = F.col("worker").isin(*masters)
    open_ = experiments.filter(~F.col("status").isin("completed", "cancelled")).select("experiment_id")
    failed = gone.filter(master).join(open_, "experiment_id", "left_semi")
    text = F.concat("worker", F.lit(" failed after "), F.col("attempt").cast("string"), F.lit(" attempts: "), "reason")
    others = gone.filter(~master)
    return failed.select("job_id", "experiment_id", text.alias("message")).unionByName(others.select("job_id", F.lit(None).cast("bigint").alias("experiment_id"), F.concat("worker", F.lit(" job exhausted retries: "), "reason").alias("message")))


def mark_failed(experiments: DataFrame, events: DataFrame) -> DataFrame:
    """experiments with those that an event names failed, under the last event's message."""
    last = events.filter(F.col("experiment_id").isNotNull()).groupBy("experiment_id").agg(F.max_by("message", "job_id").alias("_message"))
    joined = experiments.join(last, "experiment_id", "left")
    return joined.withColumn("status", F.when(F.col("_message").isNotNull(), "failed").otherwise(F.col("status"))).withColumnRenamed("_message", "error")


def stall_clock(ticks: DataFrame, key: str, grace: int = GRACE, timeout: int = TIMEOUT, deadline: int = DEADLINE) -> DataFrame:
    """What a batch's polls come to: key, verdict (running, stalled or deadline), pauses.

    ticks: key, at (seconds), progressed, live (some worker can take its chunks).  Without progress for longer than the
    grace and without a worker the clock stands still just past the grace; with one it runs on to the timeout.  Only the
    state goes along a batch's ticks, of any number.
    """
    kind = dict(ticks.dtypes)[key]
    rows = ticks.select(F.col(key).alias("k"), F.col("at").cast("bigint").alias("at"), "progressed", "live")

    def step(state, row):
        first, clock, verdict, pauses = state
        _, at, progressed, live = row
        if verdict == "running":
            if at - first > deadline:
                verdict = "deadline"
            elif at - clock > grace and not live:
                clock, pauses = at - grace - 1, pauses + 1
            elif at - clock > timeout:
                verdict = "stalled"
            elif progressed:
                clock = at
        return (first, clock, verdict, pauses), None

    return fold(rows, "k", ["at", "progressed", "live"], lambda row: (row[1], row[1], "running", 0), step, f"{key} {kind}, verdict string, pauses bigint", lambda k, s: (k, s[2], s[3]))
