"""Structured-streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deliveries(stream: DataFrame, keys: list[str], at: str = "arrived", late: str = "1 hour") -> DataFrame:
    """Chunk deliveries, each key's first within the watermark; repeats are dropped (at-least-once to once)."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def running_summary(stream: DataFrame, key: str = "batch_id") -> DataFrame:
    """Running aggregates per batch, for output mode update or complete."""
    r = F.col("reward")
    return stream.groupBy(key).agg(F.max(r).alias("best"), F.count(r).alias("n"), F.sum(r).alias("total"), F.sum(r * r).alias("squares"), F.max("arrived").alias("last_at"))


def windowed(stream: DataFrame, at: str, keys: list[str], width: str = "60 seconds", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling or sliding windows of event time, with a watermark."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, at: str, keys: list[str], gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Stretches of progress without a gap: a stall ends one."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("session"), *keys).agg(F.count(F.lit(1)).alias("n"))


def assembled(stream: DataFrame, timeout_ms: int = 300_000) -> DataFrame:
    """Chunks of results as they become whole: a row chunk_id, n, reward, error.

    stream: chunk_id, total, idx, reward.  State is an index to reward map as two lists; a repeated index counts
    once.  A chunk that gets nothing for timeout_ms is given up: what came goes out with an error.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        idxs, rewards, total = state.get if state.exists else ([], [], 0)
        idxs, rewards = list(idxs), list(rewards)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"chunk_id": [key[0]], "n": [len(idxs)], "reward": [float(sum(rewards))], "error": ["missing result from oracle"]})
            return
        known = set(idxs)
        for b in batches:
            for i, r, n in zip(b["idx"], b["reward"], b["total"], strict=True):
                total = int(n)
                if i not in known:
                    known.add(i)
                    idxs.append(int(i))
                    rewards.append(float(r))
        if total and len(idxs) >= total:
            state.remove()
            yield pd.DataFrame({"chunk_id": [key[0]], "n": [len(idxs)], "reward": [float(sum(rewards))], "error": [None]})
        else:
            state.update((idxs, rewards, total))
            state.setTimeoutDuration(timeout_ms)

    return stream.groupBy("chunk_id").applyInPandasWithState(step, "chunk_id string, n long, reward double, error string", "idxs array<int>, rewards array<double>, total int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def insert_absent_sink(path: str, keys: list[str], order: list[str | Column], by: str | None = None):
    """For foreachBatch: append what the table at path lacks; a replayed batch adds nothing.

    `by` names a text column that a key always has the same value of (the day a chunk was made, say): the table is laid out
    by it, and a batch reads only the folders of its own values instead of the whole history.
    """
    from ..operators.queue import first_delivery

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = first_delivery(batch, keys, order)
        try:
            there = spark.read.schema(batch.schema).parquet(path)
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            there = None
        if there is not None and by:
            there = there.filter(F.col(by).isin([r[0] for r in batch.select(by).distinct().collect()]))  # a batch's days
        new = first.join(there.select(*keys), keys, "left_anti") if there is not None else first
        out = new.write.mode("append")
        (out.partitionBy(by) if by else out).parquet(path)

    return write


def snapshots(stream: DataFrame, name: str, seconds: float = 1.0):
    """Start a query whose latest complete result is the table `name`; a failing tick leaves the old one."""
    return stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(processingTime=f"{seconds} seconds").start()


class Progress(StreamingQueryListener):
    """Counts of batches and rows, as telemetry."""

    def __init__(self):
        self.batches, self.rows, self.failures = 0, 0, []

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        self.batches += 1
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        if event.exception:
            self.failures.append(event.exception)


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet as a stream with back-pressure: so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
