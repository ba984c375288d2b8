"""Stateful streams with state of their own shape: rates over rings, chunks that are padded when they close."""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..storage import shared_dir, ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
MISSING = "missing result from oracle"


class Rates(StatefulProcessor):
    """A key's samples of the last `seconds` as a list, its last one, and a timer that drops both when nothing came for
    `idle` seconds.  A sample below the one before it begins a new list."""

    def __init__(self, seconds: int, per: float, idle: int):
        self.span, self.per, self.idle = seconds * 1_000_000, per, idle * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "at long, total double")
        self.last = handle.getValueState("last", "at long, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = sorted((int(a), int(i), float(t)) for b in rows for a, i, t in zip(b["at"], b["id"], b["total"], strict=True))
        ring, last = list(self.ring.get()) if self.ring.exists() else [], self.last.get()
        said, first = [], 0
        for at, sample, total in fresh:
            if last is not None and at < last[0]:
                continue  # older than what counts already
            if last is not None and last[1] > total:
                ring, first = [], 0
            last = (at, total)
            ring.append(last)
            while ring[first][0] < at - self.span:
                first += 1
            took, gained = (at - ring[first][0]) / 1e6, total - ring[first][1]
            said.append((key[0], sample, int(_rounded(gained * self.per / took)) if took > 0 else 0, False))
        self.ring.put(ring[first:])
        self.last.update(last)
        due = last[0] // 1000 + self.idle
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        self.handle.registerTimer(due)
        yield pd.DataFrame(said, columns=["key", "id", "rate", "evicted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.ring.clear()
        self.last.clear()
        yield pd.DataFrame([(key[0], -1, 0, True)], columns=["key", "id", "rate", "evicted"])

    def close(self) -> None:
        pass


def _rounded(x: float) -> float:
    """Half away from zero."""
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(x)).quantize(Decimal(1), ROUND_HALF_UP))


class Assembly(StatefulProcessor):
    """A chunk's items by index, first ones first, until all have come or the chunk is `wait` seconds old; then it goes out
    whole, an error for each index that lacks, and what comes later counts no more.

    A key is a part of all chunks, so that a call and its state serve many of them; its timer is that of its oldest open one.
    State: of the chunks id, total, first time, closed; of their items the chunk's place among them, index, reward.
    """

    def __init__(self, wait: int):
        self.wait = wait * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "packed binary, due long")

    def _close(self, chunks: list, items: list, which: np.ndarray, before: int | None) -> Iterator[pd.DataFrame]:
        """The rows of the chunks that close now; the others are held, with a timer for the oldest instead of the one before."""
        ids, total, first, closed = chunks
        chunk, idx, reward = items
        size, goes = np.where(which, total, 0).clip(0), which[chunk]
        start = np.cumsum(size) - size
        given, known = np.full(size.sum(), np.nan), np.zeros(size.sum(), bool)
        at = start[chunk[goes]] + idx[goes]
        given[at], known[at] = reward[goes], True
        closed = closed | which
        due = None if closed.all() else (int(first[~closed].min()) + self.wait) // 1000
        self.held.update((pickle.dumps(((ids, total, first, closed), (chunk[~goes], idx[~goes], reward[~goes]))), due))
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        if len(known):
            yield pd.DataFrame({"chunk_id": ids.repeat(size), "idx": np.arange(len(known)) - start.repeat(size), "reward": given, "error": np.where(known, None, MISSING)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = None
        for b in rows:
            packs = [pickle.loads(p) for p in b["packed"]] + ([fresh] if fresh is not None else [])
            fresh = _firsts([np.concatenate(x) for x in zip(*packs, strict=True)])
        named, at, idx, reward, total = fresh
        held = self.held.get()
        chunks, items = pickle.loads(held[0]) if held is not None else ([named[:0], total[:0], at[:0], np.zeros(0, bool)], [idx[:0], idx[:0], reward[:0]])
        n = len(chunks[0])
        chunk, ids = pd.factorize(np.concatenate([chunks[0], named]))
        chunk = chunk[n:]
        begins = np.zeros(len(ids), int)
        begins[chunk[::-1]] = np.arange(len(chunk))[::-1]
        begins = begins[n:]
        chunks = [ids, np.concatenate([chunks[1], total[begins]]), np.concatenate([chunks[2], at[begins]]), np.concatenate([chunks[3], np.zeros(len(begins), bool)])]
        counts = ~chunks[3][chunk] & (at <= chunks[2][chunk] + self.wait) & (idx >= 0) & (idx < chunks[1][chunk])
        items = [np.concatenate(two) for two in zip(items, (chunk[counts], idx[counts], reward[counts]), strict=True)]
        once = np.unique((items[0] << 32) + items[1], return_index=True)[1]
        items = [x[once] for x in items]
        whole = ~chunks[3] & (np.bincount(items[0], minlength=len(ids)) >= chunks[1])
        yield from self._close(chunks, items, whole, held[1] if held is not None else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        chunks, items = pickle.loads(self.held.get()[0])
        old = (chunks[2] + self.wait) // 1000 <= timerValues.getCurrentWatermarkInMs()
        yield from self._close(chunks, items, ~chunks[3] & old, None)  # the timer that has expired goes by itself

    def close(self) -> None:
        pass


def _firsts(rows: list) -> list:
    """chunk_id, at, idx, reward, total in order of time, of each index of a chunk the first: of an index only the first
    can count, and a chunk's first row is the first of its index."""
    order = np.lexsort((rows[4], rows[3], rows[2], rows[1]))
    pair = (pd.factorize(rows[0][order])[0].astype(np.int64) << 32) + rows[2][order]
    order = order[np.sort(np.unique(pair, return_index=True)[1])]
    return [x[order] for x in rows]


#: Rows that a task packs at a time.
PACK = 1 << 18


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same part as one: the last time, and what of them can count."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= PACK:
            yield from _pack(held)
            held, n = [], 0
    if n:
        yield from _pack(held)


def _pack(held: list) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).to_pandas()
    last = rows.groupby("part")["at"].max()
    first = _firsts([rows[c].to_numpy() for c in ("chunk_id", "at", "idx", "reward", "total", "part")])
    order = np.argsort(first[5], kind="stable")
    first = [x[order] for x in first]
    cuts = [0, *(np.flatnonzero(np.diff(first[5])) + 1).tolist(), len(order)]
    for k in range(0, len(last), 1024):
        few = last.iloc[k : k + 1024]
        packed = [pickle.dumps([x[i:j] for x in first[:5]]) for i, j in itertools.pairwise(cuts[k : k + 1025])]
        yield pa.RecordBatch.from_arrays([pa.array(few.index, pa.int32()), pa.array(few.to_numpy(), pa.timestamp("us", "UTC")), pa.array(packed, pa.binary())], ["part", "arrived", "packed"])


def rates(stream: DataFrame, key: str, at: str, sample: str, total: str, seconds: int, per: float, idle: int, late: str = "0 seconds") -> DataFrame:
    """A row (key, id, rate, evicted) per sample: the growth of its key's running total over the last `seconds`, per
    `per` seconds; and one when a key is dropped, which is when event time is `idle` seconds past its last sample.

    Samples of a micro-batch are taken in order of time; one that is older than its key's last in an earlier batch counts
    no more.
    """
    ship(stream.sparkSession)
    rows = stream.select(F.col(key).alias("key"), F.col(at).alias("time"), F.unix_micros(at).alias("at"), F.col(sample).cast("bigint").alias("id"), F.col(total).cast("double").alias("total"))
    kind = dict(rows.dtypes)["key"]
    return rows.withWatermark("time", late).groupBy("key").transformWithStateInPandas(Rates(seconds, per, idle), f"key {kind}, id bigint, rate bigint, evicted boolean", "append", "eventTime")


def assembled(stream: DataFrame, wait: int, late: str = "0 seconds", parts: int = 1024) -> DataFrame:
    """A row (chunk_id, idx, reward, error) for each index of a chunk that is whole or closed.

    stream: chunk_id, total (the chunk's own), idx, reward, arrived.  Of an index that comes twice the first counts; an
    index that is no chunk's is left out.  The chunks are dealt by a hash into `parts`, each with one state: a micro-batch
    reads and writes those of the parts that it has rows for.  A task sends a part's rows as one, which is late if all are;
    a late row that comes with others still counts for a chunk that is open.  A row without an index only tells its chunk's
    time; one without a chunk, total or time is left out.
    """
    ship(stream.sparkSession)
    told = stream.filter("chunk_id IS NOT NULL AND total IS NOT NULL AND arrived IS NOT NULL")
    rows = told.select(F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part"), "chunk_id", F.unix_micros("arrived").alias("at"), F.col("total").cast("int").alias("total"), F.coalesce(F.col("idx").cast("int"), F.lit(-1)).alias("idx"), F.col("reward").cast("double").alias("reward"))
    kind = dict(rows.dtypes)["chunk_id"]
    packs = rows.mapInArrow(_packs, "part int, arrived timestamp, packed binary")
    return packs.withWatermark("arrived", late).groupBy("part").transformWithStateInPandas(Assembly(wait), f"chunk_id {kind}, idx int, reward double, error string", "append", "eventTime")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream has now, through a query that stops at its end, as a table in the shared folder."""
    spark = stream.sparkSession
    top = shared_dir(spark, name)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{top}/rows").option("checkpointLocation", f"{top}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/rows")


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table (a file or a folder of Parquet) as a stream, times as timestamps."""
    schema = spark.read.parquet(path).schema
    # as a pattern, since a stream's plain path must be a folder
    rows = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema))
