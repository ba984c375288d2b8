"""Which windows of a corpus may occur twice, without moving the texts.

Every window of fixed length selects the least hash among the grams inside it.  Consecutive windows mostly
select the same one: a *run* is a stretch of windows of one text that share it, and its hash is its key.
Equal windows always have equal keys, wherever they stand, so a key that a single place has rules out all
the windows of its run.  Blocks of rows send their distinct keys (48 bits, compressed) to buckets of keys;
a bucket answers each block with one bit a key: seen again, or not.  False hits only cost further work.

A block sends a bucket at most one message, and none without a key, so that there are never more messages than the
blocks' distinct keys, however many blocks and buckets there are.  A key that a third of all rows have is sent once a
block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

MESSAGE = "block int, bucket int, kind int, body binary"


@dataclass
class Runs:
    """Parallel arrays: key, first window, number of windows, text number; again: a window may repeat inside."""

    key: np.ndarray
    start: np.ndarray
    count: np.ndarray
    row: np.ndarray
    again: np.ndarray


def split_runs(least: np.ndarray, row: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of valid windows with equal least hash and text."""
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.ones(len(least) + 1, bool)
    edge[1:-1] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])
    at = np.flatnonzero(edge)
    starts, counts = at[:-1], np.diff(at)
    keep = valid[starts]
    return starts[keep], counts[keep]


def key_of(least: np.ndarray) -> np.ndarray:
    return C.mix(least.copy()) >> np.uint64(16)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def message(block: int, kind: int, bodies: dict[int, bytes]) -> pa.Table:
    n = len(bodies)
    return pa.table({"block": pa.array([block] * n, pa.int32()), "bucket": pa.array(list(bodies), pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "body": pa.array(list(bodies.values()), pa.binary())})


def cuts(sorted_keys: np.ndarray, buckets: int):
    """(bucket, from, to) of each bucket that some of the sorted keys fall in."""
    which = bucket_of(sorted_keys, buckets)
    if not len(which):
        return []
    at = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
    return [(int(which[a]), int(a), int(b)) for a, b in zip(at, [*at[1:], len(which)], strict=True)]


def distinct(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, for each run the place of its key, and the order that sorts the runs."""
    order = np.argsort(runs.key, kind="stable")
    key = runs.key[order]
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return key[new], place, order


def offer(block: int, runs: Runs, rank: np.ndarray | None, buckets: int) -> pa.Table:
    """The block's keys; flagged where two of its own runs can hold equal windows (of other ids, if rank has them)."""
    keys, place, order = distinct(runs)
    if not len(keys):
        return message(block, 0, {})
    first = np.flatnonzero(np.diff(place[order], prepend=-1))
    if rank is None:
        own = np.diff(np.append(first, len(order))) > 1
    else:
        own = np.minimum.reduceat(rank[order], first) != np.maximum.reduceat(rank[order], first)
    own |= np.logical_or.reduceat(runs.again[order], first)
    return message(block, 0, {k: C.squeeze(keys[a:b], np.packbits(own[a:b])) for k, a, b in cuts(keys, buckets)})


def answer(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block a bit a key it sent, set if another block has it or the block's flag is."""
    blocks, parts = table["block"].to_pylist(), [C.expand(x, np.uint64, np.uint8) for x in table["body"].to_pylist()]
    sizes = [len(k) for k, _ in parts]
    keys = np.concatenate([k for k, _ in parts])
    own = np.concatenate([np.unpackbits(f, count=n).astype(bool) for (_, f), n in zip(parts, sizes, strict=True)])
    order = np.argsort(keys, kind="stable")
    key = keys[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    counts = np.diff(np.append(first, len(key)))
    hit = (counts > 1) | np.logical_or.reduceat(own[order], first)
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(hit, counts)
    ends = np.cumsum(sizes)
    bucket = int(table["bucket"][0].as_py())
    bodies = [np.packbits(out[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
    n = len(blocks)
    return pa.table({"block": pa.array(blocks, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "kind": pa.array([0] * n, pa.int32()), "body": pa.array(bodies, pa.binary())})


def candidates(runs: Runs, messages: pa.Table, buckets: int) -> np.ndarray:
    """Numbers of the runs whose key was seen again."""
    keys, place, _ = distinct(runs)
    hit = np.zeros(len(keys), bool)
    said = {b: body for b, k, body in zip(messages["bucket"].to_pylist(), messages["kind"].to_pylist(), messages["body"].to_pylist(), strict=True) if k == 0}
    for k, a, b in cuts(keys, buckets):
        hit[a:b] = np.unpackbits(np.frombuffer(said[k], np.uint8), count=b - a)
    return np.flatnonzero(hit[place])


def settled_messages(rows: DataFrame, offered, sent, settled) -> DataFrame:
    """Three rounds between blocks of rows and buckets of keys; all that the buckets say, by block.

    offered(table) and answer(): which keys are seen again; sent(texts, messages): the runs that have them,
    by bucket; settled(table): what a bucket finds.
    """
    seen = rows.groupBy("block").applyInArrow(C.lean(offered), MESSAGE).groupBy("bucket").applyInArrow(C.lean(answer), MESSAGE)
    found = rows.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(C.lean_pair(sent), MESSAGE).groupBy("bucket").applyInArrow(C.lean(settled), MESSAGE)
    return seen.unionByName(found)


def exchange(rows: DataFrame, offered, sent, settled, finished, schema) -> DataFrame:
    """These rounds, and finished(texts, messages): the result of a block."""
    said = settled_messages(rows, offered, sent, settled)
    return rows.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(C.lean_pair(finished), schema)
