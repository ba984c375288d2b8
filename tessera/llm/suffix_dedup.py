"""Removal of bytes that a document of smaller id already has, in matches of a fixed length.

Windows that may repeat are found by their anchors (see anchors.py) and only those travel.  In a bucket,
equal stretches collapse; the suffixes of those that differ are sorted by bucket-pointer refinement: eight
bytes give each suffix its first bucket, and a bucket of suffixes that agree on d bytes is refined by the
bucket identifiers d bytes further on, so that each round reuses all that the last one found (8, 16, 32
bytes, then the full length).  A suffix alone in its bucket is done.  Suffixes of one last bucket share the
whole window; the least id of a bucket decides for all in it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors as A
from . import common as C

LENGTH = 50
GRAM = 16
#: Windows whose hashes are made at a time.
STEP = 1 << 20
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def eights(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one integer, zeros after the end."""
    n = len(b)
    padded = np.concatenate([b, np.zeros(16, np.uint8)])
    out = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        k = len(range(r, n, 8))
        out[r::8] = padded[r : r + 8 * k].view("<u8")
    return out


def byte_runs(buf: np.ndarray, off: np.ndarray, length: int = LENGTH) -> A.Runs:
    found = []
    n, gram = len(buf), min(GRAM, length)
    for a in range(0, n - length + 1, STEP):
        z = min(n, a + STEP + length - 1)
        row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(np.clip(off, a, z)))
        g = eights(buf[a:z])
        h = g[: len(g) - gram + 1] * _M1
        if gram == 16:
            h ^= g[8 : 8 + len(h)] * _M2
        h ^= h >> np.uint64(29)
        h *= _M3
        h ^= h >> np.uint64(32)
        least = C.sliding_min(h, length - gram + 1)
        k = len(least)
        starts, counts = A.split_runs(least, row[:k], row[:k] == row[length - 1 : length - 1 + k])
        found.append((A.key_of(least[starts]), starts + a, counts, row[starts]))
    cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int32)]
    return A.Runs(*cols, np.zeros(len(cols[0]), bool))


def ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks, and whether each value occurs again."""
    order = np.argsort(values)
    v = values[order]
    new = np.append(True, v[1:] != v[:-1]) if len(v) else np.zeros(0, bool)
    rank = np.empty(len(v), np.int64)
    rank[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    shared = np.empty(len(v), bool)
    shared[order] = np.repeat(np.diff(np.append(first, len(v))) > 1, np.diff(np.append(first, len(v))))
    return rank, shared


def window_groups(buf: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that occur again in the texts of a flat buffer, and the group each is in.

    Bucket-pointer refinement: pointer[p] is the bucket of the suffix at p, among those that agree on its
    first `depth` bytes; -1 where the suffix is alone (no window from there can occur again).
    """
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(buf))  # bytes to the text's end
    depth = min(8, length)
    live = np.flatnonzero(left >= depth)
    g = eights(buf)[live]
    if depth < 8:
        g &= np.uint64((1 << 8 * depth) - 1)
    pointer = np.full(len(buf), -1, np.int64)
    rank, shared = ranks(g)
    live = live[shared]
    pointer[live] = rank[shared]
    while depth < length:
        ahead = min(depth, length - depth)
        live = live[left[live] >= depth + ahead]
        later = pointer[live + ahead]
        live, later = live[later >= 0], later[later >= 0]
        rank, shared = ranks(pointer[live].astype(np.uint64) << np.uint64(32) | later.astype(np.uint64))
        pointer[:] = -1
        live = live[shared]
        pointer[live] = rank[shared]
        depth += ahead
    return live, pointer[live]


class Block:
    """The rows of a block in a fixed order, and the runs of their windows."""

    def __init__(self, table: pa.Table, length: int):
        table = C.in_order(table)
        self.buf, self.off = C.flat(table["text"])
        self.ids = C.ids_of(table["doc_id"])
        self.runs = byte_runs(self.buf, self.off, length)

    def collapse(self, picked: np.ndarray, length: int):
        """Distinct stretches of the picked runs, sorted by key: keys, first runs, bytes, and each picked run's place."""
        runs = self.runs
        text, off = C.slices(self.buf, runs.start[picked], runs.count[picked] + length - 1)
        coded = C.binary(text, off).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        first = np.empty(len(coded.dictionary), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        order = np.argsort(runs.key[picked][first], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return runs.key[picked][first][order], first[order], text, off, place[code]


def _block(table: pa.Table) -> int:
    return int(table["block"][0].as_py())


def _offered(length, buckets):
    def run(table):
        block = Block(table, length)
        return A.offer(_block(table), block.runs, np.unique(block.ids, return_inverse=True)[1][block.runs.row], buckets)

    return run


def _sent(length, buckets):
    def run(texts, messages):
        if not texts.num_rows or not messages.num_rows:
            return A.message(0, 0, {})
        block = Block(texts, length)
        picked = A.candidates(block.runs, messages, buckets)
        keys, first, text, off, _ = block.collapse(picked, length)
        ids = block.ids[block.runs.row[picked[first]]]  # rows go by id, so the first has the least
        out = {}
        for k, a, b in A.cuts(keys, buckets):
            part, _ = C.slices(text, off[first[a:b]], np.diff(off)[first[a:b]])
            out[k] = C.squeeze(keys[a:b], ids[a:b], np.diff(off)[first[a:b]].astype(np.int32), part)
        return A.message(_block(texts), 1, out)

    return run


def least_ids(keys: np.ndarray, ids: np.ndarray, text: np.ndarray, off: np.ndarray, length: int):
    """Stretches of windows (text number, first, count, least id): together all windows of all texts."""
    coded = C.binary(text, off).dictionary_encode()
    code, n = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
    order = np.lexsort((ids, code))
    first = order[np.flatnonzero(np.diff(code[order], prepend=-1))]  # of each distinct text, where its id is least
    windows = np.diff(off)[first] - length + 1
    by_key = np.argsort(keys[first], kind="stable")
    key = keys[first][by_key]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    several = np.repeat(np.diff(np.append(edge, n)) > 1, np.diff(np.append(edge, n)))
    single = by_key[~several]
    parts = [(single, np.zeros(len(single), np.int64), windows[single], ids[first][single])]
    some = by_key[several]
    if len(some):
        # whole keys, a few MB of text at a time
        size = np.cumsum(np.diff(off)[first[some]])
        new = np.flatnonzero(np.append(True, keys[first[some]][1:] != keys[first[some]][:-1]))
        at = 0
        while at < len(some):
            over = np.searchsorted(size, (size[at - 1] if at else 0) + (4 << 20), "right")
            later = new[new > at]
            fit = later[later <= over]
            to = int(fit[-1]) if len(fit) else int(later[0]) if len(later) else len(some)
            to = len(some) if over >= len(some) else to
            mine = some[at:to]
            sub, sub_off = C.slices(text, off[first[mine]], np.diff(off)[first[mine]])
            starts, group = window_groups(sub, sub_off, length)
            own = np.repeat(ids[first[mine]], windows[mine])
            base = np.zeros(len(mine) + 1, np.int64)
            np.cumsum(windows[mine], out=base[1:])
            if len(starts):
                which = np.searchsorted(sub_off, starts, "right") - 1
                at_window = base[which] + starts - sub_off[which]
                o = np.lexsort((own[at_window], group))
                head = np.flatnonzero(np.diff(group[o], prepend=-1))
                own[at_window[o]] = np.repeat(own[at_window[o]][head], np.diff(np.append(head, len(o))))
            text_no = np.repeat(np.arange(len(mine)), windows[mine])
            cut = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (text_no[1:] != text_no[:-1])))
            parts.append((mine[text_no[cut]], cut - base[text_no[cut]], np.diff(np.append(cut, len(own))), own[cut]))
            at = to
    which, start, count, least = (np.concatenate(x) for x in zip(*parts, strict=True))
    return code, which, start, count, least


def expand_by(which: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (item, stretch) whose distinct text is the same: code of items, which of stretches."""
    order = np.argsort(which, kind="stable")
    first = np.searchsorted(which[order], np.arange(n + 1))
    many = np.diff(first)[code]
    item = np.repeat(np.arange(len(code)), many)
    step = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    return item, order[first[code[item]] + step]


def _settled(length):
    def run(table):
        blocks, parts = table["block"].to_pylist(), [C.expand(x, np.uint64, np.int64, np.int32, np.uint8) for x in table["body"].to_pylist()]
        keys, ids, sizes, text = (np.concatenate(x) for x in zip(*parts, strict=True))
        off = np.append(0, np.cumsum(sizes, dtype=np.int64))
        code, which, start, count, least = least_ids(keys, ids, text, off, length)
        item, stretch = expand_by(which, code, int(code.max()) + 1)
        less = least[stretch] < ids[item]
        item, stretch = item[less], stretch[less]
        ends = np.cumsum([len(p[0]) for p in parts])
        bounds, out = np.searchsorted(item, [0, *ends]), []
        for k, block in enumerate(blocks):
            a, b = bounds[k], bounds[k + 1]
            if b > a:
                s = stretch[a:b]
                out.append((block, C.squeeze((item[a:b] - (ends[k - 1] if k else 0)).astype(np.int32), start[s].astype(np.int32), count[s].astype(np.int32), least[s])))
        n, bucket = len(out), int(table["bucket"][0].as_py())
        return pa.table({"block": pa.array([x[0] for x in out], pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "kind": pa.array([1] * n, pa.int32()), "body": pa.array([x[1] for x in out], pa.binary())})

    return run


def covered(size: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of size positions some stretch covers."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def _finished(length, buckets, texts_too):
    def run(texts, messages):
        if not texts.num_rows:
            return None
        block = Block(texts, length)
        buf, off, runs = block.buf, block.off, block.runs
        starts = lengths = np.zeros(0, np.int64)
        picked = A.candidates(runs, messages, buckets) if messages.num_rows else starts
        if len(picked):
            keys, first, _, _, place = block.collapse(picked, length)
            own = block.ids[runs.row[picked]]
            local = own[first][place] < own  # the block itself has the stretch under a smaller id
            starts, lengths = [runs.start[picked][local]], [runs.count[picked][local]]
            said = {b: body for b, k, body in zip(messages["bucket"].to_pylist(), messages["kind"].to_pylist(), messages["body"].to_pylist(), strict=True) if k == 1}
            found = [(x[0] + a, *x[1:]) for k, a, _ in A.cuts(keys, buckets) if k in said for x in [C.expand(said[k], np.int32, np.int32, np.int32, np.int64)]]
            if found:
                item, start, count, least = (np.concatenate(x) for x in zip(*found, strict=True))
                run_no, which = expand_by(item, place, len(keys))
                less = least[which] < own[run_no]
                starts.append(runs.start[picked][run_no[less]] + start[which[less]])
                lengths.append(count[which[less]])
            starts, lengths = np.concatenate(starts), np.concatenate(lengths)
        gone = covered(len(buf), starts, lengths + length - 1)
        before = np.append(np.int32(0), np.cumsum(gone, dtype=np.int32))
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        inner = off[:-1][np.diff(off) > 0]
        head[inner] = gone[inner]
        heads = np.append(np.int32(0), np.cumsum(head, dtype=np.int32))
        kept, left = buf[~gone], off - before[off]
        digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(left[:-1], left[1:], strict=True)]
        out = {"doc_id": C.ids_back(block.ids), "n_bytes": np.diff(off), "n_removed": np.diff(before[off]).astype(np.int64), "n_spans": np.diff(heads[off]).astype(np.int64), "kept_sha256": pa.array(digests, pa.string())}
        if texts_too:
            out["kept"] = C.binary(kept, left).cast(pa.binary())
        return pa.table(out)

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_bytes: int = C.BLOCK_BYTES, texts: bool = True) -> DataFrame:
    """One row per row of df: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if
    texts are asked for, kept (the remaining bytes).

    Texts are UTF-8 bytes, a null text is empty.  A byte goes if a window of `length` bytes covers it that
    also starts in a row of smaller id; rows of equal id never outrank each other and a null id comes after
    all others.  An empty table gives an empty result.  Other columns of df are ignored.
    """
    C.prepare(df.sparkSession)
    rows = C.rows_of(df, id_col, text_col)
    blocks = C.block_count(rows, "text", block_bytes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return A.exchange(C.in_blocks(rows, blocks), _offered(length, blocks), _sent(length, blocks), _settled(length), _finished(length, blocks, texts), schema)
