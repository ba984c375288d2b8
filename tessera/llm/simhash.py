"""SimHash near-dedup with Golay-code fuzzy keys.

A text's fingerprint has a bit for each of 64: set if over half of its word shingles' hashes have it set.
The fingerprint's three segments (22, 21 and 21 bits) are words of the perfect binary Golay code (23,12,7):
every word is within three bits of one codeword, whose 12-bit index is the word's key.  The keys of all
words one bit away, at most six different ones with its own, find what lies near: a word one bit off has its
own key among them, and two words two bits apart share one (that of the word between them).

With at most four bits wrong over three segments, either two segments have one wrong bit at most, or the
errors are (2, 2, 0) in some order.  So a fingerprint gives, for each pair of segments, its own pair of keys
(3 rows) and all pairs of near keys (up to 108), and for each segment the bits as they are with the near keys
of the next (up to 18).  Fingerprints that meet are compared in full.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components
from .exact_dedup import by_bytes
from .suffix_dedup import eights

SHINGLE = 4
BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR = 0xAE3
#: Bytes of key rows that one bucket should hold.
BUCKET_BYTES = 6 << 20
#: Shingles hashed at a time.
STEP = 1 << 16

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEED = np.uint64(42)


def _rotl(x, r):
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lanes: np.ndarray | None = None) -> np.ndarray:
    """XXH64 with seed 42 of many pieces of a buffer.  lanes: eights(buf)."""
    lanes = eights(buf) if lanes is None else lanes
    acc = np.full(len(starts), _SEED + _P5)
    at, left = starts.copy(), lengths.copy()
    long_ = np.flatnonzero(lengths >= 32)
    if len(long_):
        v = [np.full(len(long_), x) + _SEED for x in (_P1, _P2, np.uint64(0), ~_P1 + np.uint64(1))]
        v[0] += _P2
        todo = np.arange(len(long_))
        while len(todo):
            p = at[long_[todo]]
            for k in range(4):
                v[k][todo] = _round(v[k][todo], lanes[p + 8 * k])
            at[long_[todo]] += 32
            left[long_[todo]] -= 32
            todo = todo[left[long_[todo]] >= 32]
        total = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for k in range(4):
            total = (total ^ _round(np.uint64(0), v[k])) * _P1 + _P4
        acc[long_] = total
    acc += lengths.astype(np.uint64)
    todo = np.flatnonzero(left >= 8)
    while len(todo):
        acc[todo] = _rotl(acc[todo] ^ _round(np.uint64(0), lanes[at[todo]]), 27) * _P1 + _P4
        at[todo] += 8
        left[todo] -= 8
        todo = todo[left[todo] >= 8]
    todo = np.flatnonzero(left >= 4)
    acc[todo] = _rotl(acc[todo] ^ (lanes[at[todo]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
    at[todo] += 4
    left[todo] -= 4
    todo = np.flatnonzero(left)
    while len(todo):
        acc[todo] = _rotl(acc[todo] ^ buf[at[todo]].astype(np.uint64) * _P5, 11) * _P1
        at[todo] += 1
        left[todo] -= 1
        todo = todo[left[todo] > 0]
    acc ^= acc >> np.uint64(33)
    acc *= _P2
    acc ^= acc >> np.uint64(29)
    acc *= _P3
    return acc ^ acc >> np.uint64(32)


def fingerprints(buf: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text of a flat buffer."""
    starts, ends, before = C.words_of(buf, off)
    lens = ends - starts + 1
    norm, at = C.slices(np.append(buf, np.uint8(0x20)), starts, lens)
    norm = C.LOWER[norm]
    norm[at[1:] - 1] = 0x20
    words = np.diff(before)
    many = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    base = np.append(0, np.cumsum(many))
    row = np.repeat(np.arange(len(words)), many)
    first = before[row] + np.arange(base[-1]) - base[row]
    last = first + np.minimum(words[row], shingle)
    counts = np.zeros((len(words), 64), np.int64)
    for a in range(0, len(row), STEP):
        s, e, r = at[first[a : a + STEP]], at[last[a : a + STEP]] - 1, row[a : a + STEP]
        lo, hi = int(s[0]), int(e.max())
        h = xxh64(norm[lo:hi], s - lo, e - s)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.flatnonzero(np.diff(r, prepend=-1))
        counts[r[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    over = (2 * counts > many[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)


_GOLAY: list[np.ndarray] = []


def _golay() -> list[np.ndarray]:
    """Remainders of the high and the low bits, and by remainder the error of at most three bits."""
    if not _GOLAY:
        single = []
        for i in range(23):
            r = 1 << i
            for k in range(22, 10, -1):
                r ^= (r >> k & 1) * (GENERATOR << (k - 11))
            single.append(r)
        high, low, error = np.zeros(4096, np.int32), np.zeros(2048, np.int32), np.zeros(2048, np.int32)
        for i in range(23):
            part, k = (low, i) if i < 11 else (high, i - 11)
            part ^= np.where(np.arange(len(part)) >> k & 1, single[i], 0).astype(np.int32)
        for n in range(1, 4):
            for bits in combinations(range(23), n):
                s = 0
                for i in bits:
                    s ^= single[i]
                error[s] = sum(1 << i for i in bits)
        _GOLAY.extend((high, low, error))
    return _GOLAY


def codeword(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword nearest to each 23-bit word."""
    high, low, error = _golay()
    return (words ^ error[high[words >> 11] ^ low[words & 2047]]) >> 11


def near_keys(words: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of all different keys of each word and of the words one of its `width` bits away."""
    keys = np.sort(np.stack([codeword(words)] + [codeword(words ^ (1 << i)) for i in range(width)], axis=1), axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    row, col = np.nonzero(new)
    return row, keys[row, col]


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the fingerprint, probe) rows; rows of a key need comparing unless all of them are probes."""
    parts = [((fps >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    own = [codeword(p) for p in parts]
    near = [near_keys(p, n) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
    n, out = np.arange(len(fps)), []
    for t, (x, y) in enumerate(((0, 1), (1, 2), (0, 2))):
        out.append((t << 40 | own[x] << 12 | own[y], n, False))
        first = np.searchsorted(near[y][0], np.arange(len(fps) + 1))
        many = np.diff(first)[near[x][0]]
        left = np.repeat(np.arange(len(near[x][0])), many)
        right = first[near[x][0][left]] + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
        out.append((t << 40 | near[x][1][left] << 12 | near[y][1][right], near[x][0][left], True))
    for t, (x, y) in enumerate(((0, 1), (1, 2), (2, 0)), 3):
        out.append((t << 40 | parts[x][near[y][0]] << 12 | near[y][1], near[y][0], False))
    return tuple(np.concatenate(x) for x in zip(*((k, i, np.full(len(k), p)) for k, i, p in out), strict=True))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches over links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return root
        root = new


#: Five bands of a fingerprint: two that differ in at most four bits agree in one of them.
BANDS = [np.uint64(((1 << n) - 1) << a) for a, n in ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))]


def banded_pairs(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """near_pairs() of different fingerprints that all share a key: only those that agree in a band are compared."""
    key = np.concatenate([C.mix((values & mask) + np.uint64(k)) for k, mask in enumerate(BANDS)])
    who = np.tile(np.arange(len(values)), len(BANDS))
    order = np.argsort(key, kind="stable")
    a, b = near_pairs(key[order], values[who[order]], np.zeros(len(key), bool), bits, banded=True)
    return who[order][a], who[order][b]


def near_pairs(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, bits: int, banded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rows, sorted by key, that share a key and differ in at most `bits` bits; enough to connect them."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(head, len(key)))
    useful = (size > 1) & ~np.logical_and.reduceat(probe, head)
    left, right = [], []
    small = np.flatnonzero(np.repeat(useful & (size <= 64), size))
    lag = 1
    while len(small):
        small = small[small + lag < len(key)]
        small = small[key[small] == key[np.minimum(small + lag, len(key) - 1)]]
        hit = np.bitwise_count(fp[small] ^ fp[small + lag]) <= bits
        left.append(small[hit])
        right.append(small[hit] + lag)
        lag += 1
    for h, n in zip(head[useful & (size > 64)], size[useful & (size > 64)], strict=True):
        # a crowded key: its different fingerprints by bands, then by strips, reduced to what connects them
        values, first = np.unique(fp[h : h + n], return_index=True)
        if not banded:
            pairs = [banded_pairs(values, bits)]
        else:
            pairs = []
            for s in range(0, len(values), 256):
                i, j = np.nonzero(np.bitwise_count(values[s : s + 256, None] ^ values[None, s:]) <= bits)
                pairs.append((i[j > i] + s, j[j > i] + s))
        for i, j in pairs:
            root = forest(i, j, len(values))
            moved = np.flatnonzero(root != np.arange(len(values)))
            left.append(h + first[moved])
            right.append(h + first[root[moved]])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _fingerprinted(shingle):
    def run(batches):
        for batch in batches:
            for part, buf, off in by_bytes(batch, 1 << 20):
                C.trim()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(fingerprints(buf, off, shingle).view(np.int64))], ["doc_id", "text_hash", "fp"])

    return run


def _keyed(buckets):
    def run(batches):
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(every), 2048):
                fps = every[a : a + 2048]
                key, row, probe = fuzzy_keys(fps)
                which = (C.mix(key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((fps[row], which))
                which, key, row, probe = which[order], key[order], row[order], probe[order]
                cut = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
                bodies = [C.squeeze(key[i:j].astype(np.uint64), fps[row[i:j]], probe[i:j].astype(np.uint8)) for i, j in zip(cut, [*cut[1:], len(which)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(which[cut], pa.int32()), pa.array(bodies, pa.binary())], ["bucket", "body"])

    return run


def _linked(bits):
    def run(table):
        parts = [C.expand(x, np.uint64, np.uint64, np.uint8) for x in table["body"].to_pylist()]
        key, fp, probe = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((probe, key))
        key, fp, probe = key[order], fp[order], probe[order].astype(bool)
        a, b = near_pairs(key, fp, probe, bits)
        nodes, at = np.unique(np.concatenate([fp[a], fp[b]]), return_inverse=True)
        root = forest(at[: len(a)], at[len(a) :], len(nodes))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"a": pa.array(nodes[moved].view(np.int64)), "b": pa.array(nodes[root[moved]].view(np.int64))})

    return run


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, buckets: int | None = None) -> DataFrame:
    """One row per row of df: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Words are runs of bytes other than ASCII white space with A-Z in lower case; a text of fewer words than a
    shingle is one shingle, one without words (or null) has fingerprint zero.  Rows link if their fingerprints
    differ in at most `bits` (up to 4) bits; component_id is the smallest id that a row reaches, null ids being
    left out unless there is no other.  An empty table gives an empty result; other columns are ignored.
    """
    found = _grouped(df, id_col, text_col, shingle, bits, buckets)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(df, id_col, text_col, shingle=SHINGLE, bits=BITS, buckets=None) -> DataFrame:
    """doc_id, text_hash, fp, component_id of each row."""
    if not 0 <= bits <= 4:
        raise ValueError("the keys find fingerprints of at most 4 different bits")
    C.prepare(df.sparkSession)
    rows = C.rows_of(df, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    found = C.written(rows.mapInArrow(C.lean_map(_fingerprinted(shingle)), "doc_id long, text_hash long, fp long"), "fingerprints")
    total = found.count()
    # copies are one fingerprint from here on
    nodes = C.written(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "nodes")
    # a fingerprint's rows are up to 129 keys of some 17 bytes; a bucket is to hold a few MB of them
    buckets = buckets or max(C.slots(df.sparkSession), total * 129 * 17 // BUCKET_BYTES)
    links = nodes.select("fp").mapInArrow(C.lean_map(_keyed(buckets)), "bucket int, body binary").groupBy("bucket").applyInArrow(C.lean(_linked(bits)), "a long, b long")
    roots = components(links)
    labelled = C.written(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "components")
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("weight"))
    known = C.join_to(labelled.select("fp", "root", "rows"), least, "root", total).select("fp", "component_id", F.col("rows").alias("weight"))
    return C.join_to(found, C.written(known, "known"), "fp", total)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """df without the rows that a near copy of smaller id stands for; rows without id stay, as do all rows of a
    component that have its smallest id.  An empty table stays empty.

    Only rows whose id and text's hash may be in the list of those that go are shuffled.
    """
    goes = _grouped(df, id_col, text_col, **named).filter("doc_id != component_id")
    listed = C.written(goes.select(F.xxhash64("doc_id", "text_hash").alias("key"), "doc_id", "text_hash").distinct(), "near-copies")
    row_id, text_hash = F.col(id_col).cast("bigint"), F.xxhash64(F.col(text_col).cast("string"))
    rows = C.may_hold(C.packed(df, key=F.xxhash64(row_id, text_hash), doc_id=row_id, text_hash=text_hash), "key", listed.select("key"))
    stays = rows.filter("may").join(listed, ["key", "doc_id", "text_hash"], "left_anti")
    return rows.filter("NOT may").select("row.*").unionByName(stays.select("row.*"))
