"""Periodic runs of words: lags with enough matches, found by counting, then scanned for islands.

A run is a maximal stretch of words that are the same some q words apart, q its smallest period, of at least three
periods and 24 words.  How often a text's words recur at each lag is counted exactly: by autocorrelation (FFT) of the
places of words that are frequent in it, by differences of pairs of places for the others.  A run of period q needs
max(24 - q, 2 q) matches in a row at lag q, so only lags with that many are scanned, and of those only cells around
places, one in that many, that match.

Texts are independent: rows stay where they were read and nothing is shuffled.  A null text has no words; ids may be null
or repeated; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .simhash import xxh64

#: Words and periods that a run has at least.
WORDS, PERIODS = 24, 3
#: Places that are tested or scanned at a time.
AT_ONCE = 1 << 18
#: What calling a transform costs, in eighths of a pair.
FFT_CALL = 1 << 17


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of these lengths, each item's list and its place in it."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def numbered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word: equal words, equal numbers.  Hashes are compared with their first word's bytes."""
    sizes = ends - starts
    _, first, number = np.unique(xxh64(buf, starts, sizes), return_index=True, return_inverse=True)
    same = sizes[first[number]] == sizes
    at = 0
    while same.all() and at < len(starts):
        to = min(len(starts), at + AT_ONCE)
        mine, _ = C.slices(buf, starts[at:to], sizes[at:to])
        other, _ = C.slices(buf, starts[first[number[at:to]]], sizes[at:to])
        same[at] = np.array_equal(mine, other)
        at = to
    if same.all():
        return number
    names: dict[bytes, int] = {}
    return np.array([names.setdefault(buf[a:b].tobytes(), len(names)) for a, b in zip(starts, ends, strict=True)], np.int64)


def lag_counts(word: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words of each text are the same as the one q after them, for q up to a third of the text.

    word: the words' numbers, text after text, which end at cuts[1:].  Returns the counts, and where each text's begin
    (that of lag 0 first).
    """
    n = np.diff(cuts)
    most = n // PERIODS
    base = np.zeros(len(n) + 1, np.int64)
    np.cumsum(most + 1, out=base[1:])
    counts = np.zeros(base[-1], np.int64)
    if not len(word):
        return counts, base[:-1]
    text, place = ragged(n)
    key = text * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    key, text, place = key[order], text[order], place[order]
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[begins, len(key)])
    wide = np.exp2(np.ceil(np.log2(np.maximum(2, n + most))))
    heavy = 8.0 * sizes * sizes > (wide * np.log2(wide) + FFT_CALL)[text[begins]]
    few = np.flatnonzero(heavy)
    for mine in np.split(few, np.flatnonzero(np.diff(text[begins[few]])) + 1) if len(few) else ():
        t = text[begins[mine[0]]]
        power, mark = 0.0, np.zeros(n[t])
        for g in mine:
            at = place[begins[g] : begins[g] + sizes[g]]
            mark[at] = 1.0
            power += np.abs(np.fft.rfft(mark, int(wide[t]))) ** 2
            mark[at] = 0.0
        counts[base[t] : base[t + 1]] += np.rint(np.fft.irfft(power, int(wide[t]))[: most[t] + 1]).astype(np.int64)
    after = np.repeat(begins + sizes, sizes)
    left, step = np.flatnonzero(np.repeat(~heavy, sizes)), 1
    while len(left):
        left = left[left + step < after[left]]
        lag = place[left + step] - place[left]
        near = lag <= most[text[left]]
        left, lag = left[near], lag[near]  # the next ones are further away still
        if len(left):
            at = base[text[left]] + lag
            if len(at) * 8 > len(counts):
                counts += np.bincount(at, minlength=len(counts))
            else:
                np.add.at(counts, at, 1)
        step += 1
    return counts, base[:-1]


def islands(word: np.ndarray, cuts: np.ndarray, text: np.ndarray, lag: np.ndarray) -> list[np.ndarray]:
    """text, start, length, lag of all maximal stretches that repeat at a lag, long enough for a run."""
    need = np.maximum(WORDS - lag, (PERIODS - 1) * lag)
    places = cuts[text + 1] - cuts[text] - lag
    tests = -(-places // need)
    found = []
    off = np.r_[0, np.cumsum(tests)]
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(off, off[at] + AT_ONCE, "right")) - 1)
        pair, n = ragged(tests[at:to])
        pair += at
        i = cuts[text[pair]] + n * need[pair]
        hit = word[i] == word[i + lag[pair]]
        cell = np.unique(np.concatenate([off[pair[hit]] + n[hit], (off[pair] + n - 1)[hit & (n > 0)]]))
        at = to
        if not len(cell):
            continue
        pair = np.searchsorted(off, cell, "right") - 1
        first = (cell - off[pair]) * need[pair]
        sizes = np.minimum(need[pair], places[pair] - first)
        joined = np.r_[False, (cell[1:] == cell[:-1] + 1) & (pair[1:] == pair[:-1])]
        # whole rows of cells that touch, as many as may be scanned at once
        rows = np.r_[np.flatnonzero(~joined), len(cell)]
        done = 0
        total = np.r_[0, np.cumsum(sizes)]
        while done < len(rows) - 1:
            end = max(done + 1, int(np.searchsorted(total[rows], total[rows[done]] + AT_ONCE, "right")) - 1)
            a, z = rows[done], rows[end]
            c, k = ragged(sizes[a:z])
            c += a
            k += first[c]
            i = cuts[text[pair[c]]] + k
            same = word[i] == word[i + lag[pair[c]]]
            edge = np.zeros(len(same), bool)
            edge[total[rows[done:end]] - total[a]] = True
            begins = np.flatnonzero(same & (edge | ~np.r_[False, same[:-1]]))
            ends = np.flatnonzero(same & (np.r_[edge[1:], True] | ~np.r_[same[1:], False]))
            long = ends - begins + 1 >= need[pair[c[begins]]]
            p = pair[c[begins[long]]]
            found.append(np.stack([text[p], k[begins[long]], (ends - begins)[long] + 1 + lag[p], lag[p]]))
            done = end
    return found


def runs(word: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """All runs, as rows text, start, length, period, by text, start and period."""
    counts, base = lag_counts(word, cuts)
    text, lag = ragged(np.diff(np.r_[base, len(counts)]))
    some = np.flatnonzero((lag > 0) & (counts >= np.maximum(WORDS - lag, (PERIODS - 1) * lag)))
    found = islands(word, cuts, text[some], lag[some])
    rows = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    # a stretch that repeats at a lag and at its multiples has the smallest for its period
    fresh = np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)][: rows.shape[1]]
    rows = rows[:, fresh]
    return rows[:, np.lexsort((rows[3], rows[1], rows[0]))].T


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins."""
    sizes = ends - starts
    off = np.r_[0, np.cumsum(sizes + 1)]
    out = np.full(off[-1], 32, np.uint8)
    for at in range(0, len(starts), AT_ONCE):
        to = min(len(starts), at + AT_ONCE)
        data, _ = C.slices(buf, starts[at:to], sizes[at:to])
        out[off[at] + np.arange(len(data)) + np.repeat(np.arange(to - at), sizes[at:to])] = data
    return out, off


def _strongest(a, b) -> int:
    """By length / period, largest first, then start, then period."""
    return int(b[1]) * int(a[2]) - int(a[1]) * int(b[2]) or int(a[0] - b[0]) or int(a[2] - b[2])


def _found(digests: bool):
    """A map of batches: last column the texts, in its place the runs and the collapsed texts, or their digests."""

    def run(batches):
        for batch in batches:
            buf, off = C.flat(batch.columns[-1])
            starts, ends, cuts = C.words_of(buf, off)
            word = numbered(buf, starts, ends) if len(starts) else np.zeros(0, np.int64)
            rows = runs(word, cuts)
            gone = np.zeros(len(word) + 1, np.int64)
            np.add.at(gone, cuts[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
            np.add.at(gone, cuts[rows[:, 0]] + rows[:, 1] + rows[:, 2], -1)
            kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
            out, at = joined(buf, starts[kept], ends[kept])
            edges = np.searchsorted(kept, cuts)
            mine = np.searchsorted(rows[:, 0], np.arange(len(cuts)))
            lists, columns = [rows[a:b, 1:] for a, b in zip(mine[:-1], mine[1:], strict=True)], []
            texts = [memoryview(out)[at[a] : max(at[a], at[b] - 1)] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            if digests:
                best = [min(x, key=cmp_to_key(_strongest)) if len(x) else None for x in lists]
                pick = lambda f, best=best: pa.array([None if x is None else f(*map(int, x)) for x in best], pa.int64())
                said = ["".join(f"{s},{n},{q}\n" for s, n, q in x.tolist()) for x in lists]
                columns = [pa.array([len(x) for x in lists], pa.int64()), pick(lambda s, n, q: s), pick(lambda s, n, q: n), pick(lambda s, n, q: q), pick(lambda s, n, q: 1000 * n // q)]
                columns += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in said], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
            else:
                told = [[{"start": s, "length": n, "period": q} for s, n, q in x.tolist()] for x in lists]
                columns = [pa.array(told, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), pa.array([bytes(x).decode() for x in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([*map(C.loose, batch.columns[:-1]), *columns], [*batch.schema.names[:-1], *(DIGESTS if digests else ("runs", "collapsed"))])

    return run


DIGESTS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (by start, then period), collapsed (the words that no run has after its first period) of every row."""
    C.prepare(df.sparkSession)
    return C.rows_of(df, id_col, text_col).mapInArrow(C.lean_map(_found(False)), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find_runs() in numbers: n_runs, the run of most periods (start, length, period, exponent_milli) and digests."""
    C.prepare(df.sparkSession)
    kinds = ", ".join(f"{name} {'string' if 'sha' in name else 'long'}" for name in DIGESTS)
    return C.rows_of(df, id_col, text_col).mapInArrow(C.lean_map(_found(True)), f"doc_id long, {kinds}")


def with_cycles(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's ids and texts, a tenth of them (crc32 of the id) made periodic from some word on.

    With g = crc32 div 10 and n words, those from a = g mod n on repeat the 1 + (n - a) div (3 + g mod 8) that come there.
    Texts without words and rows without id stay as they are.
    """
    crc = F.crc32(F.col("doc_id").cast("string"))
    rows = C.rows_of(df, id_col, text_col).withColumn("h", F.coalesce(crc, F.lit(1)))
    listed = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, listed))
    rows = rows.withColumns({"n": F.size("words"), "g": F.expr("h div 10")})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    turned = F.array_join(F.transform("words", lambda w, i: F.get("words", at(i))), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), turned).otherwise(F.col("text")).alias("text"))
