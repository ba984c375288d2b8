"""Exact dedup by composable polynomial fingerprints, checked chunk by chunk.

A text is cut into 64 KB chunks.  Each chunk gets the polynomial sum(byte+1 times base^position) modulo two
primes; the chunks' values combine as H(xy) = H(x) + base^len(x) * H(y), so chunks may be hashed anywhere and
in any order: a huge text's pieces are hashed by many tasks.  Texts of equal length and fingerprint are then compared
as streams of pieces, so that a collision can't drop a document and no task holds whole texts.

1. A pass over the texts groups (fingerprint, length) and keeps those seen twice as a bitmap of a fixed size.
2. A second pass lets the text of a row travel only if the bitmap has its fingerprint, and once for each
   distinct text that a task has seen: of a group of copies, however large, a task sends one.
3. Pieces of texts of equal fingerprints meet in order and part the texts that differ; each sent text learns its
   group's survivor and size.
4. Rows learn it from the text that stood for them, over a key that no more than one task's rows share.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

CHUNK = 1 << 16
#: Primes below 2^31, so that a byte times a residue, summed over a chunk, stays below 2^55.
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003_337, 786_433_117)
#: Bytes of a piece of a text that travels, and of a text that one task doesn't hash by itself.
PIECE, HUGE = 1 << 20, 8 << 20
#: Bits of the map of fingerprints seen twice: 8 MB whatever the input; a full map only sends more texts.
BITMAP_BITS = 26
#: Bytes of texts that a task remembers to recognise further copies.
REMEMBERED = 8 << 20

_POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    if not _POWERS:
        for p, base in zip(PRIMES, BASES, strict=True):
            table = np.ones(CHUNK + 1, np.uint64)
            n = 1
            while n <= CHUNK:
                m = min(n, CHUNK + 1 - n)
                table[n : n + m] = table[:m] * np.uint64(pow(base, n, p)) % np.uint64(p)
                n += m
            _POWERS.append(table)
    return _POWERS


def combine(left: tuple[int, int], right: tuple[int, int], left_length: int) -> tuple[int, int]:
    """The residues of the concatenation, from those of its two parts."""
    return tuple((a + pow(base, left_length, p) * b) % p for a, b, p, base in zip(left, right, PRIMES, BASES, strict=True))


def fingerprints(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One int64 for each text of a flat buffer: both residues side by side."""
    lengths = np.diff(off)
    chunks = -(-lengths // CHUNK)
    first = np.zeros(len(chunks) + 1, np.int64)
    np.cumsum(chunks, out=first[1:])
    starts = np.repeat(off[:-1] - first[:-1] * CHUNK, chunks) + np.arange(first[-1]) * CHUNK
    out = np.zeros((2, len(lengths)), np.int64)
    if len(starts):
        sizes = np.diff(np.append(starts, off[-1]))
        position = np.arange(len(buf)) - np.repeat(starts, sizes)
        values = buf.astype(np.uint64) + np.uint64(1)
        for k, (p, base, table) in enumerate(zip(PRIMES, BASES, powers(), strict=True)):
            part = (np.add.reduceat(values * table[position], starts) % np.uint64(p)).astype(np.int64)
            full = chunks > 0
            out[k, full] = part[first[:-1][full]]
            shift = pow(base, CHUNK, p)
            for i in np.flatnonzero(chunks > 1):  # Horner over the chunks, the last one first
                total = 0
                for x in part[first[i] : first[i + 1]][::-1]:
                    total = (int(x) + shift * total) % p
                out[k, i] = total
    return out[0] << 31 | out[1]


def by_bytes(table: pa.RecordBatch, most: int = 4 << 20):
    """The batch in pieces of some MB of text, with bytes and offsets."""
    buf, off = C.flat(table.column("text"))
    at = 0
    while at < table.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield table.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def split(fp: int) -> tuple[int, int]:
    return fp >> 31, fp & (1 << 31) - 1


def _hash_only(batches):
    for batch in batches:
        for _, buf, off in by_bytes(batch):
            yield pa.RecordBatch.from_arrays([pa.array(fingerprints(buf, off)), pa.array(np.diff(off))], ["fp", "n"])


def _hash_pieces(batches):
    for batch in batches:
        buf, off = C.flat(batch.column("bytes"))
        yield pa.RecordBatch.from_arrays([batch.column("sha256"), batch.column("n"), batch.column("piece"), pa.array(fingerprints(buf, off)), pa.array(np.diff(off))], ["sha256", "n", "piece", "fp", "size"])


def _combine(table: pa.Table) -> pa.Table:
    """A huge text's fingerprint from those of its pieces."""
    table = table.sort_by("piece")
    total, length = (0, 0), 0
    for fp, size in zip(table["fp"].to_pylist(), table["size"].to_pylist(), strict=True):
        total, length = combine(total, split(fp), length), length + size
    return pa.table({"sha256": table["sha256"][:1], "n": table["n"][:1], "fp": pa.array([total[0] << 31 | total[1]], pa.int64())})


def _pieces(data, n):
    """(piece, bytes) of a binary column of n bytes; one empty piece if it has none."""
    cuts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.floor((n - 1) / PIECE), F.lit(0).cast("bigint")))
    return F.posexplode(F.transform(cuts, lambda i: F.substring(data, (i * PIECE + 1).cast("int"), F.lit(PIECE)))).alias("piece", "bytes")


def _sender(bitmap):
    """Rows with fingerprints; a row whose fingerprint occurs again names the sent text that equals its own."""

    def run(batches):
        from pyspark import TaskContext

        bits, top = np.frombuffer(bitmap.value, np.uint8), TaskContext.get().partitionId()
        known: OrderedDict = OrderedDict()
        held = sent = 0
        for batch in batches:
            for part, buf, off in by_bytes(batch):
                fp, n = fingerprints(buf, off), np.diff(off)
                slot = fp & ((1 << BITMAP_BITS) - 1)
                again = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1) > 0
                digests, texts, reps = [], [], []
                for i, (a, b, hit) in enumerate(zip(off[:-1], off[1:], again, strict=True)):
                    text = memoryview(buf[a:b])
                    digests.append(hashlib.sha256(text).hexdigest())
                    texts.append(None)
                    reps.append(None)
                    if not hit:
                        continue
                    key = (int(fp[i]), int(n[i]), digests[-1])
                    found = known.get(key)
                    if found and found[1] == text:
                        known.move_to_end(key)
                        reps[-1] = found[0]
                        continue
                    reps[-1], texts[-1] = f"{top}-{sent}", bytes(text)
                    sent += 1
                    known[key] = reps[-1], texts[-1]
                    held += len(texts[-1]) + 200
                    while held > REMEMBERED and len(known) > 1:
                        held -= len(known.popitem(last=False)[1][1]) + 200
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp), pa.array(n), pa.array(digests, pa.string()), pa.array(reps, pa.string()), pa.array(texts, pa.binary())], ["doc_id", "fp", "n", "sha256", "rep", "body"])

    return run


def _settle(batches):
    """Sent texts and the first that each equals.  Pieces come by fingerprint, length, piece and text: of each piece only
    what differs among texts that were equal so far is held."""
    group, piece, labels, variants = None, None, {}, {}
    for batch in batches:
        out: list[tuple] = []
        keys = zip(batch.column("fp").to_pylist(), batch.column("n").to_pylist(), strict=True)
        for key, number, rep, data in zip(keys, batch.column("piece").to_pylist(), batch.column("rep").to_pylist(), batch.column("bytes"), strict=True):
            if key != group:
                out += labels.items()
                group, piece, labels = key, None, {}
            if number != piece:
                piece, variants = number, {}
            labels[rep] = variants.setdefault((labels.get(rep), data.as_py()), rep)
        if out:
            yield _pairs(out)
    if labels:
        yield _pairs(list(labels.items()))


def _pairs(rows):
    rep, member = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(rep, pa.string()), pa.array(member, pa.string())], ["rep", "member"])


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = C.BLOCK_BYTES, huge: int = HUGE) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty.  The row with the largest id stays; a
    null id is smaller than all.  Of repeated rows (same id, same text) one is kept.  An empty table gives an
    empty result.  Other columns of df are ignored.
    """
    spark = df.sparkSession
    C.prepare(spark)
    rows = C.rows_of(df, id_col, text_col)
    blocks = C.block_count(rows, "text", block_bytes)
    long_ = F.coalesce(F.octet_length("text") > huge, F.lit(False))
    some, large = rows.filter(~long_), rows.filter(long_)
    # huge texts: pieces anywhere, one of each a task, put together by their text's digest; a row is told by the task
    # that read it, so that no more than a task's rows share a key
    named = large.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("n"), F.col("text").cast("binary").alias("data"))
    cut = named.select("sha256", "n", _pieces(F.col("data"), F.col("n"))).dropDuplicates(["sha256", "n", "piece"])
    hashed = cut.mapInArrow(_hash_pieces, "sha256 string, n long, piece int, fp long, size long")
    combined = C.written(hashed.groupBy("sha256", "n").applyInArrow(_combine, "sha256 string, n long, fp long"), "huge")
    large = C.written(named.select("doc_id", "sha256", "n", F.concat_ws("-", "sha256", F.spark_partition_id()).alias("rep")).join(combined, ["sha256", "n"]), "huge-rows")
    every = some.mapInArrow(C.lean_map(_hash_only), "fp long, n long").unionByName(large.select("fp", "n"))
    twice = C.written(every.groupBy("fp", "n").count().filter("count > 1").select("fp", "n"), "twice")
    slot = F.col("fp").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    maps = twice.select((slot + 1).alias("s")).groupBy(F.expr("bitmap_bucket_number(s)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("bits"))
    bits = np.zeros(1 << BITMAP_BITS >> 3, np.uint8)
    for r in maps.collect():  # at most 2^26 / 2^15 rows of 4 KB
        bits[(r.k - 1) * 4096 :][: len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)  # buckets count from one
    sent = some.mapInArrow(C.lean_map(_sender(spark.sparkContext.broadcast(bits.tobytes()))), "doc_id long, fp long, n long, sha256 string, rep string, body binary")
    table = C.written(sent, "exact")
    texts = table.filter("body IS NOT NULL").select("fp", "n", "rep", _pieces(F.col("body"), F.col("n")))
    # a huge text that may occur again is sent once
    again = combined.join(twice, ["fp", "n"], "left_semi")
    texts = texts.unionByName(cut.join(again, ["sha256", "n"]).select("fp", "n", F.col("sha256").alias("rep"), "piece", "bytes"))
    streams = texts.repartition(blocks, "fp", "n").sortWithinPartitions("fp", "n", "piece", "rep")
    settled = C.written(streams.mapInArrow(_settle, "rep string, member string"), "settled")
    large = large.join(again.select("sha256", F.lit(True).alias("again")), "sha256", "left")
    members = settled.filter("rep LIKE '%-%'").unionByName(large.filter("again").select("rep", "sha256").distinct().join(settled.withColumnRenamed("rep", "sha256"), "sha256").select("rep", "member"))
    table = table.drop("body").unionByName(large.select("doc_id", "fp", "n", "sha256", F.when(F.col("again"), F.col("rep")).alias("rep")))
    # what each sent text stands for, then what each group comes to
    counts = table.filter("rep IS NOT NULL").groupBy("rep").agg(F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("top"))
    joined = C.written(members.join(counts, "rep"), "counts")
    groups = joined.groupBy("member").agg(F.sum("rows").alias("group_size"), F.max("top").alias("keep_id"), F.max_by("rep", F.struct("top", "rep")).alias("keep_rep"))
    known = joined.select("rep", "member").join(groups, "member").select("rep", "group_size", "keep_id", (F.col("rep") == F.col("keep_rep")).alias("holds"))
    # rows of the kept id in the kept text: one of them stays
    copies = table.filter("rep IS NOT NULL").join(known, "rep")
    first = F.row_number().over(Window.partitionBy("rep", "doc_id").orderBy("sha256")) == 1
    copies = copies.withColumn("kept", F.col("holds") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & first)
    single = table.filter("rep IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha256")
    cols = ["doc_id", "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256")]
    return single.select(*cols).unionByName(copies.select(*cols))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows whose text a row with a larger id has; repeated rows (same id and text) count once, whatever
    their other columns.  A null text counts as empty, a null id as the smallest; an empty table stays empty.

    Only rows whose id and text may be in the list of those that go, or of repeated ones, are shuffled.
    """
    found = exact_groups(df, id_col, text_col).filter("group_size > 1")
    # the key of a row: its id, null or not, and its text's digest
    key = lambda i, sha: F.concat_ws("|", F.coalesce(i.cast("bigint").cast("string"), F.lit("-")), sha)
    each = found.select(key(F.col("doc_id"), F.col("text_sha256")).alias("key"), "kept").groupBy("key").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows"))
    listed = C.written(each.filter("NOT stays OR rows > 1").select("key", "stays"), "exact-groups")
    rows = C.may_hold(C.packed(df, key=key(F.col(id_col), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))), "key", listed)
    beside = rows.filter("may").join(listed, "key", "left")
    once = beside.filter("stays").dropDuplicates(["key"])
    return rows.filter("NOT may").select("row.*").unionByName(beside.filter("stays IS NULL").select("row.*")).unionByName(once.select("row.*"))
