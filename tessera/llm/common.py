"""What the corpus operators share: worker set-up, blocks of rows, flat byte buffers.

A *block* is a group of whole rows of a bounded number of bytes.  Rows are dealt to blocks by a hash of
all that identifies them, so a hot source, id or text length does not load one block.  Inside a block
the texts are one flat byte buffer with offsets, which numpy handles without a Python loop per byte.
"""

from __future__ import annotations

import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import shared_dir

#: Bytes of text that one block should hold.
BLOCK_BYTES = 4 << 20
#: Stands for a null id: after all others.
LAST = np.iinfo(np.int64).max


def prepare(spark: SparkSession) -> None:
    """Let the Python workers import this package, on whatever machine they are.

    Sends them the package's code by way of the shared folder, once a session, and lowers the rows and bytes of the
    session's batches to Python where they are Spark's defaults.
    """
    storage.ship(spark)
    # rows may be long texts: batches to Python of Spark's default number of rows would be tens of MB
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864", "67108864b", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder of shared_dir() that nothing reads any more."""
    path, system = storage.path_of(spark, uri)
    system.delete(path, True)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: what follows starts from there, whatever executors are lost."""
    path = path or shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let the shuffles of jobs that are over go from the executors' disks: a collection in the driver tells Spark of them."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.5)  # Spark's cleaner is a thread of its own


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """The rows as a table in the shared folder, dealt by keys: what groups or joins by key reads it without a shuffle.

    The catalog has it only until the plan that reads it is made.
    """
    spark = df.sparkSession
    table = f"tessera_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *keys).option("path", shared_dir(spark, name)).mode("overwrite").format("parquet").saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # not its files, which are in a folder of ours
    return found


_LIBC = None


def trim() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task."""
    global _LIBC
    pa.default_memory_pool().release_unused()
    if _LIBC is None:
        import ctypes

        try:
            _LIBC = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):
            _LIBC = lambda _: 0
    _LIBC(0)


def lean(run):
    """A group's function that gives freed memory back."""

    def trimmed(table):
        try:
            return run(table)
        finally:
            trim()

    return trimmed


def lean_pair(run):
    """A cogroup's function that gives freed memory back."""

    def trimmed(left, right):
        try:
            return run(left, right)
        finally:
            trim()

    return trimmed


def lean_map(run):
    """A function of batches that gives freed memory back at its end."""

    def trimmed(batches):
        yield from run(batches)
        trim()

    return trimmed


#: Bits of the map of keys that may_hold() sends to all tasks: 8 MB whatever the input; a full map only moves more rows.
MAP_BITS = 26


def packed(df: DataFrame, **named) -> DataFrame:
    """df's rows as one struct, so that no name clashes with those of the columns beside it."""
    return df.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias("row"), *(c.alias(k) for k, c in named.items()))


def may_hold(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """df with `may`: false only if the row's key is surely not in `keys` (a table with a column of that name)."""
    slot = F.pmod(F.xxhash64(key), F.lit(1 << MAP_BITS)) + 1
    maps = keys.select(slot.alias("s")).groupBy(F.expr("bitmap_bucket_number(s)").alias("number")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("bits"))
    rows = df.withColumn("s", slot).withColumns({"number": F.expr("bitmap_bucket_number(s)"), "place": F.expr("bitmap_bit_position(s)")})
    byte = F.ascii(F.decode(F.expr("substring(bits, CAST(place DIV 8 AS INT) + 1, 1)"), "ISO-8859-1"))
    found = rows.join(F.broadcast(maps), "number", "left").withColumn("may", F.coalesce(F.bit_get(byte, (F.col("place") % 8).cast("int")) == 1, F.lit(False)))
    return found.drop("s", "number", "place", "bits")


def join_to(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined to table, which has each of their keys once and in `weight` how many rows have it.

    A key that many rows share does not put them in one task: keys of more than an eighth of a partition's share of
    all `total` rows are fewer than eight times the partitions, and what the table has for them goes to all tasks.
    """
    most = max(256, total // (8 * slots(rows.sparkSession)))
    heavy = F.broadcast(table.filter(F.col("weight") > most))
    rest = rows.join(heavy.select(key), key, "left_anti").join(table, key)
    return rows.join(heavy, key).unionByName(rest).drop("weight")


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def block_count(df: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of block_bytes at most that the column's bytes make on average: smaller ones where the session has
    more shuffle partitions, down to an eighth.  One pass over one column."""
    n = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(1, -(-n // block_bytes), min(slots(df.sparkSession), -(-8 * n // block_bytes)))


def rows_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns under fixed names, whatever other columns there are."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def ids_of(column) -> np.ndarray:
    """int64 ids, nulls as LAST."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.int64()), int(LAST)).to_numpy(zero_copy_only=False)


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == LAST)


def in_order(table: pa.Table) -> pa.Table:
    """By id, then text: the same rows give the same order whenever a task runs again."""
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def slices(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The given pieces of buf, concatenated, and their offsets.  Index arrays are made for `most` items at a time."""
    off = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    out = np.empty(off[-1], buf.dtype)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        a, z = off[at], off[to]
        out[a:z] = buf[np.arange(z - a) + np.repeat(starts[at:to] - (off[at:to] - a), lengths[at:to])]
        at = to
    return out, off


def binary(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])


_ZSTD = None


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: for each its byte length, the rest compressed.  Wide integers go by byte plane."""
    global _ZSTD
    _ZSTD = _ZSTD or pa.Codec("zstd", compression_level=1)
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() if a.itemsize > 1 else a.tobytes() for a in map(np.ascontiguousarray, arrays))
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return sizes.tobytes() + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def expand(blob: bytes, *types) -> list[np.ndarray]:
    global _ZSTD
    _ZSTD = _ZSTD or pa.Codec("zstd", compression_level=1)
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8)
    raw = np.frombuffer(_ZSTD.decompress(blob[8 + 8 * n :], int(sizes.sum())), np.uint8) if sizes.sum() else np.zeros(0, np.uint8)
    out, at = [], 0
    for size, kind in zip(sizes, types, strict=True):
        kind, part = np.dtype(kind), raw[at : at + size]
        out.append(np.ascontiguousarray(part.reshape(kind.itemsize, -1).T).reshape(-1).view(kind) if kind.itemsize > 1 and size else part.view(kind))
        at += size
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """min(h[i : i+w]) for every i with w values ahead."""
    n, span, m = len(h) - w + 1, 1, h
    if n <= 0:
        return h[:0]
    while 2 * span <= w:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    return np.minimum(m[:n], m[w - span : w - span + n]) if span < w else m[:n]


#: By byte: white space of the word pattern (space and 0x09 to 0x0D).
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many words stand before each text's end (one more than texts)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True  # a word ends where its text does
    prev = np.zeros(len(buf), bool)
    prev[1:] = word[:-1]
    starts = np.flatnonzero(word & (~prev | edge[:-1]))
    after = np.zeros(len(buf), bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def loose(column):
    """The column with every nested field nullable, as Spark declares what Python returns."""

    def kind(t):
        if pa.types.is_struct(t):
            return pa.struct([pa.field(f.name, kind(f.type)) for f in t])
        if pa.types.is_list(t):
            return pa.list_(pa.field("element", kind(t.value_type)))
        if pa.types.is_map(t):
            return pa.map_(kind(t.key_type), kind(t.item_type))
        return t

    return column.cast(kind(column.type))


def nullable(kind):
    """The Spark type of what loose() returns."""
    from pyspark.sql.types import ArrayType, MapType, StructField, StructType

    if isinstance(kind, StructType):
        return StructType([StructField(f.name, nullable(f.dataType)) for f in kind])
    if isinstance(kind, ArrayType):
        return ArrayType(nullable(kind.elementType))
    if isinstance(kind, MapType):
        return MapType(nullable(kind.keyType), nullable(kind.valueType))
    return kind
