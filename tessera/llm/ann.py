"""Approximate nearest neighbours by cosine: a forest of sorted hash strings.

Each tree hashes a vector to a long string of bits, the sides of random hyperplanes, and is the sorted array of these
strings, so that all strings that share a prefix with a query's are one range.  A query descends to its longest match in
each tree and then ascends in all trees together, a bit at a time, until the strings that share the prefixes are as many
as the forest was calibrated to.  Candidates are compared exactly, in double precision.

1. Trees are cut by their first bits into pieces of a bounded size, sorted and written once, dealt by (tree, prefix).
2. A query's string in each tree meets the one piece that has its prefix: how many strings share each longer prefix.
3. Summed over the trees, these counts say at which depth the query's ascent ends.
4. From there, pieces hand the candidates to the shards that hold their vectors; each shard returns its nearest.

How many candidates to ask for comes from a bounded sample of queries, answered by brute force: what so large a share of
their true neighbours needs.  Well-clustered vectors stop early, vectors without structure are searched widely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

TREES = 128
BITS = 32
#: Queries that the number of candidates is calibrated on, and the recall that they must reach.
SAMPLE = 64
RECALL = 0.95
#: Vectors of a shard, and strings of a piece of a tree.
SHARD, PIECE = 16_384, 65_536
#: Vectors that are hashed at a time, and that a task hashes before it sends their strings.
STEP, HELD = 1024, 32_768

KEYS = ["dim", "tree", "prefix"]
MESSAGE = "dim int, tree int, prefix long, body binary"


def planes(dim: int, trees: int, bits: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * bits), np.float32)


def strings(unit: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """(trees, n) hash strings as integers, first bit highest; bits is a multiple of 8, 32 at most."""
    sides = planes(unit.shape[1], trees, bits)
    out = np.zeros((len(unit), trees), np.uint64)
    for a in range(0, len(unit), STEP):
        packed = np.packbits(unit[a : a + STEP].astype(np.float32) @ sides > 0, axis=1).reshape(-1, trees, bits // 8)
        for k in range(bits // 8):
            out[a : a + STEP] = out[a : a + STEP] << np.uint64(8) | packed[:, :, k]
    return out.T.copy()


def shared(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """How many first bits two strings share."""
    return bits - np.ceil(np.log2((a ^ b).astype(np.float64) + 1)).astype(np.int64)


def clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Ids and double vectors, without those null, empty, zero, or holding a null or non-finite component."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.filter(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision; components are scaled first, so that no square overflows or vanishes."""
    q, v = query / np.abs(query).max(), vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (v * q).sum(axis=1) / np.sqrt((q * q).sum() * (v * v).sum(axis=1))


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def prefixes(hashed: np.ndarray, bits: int, depth: int) -> np.ndarray:
    return hashed >> np.uint64(bits - depth)


def _messages(dim: int, hashed: np.ndarray, extra: list[np.ndarray], bits: int, depth: int) -> pa.RecordBatch:
    """A row per tree and prefix: its strings, sorted, and what belongs to each."""
    rows = []
    for tree, h in enumerate(hashed):
        order = np.argsort(h, kind="stable")
        which = prefixes(h[order], bits, depth)
        cut = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        for a, z in zip(cut, [*cut[1:], len(order)], strict=True):
            rows.append((dim, tree, int(which[a]), C.squeeze(h[order[a:z]].astype(np.uint32), *(x[order[a:z]] for x in extra))))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["dim", "tree", "prefix", "body"])


def _by_dim(batch):
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        mine = batch.filter(pa.array(dims == dim))
        yield int(dim), mine, matrix(mine.column("v"), int(dim))


def _hashed(trees, bits, depth, stops: bool):
    """Messages of vectors' strings with their row numbers and, for queries, the depth at which their ascent ends."""

    def run(batches):
        held: dict[int, list] = {}

        def sent(dim):
            hashed, rows, stop = (np.concatenate(x, axis=-1) for x in zip(*held.pop(dim), strict=True))
            return _messages(dim, hashed, [rows, stop] if stops else [rows], bits, depth)

        for batch in batches:
            for dim, mine, v in _by_dim(batch):
                stop = mine.column("stop").to_numpy(zero_copy_only=False).astype(np.int32) if stops else np.zeros(len(v), np.int32)
                held.setdefault(dim, []).append((strings(unit(v), trees, bits), mine.column("row").to_numpy(zero_copy_only=False), stop))
                if sum(len(x[1]) for x in held[dim]) >= HELD:
                    yield sent(dim)
        for dim in list(held):
            yield sent(dim)

    return run


def _sorted(table: pa.Table) -> pa.Table:
    """One piece of a tree."""
    hashed, rows = (np.concatenate(x) for x in zip(*(C.expand(b, np.uint32, np.int64) for b in table["body"].to_pylist()), strict=True))
    order = np.argsort(hashed, kind="stable")
    body = C.squeeze(np.diff(hashed[order], prepend=np.uint32(0)), rows[order])
    return pa.table({"dim": table["dim"][:1], "tree": table["tree"][:1], "prefix": table["prefix"][:1], "body": pa.array([body], pa.binary())})


def _piece(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    gaps, rows = C.expand(table["body"][0].as_py(), np.uint32, np.int64)
    return np.cumsum(gaps, dtype=np.uint64), rows


def _range(hashed: np.ndarray, wanted: np.ndarray, shift) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the strings that agree with the wanted ones but for the last `shift` bits."""
    shift = np.asarray(shift, np.uint64)
    low = wanted >> shift << shift
    return np.searchsorted(hashed, low), np.searchsorted(hashed, low + (np.uint64(1) << shift))


def _count(bits, depth):
    """How many strings of a piece share 0, 1, 2, ... bits with each query's; below `depth`, as many as at depth."""
    names = [f"c{d}" for d in range(depth, bits + 1)]

    def run(piece, asked):
        if not piece.num_rows or not asked.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), **{n: pa.array([], pa.int64()) for n in names}})
        hashed, _ = _piece(piece)
        wanted, query, _ = (np.concatenate(x) for x in zip(*(C.expand(b, np.uint32, np.int64, np.int32) for b in asked["body"].to_pylist()), strict=True))
        wanted = wanted.astype(np.uint64)
        out = {"query": pa.array(query)}
        for d, name in zip(range(depth, bits + 1), names, strict=True):
            a, z = _range(hashed, wanted, bits - d)
            out[name] = pa.array(z - a)
        return pa.table(out)

    return run


def _lists(row: np.ndarray, who: np.ndarray, query: np.ndarray, dim: int, shards: int) -> pa.Table:
    """Pairs of a row and a query (by its number) as lists by shard and query; a list has a row's place in its shard."""
    shard = row % shards
    order = np.lexsort((row, shard, who))
    row, who, shard = row[order], who[order], shard[order]
    cut = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (shard[1:] != shard[:-1]))) if len(row) else np.zeros(0, np.int64)
    place = (row // shards).astype("<u4")
    lists = C.binary(place.view(np.uint8), 4 * np.append(cut, len(row))).cast(pa.binary())
    return pa.table({"shard": pa.array(shard[cut]), "dim": pa.array(np.full(len(cut), dim, np.int32)), "query": pa.array(query[who[cut]]), "found": lists})


def _gather(bits, shards):
    """The rows whose strings share as many bits with a query's as its ascent goes up to, by shard and query."""

    def run(piece, asked):
        none = np.zeros(0, np.int64)
        if not piece.num_rows or not asked.num_rows:
            return _lists(none, none, none, 0, shards)
        hashed, rows = _piece(piece)
        wanted, query, stop = (np.concatenate(x) for x in zip(*(C.expand(b, np.uint32, np.int64, np.int32) for b in asked["body"].to_pylist()), strict=True))
        a, z = _range(hashed, wanted.astype(np.uint64), bits - stop)
        n = z - a
        at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return _lists(rows[at], np.repeat(np.arange(len(query)), n), query, piece["dim"][0].as_py(), shards)

    return run


FOUND = "query long, query_id long, vec_id long, row long, score double"


def _top(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rows, ids, -score))[:k]


def _table(cols) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate(c) if c else [], t) for n, c, t in zip(("query", "query_id", "vec_id", "row", "score"), cols, (pa.int64(),) * 4 + (pa.float64(),), strict=True)})


def _compare(q, own, v, units, ids, rows, at, k, cols, query, query_id):
    """The k nearest to q among the vectors at these places."""
    at = at[rows[at] != own]
    if len(at) > 8 * k:  # a cheap pass leaves out what is surely not among the k nearest
        rough = units[at] @ unit(q[None])[0]
        at = at[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9]
    s = cosines(q, v[at]) if len(at) else np.zeros(0)
    best = _top(s, ids[at], rows[at], k)
    for c, x in zip(cols, (np.full(len(best), query), np.full(len(best), query_id), ids[at[best]], rows[at[best]], s[best]), strict=True):
        c.append(x)


def _nearest(k, shards):
    """The k nearest within one shard for each query that has candidates there."""

    def run(asked, vectors):
        cols: list[list] = [[] for _ in range(5)]
        if asked.num_rows and vectors.num_rows:
            dim = vectors["dim"][0].as_py()
            rows, ids, v = vectors["row"].to_numpy(), vectors["vec_id"].to_numpy(), matrix(vectors["v"], dim)
            order = np.argsort(rows)
            rows, ids, v = rows[order], ids[order], v[order]
            units, queries, shard = unit(v), matrix(asked["v"], dim), int(rows[0] % shards)
            for i, (query, query_id, found) in enumerate(zip(asked["query"].to_pylist(), asked["query_id"].to_pylist(), asked["found"], strict=True)):
                listed = found.as_py()  # none: all of the shard
                places = np.unique(np.frombuffer(b"".join(listed or []), "<u4"))
                at = np.arange(len(rows)) if listed is None else np.searchsorted(rows, places.astype(np.int64) * shards + shard)
                _compare(queries[i], query, v, units, ids, rows, at, k, cols, query, query_id)
        return _table(cols)

    return run


def _brute(k, sample):
    """The k nearest in each batch to the sampled queries."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for dim, mine, v in _by_dim(batch):
                rows, ids, units = mine.column("row").to_numpy(zero_copy_only=False), mine.column("vec_id").to_numpy(zero_copy_only=False), unit(v)
                for query, query_id, q in sample.value:
                    if len(q) == dim:
                        _compare(np.array(q), query, v, units, ids, rows, np.arange(len(v)), k, cols, query, query_id)
            yield from _table(cols).combine_chunks().to_batches()

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Forest:
    """The index of a table of vectors."""

    def __init__(self, df: DataFrame, id_col: str, vector_col: str, trees: int, bits: int, shard: int, piece: int):
        self.spark, self.trees, self.bits = df.sparkSession, trees, bits
        # rows get fixed numbers, one after the other
        held = C.written(clean(df, id_col, vector_col).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "vectors")
        sizes = held.groupBy("part").count().orderBy("part").collect()  # a row per partition of the input
        first = np.append(0, np.cumsum([r["count"] for r in sizes])).tolist()
        self.size = first[-1]
        offsets = self.spark.createDataFrame([(r["part"], n) for r, n in zip(sizes, first[:-1], strict=True)], "part int, first long")
        self.vectors = held.join(F.broadcast(offsets), "part").select("vec_id", "v", "dim", (F.col("row") + F.col("first")).alias("row"))
        self.depth = min(bits, max(0, int(np.ceil(np.log2(max(1, self.size) / piece)))))
        self.shards = max(1, -(-self.size // shard))
        rows = self.vectors.withColumn("shard", F.col("row") % self.shards)
        self.dealt = C.bucketed(rows.repartition(self.shards, "shard", "dim"), "shards", ["shard", "dim"], self.shards)
        pieces = max(C.slots(self.spark), trees << self.depth >> 3)
        messages = self.vectors.mapInArrow(_hashed(trees, bits, self.depth, False), MESSAGE)
        self.pieces = C.bucketed(messages.repartition(pieces, *KEYS).groupBy(*KEYS).applyInArrow(_sorted, MESSAGE), "forest", KEYS, pieces)

    def _meet(self, queries: DataFrame, run, schema: str) -> DataFrame:
        """Each query's strings (row, v, dim, stop) with the pieces that have their prefixes."""
        asked = queries.mapInArrow(_hashed(self.trees, self.bits, self.depth, True), MESSAGE)
        return self.pieces.groupBy(*KEYS).cogroup(asked.groupBy(*KEYS)).applyInArrow(run, schema)

    def counts(self, queries: DataFrame) -> DataFrame:
        """query, c<depth>: how many strings of all trees share so many bits with it, its own left out."""
        names = [f"c{d}" for d in range(self.depth, self.bits + 1)]
        found = self._meet(queries.withColumn("stop", F.lit(0)), _count(self.bits, self.depth), "query long, " + ", ".join(f"{n} long" for n in names))
        return found.groupBy("query").agg(*((F.sum(n) - self.trees).alias(n) for n in names))

    def wanted(self, queries: DataFrame, k: int, recall: float) -> int:
        """How many strings an ascent should gather, from a bounded sample of queries answered by brute force."""
        few = queries.orderBy(F.xxhash64("vec_id"), "row").limit(SAMPLE)
        held = [(r["row"], r["vec_id"], r["v"]) for r in few.select("row", "vec_id", "v").collect()]
        # a batch or shard sends k rows for each sampled query
        true = _best(self.vectors.mapInArrow(_brute(k, self.spark.sparkContext.broadcast(held)), FOUND), k).select("query", "row")
        near = true.join(self.vectors.select("row", "v"), "row").select("query", "v").collect()  # SAMPLE x k rows
        count = {r["query"]: r for r in self.counts(few).collect()}
        mine = {row: strings(unit(np.array([v])), self.trees, self.bits) for row, _, v in held}
        needs = [0]
        for r in near:
            deep = int(shared(strings(unit(np.array([r["v"]])), self.trees, self.bits), mine[r["query"]], self.bits).max())
            if deep < self.bits:  # copies are found anyhow, and say nothing about the others
                # it is gathered unless the strings that share one bit more are enough
                needs.append(count[r["query"]][f"c{deep + 1}"] + 1 if self.depth <= deep else self.trees * self.size >> deep)
        # a vector has a string in each tree: so many are of k vectors at least
        return max(self.trees * (k - 1) + 1, sorted(needs)[int(np.ceil(recall * (len(needs) - 1)))])

    def search(self, queries: DataFrame, k: int, most: int) -> DataFrame:
        enough = F.greatest(*(F.when(F.col(f"c{d}") >= most, F.lit(d)) for d in range(self.depth, self.bits + 1)), F.lit(-1))
        # above the pieces' own depth an ascent goes on to all pieces below a shorter prefix
        short = max(0, min(self.depth, int(np.floor(np.log2(max(1, self.trees * self.size / most))))))
        stops = self.counts(queries).select(F.col("query").alias("row"), enough.alias("stop"))
        asked = C.written(queries.join(stops, "row", "left").withColumn("stop", F.when(F.coalesce("stop", F.lit(-1)) >= 0, F.col("stop")).otherwise(short)), "stops")
        schema = "shard long, dim int, query long, found binary"
        found = self._meet(asked.filter(F.col("stop") >= self.depth), _gather(self.bits, self.shards), schema)
        if self.depth:
            found = found.unionByName(self._above(asked.filter(F.col("stop") < self.depth), schema))
        # a query's lists meet, each tree's and piece's, then its vector, and go to their shards
        lists = found.repartition("query").groupBy("query", "shard", "dim").agg(F.collect_list("found").alias("found"))
        with_vectors = lists.join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "v"), "query")
        near = C.written(_best(self._compared(with_vectors, k), k), "near")
        few = queries.join(near.groupBy("query").count().filter(F.col("count") >= k).select(F.col("query").alias("row")), "row", "left_anti")
        few = C.written(few, "few-found")
        if few.isEmpty():
            return near.select("query_id", "rank", "vec_id", "score")
        # queries with fewer than k candidates meet all vectors, shard by shard
        shards = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.shards - 1).cast("long")))
        every = few.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "v", "dim", shards.alias("shard"), F.lit(None).cast("array<binary>").alias("found"))
        rest = _best(self._compared(every, k), k)
        return near.join(few.select(F.col("row").alias("query")), "query", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(rest.select("query_id", "rank", "vec_id", "score"))

    def _compared(self, asked: DataFrame, k: int) -> DataFrame:
        return asked.groupBy("shard", "dim").cogroup(self.dealt.groupBy("shard", "dim")).applyInArrow(_nearest(k, self.shards), FOUND)

    def _above(self, queries: DataFrame, schema: str) -> DataFrame:
        """The candidates of ascents that end above the pieces' depth: whole pieces under a shorter prefix."""
        trees, bits, depth, shards = self.trees, self.bits, self.depth, self.shards

        def spread(batches):
            for batch in _hashed(trees, bits, depth, True)(batches):
                rows = []
                for dim, tree, prefix, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    _, query, stop = C.expand(body, np.uint32, np.int64, np.int32)
                    for x in np.unique(stop):
                        first = prefix >> (depth - int(x)) << (depth - int(x))
                        rows += [(dim, tree, first + i, C.squeeze(query[stop == x])) for i in range(1 << (depth - int(x)))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["dim", "tree", "prefix", "body"])

        def whole(batches):
            for batch in batches:
                for dim, piece, asked in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("dim", "piece", "body")), strict=True):
                    rows, query = C.expand(piece, np.uint32, np.int64)[1], C.expand(asked, np.int64)[0]
                    lists = _lists(rows, np.zeros(len(rows), np.int64), query[:1], dim, shards)
                    for q in query:  # the same lists for each
                        yield from lists.set_column(2, "query", pa.array(np.full(len(lists), q))).combine_chunks().to_batches()

        pieces = self.pieces.withColumnRenamed("body", "piece")
        return pieces.join(queries.mapInArrow(spread, MESSAGE), KEYS).mapInArrow(whole, schema)


def nearest(df: DataFrame, query_filter, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, bits: int = BITS, recall: float = RECALL, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """For each row that query_filter (a condition on vec_id) picks, its k nearest other rows: query_id, rank,
    vec_id, score.

    The largest cosine is nearest, ties go to the smaller id.  Rows whose id or vector is null, or whose vector
    is empty, zero, or holds a null or non-finite component, take no part; vectors only meet those of their own
    length.  A repeated row is a row of its own: it is another's neighbour, never its own.  Fewer than k others
    give fewer rows; an empty table gives an empty result.  Other columns of df are ignored.
    """
    C.prepare(df.sparkSession)
    forest = Forest(df, id_col, vector_col, trees, bits, shard, piece)
    queries = forest.vectors.filter(query_filter)
    return forest.search(queries, k, forest.wanted(queries, k, recall))
