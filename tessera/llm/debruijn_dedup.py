"""Removal of repeated word sequences over a compacted De Bruijn graph of the corpus.

Edges are windows of 20 words (k-mers), nodes their 19-word overlaps.  Only edges that may repeat are made (see anchors.py):
they travel, as stretches of text, to the bucket of their least gram, where edges of equal words meet and each gets its
first source, (document, word).  Where no stretch of the bucket begins, ends or branches off, edges that follow one another
are one segment, the same in all documents.

Segments are the rows of the graph: each has the contents (hashes) of the 19 words at which it begins and ends, its first
source and how many documents' places have it.  Nodes are these contents over the whole corpus, their degrees how many
different segments enter and leave.  Where one enters and one leaves, no place has one without the other and their sources
follow one another, the two are linked, and joins that double the pointers along the links (log2 of the longest chain of
them) contract every unbranched path.  A document then has a path where its first segment is, and the path's source
coordinates and length say which of its words repeat earlier ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import anchors as A
from . import common as C
from .suffix_dedup import STEP, covered, expand_by, ranks

WORDS = 20
GRAM = 8
_MUL = np.uint64(0x9E3779B97F4A7C15)
_TABLE = C.mix(np.arange(1, 257, dtype=np.uint64) * _MUL)
_TABLE[C.SPACE] = 0
_POW = np.cumprod(np.full(1 << 16, 0xD6E8FEB86659FD93, np.uint64))


def word_hashes(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a buffer in which words start there (and at least a space or a text's end parts them)."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + STEP)))
        a, z = int(starts[at]), int(starts[to]) if to < len(starts) else len(buf)
        mine = starts[at:to] - a
        place = np.arange(z - a) - np.repeat(mine, np.diff(np.append(mine, z - a)))
        out[at:to] = np.add.reduceat(_TABLE[buf[a:z]] * _POW[place & 0xFFFF], mine)
        at = to
    return C.mix(out)


def folded(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n values in a row."""
    h = np.zeros(max(0, len(values) - n + 1), np.uint64)
    for j in range(n):
        h *= _MUL
        h += values[j : j + len(h)]
    return C.mix(h)


def same_windows(tokens: np.ndarray, starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each window, and whether others share it: by hash, then verified word by word."""
    group, shared = ranks(folded(tokens.astype(np.uint64) + np.uint64(1), words)[starts])
    if not len(starts):
        return group, shared
    head = np.empty(group.max() + 1, np.int64)
    head[group[::-1]] = starts[::-1]
    ok = np.ones(len(starts), bool)
    for j in range(words):
        ok &= tokens[starts + j] == tokens[head[group] + j]
    if not ok.all():  # a collision of hashes: rank by the words themselves
        rank = np.unique(tokens, return_inverse=True)[1].astype(np.uint64)
        depth = 1
        while depth < words:
            ahead = min(depth, words - depth)
            n = len(rank) - ahead
            rank = np.unique(rank[:n] << np.uint64(32) | rank[ahead:], return_inverse=True)[1].astype(np.uint64)
            depth += ahead
        group, shared = ranks(rank[starts])
    return group, shared


class Texts:
    """The rows of a block in a fixed order, and their words."""

    def __init__(self, table: pa.Table):
        self.table = table = C.in_order(table)
        self.buf, self.off = C.flat(table["text"])
        self.ids = C.ids_of(table["doc_id"])
        self.starts, self.ends, self.before = C.words_of(self.buf, self.off)
        self.row = np.repeat(np.arange(len(self.off) - 1), np.diff(self.before))
        self.words = len(self.starts)


class Block(Texts):
    """And the runs of their windows."""

    def __init__(self, table: pa.Table, words: int):
        super().__init__(table)
        gram, row = min(GRAM, words), self.row
        h = folded(word_hashes(self.buf, self.starts), gram)
        span = words - gram + 1
        least = C.sliding_min(h, span)
        k = len(least)
        starts, counts = A.split_runs(least, row[:k], row[:k] == row[words - 1 : words - 1 + k])
        close = np.zeros(len(h) + 1, np.int64)
        for d in range(1, span + 1):  # in a run the least gram stands at most span words on
            close[1:][: max(0, len(h) - d)] += h[: max(0, len(h) - d)] == h[d:]
        close = np.cumsum(close)
        again = close[np.minimum(starts + counts + span - 1, len(h))] > close[starts]
        self.runs = A.Runs(A.key_of(least[starts]), starts, counts, row[starts], again)

    def collapse(self, picked: np.ndarray, words: int):
        """Distinct stretches of the picked runs by key: keys, least source (id, word) of each, its text, each run's place."""
        runs = self.runs
        lens = self.ends - self.starts + 1
        norm_off = np.append(0, np.cumsum(lens))
        buf = np.append(self.buf, np.uint8(0x20))
        norm, _ = C.slices(buf, self.starts, lens)
        if len(norm):
            norm[norm_off[1:] - 1] = 0x20
        a, z = norm_off[runs.start[picked]], norm_off[runs.start[picked] + runs.count[picked] + words - 1]
        text, off = C.slices(norm, a, z - a)
        coded = C.binary(text, off).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        ids, places = self.ids[runs.row[picked]], runs.start[picked] - self.before[runs.row[picked]]
        order = np.lexsort((places, ids, code))
        first = order[np.flatnonzero(np.diff(code[order], prepend=-1))]
        by_key = np.argsort(runs.key[picked][first], kind="stable")
        place = np.empty(len(by_key), np.int64)
        place[by_key] = np.arange(len(by_key))
        first = first[by_key]
        return runs.key[picked][first], ids[first], places[first], text, off, first, place[code], ids, places


def _block(table):
    return int(table["block"][0].as_py())


def _offered(words, buckets):
    return lambda table: A.offer(_block(table), Block(table, words).runs, None, buckets)


def _sent(words, buckets):
    def run(texts, messages):
        if not texts.num_rows or not messages.num_rows:
            return A.message(0, 0, {})
        block = Block(texts, words)
        picked = A.candidates(block.runs, messages, buckets)
        keys, ids, places, text, off, first, place, *_ = block.collapse(picked, words)
        many = (np.bincount(place, minlength=len(keys)) > 1).astype(np.uint8)  # the block has it several times
        out = {}
        for k, a, b in A.cuts(keys, buckets):
            size = np.diff(off)[first[a:b]]
            out[k] = C.squeeze(ids[a:b], places[a:b], size.astype(np.int32), many[a:b], C.slices(text, off[first[a:b]], size)[0])
        return A.message(_block(texts), 1, out)

    return run


def paths(ids: np.ndarray, places: np.ndarray, text: np.ndarray, off: np.ndarray, words: int):
    """(text number of each item; then of each segment its text number, first window, windows, first source)."""
    coded = C.binary(text, off).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((places, ids, code))
    first = order[np.flatnonzero(np.diff(code[order], prepend=-1))]
    sub, sub_off = C.slices(text, off[first], np.diff(off)[first])
    starts, ends, before = C.words_of(sub, sub_off)
    tokens = C.binary(*C.slices(sub, starts, ends - starts)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    windows = np.diff(before) - words + 1
    base = np.append(0, np.cumsum(windows))
    which = np.repeat(np.arange(len(first)), windows)
    inside = np.arange(base[-1]) - base[which]
    at = before[which] + inside
    own_id, own_place = ids[first][which], places[first][which] + inside
    group, shared = same_windows(tokens, at, words)
    s = np.flatnonzero(shared)
    o = s[np.lexsort((own_place[s], own_id[s], group[s]))]
    head = np.flatnonzero(np.diff(group[o], prepend=-1))
    many = np.diff(np.append(head, len(o)))
    own_id[o], own_place[o] = np.repeat(own_id[o][head], many), np.repeat(own_place[o][head], many)
    if not len(which):
        return code, which, inside, which, own_id, own_place
    # an edge goes on into the next one unless a text begins or ends there, or other edges follow or go before
    n, same = int(group.max()) + 1, which[1:] == which[:-1]
    begins, ends_here = np.zeros(n, bool), np.zeros(n, bool)
    begins[group[inside == 0]] = True
    ends_here[group[np.append(~same, True)]] = True
    pairs = np.unique(group[:-1][same] * n + group[1:][same])
    splits, meets = np.bincount(pairs // n, minlength=n) > 1, np.bincount(pairs % n, minlength=n) > 1
    on = same & (own_id[1:] == own_id[:-1]) & (own_place[1:] == own_place[:-1] + 1)
    on &= ~(begins | meets)[group[1:]] & ~(ends_here | splits)[group[:-1]]
    cut = np.flatnonzero(np.append(True, ~on))
    return code, which[cut], inside[cut], np.diff(np.append(cut, len(which))), own_id[cut], own_place[cut]


def earlier(id_a, place_a, id_b, place_b):
    return (id_a < id_b) | ((id_a == id_b) & (place_a < place_b))


def _settled(words):
    def run(table):
        blocks, parts = table["block"].to_pylist(), [C.expand(x, np.int64, np.int64, np.int32, np.uint8, np.uint8) for x in table["body"].to_pylist()]
        ids, places, sizes, many, text = (np.concatenate(x) for x in zip(*parts, strict=True))
        code, which, start, count, source, at = paths(ids, places, text, np.append(0, np.cumsum(sizes, dtype=np.int64)), words)
        item, path = expand_by(which, code, int(code.max()) + 1)
        told = earlier(source[path], at[path], ids[item], places[item] + start[path]) | (many[item] > 0)
        item, path = item[told], path[told]
        ends = np.cumsum([len(p[0]) for p in parts])
        bounds, out = np.searchsorted(item, [0, *ends]), []
        for k, block in enumerate(blocks):
            a, b = bounds[k], bounds[k + 1]
            if b > a:
                p = path[a:b]
                out.append((block, C.squeeze((item[a:b] - (ends[k - 1] if k else 0)).astype(np.int32), start[p].astype(np.int32), count[p].astype(np.int32), source[p], at[p])))
        n, bucket = len(out), int(table["bucket"][0].as_py())
        return pa.table({"block": pa.array([x[0] for x in out], pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "kind": pa.array([1] * n, pa.int32()), "body": pa.array([x[1] for x in out], pa.binary())})

    return run


#: A segment where a document has it: windows from `start` on, where their words stand first, the hashes of the 19 words at
#: both ends, and whether the document has segments right before and after it.
SPAN = "block int, row int, start int, windows int, source long, at int, enter long, leave long, joined boolean, goes_on boolean"
SEGMENT = ["source", "at", "windows", "enter", "leave"]


def _spread(words, buckets):
    """The segments that each document of a block has and that stand earlier too."""

    def run(texts, messages):
        cols = [np.zeros(0, np.int64)] * 5
        nodes = np.zeros(0, np.uint64)
        before = np.zeros(1, np.int64)
        if texts.num_rows and messages.num_rows:
            block = Block(texts, words)
            runs, before = block.runs, block.before
            picked = A.candidates(runs, messages, buckets)
            keys, _, _, _, _, _, place, ids, places = block.collapse(picked, words)
            row = runs.row[picked]
            said = {b: body for b, k, body in zip(messages["bucket"].to_pylist(), messages["kind"].to_pylist(), messages["body"].to_pylist(), strict=True) if k == 1}
            found = [(x[0] + a, *x[1:]) for k, a, _ in A.cuts(keys, buckets) if k in said for x in [C.expand(said[k], np.int32, np.int32, np.int32, np.int64, np.int64)]]
            if found:
                item, start, count, source, at = (np.concatenate(x) for x in zip(*found, strict=True))
                run_no, which = expand_by(item, place, len(keys))
                hit = earlier(source[which], at[which], ids[run_no], places[run_no] + start[which])
                run_no, which = run_no[hit], which[hit]
                cols = [row[run_no], places[run_no] + start[which], count[which].astype(np.int64), source[which], at[which]]
                nodes = folded(word_hashes(block.buf, block.starts), words - 1).view(np.int64)
        order = np.lexsort((cols[1], cols[0]))
        row, start, windows, source, at = (c[order] for c in cols)
        first = before[row] + start if len(row) else row
        joined = np.zeros(len(row) + 1, bool)
        joined[1:-1] = (row[1:] == row[:-1]) & (start[:-1] + windows[:-1] == start[1:])
        number = int(texts["block"][0].as_py()) if texts.num_rows else 0
        ints = lambda x: pa.array(x.astype(np.int32))
        ends = [pa.array(nodes[first + k] if len(row) else np.zeros(0, np.int64), pa.int64()) for k in (0, windows)]
        return pa.table({"block": ints(np.full(len(row), number)), "row": ints(row), "start": ints(start), "windows": ints(windows), "source": pa.array(source.astype(np.int64)), "at": ints(at), "enter": ends[0], "leave": ends[1], "joined": pa.array(joined[:-1]), "goes_on": pa.array(joined[1:])})

    return run


def segments(spans: DataFrame) -> DataFrame:
    """The graph's rows: each segment once under a number (h, a hash of SEGMENT), with the places that have it (n) and
    whether all of these have one right before it (joined) and right after it (goes_on).  Segments whose numbers clash are
    told by their differing bounds and stay unlinked."""
    h = F.xxhash64(*SEGMENT).alias("h")
    both = [f(c).alias(f"{name}_{c}") for c in SEGMENT for name, f in (("a", F.min), ("z", F.max))]
    found = spans.groupBy(h).agg(F.count(F.lit(1)).alias("n"), F.bool_and("joined").alias("joined"), F.bool_and("goes_on").alias("goes_on"), *both)
    one = F.lit(True)
    for c in SEGMENT:
        one = one & (F.col(f"a_{c}") == F.col(f"z_{c}"))
    return found.select("h", "n", (one & F.col("joined")).alias("joined"), (one & F.col("goes_on")).alias("goes_on"), *(F.col(f"a_{c}").alias(c) for c in SEGMENT))


def links(found: DataFrame) -> DataFrame:
    """Pairs of segments (next, head: the one before it, windows of next) about a node that one enters and one leaves, of
    which no place has one alone and whose sources follow one another.  Degrees are over all segments of the corpus."""
    none = F.lit(None).cast("bigint")
    side = lambda node, into, out_of, at, always: F.struct(F.col(node).alias("node"), into.alias("into"), out_of.alias("out_of"), at.cast("bigint").alias("place"), F.col(always).alias("always"))
    ends = F.array(side("leave", F.col("h"), none, F.col("at") + F.col("windows"), "goes_on"), side("enter", none, F.col("h"), F.col("at"), "joined"))
    met = found.select("source", "windows", F.explode(ends).alias("e")).select("source", "windows", "e.*")
    leaves = F.when(F.col("out_of").isNotNull(), F.col("windows"))
    nodes = met.groupBy("node").agg(F.count("into").alias("entering"), F.count("out_of").alias("leaving"), F.bool_and("always").alias("always"), F.max("into").alias("head"), F.max("out_of").alias("next"), F.max(leaves).alias("windows"), *(f(c).alias(f"{name}_{c}") for c in ("source", "place") for name, f in (("a", F.min), ("z", F.max))))
    plain = nodes.filter("entering = 1 AND leaving = 1 AND always AND a_source = z_source AND a_place = z_place AND head <> next")
    return plain.select("next", "head", "windows")


#: Doublings between two looks at whether all pointers have arrived.
DOUBLINGS = 3


def heads(linked: DataFrame) -> DataFrame:
    """next, head, windows: for each segment that follows another, the first one of its path; pointers are doubled by
    joins until none moves."""
    spark = linked.sparkSession
    place = C.shared_dir(spark, "pointers")
    at = C.written(linked.withColumn("moved", F.lit(True)), "pointers", f"{place}/0")
    turn = 0
    while not at.filter("moved").isEmpty():
        far = at.drop("moved").withColumn("old", F.col("head"))
        for _ in range(DOUBLINGS):
            ahead = far.select(F.col("next").alias("mid"), F.col("head").alias("far"))
            far = far.join(ahead, F.col("head") == F.col("mid"), "left").select("next", F.coalesce("far", "head").alias("head"), "windows", "old")
        turn += 1
        at = C.written(far.select("next", "head", "windows", (F.col("head") != F.col("old")).alias("moved")), "pointers", f"{place}/{turn}")
        C.remove(spark, f"{place}/{turn - 1}")
    return at.drop("moved")


def compacted(spans: DataFrame, total: int) -> DataFrame:
    """Where documents have paths: block, row, start, windows of the whole path, source, at.

    A segment inside a path is told by the path's first one, and goes.  A segment that a third of all places have is not
    in one task (common.join_to)."""
    found = C.written(segments(spans), "segments")
    inner = heads(links(found))
    more = inner.groupBy(F.col("head").alias("h")).agg(F.sum("windows").alias("more"))
    known = found.select("h", F.col("n").alias("weight"))
    told = known.join(more, "h", "left").join(inner.select(F.col("next").alias("h"), F.lit(True).alias("inside")), "h", "left")
    told = C.written(told.select("h", "weight", F.when(F.col("inside"), -1).otherwise(F.coalesce("more", F.lit(0))).alias("more")), "told")
    rows = spans.select(F.xxhash64(*SEGMENT).alias("h"), "block", "row", "start", "windows", "source", "at")
    put = C.join_to(rows, told, "h", total).filter("more >= 0")
    return put.select("block", "row", "start", (F.col("windows") + F.col("more")).cast("int").alias("windows"), "source", "at")


def _finished(words, texts_too):
    def run(texts, paths):
        if not texts.num_rows:
            return None
        block = Texts(texts)
        starts = paths["start"].to_numpy() + block.before[paths["row"].to_numpy()] if paths.num_rows else np.zeros(0, np.int64)
        lengths = paths["windows"].to_numpy() + words - 1 if paths.num_rows else np.zeros(0, np.int64)
        gone = covered(block.words, starts, lengths)
        lost = np.append(0, np.cumsum(gone))[block.before]
        stay = np.flatnonzero(~gone)
        buf = np.append(block.buf, np.uint8(0x20))
        lens = block.ends[stay] - block.starts[stay] + 1
        norm, off = C.slices(buf, block.starts[stay], lens)
        if len(norm):
            norm[off[1:] - 1] = 0x20
        left = off[block.before - lost]
        digests = [hashlib.sha256(norm[a : max(a, b - 1)]).hexdigest() for a, b in zip(left[:-1], left[1:], strict=True)]
        out = {"doc_id": C.ids_back(block.ids), "n_words": np.diff(block.before), "n_removed": np.diff(lost), "kept_sha256": pa.array(digests, pa.string())}
        if texts_too:
            # a removed word goes with the space up to the next word
            until = np.append(block.starts[1:], len(block.buf))[: block.words]
            until = np.minimum(until, block.off[1:][block.row]) if block.words else until
            keep = ~covered(len(block.buf), block.starts[gone], until[gone] - block.starts[gone])
            at = np.append(0, np.cumsum(keep))[block.off]
            out["kept"] = C.binary(block.buf[keep], at).cast(pa.large_string()).cast(pa.string())
            out["carried"] = C.loose(block.table["carried"])
        return pa.table(out)

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, block_bytes: int = C.BLOCK_BYTES, texts: bool = True) -> DataFrame:
    """One row per row of df: doc_id, n_words, n_removed, kept_sha256 and, if texts are asked for, kept (the text
    without the removed words) and carried (a struct: df's other columns, and whether the text was null).

    Words are runs of bytes other than ASCII white space, as they stand; a null text has none.  A word goes if
    a window of `words` words covers it whose words also start earlier: in a row of smaller id, or at an earlier
    word under the same id.  A null id comes after all others.  An empty table gives an empty result.
    """
    C.prepare(df.sparkSession)
    rows = C.rows_of(df, id_col, text_col)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if texts:
        carried = [F.col(f"`{c}`") for c in df.columns if c != text_col]
        none = F.col(text_col).isNull().alias("none")
        rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(F.struct(*carried).alias("row"), none).alias("carried"))
        schema = StructType.fromDDL(schema).add("kept", "string").add("carried", C.nullable(rows.schema["carried"].dataType))
    rows, blocks = _dealt(rows, block_bytes)
    paths = _paths(rows, blocks, words)
    return rows.groupBy("block").cogroup(paths.groupBy("block")).applyInArrow(C.lean_pair(_finished(words, texts)), schema)


def _dealt(rows: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    blocks = C.block_count(rows, "text", block_bytes)
    return C.in_blocks(rows, blocks), blocks


def _paths(rows: DataFrame, blocks: int, words: int) -> DataFrame:
    """Where the dealt documents have paths."""
    bare = rows.select("doc_id", "text", "block")
    spark = rows.sparkSession
    place = C.shared_dir(spark, "spans")
    said = A.settled_messages(bare, _offered(words, blocks), _sent(words, blocks), _settled(words))
    spans = C.written(bare.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(C.lean_pair(_spread(words, blocks)), SPAN), "spans", place)
    del said, bare
    C.tidy(spark)
    # only what is needed of a place goes on
    paths = C.written(compacted(spans, spans.count()).select("block", "row", "start", "windows"), "paths")
    del spans
    C.remove(spark, place)
    C.tidy(spark)
    return paths


def repeated_paths(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, block_bytes: int = C.BLOCK_BYTES) -> DataFrame:
    """The unbranched paths of the graph of repeated windows: source and at (the document and word where they stand first),
    n_words, and places (how many later places have them)."""
    C.prepare(df.sparkSession)
    rows, blocks = _dealt(C.rows_of(df, id_col, text_col), block_bytes)
    said = A.settled_messages(rows, _offered(words, blocks), _sent(words, blocks), _settled(words))
    spans = C.written(rows.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(C.lean_pair(_spread(words, blocks)), SPAN), "spans")
    found = compacted(spans, spans.count())
    return found.groupBy("source", "at", (F.col("windows") + words - 1).alias("n_words")).agg(F.count(F.lit(1)).alias("places"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """df with the repeated words cut from its texts; texts that lose none stay as they are, null ones null.  An empty
    table stays empty; columns may have any names."""
    found = remove_repeats(df, id_col, text_col, **named)
    row = F.col("carried").getField("row")
    text = F.when(~F.col("carried").getField("none"), F.col("kept"))
    return found.select(*((text if c == text_col else row.getField(c)).alias(c) for c in df.columns))
