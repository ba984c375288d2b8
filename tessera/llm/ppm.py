"""Language-model scoring by prediction by partial matching (PPM, escape method C, symbol exclusion).

A document is its words in lower case, each followed by a space, and an end byte.  Every byte is predicted from
the longest context of up to five bytes before it that was seen in training; a byte that is new there costs an
escape, after which the next shorter context is asked without the symbols that the longer one has had, down to
256 equal shares.  log10 of these adds up to the document's code length.

The byte-context trie is spread by the three bytes next to the symbol: all longer contexts hang below them.  The
three shortest orders are counts of three bytes (2^24 at most, whatever the input; some 10^5 in text) and go to every
task.  Blocks of documents send their distinct six-byte grams with counts to the trie's parts, and distinct words with
counts to parts of the vocabulary, each only to parts that it has something for; both answer in the order asked.  A
gram's probability is worked out once per part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .exact_dedup import by_bytes

ORDER = 5
END = 0x0A
MESSAGE = "block int, part int, kind int, body binary"


def held_out(column):
    """Rows that the model must not learn from."""
    return F.coalesce(F.crc32(column.cast("string")) % 7 == 2, F.lit(False))


def stream(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, text offsets, word offsets) of the texts' words, each with a space, and an end byte a text.

    The end is one more word of a text, so word offsets part the bytes without gaps.
    """
    starts, ends, before = C.words_of(buf, off)
    n = len(off) - 1
    lens = np.empty(len(starts) + n, np.int64)
    end_at = before[1:] + np.arange(n)
    word = np.ones(len(lens), bool)
    word[end_at] = False
    lens[word] = ends - starts + 1
    lens[end_at] = 1
    at = np.append(0, np.cumsum(lens))
    src = np.full(len(lens), len(buf))
    src[word] = starts
    out, _ = C.slices(np.append(buf, np.uint8(END)), src, np.where(word, np.minimum(lens, len(buf) + 1 - src), lens))
    out = C.LOWER[out]
    out[at[1:][word] - 1] = 0x20
    return out, at[np.append(0, end_at + 1)], at


def grams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte: the byte before it, the one before that, ... (END before a text), and last itself."""
    padded = np.full(len(data) + ORDER * (len(off) - 1) + ORDER, END, np.uint8)
    at = np.arange(len(data)) + np.repeat(ORDER * np.arange(1, len(off)), np.diff(off))
    padded[at] = data
    code = np.zeros(len(data), np.uint64)
    for k in range(1, ORDER + 1):
        code = code << np.uint64(8) | padded[at - k]
    return code << np.uint64(8) | data


def _triples(batches):
    """Counts of (byte before, the one before that, byte) in training texts."""
    keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for batch in batches:
        for part, buf, off in by_bytes(batch, 2 << 20):
            data, ends, _ = stream(buf, off)
            code = grams(data, ends)[np.repeat(part.column("train").to_numpy(zero_copy_only=False), np.diff(ends))]
            if len(code):
                new, n = np.unique((code >> np.uint64(32) << np.uint64(8) | code & np.uint64(255)).astype(np.uint32), return_counts=True)
                keys, counts = summed(np.concatenate([keys, new]), np.concatenate([counts, n]))
    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["triple", "n"])


class Block:
    def __init__(self, table: pa.Table):
        table = C.in_order(table)
        self.ids, self.train = table["doc_id"], table["train"].to_numpy(zero_copy_only=False)
        buf, off = C.flat(table["text"])
        self.pieces = []
        at = 0
        while at < table.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + (4 << 20), "right")) - 1)
            self.pieces.append((at, to, *stream(buf[off[at] : off[to]], off[at : to + 1] - off[at])))
            at = to

    def grams(self):
        """Sorted distinct grams of the block, and how often each occurs in training texts."""
        found = []
        for at, to, data, off, _ in self.pieces:
            code = np.sort(grams(data, off) << np.uint64(1) | np.repeat(self.train[at:to], np.diff(off)))
            head = np.flatnonzero(np.append(True, code[1:] >> np.uint64(1) != code[:-1] >> np.uint64(1)))
            found.append((code[head] >> np.uint64(1), np.add.reduceat((code & np.uint64(1)).astype(np.int64), head)))
        return summed(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def words(self):
        """Distinct words of the block with their training counts, and each piece's words as numbers of these."""
        names, codes = None, []
        for _, _, data, _, at in self.pieces:
            coded = C.binary(data, at).dictionary_encode()
            if names is None:
                names, here = coded.dictionary, np.arange(len(coded.dictionary))
            else:
                here = pc.index_in(coded.dictionary, names)
                new = coded.dictionary.filter(pc.is_null(here))
                here = here.to_numpy(zero_copy_only=False).copy()
                here[np.isnan(here)] = len(names) + np.arange(len(new)) if len(new) else 0
                here = here.astype(np.int64)
                names = pa.concat_arrays([names, new])
            codes.append(here[coded.indices.to_numpy(zero_copy_only=False)])
        counts = np.zeros(len(names), np.int64)
        for (at, to, _, off, word_off), code in zip(self.pieces, codes, strict=True):
            learn = np.repeat(self.train[at:to], np.diff(np.searchsorted(word_off, off)))
            counts += np.bincount(code[learn], minlength=len(names))
        return names, counts, codes


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[head], np.add.reduceat(counts[order], head)


def gram_parts(keys: np.ndarray, parts: int) -> np.ndarray:
    return (C.mix(keys >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)


def word_parts(names: pa.Array, parts: int) -> np.ndarray:
    from .simhash import xxh64

    buf, off = C.flat(names)
    return (xxh64(buf, off[:-1], np.diff(off)) % np.uint64(parts)).astype(np.int64)


def by_part(which: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(which, kind="stable")
    return order, np.searchsorted(which[order], np.arange(parts + 1))


def _messages(block: int, rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"block": pa.array([block] * len(rows), pa.int32()), "part": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "body": pa.array([r[2] for r in rows], pa.binary())})


def _ask(parts):
    def run(table):
        block, rows = Block(table), []
        keys, counts = block.grams()
        order, at = by_part(gram_parts(keys, parts), parts)
        for k in np.flatnonzero(np.diff(at)):
            i = order[at[k] : at[k + 1]]
            rows.append((int(k), 0, C.squeeze(np.diff(keys[i], prepend=np.uint64(0)), counts[i].astype(np.uint32))))
        names, counts, _ = block.words()
        order, at = by_part(word_parts(names, parts), parts)
        for k in np.flatnonzero(np.diff(at)):
            i = order[at[k] : at[k + 1]]
            text, off = C.flat(names.take(pa.array(i)))
            rows.append((-1 - int(k), 1, C.squeeze(counts[i].astype(np.uint32), np.diff(off).astype(np.uint32), text)))
        return _messages(int(table["block"][0].as_py()), rows)

    return run


def log_probabilities(keys: np.ndarray, counts: np.ndarray, triples: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of each gram's probability, from the counts of all grams with the same three last context bytes.

    keys: sorted; the context's bytes nearest first, then the symbol.  triples: training counts of order two, by sorted
    (byte before, the one before that, symbol).
    """
    pairs = summed((triples[0] >> 16 << 8 | triples[0] & 255).astype(np.uint64), triples[1])
    single = summed(pairs[0] & np.uint64(255), pairs[1])
    short = {2: (triples[0].astype(np.uint64), triples[1]), 1: pairs, 0: single}
    symbol = keys & np.uint64(255)
    seen = counts > 0
    out, todo = np.zeros(len(keys)), np.ones(len(keys), bool)
    escaped_from = None  # of the last longer context: (contexts, symbols) it has had

    def level(order):
        """Of one order: sorted (context, symbol) keys with counts; each gram's context."""
        shift = np.uint64(8 * (ORDER - order) + 8)
        context = keys >> shift
        k, c = summed((context << np.uint64(8) | symbol)[seen], counts[seen]) if seen.any() else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return context, k, c

    def stats(contexts, values):
        """Sums by sorted context."""
        if not len(contexts):
            return contexts, values[:0], values[:0]
        head = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1]))
        return contexts[head], np.add.reduceat(values, head), np.diff(np.append(head, len(contexts)))

    def find(table, wanted, values):
        if not len(table):
            return np.zeros(len(wanted), values.dtype if hasattr(values, "dtype") else np.int64)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return np.where(table[at] == wanted, values[at], 0)

    for order in range(ORDER, -1, -1):
        if order > 2:
            context, k, c = level(order)
        else:
            context = keys >> np.uint64(8 * (ORDER - order) + 8)
            k, c = short[order]
        names, total, kinds = stats(k >> np.uint64(8), c)
        total, kinds = find(names, context, total), find(names, context, kinds)
        if escaped_from is not None:
            # what the longer context has had is no choice here
            longer, had = escaped_from
            mine = ((longer >> np.uint64(16)) << np.uint64(8) if order else np.uint64(0)) | longer & np.uint64(255)
            names, less, fewer = stats(longer >> np.uint64(8), find(k, mine, c))
            total, kinds = total - find(names, had, less), kinds - find(names, had, fewer)
        own = np.where(todo, find(k, context << np.uint64(8) | symbol, c), 0)
        asked = todo & (kinds > 0)
        hit = asked & (own > 0)
        out[hit] += np.log10(own[hit] / (total[hit] + kinds[hit]))
        miss = asked & ~hit
        out[miss] += np.log10(kinds[miss] / (total[miss] + kinds[miss]))
        todo &= ~hit
        escaped_from = k, context
        # the next shorter context drops the byte farthest away
    out[todo] -= np.log10(256 - len(single[0])) if len(single[0]) < 256 else 0
    return out


def _answer(triples):
    def run(table):
        blocks, bodies, kind, part = table["block"].to_pylist(), table["body"].to_pylist(), table["kind"][0].as_py(), table["part"][0].as_py()
        rows = []
        if kind == 0:
            sent = [C.expand(x, np.uint64, np.uint32) for x in bodies]
            keys = [np.cumsum(k, dtype=np.uint64) for k, _ in sent]
            every, counts = summed(np.concatenate(keys), np.concatenate([c for _, c in sent]).astype(np.int64))
            found = log_probabilities(every, counts, triples.value)
            for block, mine in zip(blocks, keys, strict=True):
                # as bytes, so that equal values are found as such
                rows.append((block, C.squeeze(found[np.searchsorted(every, mine)].view(np.uint8))))
        else:
            sent = [C.expand(x, np.uint32, np.uint32, np.uint8) for x in bodies]
            names = [C.binary(t, np.append(0, np.cumsum(n, dtype=np.int64))) for _, n, t in sent]
            coded = pa.concat_arrays(names).dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            counts = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(counts, code, np.concatenate([c for c, _, _ in sent]).astype(np.int64))
            at = 0
            for block, mine in zip(blocks, names, strict=True):
                rows.append((block, C.squeeze(counts[code[at : at + len(mine)]])))
                at += len(mine)
        n = len(rows)
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([part] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "body": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _totals(table: pa.Table) -> pa.Table:
    """Training tokens of a part of the vocabulary, and how many different ones."""
    n = kinds = 0
    if table["kind"][0].as_py():
        sent = [C.expand(x, np.uint32, np.uint32, np.uint8) for x in table["body"].to_pylist()]
        seen = [c > 0 for c, _, _ in sent]
        n = sum(int(c.sum(dtype=np.int64)) for c, _, _ in sent)
        names = [C.binary(t, np.append(0, np.cumsum(m, dtype=np.int64))).filter(pa.array(s)) for s, (_, m, t) in zip(seen, sent, strict=True)]
        kinds = len(pa.concat_arrays(names).unique())
    return pa.table({"trained": pa.array([n], pa.int64()), "kinds": pa.array([kinds], pa.int64())})


def _score(parts):
    def run(texts, messages):
        if not texts.num_rows:
            return None
        block = Block(texts)
        said = {k: body for k, body in zip(messages["part"].to_pylist(), messages["body"].to_pylist(), strict=True)}
        names, _, codes = block.words()
        known = np.zeros(len(names), np.int64)
        order, at = by_part(word_parts(names, parts), parts)
        for k in np.flatnonzero(np.diff(at)):
            known[order[at[k] : at[k + 1]]] = C.expand(said[-1 - int(k)], np.int64)[0]
        share = np.log10(known + 1)
        keys, _ = block.grams()
        bits = np.zeros(len(keys))
        order, at = by_part(gram_parts(keys, parts), parts)
        for k in np.flatnonzero(np.diff(at)):
            bits[order[at[k] : at[k + 1]]] = C.expand(said[int(k)], np.uint8)[0].view(np.float64)
        cols = [[] for _ in range(4)]
        table = pa.array(keys)
        for (_, _, data, off, word_off), code in zip(block.pieces, codes, strict=True):
            edge = np.searchsorted(word_off, off)[:-1]
            cols[0].append(np.diff(np.append(edge, len(code))))
            cols[1].append(np.add.reduceat((known[code] > 0).astype(np.int64), edge))
            cols[2].append(np.add.reduceat(share[code], edge))
            coded = pa.array(grams(data, off)).dictionary_encode()
            value = bits[pc.index_in(coded.dictionary, table).to_numpy(zero_copy_only=False)]
            cols[3].append(np.add.reduceat(value[coded.indices.to_numpy(zero_copy_only=False)], off[:-1]))
        n_tokens, n_known, counted, score = map(np.concatenate, cols)
        return pa.table({"doc_id": block.ids, "train": pa.array(block.train), "n_tokens": n_tokens, "n_known": n_known, "counted": counted, "score": score})

    return run


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = C.BLOCK_BYTES) -> DataFrame:
    """One row per row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(id as text) mod 7 is not 2 (a null id is learnt from) and scores all.  Words are
    runs of bytes other than ASCII white space with A-Z in lower case, a null text has none; the end counts as a
    token.  base_score is the word model's, score the PPM model's log10 probability of the tokens.  With nothing
    to learn from, each byte costs log10(256).  An empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    C.prepare(spark)
    rows = C.rows_of(df, id_col, text_col).withColumn("train", ~held_out(F.col("doc_id")))
    blocks = C.block_count(rows, "text", block_bytes)
    found = rows.mapInArrow(C.lean_map(_triples), "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")).orderBy("triple").toArrow()  # at most 2^24 rows
    triples = spark.sparkContext.broadcast((found["triple"].to_numpy().astype(np.uint32), found["n"].to_numpy()))
    rows = C.in_blocks(rows, blocks)
    asked = rows.groupBy("block").applyInArrow(C.lean(_ask(blocks)), MESSAGE)
    answered = asked.groupBy("part").applyInArrow(C.lean(_answer(triples)), MESSAGE)
    schema = "doc_id long, train boolean, n_tokens long, n_known long, counted double, score double"
    scored = rows.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(C.lean_pair(_score(blocks)), schema)
    totals = asked.groupBy("part").applyInArrow(C.lean(_totals), "trained long, kinds long").agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("trained"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds"))
    # each token's share is (count + 1) over the same sum: the sum comes in at the end, one row for all tasks
    all_ = F.broadcast(totals.withColumn("one", F.lit(1)))
    base = F.col("counted") - F.col("n_tokens") * F.log10(F.col("trained") + F.col("kinds") + 1)
    return scored.withColumn("one", F.lit(1)).join(all_, "one").select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.col("trained").alias("train_tokens"), base.alias("base_score"), "score")
