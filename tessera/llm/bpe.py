"""Byte-level BPE with the merge ranks of a public vocabulary.

Text is parted by the vocabulary's pattern in the JVM.  Each distinct part ("word") of the corpus is encoded once, by
Spark higher-order functions: its bytes become an array of ranks, and a fold merges the neighbours of lowest rank until
none are left.  Ranks of merges come from a literal map (in buckets) by the ranks of the two neighbours.

1. Tasks cut their rows into chunks of some MB, number the distinct words of a chunk, and write to the shared folder,
   compressed: the rows' word numbers, and the words by bucket of their hash.
2. A bucket's distinct words go through the fold, each once, and every chunk gets the ids of the words it sent.
3. Each chunk's rows meet the ids of the chunk's words.  Decoding concatenates the ids' binary pieces.

No text is shuffled.  A chunk sends a bucket at most one message, and none without words, so that messages are never
more than the chunks' distinct words.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .simhash import xxh64

#: Buckets of the literal map; a prime, so that close keys fall apart.
MAPS = 65_521
#: Bytes of a chunk's text, of the text whose words a bucket should get, and words that a row may list.
CHUNK_BYTES, BUCKET_BYTES, LIST = 12 << 20, 32 << 20, 4096
#: Up to so many bytes a step of the fold merges one pair; in longer words, all places of the lowest pair.
SHORT = 64
#: A merge is told from a symbol by its sign.
_SHIFT = 1 << 40


def read_ranks(path: str) -> list[bytes]:
    """Pieces by rank, from a file of base64 pieces with their ranks."""
    out = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                piece, rank = line.split()
                out[int(rank)] = base64.b64decode(piece)
    return [out[i] for i in range(len(out))]


def literal(value, kind: str) -> Column:
    """A constant of any type, which the optimizer parses once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def big(value: int) -> Column:
    return F.lit(value).cast("bigint")


class Ranks:
    """The vocabulary as literals: ranks by byte, merges by the ranks of two neighbours, a character for each rank."""

    def __init__(self, pieces: list[bytes]):
        ranks = {p: i for i, p in enumerate(pieces)}
        self.size = len(pieces)
        maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
                if a is not None and b is not None:
                    key = a * self.size + b
                    maps[key % MAPS][str(key)] = rank - _SHIFT
        self.bytes = literal([ranks[bytes([i])] for i in range(256)], "array<bigint>")
        self.merges = literal([m or None for m in maps], "array<map<string,bigint>>").cast("array<map<bigint,bigint>>")
        self.chars = literal([chr(symbol(i)) for i in range(self.size)], "array<string>")
        # a piece that its own merges don't reach is still one token where it is a whole word
        self.whole = {p: r for p, r in ranks.items() if _merged(p, ranks) != [r]}

    def lookup(self, merges: Column, left: Column, right: Column, less: int = 0) -> Column:
        """What two neighbours (whose key is greater by `less`) merge to, as its rank - _SHIFT, or null."""
        key = left * big(self.size) + right
        key = key + big(less) if less else key
        return F.element_at(F.get(merges, (key % big(MAPS)).cast("int")), key)


def symbol(rank: int) -> int:
    """The code point that stands for a rank, in the ranks' order: no surrogates, no zero."""
    return rank + 1 if rank < 0xD7FF else rank + 0x801


def rank_of(char: Column) -> Column:
    code = F.ascii(char).cast("bigint")
    return code - F.when(code < 0xD800, big(1)).otherwise(big(0x801))


def _merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges of a short word one after the other, without a look at the whole."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        low, i = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if low == len(ranks):
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def let(value: Column, use) -> Column:
    """use(value), with value worked out once: lambdas evaluate what they hold again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def steps(n: Column, state: Column, step) -> Column:
    """The state after as many steps as a word of n bytes can have merges."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), state, lambda s, _: step(s))


def fold_short(symbols: Column, merges: Column, ranks: Ranks) -> Column:
    """A step merges one pair: the leftmost of the lowest.

    The state is one array: each symbol, and behind it what it and the next merge to (less than zero) or null; a null
    stands before the first and behind the last.  Only the two merges around a new symbol are looked up anew.
    """
    rest = F.lit(1 << 30)

    def step(z):
        def merge(low):
            def at(i):  # the merge's place, counted from one
                new = low + big(_SHIFT)
                middle = F.array(ranks.lookup(merges, F.get(z, i - 4), low, _SHIFT), new, ranks.lookup(merges, new, F.get(z, i + 2)))
                return F.concat(F.slice(z, F.lit(1), i - 3), middle, F.slice(z, i + 3, rest))

            return F.when(low < 0, let(F.array_position(z, low).cast("int"), at)).otherwise(z)

        return let(F.array_min(z), merge)

    none = F.array(F.lit(None).cast("bigint"))
    start = let(F.concat(none, symbols, none), lambda p: F.flatten(F.zip_with(p, F.slice(p, F.lit(2), rest), lambda a, b: F.array(a, ranks.lookup(merges, a, b)))))
    return F.filter(steps(F.size(symbols), start, step), lambda x: x.isNotNull())


def fold_long(symbols: Column, merges: Column, ranks: Ranks) -> Column:
    """A step merges all places of the lowest pair, from the left; the symbols are the characters of a string.

    That is what merging them one by one gives, unless a merge brings about a pair that is lower still: then the
    step merges the leftmost place only.
    """

    def folded(chars):
        def looked(s):
            """The string with its lowest merge (low, pair)."""
            pairs = lambda c: F.array_distinct(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.concat(a, b)))
            merge = lambda p: F.struct(ranks.lookup(merges, rank_of(p), rank_of(F.substring(p, 2, 1))).alias("low"), p.alias("pair"))
            found = let(F.split(s, ""), lambda c: F.transform(pairs(c), merge))
            return F.struct(s.alias("s"), F.array_min(F.filter(found, lambda x: x["low"].isNotNull())).alias("next"))

        def step(state):
            s, low, pair = state["s"], state["next"]["low"], state["next"]["pair"]
            higher = lambda x: F.coalesce(x > low, F.lit(True))

            def merge(new):
                first = lambda i: F.concat(F.substring(s, F.lit(1), i - 1), new, F.substring(s, i + 2, F.length(s)))
                safe = lambda x: higher(x["next"]["low"]) & higher(ranks.lookup(merges, low, rank_of(pair), _SHIFT * ranks.size))
                return let(let(F.replace(s, pair, new), looked), lambda x: F.when(safe(x), x).otherwise(let(let(F.instr(s, pair), first), looked)))

            return F.when(state["next"].isNull(), state).otherwise(let(F.get(chars, (low + big(_SHIFT)).cast("int")), merge))

        text = F.array_join(F.transform(symbols, lambda x: F.get(chars, x.cast("int"))), "")
        return F.transform(F.split(steps(F.size(symbols), let(text, looked), step)["s"], ""), rank_of)

    return let(ranks.chars, folded)


def fold(word: Column, ranks: Ranks) -> Column:
    """The ranks of a word's pieces after all merges (array<int>), for a non-empty string column."""
    symbols = let(ranks.bytes, lambda table: F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.get(table, F.ascii(c))))
    folded = lambda x, m: F.when(F.size(x) <= SHORT, fold_short(x, m, ranks)).otherwise(fold_long(x, m, ranks))
    out = let(ranks.merges, lambda m: let(symbols, lambda x: folded(x, m))).cast("array<int>")
    for piece, rank in ranks.whole.items():
        out = F.when(word.cast("binary") == F.lit(piece), F.array(F.lit(rank))).otherwise(out)
    return out


def _numbered(chunk_bytes, buckets):
    """Of each chunk: its rows' words as numbers, the buckets of its words, and a message for each of these buckets.

    Numbers go by falling count, so that most are small, then by word, so that messages are nearly sorted.
    """

    def chunk(number, held):
        flat = pa.concat_arrays([b.column("words").flatten() for b in held]).dictionary_encode()
        codes, names = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
        count = np.bincount(codes, minlength=len(names))
        order = pc.sort_indices(pa.table({"n": -count, "w": names}), sort_keys=[("n", "ascending"), ("w", "ascending")]).to_numpy()
        place = np.empty(len(names), np.uint32)
        place[order] = np.arange(len(names))
        codes, at = place[codes], 0
        for b in held:
            counts = pc.list_value_length(b.column("words")).to_numpy(zero_copy_only=False).astype(np.uint32)
            mine = codes[at : at + int(counts.sum())]
            null = pc.is_null(b.column("doc_id")).to_numpy(zero_copy_only=False).astype(np.uint8)
            yield number, -1, C.squeeze(C.ids_of(b.column("doc_id")), null, counts, np.minimum(mine, 255).astype(np.uint8), mine[mine >= 255])
            at += len(mine)
        data, off = C.flat(names.take(pa.array(order)))
        which = (xxh64(data, off[:-1], np.diff(off)) % np.uint64(buckets)).astype(np.uint32)
        yield number, -2, C.squeeze(which)
        by = np.argsort(which, kind="stable")
        cut = np.flatnonzero(np.append(True, which[by][1:] != which[by][:-1])) if len(by) else []
        for a, z in zip(cut, [*cut[1:], len(by)][: len(cut)], strict=True):
            text, ends = C.slices(data, off[by[a:z]], np.diff(off)[by[a:z]])
            yield number, int(which[by[a]]), C.squeeze(np.diff(ends).astype(np.uint32), text)

    def rows(found):
        number, bucket, body = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(bucket, pa.int32()), pa.array(body, pa.binary())], ["chunk", "bucket", "body"])

    def run(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            # an offset of four bytes beside some five of text
            if size > 2 * chunk_bytes:
                yield rows(chunk(number, held))
                number, held, size = number + 1, [], 0
                C.trim()
        if held:
            yield rows(chunk(number, held))
        del held
        C.trim()

    return run


def _distinct(table: pa.Table) -> pa.Table:
    """A bucket's distinct words, in lists, then which of them each message has."""
    sent = [C.expand(x, np.uint32, np.uint8) for x in table["body"].to_pylist()]
    sizes = np.concatenate([n for n, _ in sent]).astype(np.int64)
    coded = C.binary(np.concatenate([t for _, t in sent]), np.append(0, np.cumsum(sizes))).dictionary_encode()
    names, codes = coded.dictionary.cast(pa.large_string()).cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False)
    cuts = np.arange(0, len(names), LIST)
    ends = np.cumsum([len(n) for n, _ in sent])
    lists = pa.ListArray.from_arrays(pa.array([*cuts, *[len(names)] * (len(sent) + 1)], pa.int32()), names)
    bodies = [None] * len(cuts) + [C.squeeze(codes[z - len(n) : z]) for z, (n, _) in zip(ends, sent, strict=True)]
    n = len(cuts) + len(sent)
    return pa.table({"chunk": pa.array([None] * len(cuts) + table["chunk"].to_pylist(), pa.int64()), "bucket": pa.array([table["bucket"][0].as_py()] * n, pa.int32()), "body": pa.array(bodies, pa.binary()), "words": lists})


def _answered(batches):
    """The ids of each message's words, in its order; a bucket's words come before its messages."""
    bucket, parts, table = None, [], None
    for batch in batches:
        out = []
        ids = batch.column("ids")
        for i, (chunk, number, body) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("bucket").to_pylist(), batch.column("body").to_pylist(), strict=True)):
            if number != bucket:
                bucket, parts, table = number, [], None
            if body is None:
                parts.append(ids[i].values)
                continue
            if table is None:
                every = pa.concat_arrays(parts)
                table, parts = _lists(every), []
            codes = C.expand(body, np.int32)[0]
            values, off = table
            size = off[codes + 1] - off[codes]
            out.append((chunk, bucket, C.squeeze(size.astype(np.uint32), C.slices(values, off[codes], size)[0].astype(np.uint32))))
        C.trim()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["chunk", "bucket", "body"])


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), off - off[0]


def _rows(sent, answers):
    """(doc ids, token ids, their offsets) of each of a chunk's batches of rows."""
    which = next(C.expand(body, np.uint32)[0] for bucket, body in zip(sent["bucket"].to_pylist(), sent["body"].to_pylist(), strict=True) if bucket == -2)
    said = dict(zip(answers["bucket"].to_pylist(), answers["body"].to_pylist(), strict=True)) if answers.num_rows else {}
    got = [C.expand(said[k], np.uint32, np.uint32) for k in sorted(said)]
    size, start = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
    if got:
        sizes = np.concatenate([n for n, _ in got]).astype(np.int64)
        order = np.argsort(which, kind="stable")
        size[order], start[order] = sizes, np.cumsum(sizes) - sizes
    ids = np.concatenate([x for _, x in got]).astype(np.int32) if got else np.zeros(0, np.int32)
    for bucket, body in zip(sent["bucket"], sent["body"], strict=True):
        if bucket.as_py() == -1:
            doc_id, null, counts, low, rest = C.expand(body.as_py(), np.int64, np.uint8, np.uint32, np.uint8, np.uint32)
            codes = low.astype(np.int64)
            codes[low == 255] = rest
            tokens, at = C.slices(ids, start[codes], size[codes])
            yield pa.array(doc_id, pa.int64(), mask=null > 0), tokens, at[np.append(0, np.cumsum(counts, dtype=np.int64))]


def _encoded(sent, answers):
    if not sent.num_rows:
        return None
    parts = [pa.table({"doc_id": doc_id, "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))}) for doc_id, ids, at in _rows(sent, answers)]
    return pa.concat_tables(parts)


class Pieces:
    """The vocabulary's bytes, one piece after the other, and the decimal digits of all ids, a space behind each."""

    def __init__(self, path: str):
        pieces = read_ranks(path)
        self.data, self.off = self._flat(pieces)
        self.digits, self.digits_off = self._flat([b"%d " % i for i in range(len(pieces))])

    @staticmethod
    def _flat(items):
        return np.frombuffer(b"".join(items), np.uint8), np.append(0, np.cumsum([len(x) for x in items]))

    def decode(self, ids, at):
        """The concatenated pieces of lists of ids: bytes and offsets."""
        data, off = C.slices(self.data, self.off[ids], self.off[ids + 1] - self.off[ids])
        return data, off[at]

    def decimals(self, ids, at):
        """The ids' digits, one space between: bytes, and from where to where each list has them."""
        data, off = C.slices(self.digits, self.digits_off[ids], self.digits_off[ids + 1] - self.digits_off[ids])
        return data, off[at[:-1]], np.maximum(off[at[:-1]], off[at[1:]] - 1)


#: Of this Python worker, by path.
_PIECES: dict[str, Pieces] = {}


def _digested(path):
    def run(sent, answers):
        if not sent.num_rows:
            return None
        pieces = _PIECES.get(path) or _PIECES.setdefault(path, Pieces(path))
        sha = lambda data, a, z: pa.array([hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(a, z, strict=True)], pa.string())
        parts = []
        for doc_id, ids, at in _rows(sent, answers):
            decoded, off = pieces.decode(ids, at)
            parts.append(pa.table({"doc_id": doc_id, "n_tokens": np.diff(at), "ids_sha256": sha(*pieces.decimals(ids, at)), "decoded_sha256": sha(decoded, off[:-1], off[1:])}))
        return pa.concat_tables(parts)

    return run


def _path(ranks: str | None) -> str:
    import public_tokenizers as public

    return ranks or public.path("byte_bpe_50k.tiktoken")


def _chunks(df: DataFrame, ranks: str | None, pattern: str | None, id_col: str, text_col: str, chunk_bytes: int):
    """The chunks' rows and their words' ids, both by chunk."""
    import public_tokenizers as public

    spark = df.sparkSession
    C.prepare(spark)
    rows = C.rows_of(df, id_col, text_col)
    buckets = max(C.slots(spark), C.block_count(rows, "text", BUCKET_BYTES))
    # (?U): white space as Unicode has it
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?U)" + (pattern or public.PATTERN)), F.lit(0)).alias("words")
    schema = "chunk long, bucket int, body binary"
    # dealt by chunk, so that only the answers are shuffled to the rows
    sent = C.bucketed(rows.select("doc_id", words).mapInArrow(_numbered(chunk_bytes, buckets), schema), "words", ["chunk"], buckets)
    # the fold costs far more than its rows' bytes say: as many partitions as buckets
    asked = sent.select(*(F.col(c).alias(c) for c in sent.columns)).filter("bucket >= 0")
    found = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(C.lean(_distinct), f"{schema}, words array<string>")
    vocabulary = Ranks(read_ranks(_path(ranks)))
    folded = found.select("chunk", "bucket", "body", F.transform("words", lambda w: fold(w, vocabulary)).alias("ids"))
    return sent.filter("bucket < 0").groupBy("chunk").cogroup(folded.mapInArrow(C.lean_map(_answered), schema).groupBy("chunk"))


def encode(df: DataFrame, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of df: doc_id, ids (array<int>).  A null text is empty and has no ids.

    Special tokens are ordinary text.  Repeated rows and null ids are encoded row by row; an empty table gives an
    empty result; other columns of df are ignored.
    """
    return _chunks(df, ranks, pattern, id_col, text_col, chunk_bytes).applyInArrow(C.lean_pair(_encoded), "doc_id long, ids array<int>")


def _decoded(path):
    def run(batches):
        pieces = Pieces(path)
        for batch in batches:
            ids, at = _lists(batch.column("ids"))
            yield pa.RecordBatch.from_arrays([*batch.columns, C.binary(*pieces.decode(ids, at)).cast(pa.binary())], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """encode()'s rows with `decoded`, the concatenated pieces (binary)."""
    C.prepare(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(_path(ranks)), "doc_id long, ids array<int>, decoded binary")


def digests(df: DataFrame, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, spaces between) and decoded_sha256 of each row, where encode()
    finds the ids and decode()'s pieces are the bytes.  Nulls, repeated rows and empty tables: as encode() has them."""
    return _chunks(df, ranks, pattern, id_col, text_col, chunk_bytes).applyInArrow(C.lean_pair(_digested(_path(ranks))), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
