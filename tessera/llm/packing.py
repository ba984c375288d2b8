"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best-fit: a task holds a fixed number of open bins.  A bitset has a bit for each amount
of free space that some open bin has, so the tightest bin that takes a piece is the lowest set bit at or
above the piece's length.  If a piece fits nowhere and all bins are in use, the fullest closes first.
A task keeps its open bins from batch to batch and never moves a text.  When it ends, the pieces of bins that are not
full go to a second round of the same, in few tasks: what a task throws away doesn't grow with the number of tasks.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 4096
OPEN_BINS = 4096
END_ID = 1
#: A bin with more free space than this share of its length is packed anew when its task ends; pieces that a task holds
#: back for that at most; bins that a task of the second round should make.
SLACK, HELD, ROUND = 1 / 64, 1 << 17, 1 << 14


class Packer:
    """place(n) says which bin takes n more tokens, and at which offset; `closed` has the bins that closed since."""

    def __init__(self, length: int = LENGTH, most: int = OPEN_BINS):
        self.length, self.most = length, most
        self.free: list[list[int]] = [[] for _ in range(length + 1)]  # open bins by their free space
        self.bits = 0
        self.open = self.made = 0
        self.closed: list[int] = []

    def _put(self, number: int, space: int) -> None:
        if space:
            self.free[space].append(number)
            self.bits |= 1 << space
            self.open += 1
        else:
            self.closed.append(number)

    def _take(self, space: int) -> int:
        number = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.open -= 1
        return number

    def close(self) -> int:
        """The fullest bin closes; its free space."""
        space = (self.bits & -self.bits).bit_length() - 1
        self.closed.append(self._take(space))
        return space

    def place(self, n: int) -> tuple[int, int]:
        fits = self.bits >> n << n
        if fits:
            space = (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.most:
                self.close()
            number, space = self.made, self.length
            self.made += 1
        self._put(number, space - n)
        return number, self.length - space


#: Fixed value: the pattern of the tokenizer whose parts of a word are known beforehand.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: By byte: a letter's, a digit, any other sign that is sure to be one, or not known here.
LETTER, DIGIT, SIGN, UNKNOWN = 1, 2, 3, 9
KIND = np.full(256, UNKNOWN, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = LETTER
KIND[48:58] = DIGIT
KIND[ord("'")] = UNKNOWN


def parts_in(words: list[bytes]) -> np.ndarray:
    """Into how many parts PATTERN cuts each word; 0 where that isn't sure.

    Letters are ASCII's and those of the Latin-1 block: runs of letters and of signs are parts, as is each digit.  A
    word that may hold an added token's literal, or an apostrophe, is left out.
    """
    off = np.append(0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))
    data = np.frombuffer(b"".join(words), np.uint8)
    kind = KIND[data]
    after = np.append(data[1:], np.uint8(0))
    unknown = (kind == UNKNOWN) | ((data == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((data == ord("<")) & (after == ord("|")))
    new = np.ones(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    new[off[:-1]] = True
    counts = np.add.reduceat(new, off[:-1], dtype=np.int64) if len(words) else np.zeros(0, np.int64)
    return np.where(np.add.reduceat(unknown, off[:-1], dtype=np.int64) > 0, 0, counts) if len(words) else counts


class Encoder:
    """The tokenizer: ids of words, no special tokens around them.

    Spaces part tokens and no added token's literal has one, so words may be encoded one by one, or many in one string
    where it is known how many parts each has: a part's last token, and no other, ends in the word's end mark.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Literals of added tokens in lower case.
        self.literals = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        # the file is searched, not parsed: its vocabulary would take many times the tokenizer's memory
        with open(path, encoding="utf-8") as f:
            said = f.read()
        mark = re.search(r'"end_of_word_suffix":\s*"([^"]+)"', said)
        if mark and PATTERN.replace("\\", "\\\\") in said:
            self.ends[:] = [(self.tokenizer.id_to_token(i) or "").endswith(mark[1]) for i in range(len(self.ends))]

    def one_by_one(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # in strips: what the library returns for a word takes far more memory than its ids
        got = [e.ids for a in range(0, len(words), 4096) for e in self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in words[a : a + 4096]], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def together(self, words: list[bytes], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out: list[np.ndarray] = []
        sizes = np.zeros(len(words), np.int64)
        for a in range(0, len(words), 2048):
            mine = words[a : a + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(mine).decode("utf-8")], add_special_tokens=False)[0].ids, np.uint32)
            ends, last = np.flatnonzero(self.ends[ids]), np.cumsum(parts[a : a + 2048])
            if len(ends) == last[-1] and ends[-1] == len(ids) - 1:
                sizes[a : a + 2048] = np.diff(ends[last - 1], prepend=-1)
            else:
                ids, sizes[a : a + 2048] = self.one_by_one(mine)
            out.append(ids)
        return np.concatenate(out) if out else np.zeros(0, np.uint32), sizes

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        parts = parts_in(words) if self.ends.any() else np.zeros(len(words), np.int64)
        sure, rest = np.flatnonzero(parts), np.flatnonzero(parts == 0)
        got = [self.together([words[i] for i in sure], parts[sure]), self.one_by_one([words[i] for i in rest])]
        sizes, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        base = 0
        for which, (ids, n) in zip((sure, rest), got, strict=True):
            sizes[which], start[which] = n, base + np.cumsum(n) - n
            base += len(ids)
        return C.slices(np.concatenate([ids for ids, _ in got]), start, sizes)[0], sizes


#: What the tokenizer's pattern and Python both take as white space beyond the ASCII kinds is left inside a
#: word here; the tokenizer then parts it itself.
_KNOWN_WORDS, _KNOWN_BYTES = 400_000, 16 << 20
#: A byte of these at a word's end, after a letter, is a token of its own.
MARKS = np.zeros(256, bool)
MARKS[list(b",.;:!?")] = True
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True


def parts_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray):
    """The words in smaller parts where these are sure to be encoded apart: a mark after a last letter.

    Returns starts, ends and how many parts stand before each text's end.  Letters are ASCII's and those of the
    Latin-1 block (two bytes, the first 0xC3, but for the signs 0xD7 and 0xF7); with nothing but the mark behind
    the letter, no rule of letter case or composition reaches across.
    """
    if not len(starts):
        return starts, ends, before
    last = buf[ends - 1]
    c, lead = buf[np.maximum(ends - 2, 0)], buf[np.maximum(ends - 3, 0)]
    letter = ((ends - starts > 1) & LETTERS[c]) | ((ends - starts > 2) & (lead == 0xC3) & (c >= 0x80) & (c != 0x97) & (c != 0xB7))
    cut = MARKS[last] & letter
    more = np.append(0, np.cumsum(cut))
    at = np.arange(len(starts)) + more[:-1]
    a, z = np.empty(len(starts) + more[-1], np.int64), np.empty(len(starts) + more[-1], np.int64)
    a[at], z[at] = starts, ends - cut
    a[at[cut] + 1], z[at[cut] + 1] = ends[cut] - 1, ends[cut]
    return a, z, before + more[before]


class Words:
    """Encodes texts by their distinct words, remembering those of earlier batches up to a bound."""

    def __init__(self, encode: Encoder):
        self.encode, self.literals = encode, encode.literals
        self.forget()

    def forget(self):
        self.places: dict[bytes, int] = {}
        self.held = 0
        self.ids, self.off, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def learn(self, new: list[bytes]) -> None:
        got, sizes = self.encode(new)
        n, more = len(self.places), len(got)
        while n + len(new) + 1 > len(self.off):
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
        while self.used + more > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + more] = got
        self.off[n + 1 : n + 1 + len(new)] = self.used + np.cumsum(sizes)
        self.used += more
        self.held += sum(map(len, new))
        self.places.update(zip(new, range(n, n + len(new)), strict=True))

    def literal(self, low: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of the words that may hold an added token's literal, in any case of letters."""
        data, found = low.tobytes(), []
        for x in self.literals:
            i = data.find(x)
            while i >= 0:
                found.append(i)
                i = data.find(x, i + 1)
        return np.searchsorted(at, np.array(found, np.int64), "right") - 1

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, each ended by END_ID."""
        starts, ends, before = parts_of(buf, *C.words_of(buf, off))
        text, at = C.slices(buf, starts, ends - starts)
        # the tokenizer lowers case; in words of ASCII alone that may be done before, but it takes an added
        # token's literal in its own case only
        low = C.LOWER[text]
        lowers = ~np.logical_or.reduceat(text >= 0x80, at[:-1]) if len(text) else np.zeros(0, bool)
        lowers[self.literal(low, at)] = False
        text = np.where(np.repeat(lowers, np.diff(at)), low, text)
        words = C.binary(text, at).dictionary_encode()
        code, names = words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist()
        new = [x for x in names if x not in self.places]
        if len(self.places) + len(new) > _KNOWN_WORDS or self.held > _KNOWN_BYTES:
            self.forget()
            new = names
        self.learn(new)
        at = np.fromiter(map(self.places.__getitem__, names), np.int64, len(names))[code]
        # the end is one more word after each text's last
        n = len(off) - 1
        place = before[1:] + np.arange(n)
        which = np.full(len(at) + n, -1, np.int64)
        other = np.ones(len(which), bool)
        other[place] = False
        which[other] = at
        known = len(self.places)
        table, table_off = np.append(self.ids[: self.used], np.uint32(END_ID)), np.append(self.off[: known + 1], self.used + 1)
        which[place] = known
        ids, word_off = C.slices(table, table_off[which], np.diff(table_off)[which])
        return ids, word_off[np.append(0, place + 1)]


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Bins:
    """Pieces in a packer's bins: rows leave when their bin closes."""

    def __init__(self, length: int, most: int, top: int):
        self.packer, self.top, self.rows, self.held = Packer(length, most), top, {}, 0
        self.out: list[tuple] = []

    def add(self, doc, piece, start, n, crc) -> None:
        number, offset = self.packer.place(n)
        self.rows.setdefault(number, []).append((doc, piece, start, n, crc, self.top + number, offset))
        self.held += 1
        while self.held > HELD and self.packer.open:
            self.packer.close()
            self._leave()
        self._leave()

    def _leave(self) -> None:
        for number in self.packer.closed:
            rows = self.rows.pop(number)
            self.held -= len(rows)
            self.out += rows
        self.packer.closed.clear()

    def end(self, slack: int) -> list[tuple]:
        """All bins close; the rows of those with more free space than slack are returned instead."""
        while self.packer.open and (self.packer.bits & -self.packer.bits).bit_length() - 1 <= slack:
            self.packer.close()
        self._leave()
        loose = [r for rows in self.rows.values() for r in rows]
        self.rows.clear()
        return loose

    def batch(self, loose: list[tuple] | None = None) -> pa.RecordBatch:
        rows, self.out = (self.out, []) if loose is None else (loose, self.out)
        cols = np.array(rows, np.int64).reshape(-1, 7).T
        placed = [pa.array(c, mask=np.full(len(c), loose is not None)) for c in cols[5:]]
        return pa.RecordBatch.from_arrays([C.ids_back(cols[0]), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:5]), *placed], NAMES)


def _pack(path: str, length: int, most: int):
    """Rows of texts' pieces; those without a sequence are for the second round."""

    def run(batches):
        from pyspark import TaskContext

        from .exact_dedup import by_bytes

        bins = Bins(length, most, TaskContext.get().partitionId() << 40)
        words = Words(Encoder(path))
        for batch in batches:
            for part, buf, off in by_bytes(batch, 3 << 20):
                ids, ends = words(buf, off)
                docs, raw = C.ids_of(part.column("doc_id")), ids.astype("<u4")
                sizes = np.diff(ends)
                # the longest first: a stream may come in any order, and this one leaves the fewest gaps
                for i in np.argsort(-sizes, kind="stable"):
                    for piece, at in enumerate(range(0, int(sizes[i]), length)):
                        n = min(length, int(sizes[i]) - at)
                        bins.add(docs[i], piece, at, n, zlib.crc32(raw[ends[i] + at : ends[i] + at + n]))
            yield bins.batch()
            C.trim()
        loose = bins.end(int(length * SLACK))
        yield bins.batch()
        yield bins.batch(loose)

    return run


def _pack_again(length: int, most: int):
    def run(batches):
        from pyspark import TaskContext

        bins = Bins(length, most, (TaskContext.get().partitionId() << 40) + (1 << 62))
        for batch in batches:
            cols = [C.ids_of(batch.column(0)), *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))]
            for i in np.argsort(-cols[3], kind="stable"):
                bins.add(*(int(c[i]) for c in cols))
            yield bins.batch()
        bins.end(length)
        yield bins.batch()

    return run


def pack(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each row's text (null: empty) becomes its ids, an added token's literal that token's, and END_ID; only texts of more than `length` ids are cut.
    Repeated rows and equal or null ids are packed row by row.  An empty table gives an empty result; other
    columns of df are ignored.
    """
    C.prepare(df.sparkSession)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rows = C.rows_of(df, id_col, text_col)
    first = C.written(rows.mapInArrow(C.lean_map(_pack(tokenizer, length, open_bins)), SCHEMA), "packed")
    loose = first.filter("sequence_id IS NULL")
    left = loose.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, left // (length * ROUND))
    # by size, so that a batch is a stretch of falling lengths
    again = loose.repartition(tasks, F.xxhash64("doc_id", "ids_crc32", "length")).sortWithinPartitions(F.desc("length"), "ids_crc32", "start")
    return first.filter("sequence_id IS NOT NULL").unionByName(again.mapInArrow(_pack_again(length, open_bins), SCHEMA))
