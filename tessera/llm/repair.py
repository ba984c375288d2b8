"""Cheapest repair of a conversation's structure: Dial's shortest paths over its rows.

A repaired conversation's roles begin with nothing or one of `s...`, then pairs of `u...` and `a...`; or there is none.
Rows in order, and what the roles so far allow, are the nodes; keeping, re-roling or deleting a row and inserting an empty
message are the arcs, of costs up to six, so that seven buckets of nodes are the queue.  Distances to the end are
recorded, then arcs that lie on shortest ways are walked from the start, the ASCII-least letter first.

Conversations come sorted to tasks, which hold one at a time.  Those of more than LONG rows (or than their 2^20th part of
the table) are cut into segments of SEGMENT rows: a segment's least costs between its entries and exits are put together
per conversation, backwards, then each segment is walked from each entry with the true distances behind it, and the exits
decide, forwards, which walk counts.  So the work on a long conversation is spread; only the digest of its repaired text,
which is serial by nature, streams through one task.

Rows are ordered by turn (nulls first); ties by role, then by a hash of role and text, then text.  Nulls in any column
stand for one space; a conversation without id is that of all rows without one.  Empty tables give no rows; other columns
don't matter.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a.  What comes next unless it is s, and the state then.
NEXT, THEN = "uuau", (2, 2, 3, 2)
#: Costs to the end of a conversation from each state, and the messages that they insert.
GOAL, TAIL = (0, 10, 5, 0), ("", "ua", "a", "")
NAMES = {"u": "user", "a": "assistant"}
#: A row's code: its role's class (s, u, a, others), 4 if cut short, 8 if it must go.
CLASSES, SHORT, MUST = "sua", 4, 8
NEVER = 1 << 40
LONG, SEGMENT = 4096, 4096
SPACES = " \t\n\x0b\x0c\r"


def _moves(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of a row's arcs in ASCII order of their edits; inserts stay at the row."""
    kind, extra = code & 3, CUT if code & SHORT else 0
    out = [("D", DELETE, state), (NEXT[state], INSERT, THEN[state])]
    if not code & MUST:
        fits = kind < 3 and (CLASSES[kind] == NEXT[state] or (kind == 0 and state == 0))
        out += [("K", KEEP + extra, 1 if kind == 0 else THEN[state])] if fits else []
        out += [(NEXT[state].upper(), REROLE + extra, THEN[state])]
    return out


#: By code and state: the arcs; by code and state after: cost and state before of the arcs over a row.
MOVES = [[_moves(c, s) for s in range(4)] for c in range(16)]
BACK = [[[(w, s) for s in range(4) for x, w, z in MOVES[c][s] if z == t and not x.islower()] for t in range(4)] for c in range(16)]
BEFORE = [[s for s in range(4) if THEN[s] == t] for t in range(4)]


def distances(codes: bytes, end: tuple) -> list[int]:
    """Least costs from each row and state (4 * row + state) to the end, whose states cost `end`: Dial's queue."""
    n = len(codes)
    dist = [NEVER] * (4 * n + 4)
    far = [d for d in end if d < NEVER]
    if not far:
        return dist
    buckets: list[list[int]] = [[] for _ in range(8)]
    starts = sorted((d, 4 * n + s) for s, d in enumerate(end) if d < NEVER)
    for d, v in starts:
        dist[v] = d
    at, waiting = starts[0][0], 0
    starts.reverse()
    while waiting or starts:
        while starts and starts[-1][0] == at:
            buckets[at & 7].append(starts.pop()[1])
            waiting += 1
        bucket = buckets[at & 7]
        while bucket:
            v = bucket.pop()
            waiting -= 1
            if dist[v] != at:
                continue
            i, t = v >> 2, v & 3
            if i < n:
                for s in BEFORE[t]:
                    u = v - t + s
                    if dist[u] > at + INSERT:
                        dist[u] = at + INSERT
                        buckets[(at + INSERT) & 7].append(u)
                        waiting += 1
            if i:
                for w, s in BACK[codes[i - 1]][t]:
                    u = v - t - 4 + s
                    if dist[u] > at + w:
                        dist[u] = at + w
                        buckets[(at + w) & 7].append(u)
                        waiting += 1
        at = at + 1 if waiting else max(at, starts[-1][0]) if starts else at
    return dist


def walk(codes: bytes, dist: list[int], state: int) -> tuple[str, int]:
    """The edits of the ASCII-least shortest way from a state (u, a: inserted; U, A: re-roled to; K, D), and its exit."""
    out, i = [], 0
    while i < len(codes):
        left = dist[4 * i + state]
        for x, w, s in MOVES[codes[i]][state]:
            j = i if x.islower() else i + 1
            if w + dist[4 * j + s] == left:
                out.append(x)
                i, state = j, s
                break
    return "".join(out), state


@lru_cache(1 << 16)
def _short(codes: bytes) -> tuple[int, str]:
    dist = distances(codes, GOAL)
    script, state = walk(codes, dist, 0)
    return dist[0], script + TAIL[state]


def audit_of(script: str) -> str:
    return script.translate(str.maketrans("uaUA", "IIRR"))


def messages(script: str, rows: list[tuple[str, str]]):
    """(edit, role, text) of the messages that a script leaves of rows."""
    left = iter(rows)
    for x in script:
        if x.islower():
            yield "I", NAMES[x], ""
            continue
        role, text = next(left)
        if x != "D":
            yield ("K", role, text) if x == "K" else ("R", NAMES[x.lower()], text)


def _coded(df: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """conv (null: one space), turn, role, text, code without repeats, gone."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    there = F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)
    rows = df.select(one(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), one(role).alias("role"), one(text).alias("text"), there.alias("there"))
    core = F.rtrim("text", F.lit(SPACES))
    kind = F.instr(F.lit(CLASSES), F.substring("role", 1, 1))
    kind = F.when((F.length("role") > 0) & (kind > 0), kind - 1).otherwise(3)
    fault = F.when(core == "", MUST).when(F.right(core, F.lit(1)).isin(".", "!", "?"), 0).otherwise(SHORT)
    return rows.withColumns({"code": (kind + fault).cast("int"), "tie": F.xxhash64("role", "text")})


ORDER = ["turn", "role", "tie", "text"]
LEGAL = {(0, 1), (1, 2), (2, 1)}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = ", ".join(["conv string", *(f"{c} long" for c in COUNTS), "audit string", "repaired_sha256 string"])
MESSAGE = "conv string, place long, sub int, edit string, role string, text string"


def _conversations(batches):
    """(conv, [(turn, role, text, code), ...]) of sorted batches, one after the other."""
    now, rows = None, []
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "turn", "role", "text", "code", "there")]
        for conv, turn, role, text, code, there in zip(*cols, strict=True):
            if conv != now:
                if now is not None:
                    yield now, rows
                now, rows = conv, []
            if there:
                rows.append((turn, role, text, code))
    if now is not None:
        yield now, rows


def _finished(rows):
    """Codes with repeats marked, and how many rows repeat an earlier one without being blank."""
    seen, codes, again = set(), bytearray(), 0
    for _, role, text, code in rows:
        if not code & MUST:
            if (role, text) in seen:
                code, again = code & 3 | MUST, again + 1
            seen.add((role, text))
        codes.append(code)
    return bytes(codes), again


def _illegal(codes) -> int:
    return sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:]))


def _whole(batches):
    """Result rows of conversations that are held whole."""
    out = []
    for conv, rows in _conversations(batches):
        codes, again = _finished(rows)
        cost, script = _short(codes) if len(codes) <= 64 else _short.__wrapped__(codes)
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        blank = sum(1 for c in codes if c & MUST) - again
        text = "\n".join(f"{r}:{t}" for _, r, t in messages(script, [r[1:3] for r in rows]))
        out.append((conv, gaps, blank, again, sum(1 for c in codes if c & SHORT), _illegal(codes), cost, audit_of(script), hashlib.sha256(text.encode()).hexdigest()))
        if len(out) == 1024:
            yield _batch(out, RESULT)
            out = []
    if out:
        yield _batch(out, RESULT)


TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _messages(batches):
    out, size = [], 0
    for conv, rows in _conversations(batches):
        script = _short.__wrapped__(_finished(rows)[0])[1]
        for place, (edit, role, text) in enumerate(messages(script, [r[1:3] for r in rows])):
            out.append((conv, place, 0, edit, role, text))
            size += len(text)
            if size > 1 << 20 or len(out) == 4096:
                yield _batch(out, MESSAGE)
                out, size = [], 0
    if out:
        yield _batch(out, MESSAGE)


def _split(df: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None, long: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Sorted rows of conversations that a task can hold, and rows of the others.

    Longer ones are fewer than 2^20, by the bound itself, so that their names can go to all tasks.
    """
    rows = _coded(df, conv, turn, role, text, present)
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    if long is None:
        long = max(LONG, (df.count()) >> 20)
    names = C.written(sizes.filter(F.col("n") > long).select("conv"), "long-conversations")
    if names.isEmpty():
        return rows.repartition("conv").sortWithinPartitions("conv", *ORDER), None
    short = rows.join(F.broadcast(names), "conv", "left_anti")
    return short.repartition("conv").sortWithinPartitions("conv", *ORDER), rows.join(F.broadcast(names), "conv", "left_semi")


class _Long:
    """The tables of conversations that are cut into segments."""

    def __init__(self, rows: DataFrame, segment: int):
        slots = C.slots(rows.sparkSession)
        self.names = rows.select("conv").distinct()
        # all in order, cut by rows, so that one conversation spreads; a row's number tells its place
        ordered = rows.filter("there").repartitionByRange(slots, "conv", "turn", "role", "tie").sortWithinPartitions("conv", *ORDER)
        self.rows = C.written(ordered.select(F.monotonically_increasing_id().alias("pos"), "conv", "turn", "role", "text", "code"), "long-rows")
        body = self.rows.filter(F.col("code").bitwiseAND(MUST) == 0)
        first = body.groupBy("conv", "role", F.sha2("text", 256).alias("said")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("fresh"))
        again = F.col("fresh").isNull() & (F.col("code").bitwiseAND(MUST) == 0)
        marked = self.rows.drop("text", "role").join(first, "pos", "left").withColumns({"again": again, "code": F.when(again, F.col("code").bitwiseAND(3) + MUST).otherwise(F.col("code")), "seg": F.floor(F.col("pos") / segment).cast("bigint")})
        marked = C.written(marked.drop("fresh"), "long-codes")
        turns = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
        bad = F.col("code").bitwiseAND(MUST) > 0
        self.counts = marked.groupBy("conv").agg(F.coalesce(turns, F.lit(0)).alias("gaps"), F.count_if(bad & ~F.col("again")).alias("blank"), F.count_if("again").alias("duplicate"), F.count_if(F.col("code").bitwiseAND(SHORT) > 0).alias("truncated"))
        # a segment has SEGMENT rows at most
        listed = F.array_sort(F.collect_list(F.struct("pos", "code")))
        self.segments = C.written(marked.groupBy("conv", "seg").agg(listed.alias("x")).select("conv", "seg", F.col("x.pos").alias("at"), F.col("x.code").alias("codes")), "long-segments")
        costs = self.segments.select("conv", "seg", "codes").mapInArrow(_costs, "conv string, seg long, costs array<long>, edges array<int>")
        ends = costs.groupBy("conv").applyInArrow(_ends, "conv string, seg long, ends array<long>, illegal long, cost long")
        self.ends = C.written(ends, "long-ends")
        walks = self.segments.select("conv", "seg", "codes").join(self.ends.select("conv", "seg", "ends"), ["conv", "seg"]).mapInArrow(_walks, "conv string, seg long, scripts array<string>, exits array<int>")
        walks = C.written(walks, "long-walks")
        entries = walks.select("conv", "seg", "exits").groupBy("conv").applyInArrow(_entries, "conv string, seg long, entry int, tail string")
        self.scripts = walks.join(entries, ["conv", "seg"]).select("conv", "seg", F.get("scripts", "entry").alias("script"), "tail")

    def messages(self) -> DataFrame:
        """Repaired messages with pos and sub, which order them."""
        pieces = F.regexp_extract_all("script", F.lit("[ua]*[KUAD]"), F.lit(0))
        each = self.segments.join(self.scripts, ["conv", "seg"]).select("conv", F.explode(F.arrays_zip(F.col("at"), pieces.alias("piece"))).alias("x")).select(F.col("x.at").alias("pos"), F.col("x.piece").alias("piece"))
        done = self.rows.join(each, "pos").select("conv", "pos", "role", "text", F.posexplode(F.split("piece", "")).alias("sub", "x"))
        tails = self.scripts.filter("tail <> ''").join(self.segments.select("conv", "seg", F.array_max("at").alias("pos")), ["conv", "seg"])
        # after all pieces of its row, which are three at most
        ends = tails.select("conv", "pos", F.lit("").alias("role"), F.lit("").alias("text"), F.posexplode(F.split("tail", "")).alias("sub", "x")).withColumn("sub", F.col("sub") + 8)
        every = done.unionByName(ends).filter("x <> 'D'")
        own, inserted = F.col("x") == "K", F.col("x").isin("u", "a")
        name = F.when(own, F.col("role")).when(F.lower("x") == "u", NAMES["u"]).otherwise(NAMES["a"])
        edit = F.when(own, "K").when(inserted, "I").otherwise("R")
        return every.select("conv", F.col("pos").alias("place"), "sub", edit.alias("edit"), name.alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"))

    def results(self) -> DataFrame:
        sums = self.ends.groupBy("conv").agg(F.max("illegal").alias("illegal"), F.max("cost").alias("cost"))
        parts = F.array_sort(F.collect_list(F.struct("seg", F.translate(F.concat("script", "tail"), "uaUA", "IIRR").alias("t"))))
        audits = self.scripts.groupBy("conv").agg(F.array_join(parts["t"], "").alias("audit"))
        lines = self.messages().select("conv", "place", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
        hashed = lines.repartition("conv").sortWithinPartitions("conv", "place", "sub").mapInArrow(_hashed, "conv string, repaired_sha256 string")
        every = self.names
        for part in (self.counts, sums, audits, hashed):
            every = every.join(part, "conv", "left")
        told = every.fillna(0, list(COUNTS)).fillna({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
        return told.select(*(f.strip().split(" ")[0] for f in RESULT.split(", ")))


def _costs(batches):
    for batch in batches:
        out = []
        for conv, seg, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            table = [distances(bytes(codes), tuple(0 if t == e else NEVER for t in range(4)))[:4] for e in range(4)]
            out.append((conv, seg, [table[e][s] for s in range(4) for e in range(4)], [codes[0] & 3, codes[-1] & 3, _illegal(codes)]))
        yield _batch(out, "conv string, seg long, costs array<long>, edges array<int>")


def _ends(table: pa.Table) -> pa.Table:
    """Backwards over a conversation's segments: what the states at each one's end cost."""
    rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
    illegal = sum(r["edges"][2] for r in rows) + sum((a["edges"][1], b["edges"][0]) not in LEGAL for a, b in zip(rows, rows[1:]))
    end, out = list(GOAL), []
    for r in reversed(rows):
        out.append((r["conv"], r["seg"], end, illegal))
        end = [min(NEVER, *(r["costs"][4 * s + e] + end[e] for e in range(4))) for s in range(4)]
    return pa.Table.from_batches([_batch([(*x, end[0]) for x in out], "conv string, seg long, ends array<long>, illegal long, cost long")])


def _walks(batches):
    for batch in batches:
        out = []
        for conv, seg, codes, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes = bytes(codes)
            dist = distances(codes, tuple(ends))
            ways = [walk(codes, dist, s) for s in range(4)]
            out.append((conv, seg, [w[0] for w in ways], [w[1] for w in ways]))
        yield _batch(out, "conv string, seg long, scripts array<string>, exits array<int>")


def _entries(table: pa.Table) -> pa.Table:
    """Forwards: the state in which each segment is entered; the last one has the messages at the end."""
    rows, state, out = sorted(table.to_pylist(), key=lambda r: r["seg"]), 0, []
    for k, r in enumerate(rows):
        entry, state = state, r["exits"][state]
        out.append((r["conv"], r["seg"], entry, TAIL[state] if k == len(rows) - 1 else ""))
    return pa.Table.from_batches([_batch(out, "conv string, seg long, entry int, tail string")])


def _hashed(batches):
    now, h, out = None, None, []
    for batch in batches:
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if conv != now:
                if now is not None:
                    out.append((now, h.hexdigest()))
                now, h = conv, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(line.encode())
    if now is not None:
        out.append((now, h.hexdigest()))
    yield _batch(out, "conv string, repaired_sha256 string")


def _named(found: DataFrame, df: DataFrame, conv: str) -> DataFrame:
    kind = df.schema[conv].dataType
    told = F.col("conv") if kind.typeName() == "string" else F.when(F.col("conv") != " ", F.col("conv")).cast(kind)
    return found.select(told.alias("conv_id"), *(c for c in found.columns if c != "conv"))


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None, long: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """Faults, least cost, its audit and a digest of the repaired conversation, for each conversation.

    Rows of which the Boolean column `present` is not true only name their conversation; one of such rows alone has zeros,
    an empty audit and the empty text's digest.
    """
    C.prepare(df.sparkSession)
    short, rest = _split(df, conv, turn, role, text, present, long)
    found = short.mapInArrow(C.lean_map(_whole), RESULT)
    return _named(found if rest is None else found.unionByName(_Long(rest, segment).results()), df, conv)


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None, long: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """The repaired conversations' messages: conv_id, place and sub (which order them), edit (K, R or I), role, text."""
    C.prepare(df.sparkSession)
    short, rest = _split(df, conv, turn, role, text, present, long)
    found = short.mapInArrow(C.lean_map(_messages), MESSAGE)
    return _named(found if rest is None else found.unionByName(_Long(rest, segment).messages()), df, conv)


def damaged(df: DataFrame) -> DataFrame:
    """conversations with faults by crc32(conv_id:turn) mod 20: 0 drops a row (present is false), 1 empties its text, 2
    takes its full stops, exclamation and question marks, 3 repeats it, 4 makes its role `user`; nulls are one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    rows = df.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), copies.alias("copy"))
