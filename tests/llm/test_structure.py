"""Conversation repair, shards and periodic runs against plain forms."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import debruijn_dedup, queries, repair, runs, sharding
from tests.llm import helpers as H

NEAR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]")


# --- conversations


def hurt(rows):
    """(conv, turn, role, text) rows after damage, by conversation."""
    out = defaultdict(list)
    one = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        mine, role, text = out[conv], one(role), one(text)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = WORD.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, wrong):
    """(cost, audit, messages) by recursion from the start over what the roles may go on with."""
    goes = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, inserted):
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, left = best(i + 1, state, 0)
            options.append((cost + 2, "D" + audit, left))
            if wrong[i] in ("", "truncated"):
                extra = 5 if wrong[i] else 0
                moves = [("K", 0, role[:1], role)] + [("R", 1, x, names[x]) for x in "ua"]
                for letter, price, initial, name in moves:
                    if initial in goes[state]:
                        cost, audit, left = best(i + 1, goes[state][initial], 0)
                        options.append((cost + price + extra, letter + audit, ((name, text), *left)))
        if inserted < 3:
            for x in "ua":
                if x in goes[state]:
                    cost, audit, left = best(i, goes[state][x], inserted + 1)
                    options.append((cost + 5, "I" + audit, ((names[x], ""), *left)))
        return min(options, default=(10**6, "", ()))

    return best(0, "", 0)


def mended(rows):
    out = []
    for conv, mine in hurt(rows).items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        wrong = faults(mine)
        cost, audit, left = cheapest(mine, wrong)
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        text = "\n".join(f"{r}:{t}" for r, t in left)
        out.append((conv, gaps, *(wrong.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_audit_is_the_least_of_all_edits():
    """All edit scripts of two rows with up to two inserts in each gap."""
    gap = ["", "u", "a", "uu", "ua", "au", "aa"]
    good = re.compile("(s?(ua)+)?")
    for codes in itertools.product(range(16), repeat=2):
        found = []
        for parts in itertools.product(gap, "KuaD", gap, "KuaD", gap):
            roles, cost, audit = "", 0, ""
            for k, x in enumerate(parts):
                if k % 2 == 0:
                    roles, cost, audit = roles + x, cost + 5 * len(x), audit + "I" * len(x)
                    continue
                code = codes[k // 2]
                if x == "D":
                    cost, audit = cost + 2, audit + "D"
                elif code & 8:
                    break
                else:
                    roles += "sua?"[code & 3] if x == "K" else x
                    cost += (x != "K") + (5 if code & 4 else 0)
                    audit += "K" if x == "K" else "R"
            else:
                if good.fullmatch(roles):
                    found.append((cost, audit))
        cost, script = repair._short(bytes(codes))
        assert (cost, repair.audit_of(script)) == min(found)


def some_conversations(seed):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No", "", " \t", "What?", "a b c!", None, "ok. ", "x" * 50 + "."]
    for conv in [*range(40), None]:
        turns = [rng.choice([None, *range(60)]) for _ in range(rng.choice([1, 1, 2, 5, 9, 40]))] if conv != 7 else list(range(30))
        for turn in dict.fromkeys(turns):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("long, segment", [(None, 4096), (3, 2), (8, 4), (0, 1)])
def test_repair(spark, long, segment):
    rows = some_conversations(5)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, kind int, code int").repartition(3)
    got = repair.repair(repair.damaged(df), present="present", long=long, segment=segment)
    assert sorted((tuple(r) for r in got.collect()), key=str) == mended(rows)


@pytest.mark.parametrize("long", [None, 3])
def test_repaired_messages(spark, long):
    rows = [r for r in some_conversations(8) if r[0] is not None]
    df = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    digests = {r["conv_id"]: r for r in repair.repair(df, present="present").collect()}
    said = defaultdict(list)
    for r in sorted(repair.repaired(df, present="present", long=long, segment=2).collect(), key=lambda r: (r["place"], r["sub"])):
        said[r["conv_id"]].append(r)
    for conv, r in digests.items():
        assert hashlib.sha256("\n".join(f"{m['role']}:{m['text']}" for m in said[conv]).encode()).hexdigest() == r["repaired_sha256"]
        assert "".join(m["edit"] for m in said[conv]) == r["audit"].replace("D", "")


def test_repair_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{NEAR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op11_repair(spark, NEAR).collect()), key=str) == mended(rows)


def test_repair_ties_and_nothing(spark):
    kind = "conv_id string, turn int, role string, text string"
    df = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yes."), ("b", None, None, None)], kind)
    got = {r["conv_id"]: r for r in repair.repair(df).collect()}
    assert (got["a"]["duplicate"], got["a"]["audit"], got["a"]["cost"], got["a"]["gaps"]) == (1, "KDK", 2, 0)
    assert (got["b"]["blank"], got["b"]["audit"], got["b"]["gaps"]) == (1, "D", 0)
    assert repair.repair(spark.createDataFrame([], kind)).collect() == []
    assert repair.repaired(spark.createDataFrame([], kind)).collect() == []


def test_repair_of_one_huge_conversation(spark):
    """A conversation with nearly all rows is many segments, and the least cost is that of the whole."""
    n = 20_000
    df = spark.range(n).selectExpr("IF(id % 50 = 0, id, -1) AS conv_id", "id AS turn", "CASE id % 5 WHEN 0 THEN 'system' WHEN 4 THEN 'assistant' WHEN 1 THEN 'assistant' ELSE 'user' END AS role", "concat('t', id % 977, IF(id % 7 = 0, '', '.')) AS text")
    whole = {r["conv_id"]: tuple(r) for r in repair.repair(df, long=n).collect()}
    cut = {r["conv_id"]: tuple(r) for r in repair.repair(df, long=50, segment=256).collect()}
    assert len(whole) == n // 50 + 1 and whole == cut


# --- shards


def least_capacity(weights, shards):
    best = [0] + [10**18] * len(weights)
    for _ in range(shards):
        now = list(best)
        for j in range(1, len(weights) + 1):
            total = 0
            for i in range(j, 0, -1):
                total += weights[i - 1]
                now[j] = min(now[j], max(best[i - 1], total))
        best = now
    return best[-1]


def check_shards(spark, rows, shards=8):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, shard string, size int").repartition(3)
    got = sharding.assign(df, shards).collect()
    facts = lambda i, t: (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted((facts(*r) for r in rows), key=str)
    slots, load, home = defaultdict(list), [0] * shards, defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        home[(r["size"], r["text_crc32"])].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    assert all(len(s) == 1 for s in home.values())
    groups = defaultdict(int)
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    total = sum(groups.values())
    # the operator's own order: heavy groups first among those of the same three digits
    key = lambda t: (H.sha(t.encode())[:3], groups[t] <= total // sharding.HEAVY, H.sha(t.encode()))
    assert max(load, default=0) == least_capacity([groups[t] for t in sorted(groups, key=key)], shards)
    return load


@pytest.mark.parametrize("rows", [
    [],
    [(1, "a")],
    [(1, None), (1, ""), (None, "b"), (None, "b"), (3, "c" * 1000)],
    [(i, "same") for i in range(50)] + [(5, "same")] * 3,
    [(i, f"text {i} " * (i % 13)) for i in range(300)],
    [(i, "hot" * 20 if i % 3 == 0 else f"word {i}") for i in range(400)],
    [(i, str(i) * (1 + i * i % 89)) for i in range(120)] + [(i, "é" * 4000) for i in (500, 501)],
])
def test_shards(spark, rows):
    check_shards(spark, rows)


def test_a_hot_group_gets_a_shard_and_the_rest_is_even(spark):
    load = check_shards(spark, [(i, "h" * 500 if i % 3 == 0 else f"{i:05d}" * 100) for i in range(900)])
    rest = sorted(load)[:-1]
    assert rest[0] > 0.6 * rest[-1]


@pytest.mark.parametrize("digits, more", [(1, 1), (2, 1)])
def test_capacity_when_stretches_are_coarse(spark, monkeypatch, digits, more):
    """With few digits the search must split stretches several times."""
    monkeypatch.setattr(sharding, "DIGITS", digits)
    monkeypatch.setattr(sharding, "MORE", more)
    monkeypatch.setattr(sharding, "HEAVY", 4)
    rng = random.Random(2)
    texts = [f"{i} " + "z" * rng.randrange(400) for i in range(400)]
    groups = {t: len(t) + 1 for t in texts}
    total = sum(groups.values())
    key = lambda t: (H.sha(t.encode())[:digits], groups[t] <= total // 4, H.sha(t.encode()))
    load = defaultdict(int)
    for r in sharding.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        load[r["shard"]] += r["size"]
    assert max(load.values()) == least_capacity([groups[t] for t in sorted(texts, key=key)], 8)


def test_search_over_stretches():
    """Cuts never pass the capacity, and the least capacity is that of trying all."""
    rng = random.Random(4)
    for _ in range(200):
        weights = [rng.choice([1, 2, 3, 50, rng.randrange(1, 400)]) for _ in range(rng.randrange(1, 30))]
        shards = rng.randrange(1, 9)
        s = sharding.Stretches([(f"{i:04d}", w, 1) for i, w in enumerate(weights)])
        c = s.least(shards, 0, s.total, max(-(-s.total // shards), max(weights)))
        ends = s.cuts(c, shards)
        assert c == least_capacity(weights, shards) and len(ends) == shards and ends[-1] == s.total
        assert all(0 <= b - a <= c for a, b in itertools.pairwise([0, *ends])) and set(ends) <= {0, *s.ends}


def test_shards_written(spark, tmp_path):
    docs = spark.read.parquet(f"{NEAR}/documents.parquet")
    sharding.write_shards(docs, f"file://{tmp_path}/s")
    back = spark.read.parquet(f"file://{tmp_path}/s")
    want = {r["doc_id"]: r["shard"] for r in sharding.assign(docs).collect()}
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == want
    assert back.drop("shard").exceptAll(docs.select(*back.columns[:-1])).isEmpty() and back.count() == docs.count()


def test_shards_stay_native(spark):
    plan = queries.op12_shards(spark, NEAR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|ExistingRDD|CartesianProduct|NestedLoop", plan)


# --- runs


def plain_runs(w):
    got = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(24, 3 * q):
                got.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in got.items()), key=lambda r: (r[0], r[2]))


def run_row(i, text, cycles):
    w = H.words(text)
    h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(w)
    if cycles and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    found = plain_runs(w)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    said = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (i, len(found), *first, H.sha(said.encode()), H.sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def odd_texts():
    rng = random.Random(6)
    out = [(None, "a " * 30), (None, None), (3, ""), (3, " \t "), (4, "x"), (10, "b c " * 12), (10, "b c " * 12), (11, "b c " * 11 + "b"), (12, "é ü\x0bé ü " * 9), (13, "a b a b c " * 9 + "d " + "a b c d e f g h " * 3)]
    for i in range(60):
        w = [str(rng.randrange(rng.choice([1, 2, 5, 300]))) for _ in range(rng.choice([10, 60, 400]))]
        for _ in range(rng.randrange(3)):
            a, p = rng.randrange(len(w)), rng.randrange(1, 30)
            for k in range(a, min(len(w), a + p * rng.randrange(2, 7))):
                w[k] = w[a + (k - a) % p]
        out.append((100 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("cycles", [False, True])
@pytest.mark.parametrize("at_once, call", [(1 << 18, 1 << 17), (40, 0)])
def test_runs(spark, monkeypatch, cycles, at_once, call):
    rows = odd_texts()
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n int, words string").repartition(2)
    if at_once != runs.AT_ONCE:  # in this process, where nothing is large
        monkeypatch.setattr(runs, "AT_ONCE", at_once)
        monkeypatch.setattr(runs, "FFT_CALL", call)
        docs = [H.words(t) for _, t in rows]
        names: dict = {}
        word = np.array([names.setdefault(x, len(names)) for d in docs for x in d])
        got = [tuple(map(int, r)) for r in runs.runs(word, np.cumsum([0, *map(len, docs)]))]
        assert got == [(k, *r) for k, d in enumerate(docs) for r in plain_runs(d)]
        return
    got = runs.digests(runs.with_cycles(df) if cycles else df).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((run_row(*r, cycles) for r in rows), key=str)


def test_lag_counts_of_frequent_and_rare_words():
    rng = np.random.default_rng(3)
    for n, kinds, call in ((300, 2, 0), (1000, 40, 0), (5000, 3000, 0), (4000, 3, 1 << 17)):
        word = rng.integers(0, kinds, n)
        cuts = np.array([0, n // 3, n // 3, n])
        runs_call, runs.FFT_CALL = runs.FFT_CALL, call
        try:
            counts, base = runs.lag_counts(word, cuts)
        finally:
            runs.FFT_CALL = runs_call
        for t, b in enumerate(base):
            w = word[cuts[t] : cuts[t + 1]]
            assert all(counts[b + q] == np.sum(w[q:] == w[: len(w) - q]) for q in range(1, len(w) // 3 + 1))


def test_words_with_equal_hashes(monkeypatch):
    buf = np.frombuffer(b"aabbaacc", np.uint8)
    starts, ends = np.array([0, 2, 4, 6]), np.array([2, 4, 6, 8])
    monkeypatch.setattr(runs, "xxh64", lambda b, s, n: np.zeros(len(s), np.uint64))
    got = runs.numbered(buf, starts, ends)
    assert got[0] == got[2] and len(set(got.tolist())) == 3


def test_runs_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{NEAR}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 20_000]
    got = {r["doc_id"]: tuple(r) for r in queries.op13_runs(spark, NEAR).collect()}
    assert len(got) == len(rows) and all(got[i] == run_row(i, t, True) for i, t in short)


def test_found_runs_and_collapsed(spark):
    df = spark.createDataFrame([(1, "x " + "a b c " * 10 + "y"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.find_runs(df).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(1, 30, 3)] and got[1]["collapsed"] == "x a b c y"
    assert got[2]["runs"] == [] and got[2]["collapsed"] == ""
    assert runs.find_runs(df.limit(0)).collect() == []


# --- paths of the graph of repeated words


def test_paths_over_documents(spark):
    """A passage of three documents is one path; where one of them goes on otherwise, the graph branches."""
    rng = random.Random(9)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(300)]
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    data = [(1, f"{own(40)} {' '.join(passage)} {own(30)}"), (2, f"{own(7)} {' '.join(passage)}"), (3, f"{' '.join(passage)} {own(5)}"), (4, own(200))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    paths = lambda d: sorted(tuple(r) for r in debruijn_dedup.repeated_paths(d, block_bytes=2000).collect())
    assert paths(df) == [(1, 40, 300, 2)]
    # document 5 has the middle alone: what is before and after it is a path of fewer places
    more = df.unionByName(spark.createDataFrame([(5, f"{own(3)} {' '.join(passage[100:200])} {own(3)}")], df.schema))
    assert paths(more) == [(1, 40, 119, 2), (1, 140, 100, 3), (1, 221, 119, 2)]
    want = H.word_repeats([*data, *(tuple(r) for r in more.filter("doc_id = 5").collect())])
    assert sorted((tuple(r) for r in debruijn_dedup.remove_repeats(more, texts=False).collect()), key=str) == want


def test_without_compaction_paths_are_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(300))
    df = spark.createDataFrame([(i, f"u{i} {passage} v{i}") for i in range(4)], "doc_id long, text string")
    whole = debruijn_dedup.repeated_paths(df).collect()
    assert [(r["n_words"], r["places"]) for r in whole] == [(300, 3)]
    monkeypatch.setattr(debruijn_dedup, "links", lambda found: found.select(F.col("h").alias("next"), F.col("h").alias("head"), F.col("windows").cast("long").alias("windows")).limit(0))
    assert len(debruijn_dedup.repeated_paths(df).collect()) > 10


def test_ends_that_only_look_alike(spark):
    """As many places end after a passage's first half as begin with its second: the halves are no path."""
    rng = random.Random(11)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(120)]
    a, b = " ".join(passage[:79]), " ".join(passage[60:])
    data = [(1, " ".join(passage)), (2, f"x {a}"), (3, f"{b} y"), (4, f"z {a}"), (5, f"{b}")]
    got = debruijn_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), texts=False).collect()
    assert sorted((tuple(r) for r in got), key=str) == H.word_repeats(data)
