"""Operators that must hold for keys, pools and streams of any size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import predicates
from tessera.operators import aggregates, bitsets, health, lineage, numbering, queue, search, steps, windows
from tessera.plans.bind import Tables
from tessera.plans.scoring import X
from tessera.sources import retention
from tessera.streaming import stateful, twins

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df) -> int:
    return plan_of(df).count("FileScan")


# --- scores in one scan


def random_term(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        i, j, k = (rng.randrange(5) for _ in range(3))
        t = rng.choice([-0.1, 0.0, 0.05, 0.3])
        return rng.choice(["truep", "falsep", None, ["feat", ["what", 1]], ["feat", ["axis", i, t]], ["feat", ["axis", 90, t]], ["feat", ["diag", i, j, 1.5]], ["feat", ["sq_diag", i, j, -2.0]], ["feat", ["prod", i, j, t]], ["feat", ["tridiag", i, j, k, 1.0, -2.0]], ["feat", ["sin_axis", i, t]], ["feat", ["cos_axis", i, 0.99]], ["feat", ["wavelet_box", i, -0.1, 0.1]], ["feat", ["wavelet_ricker", i, 0.1, 0.2, 0.5]], ["feat", ["wavelet_ricker", i, 0.1, 0, 0.5]]])
    op = rng.choice(["not", "and", "or"])
    return [op, *(random_term(rng, depth - 1) for _ in range(1 if op == "not" else 2))]


def test_bitmaps_agree_with_columns(spark):
    rng = random.Random(3)
    terms = [random_term(rng, d) for d in (0, 1, 2, 3, 4) for _ in range(12)]
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    odd = spark.createDataFrame([(3, None), (3, []), (4, [None, 1.0]), (None, [0.2, -0.3, 0.1])], "label int, embedding array<float>")
    obs = e.select(F.col("label").cast("int").alias("label"), "embedding").unionByName(odd)
    value = F.coalesce(F.expr(X(1)), F.lit(0.5))
    key = lambda d: sorted((r["idx"], round(r["reward"], 9), r["landings"]) for r in d.collect())
    want = key(aggregates.score(obs, terms, "label", value))
    got = bitsets.score_programs(obs, bitsets.Programs.of_terms(terms), "label", value)
    assert scans(got) == 1 and "NestedLoop" not in plan_of(got)
    assert key(got) == want


def test_equal_nodes_are_one():
    a, b = ["feat", ["axis", 0, 0.0]], ["feat", ["axis", 1, 0.0]]
    p = bitsets.Programs.of_terms([["and", a, b], ["or", ["and", a, b], a], ["and", a, b]])
    assert len(p.kinds) == 2 and sum(len(level[0]) for level in p.levels) == 2 and p.roots[0] == p.roots[2]


def test_score_bit_reads_once(spark):
    df = plans.QUERIES["score_bit_flagship"](spark, SF)
    assert scans(df) == 1 and "NestedLoop" not in plan_of(df) and "Generate" in plan_of(df)
    pool = plans.QUERIES["compound_pool"](spark, SF)
    assert scans(pool) == 1 and "NestedLoop" not in plan_of(pool) and pool.count() == 10_000


def test_no_observations(spark):
    obs = spark.createDataFrame([], "label int, embedding array<double>, v double")
    assert aggregates.score(obs, ["truep"], "label", F.col("v")).collect() == []
    assert bitsets.score_programs(obs, bitsets.Programs.of_terms(["truep"]), "label", F.col("v")).collect() == []


# --- crowded keys


def test_numbers_in_a_crowded_key(spark):
    rows = spark.range(40_000).selectExpr("IF(id % 10 = 0, id, -5) AS k", "hash(id) AS v", "id")
    got = numbering.numbered(rows, "k", ["v", "id"], most=1000)
    want = rows.selectExpr("*", "CAST(row_number() OVER (PARTITION BY k ORDER BY v, id) AS bigint) AS number")
    assert got.exceptAll(want).isEmpty() and got.count() == 40_000
    # the crowded key's ranges are in several tasks, none with nearly all of it
    parts = rows.filter("k = -5").repartitionByRange(4, "k", "v", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 20_000


def test_numbers_with_null_keys(spark):
    rows = spark.createDataFrame([(None, i) for i in range(30)] + [("a", i) for i in range(3)], "k string, v int")
    got = {(r["k"], r["v"]): r["number"] for r in numbering.numbered(rows, "k", ["v"], most=5).collect()}
    assert got == {(k, v): v + 1 for k, n in ((None, 30), ("a", 3)) for v in range(n)}
    plan = queue.chunk_plan(spark.range(95).selectExpr("'b' AS b", "id AS i"), "b", "i", most=10).collect()
    assert sorted((r["chunk_index"], r["items"]) for r in plan) == [(c, list(range(10 * c, min(95, 10 * c + 10)))) for c in range(10)]


@pytest.mark.parametrize("make", ["IF(id % 3 = 0, 7, hash(id))", "pow(2, id % 900 - 450)", "IF(id % 2 = 0, -double('inf'), double('inf'))"])
def test_selection_is_exact(spark, make):
    rows = spark.range(30_000).selectExpr("IF(id % 10 = 0, 'small', 'hot') AS k", f"CAST({make} AS double) AS v")
    held = {k: np.sort([r["v"] for r in rows.filter(F.col("k") == k).collect()]) for k in ("small", "hot")}
    for rank in (1, 1234):
        ranks = spark.createDataFrame([(k, rank) for k in held], "k string, k2 int").withColumnRenamed("k2", "rank").selectExpr("k AS key", "rank AS k")
        got = {r["key"]: (r["kth"], r["less"]) for r in numbering.smallest(rows.withColumnRenamed("k", "key"), "key", "v", ranks, most=100).collect()}
        assert got == {k: (x[rank - 1], int((x < x[rank - 1]).sum())) for k, x in held.items()}


def test_tails_of_a_crowded_key(spark):
    rows = spark.range(20_000).selectExpr("IF(id % 10 = 0, id % 70, -1) AS k", "CASE WHEN id % 97 = 0 THEN NULL WHEN id % 89 = 0 THEN double('nan') ELSE hash(id) / 7.0 END AS v")
    key = lambda d: sorted(tuple(round(x, 6) for x in r) for r in d.select("k", "cvar10", "worst", "p10", "mean", "n").collect())
    assert key(aggregates.tails(rows, "k", "v", most=200)) == key(aggregates.tails(rows, "k", "v"))


def test_a_long_lineage(spark):
    """A million proposals of one lineage: the fold carries its state only."""
    n = 1_000_000
    p = spark.range(n).selectExpr("1 AS k", "id AS o", "CAST(id % 1000 + id div 100000 AS double) AS r", "IF(id % 5 = 0, 0, NULL) AS e")
    got = lineage.gate(p, "k", "o", "r", "e")
    assert "ObjectHashAggregate" not in plan_of(got)
    tally = {r["outcome"]: r["count"] for r in got.groupBy("outcome").count().collect()}
    best, version, want = None, 0, {"stale": 0, "committed": 0, "no_improvement": 0}
    for i in range(n):
        r = float(i % 1000 + i // 100_000)
        if i % 5 == 0 and version != 0:
            want["stale"] += 1
        elif best is None or r > best + 1e-9:
            want["committed"], best, version = want["committed"] + 1, r, version + 1
        else:
            want["no_improvement"] += 1
    assert tally == want


def test_baseline_once(spark):
    p = spark.createDataFrame([(1, 0, 5.0, 4.0), (1, 1, 4.5, 9.0), (2, 0, 5.0, 6.0), (2, 1, 7.0, 100.0)], "k int, o int, r double, f double")
    got = sorted((r["k"], r["o"], r["outcome"]) for r in lineage.gate(p, "k", "o", "r", floor="f").collect())
    assert got == [(1, 0, "committed"), (1, 1, "no_improvement"), (2, 0, "no_improvement"), (2, 1, "committed")]


def test_all_clock_verdicts(spark):
    ticks = [("r", 0, True, True), ("r", 50, True, True), ("s", 0, True, True), ("s", 500, False, True), ("s", 501, True, True), ("d", 0, True, True), ("d", 90, True, True), ("d", 5000, True, True), ("p", 0, True, True), ("p", 90, False, False), ("p", 150, False, True)]
    got = {r["k"]: (r["verdict"], r["pauses"]) for r in health.stall_clock(spark.createDataFrame(ticks, "k string, at int, progressed boolean, live boolean"), "k", 30, 100, 1000).collect()}
    assert got == {"r": ("running", 0), "s": ("stalled", 0), "d": ("deadline", 0), "p": ("running", 1)}
    assert {r["verdict"] for r in plans.QUERIES["pause_clock"](spark, "/root/testdata/sf0.01").select("verdict").distinct().collect()} == {"running", "stalled", "deadline"}


# --- claims


def test_claims_equal_claiming_one_by_one(spark):
    rng = random.Random(7)
    for _ in range(1):
        jobs = [(i, rng.randrange(4), rng.randrange(2), rng.randrange(5), rng.choice([None, "a", "b", "c"])) for i in range(40)]
        workers = [(w, rng.randrange(0, 7), rng.sample(["a", "b", "c", "mujoco", "z"], rng.randrange(0, 5))) for w in range(14)]
        left, place = {}, {}
        for i, batch, priority, at, ad in sorted(jobs, key=lambda j: (j[3], j[0])):
            ad = ad or "mujoco"
            place[ad, batch] = place.get((ad, batch), 0) + 1
            left.setdefault(ad, []).append((priority, place[ad, batch], i))
        for q in left.values():
            q.sort(reverse=True)
        want = []
        for slot in range(7):
            for w, slots, caps in workers:
                pick = next((c for c in caps if left.get(c)), None) if slot < slots else None
                if pick:
                    want.append((w, slot, caps.index(pick) + 1, left[pick].pop()[2]))
        j = spark.createDataFrame(jobs, "id long, batch_id int, priority int, scheduled_at int, adapter string")
        got = queue.claim_all(j, spark.createDataFrame(workers, "worker_id int, slots int, capabilities array<string>"), most=6)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


# --- versions in force


def test_as_of(spark):
    rng = random.Random(1)
    versions = [(rng.choice(["a", "b"]), rng.randrange(0, 400), i) for i in range(40)]
    rows = [(rng.choice(["a", "b", "c"]), rng.randrange(-5, 500), i) for i in range(200)]
    v = spark.createDataFrame(versions, "k string, s int, version int").withColumn("at", F.timestamp_seconds("s")).drop("s")
    r = spark.createDataFrame(rows, "k string, s int, i int").withColumn("at", F.timestamp_seconds("s"))
    want = {i: max(((s2, x) for k2, s2, x in versions if k2 == k and s2 <= s), default=(None, None))[1] for k, s, i in rows}
    for span in (7, 60, 10_000):
        assert {x["i"]: x["version"] for x in windows.as_of(r, v, "k", "at", span).collect()} == want


# --- retention


def test_retention(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(900).selectExpr("id", "IF(id = 5, NULL, timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(id % 300 AS int))) AS at")
    retention.lay_out(rows, path, "at", files=2)
    cutoff = F.lit("2024-05-10 00:00:00").cast("timestamp")
    want = sorted(r["id"] for r in rows.filter("at >= timestamp'2024-05-10'").collect())
    since = retention.read_since(spark, path, "at", cutoff)
    assert sorted(r["id"] for r in since.collect()) == want
    assert "PartitionFilters: [isnotnull(part" in plan_of(since)
    assert retention.prune(spark, path, "at", cutoff) == 6  # four months, the one without a time, and May
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == want
    assert retention.prune(spark, path, "at", cutoff) == 0
    assert retention.prune(spark, path, "at", F.lit("2024-06-01").cast("timestamp")) == 1
    assert spark.read.parquet(path).agg(F.min("at").cast("string")).first()[0].startswith("2024-06-01")


def test_sink_reads_only_its_parts(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    write = twins.insert_absent_sink(path, ["k"], ["v"], by="day")
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v int, day string")
    write(rows((1, 1, "a"), (1, 2, "a"), (2, 1, "b")), 0)
    write(rows((1, 0, "a"), (3, 1, "a"), (4, 1, "c")), 1)
    assert sorted((r["k"], r["v"], r["day"]) for r in spark.read.parquet(path).collect()) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "a"), (4, 1, "c")]


# --- streams


def stream_of(spark, path, batches, schema):
    """A folder with a file per micro-batch, oldest first, and the stream over it."""
    import os

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{path}/b{n}")
        (part,) = [x for x in os.listdir(f"{path}/b{n}") if x.endswith(".parquet")]
        os.makedirs(f"{path}/all", exist_ok=True)
        os.rename(f"{path}/b{n}/{part}", f"{path}/all/{n}.parquet")
        os.utime(f"{path}/all/{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{path}/all")


def test_rates_over_micro_batches(spark, tmp_path):
    batches = [[("a", 30, 2, 13.0), ("a", 0, 1, 10.0), ("b", 0, 9, 5.0)], [("a", 50, 3, 4.0), ("a", 45, 4, 1.0)], [("a", 100, 5, 8.0), ("a", 20, 6, 99.0)], [("a", 900, 7, 9.0)]]
    stream = stream_of(spark, tmp_path, batches, "k string, s int, id long, total double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1000))
    got = stateful.drained(stateful.rates(stream, "k", "ts", "id", "total", 60, 60.0, 200), "r")
    rows = sorted((r["key"], r["id"], r["rate"], r["evicted"]) for r in got.collect())
    # a drop begins anew at id 4, id 6 comes too late, silent keys go
    assert rows == [("a", 1, 0, False), ("a", 2, 6, False), ("a", 3, 36, False), ("a", 4, 0, False), ("a", 5, 8, False), ("a", 7, 0, False), ("b", -1, 0, True), ("b", 9, 0, False)]


def test_assembly_over_micro_batches(spark, tmp_path):
    batches = [[(1, 2, 0, 5.0, 0), (2, 3, 1, 7.0, 0), (2, 3, 1, 8.0, 1), (2, 3, 9, 8.0, 1)], [(1, 2, 1, 6.0, 10), (2, 3, 0, 9.0, 20)], [(3, 1, 0, 1.0, 500)], [(2, 3, 2, 4.0, 501), (1, 2, 0, 0.0, 502), (4, 2, 1, 3.0, 503)]]
    stream = stream_of(spark, tmp_path, batches, "chunk_id long, total int, idx int, reward double, s int").withColumn("arrived", F.timestamp_seconds(F.col("s") + 1000))
    got = stateful.drained(stateful.assembled(stream, 100), "a")
    missing = stateful.MISSING
    assert sorted(tuple(r) for r in got.collect() if r["reward"] is not None) == [(1, 0, 5.0, None), (1, 1, 6.0, None), (2, 0, 9.0, None), (2, 1, 7.0, None), (3, 0, 1.0, None)]
    assert [tuple(r) for r in got.filter("error IS NOT NULL").collect()] == [(2, 2, None, missing)]


def test_assembly_keeps_a_state_for_many_chunks(spark, tmp_path):
    spark.range(6000).selectExpr("id AS chunk_id", "2 AS total", "0 AS idx", "1D AS reward", "timestamp_seconds(1000 + id % 2) AS arrived").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = stateful.assembled(spark.readStream.schema(spark.read.parquet(f"file://{tmp_path}/in").schema).parquet(f"file://{tmp_path}/in"), 100)
    before = spark.conf.get(stateful.PROVIDER)
    spark.conf.set(stateful.PROVIDER, stateful.ROCKS)
    try:
        query = stream.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(stateful.PROVIDER, before)
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 1024


@pytest.mark.parametrize("parts", [1, 5])
def test_assembly_of_named_chunks(spark, tmp_path, parts):
    import random

    rng = random.Random(7)
    batches = [[(f"c{c}", len(f"{c}") + c % 3, rng.choice([None, 0, 0, 1, 1, 2, 3, -1]), rng.choice([None, 1.0, 2.0, 3.0, 4.0, 5.0]), b * 40 + rng.randrange(40)) for c in rng.choices(range(60), k=90)] for b in range(5)]
    batches[2] += [(None, 1, 0, 1.0, 90), ("n", None, 0, 1.0, 90), ("n", 1, 0, 1.0, None)]
    stream = stream_of(spark, tmp_path, batches, "chunk_id string, total int, idx int, reward double, s int").withColumn("arrived", F.timestamp_seconds(F.col("s") + 1000))
    got = stateful.drained(stateful.assembled(stream, 60, parts=parts), "n")
    held, want, now = {}, [], 0

    def out(c):
        total, _, items = held[c]
        want.extend((c, i, items.get(i), None if i in items else stateful.MISSING) for i in range(total))
        held[c] = None

    for rows in batches:
        whole = [(s, -1 if i is None else i, 99.0 if r is None else r, n, c, r) for c, n, i, r, s in rows if None not in (c, n, s)]
        for s, i, _, n, c, r in sorted(whole, key=lambda x: x[:5]):
            if held.setdefault(c, (n, s, {})) is not None and s <= held[c][1] + 60 and 0 <= i < held[c][0]:
                held[c][2].setdefault(i, r)
        for c, h in list(held.items()):
            if h is not None and (len(h[2]) >= h[0] or h[1] + 60 <= now):
                out(c)
        now = max(x[0] for x in whole)
    for c, h in list(held.items()):
        if h is not None and h[1] + 60 <= now:
            out(c)
    assert len(want) > 60 and {w[3] for w in want} == {None, stateful.MISSING}
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


# --- search


def test_steps_show_all_outcomes(spark):
    rows = plans.QUERIES["search_steps"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r["commits"] for r in rows) and sum(r["stale"] for r in rows) and sum(r["idle"] for r in rows) and any(r["reverted"] for r in rows)
    assert {r["status"] for r in rows} == {"running", "completed"}
    first = {r["lineage"]: r["baseline"] for r in rows if r["round"] == 1}
    assert all(first[r["lineage"]] == r["baseline"] for r in rows)


def test_a_pool_is_bounded(spark):
    with pytest.raises(ValueError, match="62"):
        steps.observed(Tables(spark, SF).embeddings, "label", ["truep"] * 63, {})


def test_archive_minima_never_rise(spark):
    states = spark.createDataFrame([(str(i), [i / 50 - 1.0, (i * 7 % 50) / 25 - 1.0, 0.0]) for i in range(100)], "id string, x array<double>")
    score = lambda x: F.get(x, F.lit(0)) * F.get(x, F.lit(1))
    before: dict = {}
    for n in range(3):
        now = {(r["c0"], r["c1"]): r["score"] for r in search.archive(states, 2, score, n, seed=1).collect()}
        assert all(now[c] <= v for c, v in before.items()) and set(before) <= set(now)
        before = now
    assert search.archive(states, 2, score, 2, seed=1).exceptAll(search.archive(states, 2, score, 2, seed=1)).isEmpty()


def test_identity_of_pools():
    assert set(predicates.POOL) == set(predicates.KERNELS)
