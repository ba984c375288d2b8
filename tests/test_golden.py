"""Fixed values and edge cases of the operators."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import actions, predicates, signature, traces
from tessera.operators import aggregates, health, lineage, queue, rollout, windows
from tessera.sources import json_commands


def one(spark, column, row="SELECT 1"):
    return spark.sql(row).select(column.alias("x")).first()["x"]


def arr(*v):
    return F.array(*map(F.lit, map(float, v)))


def test_traces(spark):
    le = [one(spark, traces.trace_le(arr(*a), arr(*b))) for a, b in (((1, 0), (2, 0)), ((2, 0), (1, 0)), ((1, 0), (1, 5)), ((1, 5), (1, 0)), ((1,), (1, 0)))]
    assert le == [True, False, True, False, True]
    assert one(spark, traces.trace_advantage(arr(1, 0), arr(0.5, 100))) == 1.0
    assert one(spark, traces.trace_advantage(arr(1, 0), arr(1, 0))) == 0.0
    ks = [one(spark, traces.feasible_horizon(F.lit(n), F.lit(h), F.lit(b))) for n, h, b in ((64, 10, 1_000_000), (729, 10, 1_000_000), (64, 2, 1_000_000), (4096, 5, 100))]
    assert ks == [3, 2, 2, 1]


def test_tail(spark):
    for n, k in ((9, 1), (10, 1), (25, 2)):
        s = one(spark, traces.tail_stats(arr(*range(n))))
        assert (s["cvar10"], s["worst"], s["p10"], s["n"]) == (sum(range(k)) / k, 0.0, k - 1, n)
    assert one(spark, traces.tail_stats(F.array().cast("array<double>"))) is None


TERMS = [None, "truep", "falsep", ["what"], ["feat", ["none", 1]], ["not", None], ["feat", ["wavelet_box", 0, 0.5, 1.0]], ["feat", ["wavelet_ricker", 0, 0.1, 0, 5]], ["not", ["feat", ["axis", 9, 1]]]]


def test_predicates(spark):
    row = "SELECT array(0.5F, 1.0F) AS embedding"
    assert [one(spark, predicates.predicate(t), row) for t in TERMS] == [True, True, False, False, False, False, True, False, True]
    assert not one(spark, predicates.predicate(["feat", ["wavelet_box", 1, 0.5, 1.0]]), row)
    assert one(spark, predicates.predicate(json.dumps(["feat", ["axis", 0, 0.6]])), row)
    assert predicates.largest_index(["and", ["feat", ["tridiag", 1, 7, 2, 1, 1]], ["not", None]]) == 7


def test_actions(spark):
    assert one(spark, actions.decode([F.lit(b) for b in (1, 1, 1)], -1, 1)) == 1.0
    assert one(spark, actions.decode([F.lit(b) for b in (0, 0, 0)], -1, 1)) == -1.0
    assert actions.grids(spark.range(1).selectExpr("3 AS levels", "2 AS dims"), "levels", "dims", 3).count() == 9
    for part in ("obs", "reward", "terminated"):
        with pytest.raises(ValueError, match=f"unknown {part} type"):
            actions.Environment({"base_env": "x", "n_action_dims": 1, part: {"type": "?"}})
    assert [name for _, name, _ in actions.Environment({"base_env": "x", "n_action_dims": 3}).terms] == ["speed", "effort"]


def test_gate(spark):
    p = spark.createDataFrame([(1, 0, 5.0, None), (1, 1, 5.0, None), (1, 2, 6.0, 0), (1, 3, 6.0, 1), (2, 0, -1.0, 0)], "k int, o int, r double, e int")
    got = sorted(lineage.gate(p, "k", "o", "r", "e").collect())
    assert [r["outcome"] for r in got] == ["committed", "no_improvement", "stale", "committed", "committed"]
    assert [r["version"] for r in got] == [1, 1, 1, 2, 1]
    assert lineage.moved("completed", "running") == "completed" and lineage.moved("pending", "running") == "running"
    with pytest.raises(ValueError):
        lineage.moved("pending", "completed")


def test_health(spark):
    h = lambda age, ago: one(spark, health.batch_health(F.lit(age), F.lit(ago).cast("int")))
    assert [h(299, None), h(300, None), h(999, 300), h(999, 301)] == ["healthy", "no_poll_yet", "healthy", "stalled"]


def test_chunks(spark):
    parts = spark.createDataFrame([("b", i) for i in range(11)], "b string, i int")
    assert sorted(r["chunk_id"] for r in queue.chunk_plan(parts, "b", "i").collect()) == ["b_chunk_0", "b_chunk_1"]
    assert queue.chunk_plan(parts.limit(0), "b", "i").count() == 0
    assert [queue.page_size(v) for v in ("7", None, "x", 0, 5000)] == [7, 500, 500, 500, 500]
    assert queue.split_names("n", 120_000) == [("n-part0", 0, 50_000), ("n-part1", 50_000, 100_000), ("n-part2", 100_000, 120_000)]


def test_insert_absent(spark):
    there = spark.createDataFrame([(1, 0, 1.0)], "batch_id int, chunk_index int, reward double")
    new = spark.createDataFrame([(1, 0, 9.0), (1, 1, 3.0), (1, 1, 2.0)], "batch_id int, chunk_index int, reward double")
    assert queue.insert_absent(there, new, ["batch_id", "chunk_index"], ["reward"]).collect() == [Row(batch_id=1, chunk_index=1, reward=2.0)]


def test_mean_sd(spark):
    for n, t, q, want in ((0, 0.0, 0.0, (None, None)), (1, 3.0, 9.0, (3.0, None)), (2, 4.0, 10.0, (2.0, 1.0))):
        m, s = aggregates.mean_sd(F.lit(n), F.lit(t), F.lit(q))
        assert (one(spark, m), one(spark, s)) == want


def test_signature(spark):
    same = ['{"bits_per_dim": 3.9, "depth": 1, "max_coeff": 5, "feature_types": null}', "{}", '{"chunk_size": 7, "verifier": "random", "run_seed": null, "scorer": "?"}']
    df = spark.createDataFrame([(x,) for x in [*same, '{"bits_per_dim": "3"}', '{"bits_per_dim": null}', '{"max_coeff": 3}', '{"run_seed": "12"}', '{"depth": true}']], "config string")
    found = df.select(signature.canonical(F.col("config")).alias("c"), signature.signature(F.col("config")).alias("s")).collect()
    assert found[0]["s"] == found[1]["s"] == found[2]["s"] and len(found[0]["s"]) == 16
    assert len({r["s"] for r in found}) == 6
    assert [r["c"].split(",")[0] for r in found[3:5]] == ['{"bits_per_dim":"3"', '{"bits_per_dim":null'] and '"depth":"true"' in found[7]["c"]
    with pytest.raises(Exception, match="unknown feature type"):
        spark.createDataFrame([('{"feature_types": ["what"]}',)], "config string").select(signature.signature(F.col("config"))).collect()


#: Raw configurations as submitted, the text that the rule signs for each, and its label.
CONFIGS = [
    ('{"bits_per_dim": 3, "feature_types": ["axis", "diag"]}', '{"bits_per_dim":3,"depth":1,"feature_types":["axis","diag"],"max_coeff":5,"tridiag_max_coeff":2,"tridiag_dims":null}', "b=3 · d=1 · f=axis,diag"),
    ('{"feature_types": ["diag", "axis", "axis"], "max_coeff": 5.9, "verifier": "other", "top_k": 9, "run_seed": 0}', '{"bits_per_dim":3,"depth":1,"feature_types":["axis","diag"],"max_coeff":5,"tridiag_max_coeff":2,"tridiag_dims":null}', "b=3 · d=1 · f=axis,diag"),
    ('{"bits_per_dim": 4, "depth": 2, "feature_types": ["tridiag"], "max_coeff": 3, "tridiag_dims": {"lo": 0, "hi": 5}, "verifier": "ga_qd", "proposer": "ga", "scorer": "successor", "run_seed": "7x"}', '{"bits_per_dim":4,"depth":2,"feature_types":["tridiag"],"max_coeff":3,"tridiag_max_coeff":2,"tridiag_dims":[0,5],"verifier":"ga_qd","run_seed":7,"proposer":"ga","scorer":"successor"}', "b=4 · d=2 · f=tridiag · c=3 · t=0:5 · r7 · GAQD · GA · SUCC"),
    ("{}", '{"bits_per_dim":3,"depth":1,"feature_types":null,"max_coeff":5,"tridiag_max_coeff":2,"tridiag_dims":null}', "b=3 · d=1"),
]


def test_configs(spark):
    got = spark.createDataFrame([c[:1] for c in CONFIGS], "config string").select(signature.canonical(F.col("config")).alias("c"), signature.label(F.col("config")).alias("l")).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in CONFIGS]


def test_rate_one_sample(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 60, 8), ("a", 200, 9)], "k string, s int, n int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["rate"] for r in windows.rate(df, ["k"], "ts", "n", 60, 60.0).orderBy("s").collect()] == [0, 3, 0]


def test_commands(spark):
    lines = spark.createDataFrame([('{"cmd":"score","job_id":"1","env_name":"a"}',), ("",), ("{bad",), ('{"job_id":"2"}',)], "value string")
    got = {r["job_id"]: r["error"] for r in json_commands.commands(lines).collect()}
    assert got["1"] is None and got["2"] == "no command" and got[None] == "malformed JSON"
    envs = spark.createDataFrame([("a", 6, -1.0, 1.0, 1000, 10.0)], "env_name string, n_action_dims int, action_low double, action_high double, max_steps int, success_threshold double")
    done = {r["job_id"]: r for r in json_commands.with_environment(json_commands.commands(lines), envs).collect()}
    assert done["1"]["max_steps"] == 1000
    with pytest.raises(ValueError):
        json_commands.run_command("nothing")


def test_best_bit(spark):
    r, b = rollout.best_bit(F.lit(1.0), [F.lit(0.0), F.lit(2.0), F.lit(2.0)])
    assert (one(spark, r), one(spark, b)) == (1.0, 1)
    r, b = rollout.best_bit(F.lit(3.0), [F.lit(0.0), F.lit(2.0)])
    assert (one(spark, r), one(spark, b)) == (0.0, -1)


def test_pool_agrees_with_terms(spark):
    terms = [["feat", x] for x in (["axis", 0, 0.5], ["diag", 0, 1, -1.0], ["sq_diag", 1, 0, 2.0], ["prod", 0, 1, 0.3], ["tridiag", 0, 1, 2, 1.0, -2.0], ["sin_axis", 1, 0.2], ["cos_axis", 2, 0.9], ["wavelet_box", 0, -0.5, 0.5], ["axis", 9, 1.0])]
    obs = spark.createDataFrame([(e, [a, b, a * b], a - b) for e in range(2) for a in (-1.0, 0.2, 0.6) for b in (-0.7, 0.1, 0.9)], "label int, embedding array<double>, v double")
    pool = spark.createDataFrame([predicates.pool_row(n, x) for n, x in enumerate(terms)], predicates.POOL_SCHEMA)
    key = lambda d: sorted((r["idx"], round(r["reward"], 9), r["landings"]) for r in d.collect())
    want = key(aggregates.score(obs, terms, "label", F.col("v")))
    assert key(aggregates.score_pool(obs, pool, len(terms), "label", F.col("v"), block=4)) == want
