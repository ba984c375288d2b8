"""Queries: rates, lineages, health, reapers, configurations, commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signature
from ..operators import aggregates, health, lineage, windows
from ..sources import json_commands, read_api, retention
from ..storage import shared_dir
from .batches import ONCE, once
from .bind import Tables
from .registry import query

AS_OF = "2001-08-15"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


TICKS = "SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 100000 AS total FROM events"
RATE = "WITH t AS (" + TICKS + "), w AS (SELECT *, epoch_us(ts) AS us FROM t), f AS (SELECT *, first_value(total) OVER r AS t0, first_value(us) OVER r AS u0 FROM w WINDOW r AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {span} PRECEDING AND CURRENT ROW)) SELECT event_id, CAST(CASE WHEN us > u0 THEN round((total - t0) * {per}::DOUBLE / ((us - u0) / 1e6)) ELSE 0 END AS BIGINT) AS rate FROM f"


def _ticks(t: Tables):
    from pyspark.sql import Window

    return t.events.withColumn("total", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) * 100000).cast("bigint"))


@query("F2 J5", RATE.replace("{span}", "60000000").replace("{per}", "60"))
def rate_60s(t):
    return windows.rate(_ticks(t), ["user_id"], "ts", "total", 60, 60.0).select("event_id", "rate")


@query("F2", RATE.replace("{span}", "86400000000").replace("{per}", "3600"))
def rate_1d(t):
    return windows.rate(_ticks(t), ["user_id"], "ts", "total", 86400, 3600.0).select("event_id", "rate")


ISLANDS = "WITH l AS (SELECT *, CASE WHEN lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) > value THEN 1 ELSE 0 END AS d FROM events), i AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM l)"


@query("F4", ISLANDS + " SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, round(max(value) - min(value), 2) AS gained FROM i GROUP BY user_id, island")
def counter_reset_rate(t):
    i = windows.islands(t.events, ["user_id"], ["ts", "event_id"], "value")
    return i.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value") - F.min("value"), 2).alias("gained"))


@query("F7", "WITH d AS (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dv, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS du FROM events) SELECT event_id, round(CASE WHEN du > 0 THEN dv / (du / 1e9) * 100 ELSE 0.0::DOUBLE END, 1) + 0.0 AS util FROM d")
def util_delta(t):
    e = t.events.withColumn("us", F.unix_micros("ts"))
    dv, du = windows.delta(e, ["user_id"], ["ts", "event_id"], "value"), windows.delta(e, ["user_id"], ["ts", "event_id"], "us")
    return e.select("event_id", dv.alias("dv"), du.alias("du")).select("event_id", (F.round(F.when(F.col("du") > 0, F.col("dv") / (F.col("du") / F.lit(1e9)) * 100).otherwise(0.0), 1) + 0.0).alias("util"))


SAMPLES = "SELECT epoch(l_shipdate)::BIGINT // 2592000 AS tick, l_linenumber AS id, sum(l_quantity) AS active, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE) AS total FROM lineitem GROUP BY 1, 2"


@query("F7 D14", "WITH s AS (" + SAMPLES + "), g AS (SELECT n.tick, sum(n.active - p.active) AS a, sum(n.total - p.total) AS t, count(*) AS n, count(p.id) AS both FROM s n LEFT JOIN s p ON p.tick = n.tick - 1 AND p.id = n.id GROUP BY n.tick), c AS (SELECT tick + 1 AS tick, count(*) AS n FROM s GROUP BY tick) SELECT CAST(g.tick AS BIGINT) AS tick, CASE WHEN g.n = g.both AND g.n = c.n AND t <> 0 THEN round(a * 100 / t, 1) ELSE 0.0::DOUBLE END + 0.0 AS util FROM g LEFT JOIN c ON c.tick = g.tick")
def utilisation(t):
    tick = F.expr("unix_seconds(l_shipdate) div 2592000")
    s = t.lineitem.select(tick.alias("tick"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("q"), F.floor("l_extendedprice").alias("x"))
    return windows.utilisation(s.groupBy("tick", "id").agg(F.sum("q").alias("active"), F.sum("x").cast("double").alias("total"))).select("tick", (F.col("util") + 0.0).alias("util"))


@query("D1 D2 D3", "WITH b AS (SELECT * FROM {batches} WHERE status <> 'completed'), r AS (SELECT *, rank() OVER (PARTITION BY experiment_id ORDER BY inserted_at DESC) AS k FROM b) SELECT r.experiment_id, r.batch_id, c_mktsegment AS env_policy FROM r LEFT JOIN customer ON c_custkey = experiment_id AND c_acctbal >= 0 WHERE k = 1")
def latest_inflight(t):
    last = windows.latest(t.batches().filter("status <> 'completed'"), ["experiment_id"], "inserted_at")
    owners = t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("experiment_id"), F.col("c_mktsegment").alias("env_policy"))
    return last.join(owners, "experiment_id", "left").select("experiment_id", "batch_id", "env_policy")


@query("G2 A7", "SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(length(text) AS BIGINT) AS size FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 5")
def latest_n_commits(t):
    return windows.newest(t.conversations, ["conv_id"], [F.desc("turn")], 5).select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.length("text").cast("bigint").alias("size"))


@query("F3 B20", "SELECT conv_id, CAST(turn AS BIGINT) AS turn, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY role, turn, conv_id) AS number FROM conversations")
def renumber_versions(t):
    return lineage.renumber(t.conversations.withColumn("bucket", F.col("conv_id") % 10), "bucket", ["role", "turn", "conv_id"]).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "number")


@query("G8 B5", "SELECT CAST(c_nationkey AS BIGINT) AS nation, c_custkey AS winner FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, -1e18) DESC, c_custkey DESC) AS n FROM customer) WHERE n = 1")
def winner_per_group(t):
    best = F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.lit(-1e18))
    return t.customer.groupBy(F.col("c_nationkey").cast("bigint").alias("nation")).agg(F.max_by("c_custkey", F.struct(best, "c_custkey")).alias("winner"))


CUTOFFS = "SELECT experiment_id, greatest(min(inserted_at), max(inserted_at) FILTER (status = 'completed')) AS cutoff FROM {batches} GROUP BY experiment_id"


def _cutoffs(t):
    return t.batches().groupBy("experiment_id").agg(F.greatest(F.min("inserted_at"), F.max(F.when(F.col("status") == "completed", F.col("inserted_at")))).alias("cutoff"))


@query("D10 E13", "SELECT b.experiment_id, b.batch_id FROM {batches} b JOIN (" + CUTOFFS + ") c ON c.experiment_id = b.experiment_id AND b.inserted_at >= c.cutoff")
def wave_batches(t):
    return windows.since(t.batches(), _cutoffs(t), "experiment_id", "inserted_at").select("experiment_id", "batch_id")


FLOW = "SELECT b.experiment_id, count(*) FILTER (status = 'completed') AS done, count(*) AS total, greatest(count(*) - count(*) FILTER (status = 'completed'), 0) AS pending, max(inserted_at) AS last_at, count(DISTINCT CASE WHEN b.batch_id % 5 > 0 THEN b.batch_id % 18 END) AS bits, count(*) FILTER (inserted_at >= cutoff) AS wave FROM {batches} b JOIN (" + CUTOFFS + ") c ON c.experiment_id = b.experiment_id GROUP BY b.experiment_id"


def _flow(t):
    b = t.batches().join(_cutoffs(t), "experiment_id")
    done = F.count_if(F.col("status") == "completed")
    return b.groupBy("experiment_id").agg(done.alias("done"), F.count(F.lit(1)).alias("total"), F.greatest(F.count(F.lit(1)) - done, F.lit(0)).alias("pending"), F.max("inserted_at").alias("last_at"), F.countDistinct(F.when(F.col("batch_id") % 5 > 0, F.col("batch_id") % 18)).alias("bits"), F.count_if(F.col("inserted_at") >= F.col("cutoff")).alias("wave"))


@query("E12 D8", "SELECT experiment_id, done, total, pending, bits, wave, epoch_us(last_at) AS last_us FROM (" + FLOW + ")")
def flow_stats(t):
    return _flow(t).select("experiment_id", "done", "total", "pending", "bits", "wave", F.unix_micros("last_at").alias("last_us"))


@query("I17", "WITH f AS (" + FLOW + ") SELECT experiment_id, CAST(CASE WHEN pending > 0 AND wave > 0 THEN floor(greatest(total + CASE WHEN bits > 0 AND bits < 18 THEN CAST(round((18 - bits) * CAST(total AS DOUBLE) / bits) AS BIGINT) ELSE 0 END - done, 0) * 60.0 / wave) END AS BIGINT) AS eta FROM f")
def eta_wave(t):
    e = health.eta(F.col("total"), 18, F.col("bits"), F.col("done"), F.col("pending"), F.col("wave"))
    return _flow(t).select("experiment_id", e.cast("bigint").alias("eta"))


POLLED = "SELECT b.*, p.polled_at FROM {batches} b LEFT JOIN (SELECT batch_id, max(arrived) AS polled_at FROM {results} GROUP BY batch_id) p ON p.batch_id = b.batch_id"


def _polled(t):
    p = t.results().groupBy("batch_id").agg(F.max("arrived").alias("polled_at"))
    return t.batches().join(p, "batch_id", "left")


@query("I19", f"SELECT batch_id, CASE WHEN polled_at IS NULL THEN CASE WHEN epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(inserted_at) >= 300000000 THEN 'no_poll_yet' ELSE 'healthy' END WHEN epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(polled_at) > 300000000 THEN 'stalled' ELSE 'healthy' END AS health FROM (" + POLLED + ")")
def health_batch(t):
    age = F.unix_seconds(as_of()) - F.unix_seconds("inserted_at")
    ago = F.unix_seconds(as_of()) - F.unix_seconds("polled_at")
    return _polled(t).select("batch_id", health.batch_health(age, ago).alias("health"))


@query("I20 C15", f"WITH f AS (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_at)) // 86400000000 AS days FROM (" + FLOW + ")) SELECT experiment_id, CASE WHEN done = 0 THEN CASE WHEN days * 60 >= 300 THEN 'idle' ELSE 'healthy' END WHEN pending = 0 THEN 'unknown' WHEN days > 300 THEN 'stalled' WHEN days * 30 > 300 AND wave < 3 THEN CASE WHEN bits > 5 THEN 'idle' ELSE 'paused' END WHEN done % 3 = 0 AND days * 30 > 3600 AND wave > 1 THEN 'slow' ELSE 'healthy' END AS health FROM f")
def health_experiment(t):
    days = F.expr("(unix_micros(timestamp'" + AS_OF + "') - unix_micros(last_at)) div 86400000000")
    f = _flow(t).withColumn("days", days)
    status = F.when(F.col("done") == 0, "pending").when(F.col("pending") > 0, "running").otherwise("completed")
    h = health.experiment_health(status, F.col("days") * 60, F.col("days"), F.col("days") * 30, F.col("wave") < 3, F.col("bits") > 5, F.col("done") % 3, F.col("wave") > 1)
    return f.select("experiment_id", h.alias("health"))


#: Raw configurations as customers submit them, of all kinds that the rule tells apart; the same text on both engines.
CONFIG = """concat('{', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('"bits_per_dim":', c_nationkey % 4 + 2, ',') END, CASE c_custkey % 3 WHEN 0 THEN '"depth":null,' WHEN 1 THEN '"depth":2.7,' ELSE '' END, CASE c_custkey % 4 WHEN 0 THEN '"feature_types":["diag","axis","axis"],' WHEN 1 THEN '"feature_types":[],' WHEN 2 THEN '"feature_types":null,' ELSE '' END, CASE c_custkey % 2 WHEN 0 THEN '"max_coeff":5.9,' ELSE concat('"max_coeff":', c_nationkey, ',') END, CASE c_custkey % 6 WHEN 1 THEN '"tridiag_dims":{"lo":0,"hi":5},' WHEN 2 THEN '"tridiag_dims":[2,3],' ELSE '' END, CASE c_custkey % 7 WHEN 0 THEN '"verifier":"ga_qd",' WHEN 1 THEN '"verifier":"other",' ELSE '' END, CASE c_custkey % 8 WHEN 0 THEN '"run_seed":"7x",' WHEN 1 THEN '"run_seed":-4,' WHEN 2 THEN concat('"run_seed":', c_nationkey, ',') ELSE '' END, CASE WHEN c_custkey % 9 = 0 THEN '"proposer":"ga",' ELSE '' END, CASE WHEN c_custkey % 10 = 0 THEN '"scorer":"successor",' ELSE '' END, CASE WHEN c_custkey % 11 = 0 THEN '"successor_continuation":{"type":"cycle","actions":[[1,-0.5],[0.25,0]]},' ELSE '' END, '"top_k":', c_custkey, '}')"""
_BITS = "CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE c_nationkey % 4 + 2 END"
_MOST = "CASE c_custkey % 2 WHEN 0 THEN 5 ELSE c_nationkey END"
_SEED = "CASE c_custkey % 8 WHEN 0 THEN 7 WHEN 2 THEN c_nationkey ELSE 0 END"
SIGNED = f"""concat('{{"bits_per_dim":', {_BITS}, ',"depth":', CASE c_custkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN '2' ELSE '1' END, ',"feature_types":', CASE c_custkey % 4 WHEN 0 THEN '["axis","diag"]' WHEN 1 THEN '[]' ELSE 'null' END, ',"max_coeff":', {_MOST}, ',"tridiag_max_coeff":2,"tridiag_dims":', CASE c_custkey % 6 WHEN 1 THEN '[0,5]' WHEN 2 THEN '[2,3]' ELSE 'null' END, CASE WHEN c_custkey % 7 = 0 THEN ',"verifier":"ga_qd"' ELSE '' END, CASE WHEN {_SEED} <> 0 THEN concat(',"run_seed":', {_SEED}) ELSE '' END, CASE WHEN c_custkey % 9 = 0 THEN ',"proposer":"ga"' ELSE '' END, CASE WHEN c_custkey % 10 = 0 THEN ',"scorer":"successor"' ELSE '' END, CASE WHEN c_custkey % 11 = 0 THEN ',"successor_continuation":{{"type":"cycle","hold":1,"actions":[[1.0,-0.5],[0.25,0.0]]}}' ELSE '' END, '}}')"""
LABELLED = f"""concat('b=', {_BITS}, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' · d=2' ELSE ' · d=1' END, CASE c_custkey % 4 WHEN 0 THEN ' · f=axis,diag' WHEN 1 THEN ' · f=' ELSE '' END, CASE WHEN {_MOST} <> 5 THEN concat(' · c=', {_MOST}) ELSE '' END, CASE c_custkey % 6 WHEN 1 THEN ' · t=0:5' WHEN 2 THEN ' · t=2:3' ELSE '' END, CASE WHEN {_SEED} <> 0 THEN concat(' · r', {_SEED}) ELSE '' END, CASE WHEN c_custkey % 7 = 0 THEN ' · GAQD' ELSE '' END, CASE WHEN c_custkey % 9 = 0 THEN ' · GA' ELSE '' END, CASE WHEN c_custkey % 10 = 0 THEN ' · SUCC' ELSE '' END)"""


@query("I4 I5", f"SELECT c_custkey, substring(sha256({SIGNED}), 1, 16) AS sig FROM customer")
def config_signature(t):
    return t.customer.select("c_custkey", F.expr(CONFIG).alias("config")).select("c_custkey", signature.signature(F.col("config")).alias("sig"))


@query("I6", f"SELECT c_custkey, {LABELLED} AS label FROM customer")
def config_label(t):
    return t.customer.select("c_custkey", F.expr(CONFIG).alias("config")).select("c_custkey", signature.label(F.col("config")).alias("label"))


GATE = "WITH RECURSIVE p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn, CAST(length(text) AS DOUBLE) AS r, CASE WHEN turn % 4 = 3 THEN 0 END AS e FROM conversations), g AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS turn, CAST('' AS VARCHAR) AS outcome, CAST(0 AS BIGINT) AS version, CAST(NULL AS DOUBLE) AS best FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT p.conv_id, p.k, p.turn, CASE WHEN e IS NOT NULL AND e <> version THEN 'stale' WHEN best IS NULL OR r > best + 1e-9 THEN 'committed' ELSE 'no_improvement' END, version + CASE WHEN (e IS NULL OR e = version) AND (best IS NULL OR r > best + 1e-9) THEN 1 ELSE 0 END, CASE WHEN (e IS NULL OR e = version) AND (best IS NULL OR r > best + 1e-9) THEN r ELSE best END FROM g JOIN p ON p.conv_id = g.conv_id AND p.k = g.k + 1)"


def _gate(t):
    p = t.conversations.select("conv_id", "turn", F.length("text").cast("double").alias("reward"), F.when(F.col("turn") % 4 == 3, 0).alias("seen"))
    return lineage.gate(p, "conv_id", "turn", "reward", "seen")


@query("L6 F5 F8", GATE + " SELECT conv_id, turn, outcome, version, best FROM g WHERE k > 0")
def commit_gate(t):
    return _gate(t).select("conv_id", "turn", "outcome", "version", "best")


REPLAYED = "WITH RECURSIVE p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k, turn, CAST(length(text) % 18 AS BIGINT) AS bit, length(text) % 5 = 0 AS back FROM conversations), s AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, list_transform(range(18), lambda x: CAST(-1 AS BIGINT)) AS now, list_transform(range(18), lambda x: CAST(-1 AS BIGINT)) AS old, TRUE AS whole FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT s.conv_id, p.k, CASE WHEN p.back THEN s.old ELSE list_transform(s.now, lambda x, i: CASE WHEN i = p.bit + 1 THEN p.turn ELSE x END) END, CASE WHEN p.back THEN s.old ELSE s.now END, s.whole AND p.turn = s.k FROM s JOIN p ON p.conv_id = s.conv_id AND p.k = s.k + 1)"


@query("L11 B13", REPLAYED + " SELECT conv_id, max(k) AS versions, arg_max(whole, k) AS contiguous, array_to_string(list_transform(arg_max(now, k), lambda x: x::VARCHAR), ',') AS state FROM s GROUP BY conv_id")
def lineage_replay(t):
    """Every lineage's policy as its versions leave it, reverts included."""
    v = t.conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), (F.length("text") % 18).alias("bit"), (F.length("text") % 5 == 0).alias("back"), F.length("text").alias("size"))
    return lineage.replayed(v, "conv_id", "turn", "bit", "back", 18, ["size"]).select("conv_id", "versions", "contiguous", F.array_join(F.transform("state", lambda x: x.cast("string")), ",").alias("state"))


@query("D5 A5", "WITH v AS (SELECT conv_id, max(turn) AS version, count(*) AS n FROM conversations GROUP BY conv_id) SELECT b.batch_id, b.experiment_id, CAST(v.version AS BIGINT) AS version, v.n AS versions, CASE WHEN v.conv_id IS NULL THEN 'no lineage' END AS error FROM {batches} b LEFT JOIN v ON v.conv_id = b.experiment_id % 150")
def lineage_of_batches(t):
    """Each batch with the lineage of its experiment, as it is now."""
    v = t.conversations.groupBy("conv_id").agg(F.max("turn").cast("bigint").alias("version"), F.count(F.lit(1)).alias("versions"))
    b = t.batches().select("batch_id", "experiment_id", (F.col("experiment_id") % 150).alias("policy"))
    return lineage.for_experiment(b, v.withColumnRenamed("conv_id", "policy"), "policy").select("batch_id", "experiment_id", "version", "versions", "error")


@query("L9", "WITH l AS (SELECT conv_id, turn, CAST(length(text) AS DOUBLE) AS after, lag(CAST(length(text) AS DOUBLE)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, CAST(turn + 1 AS BIGINT) AS version, CAST(-1 AS BIGINT) AS bit_idx, after, before FROM l WHERE after < before - 1e-9 AND turn % 3 > 0")
def revert_guard(t):
    from pyspark.sql import Window

    size = F.length("text").cast("double")
    p = t.conversations.select("conv_id", F.col("turn").cast("bigint").alias("version"), size.alias("after"), F.lag(size).over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"), (F.col("turn") % 3).alias("commits"))
    return lineage.reverts(p).select("conv_id", "version", "bit_idx", "after", "before")


@query("C20", "WITH v AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 5 END AS validated, c_custkey % 4 AS version FROM customer) SELECT c_custkey, a IS NULL OR coalesce(validated < version, TRUE) AS stale FROM v")
def validation_stale(t):
    v = t.customer.select("c_custkey", F.expr("CASE WHEN c_acctbal >= 0 THEN c_acctbal END").alias("a"), F.expr("CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 5 END").alias("validated"), (F.col("c_custkey") % 4).alias("version"))
    return v.select("c_custkey", lineage.stale(F.col("a"), F.col("validated"), F.col("version")).alias("stale"))


@query("M1 D6", f"WITH u AS (SELECT experiment_id, max(inserted_at) AS updated_at, bool_or(status IN ('pending', 'running')) AS active FROM {{batches}} GROUP BY experiment_id) SELECT experiment_id FROM u WHERE active AND updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 360 DAY AND experiment_id NOT IN (SELECT experiment_id FROM {{batches}} WHERE status = 'pending' AND inserted_at >= TIMESTAMP '2000-01-01')")
def reap_stalled(t):
    b = t.batches()
    active = F.bool_or(F.col("status").isin("pending", "running"))
    u = b.groupBy("experiment_id").agg(F.max("inserted_at").alias("updated_at"), F.when(active, "running").otherwise("completed").alias("status"))
    live = b.filter("status = 'pending' AND inserted_at >= TIMESTAMP '2000-01-01'").select("experiment_id")
    return health.stalled(u, live, as_of(), 360 * 86400).select("experiment_id")


@query("D7 M2", "SELECT batch_id FROM {batches} WHERE status <> 'completed' AND experiment_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def orphan_batches(t):
    return health.orphans(t.batches(), t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("experiment_id"))).select("batch_id")


@query("M3", f"SELECT batch_id FROM (SELECT *, CASE WHEN batch_id % 3 > 0 THEN experiment_id END AS owner FROM (" + POLLED + f")) WHERE owner IS NULL AND status <> 'completed' AND (polled_at IS NULL OR polled_at < TIMESTAMP '{AS_OF}' - INTERVAL 900 DAY)")
def unowned_batches(t):
    b = _polled(t).withColumn("experiment_id", F.when(F.col("batch_id") % 3 > 0, F.col("experiment_id")))
    return health.unowned(b, as_of(), 900 * 86400).select("batch_id")


@query("B12 B18 M4", f"SELECT batch_id, CAST(chunk_index AS BIGINT) AS chunk_index, worker_id, reward, epoch_us(arrived) AS at_us FROM {{results}} WHERE arrived >= TIMESTAMP '{AS_OF}' - INTERVAL 400 DAY")
def retained_results(t):
    """Results laid out by month, those older than 400 days deleted, and read back."""
    path = shared_dir(t.spark, "results") + "/table"
    cutoff = as_of() - F.expr("INTERVAL 400 DAYS")
    retention.lay_out(t.results(), path, "arrived")
    retention.prune(t.spark, path, "arrived", cutoff)
    kept = retention.read_since(t.spark, path, "arrived", cutoff)
    return kept.select("batch_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "worker_id", "reward", F.unix_micros("arrived").alias("at_us"))


@query("B12", f"SELECT arrived >= TIMESTAMP '{AS_OF}' - INTERVAL 400 DAY AS kept, count(*) AS n FROM {{results}} GROUP BY 1")
def prune_results(t):
    return t.results().groupBy((F.col("arrived") >= as_of() - F.expr("INTERVAL 400 DAYS")).alias("kept")).agg(F.count(F.lit(1)).alias("n"))


@query("B11 B8 M4", f"SELECT worker_id, CASE WHEN max(arrived) < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 'inactive' ELSE 'active' END AS status FROM {{results}} GROUP BY worker_id")
def mark_inactive(t):
    w = t.results().groupBy("worker_id").agg(F.max("arrived").alias("last_heartbeat_at")).withColumn("status", F.lit("active"))
    return health.inactive(w, as_of(), 30 * 86400).select("worker_id", "status")


@query("C16 G2", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def incidents(t):
    return t.events.filter("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


@query("F8 H6", "WITH c AS (SELECT DISTINCT conv_id, CAST(length(text) % 18 AS BIGINT) AS bit FROM conversations), k AS (SELECT DISTINCT conv_id FROM conversations) SELECT k.conv_id, CAST(o.i AS BIGINT) AS bit FROM k, range(18) o(i) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = k.conv_id AND c.bit = o.i)")
def open_bits(t):
    settled = t.conversations.select("conv_id", (F.length("text") % 18).cast("bigint").alias("bit"))
    return lineage.open_bits(settled, "conv_id", "bit", 18)


@query("E21 L8", GATE + ", w AS (SELECT conv_id % 10 AS wave, count(*) FILTER (outcome = 'committed') AS commits, count(*) FILTER (outcome = 'stale') AS stale, count(*) FILTER (outcome = 'no_improvement') AS none FROM g WHERE k > 0 GROUP BY conv_id % 10) SELECT wave, commits, stale, none, commits = 0 AND stale = 0 AS saturated FROM w")
def pass_tally(t):
    n = lambda o, name: F.count_if(F.col("outcome") == o).alias(name)
    w = _gate(t).groupBy((F.col("conv_id") % 10).alias("wave")).agg(n("committed", "commits"), n("stale", "stale"), n("no_improvement", "none"))
    return w.withColumn("saturated", (F.col("commits") == 0) & (F.col("stale") == 0))


@query("J7", "WITH m AS (SELECT *, CASE WHEN value > 60 THEN 1 WHEN value <= 20 THEN 0 END AS mark FROM events), l AS (SELECT *, count(mark) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM m), p AS (SELECT *, max(mark) OVER (PARTITION BY user_id, grp) AS v FROM l) SELECT event_id, coalesce(v = 1, FALSE) AS paused FROM p")
def backlog_hysteresis(t):
    from ..operators import queue

    e = t.events.withColumn("at", F.struct("ts", "event_id"))
    return queue.paused(e, "user_id", "at", "value", 60, 20).select("event_id", "paused")


@query("I12 I13 C17 C18 A9", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'score' AS cmd, CASE WHEN event_id % 5 = 0 THEN 'malformed JSON' END AS error FROM events WHERE event_id % 5 > 0 UNION ALL SELECT event_id, NULL, NULL, 'malformed JSON' FROM events WHERE event_id % 5 = 0")
def json_repair(t):
    # every fifth line is cut short, the others' payload is JSON inside a JSON string
    good = F.concat(F.lit('{"cmd":"score","job_id":"'), F.col("event_id").cast("string"), F.lit('","env_name":'), F.to_json(F.struct(F.col("props").alias("x"))), F.lit("}"))
    nested = F.regexp_replace(good, r'"env_name":\{"x":(.*)\}\}$', r'"env_name":$1}')
    lines = t.events.select(F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"job_id":"'), F.col("event_id").cast("string"), F.lit('",'))).otherwise(nested).alias("value"))
    c = json_commands.commands(lines)
    found = F.coalesce(F.col("job_id"), F.regexp_extract("line", r'"job_id":"(\d+)"', 1)).cast("bigint")
    return c.select(found.alias("event_id"), F.get_json_object("env_name", "$.k").cast("bigint").alias("k"), "cmd", "error")


@query("I18", "WITH s AS (SELECT experiment_id, count(*) FILTER (status = 'completed') AS completed, count(*) AS total, max(inserted_at) FILTER (status <> 'completed') AS m FROM {batches} GROUP BY experiment_id) SELECT experiment_id, completed, total, epoch_us(m) AS active_us, round(greatest(0, (completed % 4 - 1) * 10 + (total % 7 - 1)) / 40.0::DOUBLE, 6) AS progress FROM s")
def session_progress(t):
    s = t.batches().groupBy("experiment_id").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count(F.lit(1)).alias("total"), F.max(F.when(F.col("status") != "completed", F.col("inserted_at"))).alias("m"))
    p = health.progress(F.col("completed") % 4, F.col("total") % 7, F.lit(10), F.lit(4))
    return s.select("experiment_id", "completed", "total", F.unix_micros("m").alias("active_us"), F.round(p, 6).alias("progress"))


SESSIONS = "SELECT batch_id, experiment_id, inserted_at, best_reward, CASE WHEN batch_id % 11 = 0 THEN 'failed' WHEN batch_id % 13 = 0 THEN 'cancelled' ELSE status END AS status FROM {batches}"


def _sessions(t):
    status = F.when(F.col("batch_id") % 11 == 0, "failed").when(F.col("batch_id") % 13 == 0, "cancelled").otherwise(F.col("status"))
    return t.batches().select("batch_id", "experiment_id", "inserted_at", "best_reward", status.alias("status"))


@query("E18 A7 C16", "WITH s AS (SELECT *, status IN ('pending', 'running') AS live FROM (" + SESSIONS + ")), g AS (SELECT experiment_id, arg_max((batch_id, status), (inserted_at, batch_id)) FILTER (live) AS a, arg_max((batch_id, status), (inserted_at, batch_id)) FILTER (NOT live) AS l, arg_max(batch_id, (inserted_at, batch_id)) FILTER (status = 'completed') AS c, count(*) FILTER (status = 'completed') AS completed, count(*) AS total FROM s GROUP BY experiment_id) SELECT experiment_id, a[1] AS active, l[1] AS last_run, c AS latest, coalesce(a[2], l[2], 'history') AS status, completed, total FROM g")
def session_lists(t):
    """Of each lineage the newest session that is active, that has ended and that is completed, and its status by them."""
    return lineage.session_lists(_sessions(t), "experiment_id", "batch_id", "inserted_at")


@query("C16 E4", "SELECT status, count(*) AS n, round(sum(best_reward), 2) AS total, count(*) FILTER (inserted_at >= TIMESTAMP '1999-01-01') AS recent FROM (" + SESSIONS + ") GROUP BY status")
def statuses(t):
    return _sessions(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("best_reward"), 2).alias("total"), F.count_if(F.col("inserted_at") >= F.lit("1999-01-01").cast("timestamp")).alias("recent"))


@query("C18 I13 C17", """SELECT event_id, concat('{"env":"', event_type, '",', CASE WHEN event_id % 3 = 0 THEN '"seed":"7",' ELSE '' END, '"user":"', user_id, '"}') AS payload, CAST(2 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n, event_id % 4 = 0 AS had_secret FROM events""")
def payload_scrub(t):
    """Payloads without the keys that are nobody's business and without nulls, given ones over the defaults."""
    given = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("env"), F.col("event_type"), F.lit("token"), F.when(F.col("event_id") % 4 == 0, "secret"), F.lit("candidates"), F.lit("[1,2]"), F.lit("seed"), F.when(F.col("event_id") % 3 == 0, "7"))
    clean = json_commands.scrubbed(given, drop=["token", "candidates"], defaults={"env": "none", "user": "nobody"})
    return t.events.select("event_id", F.to_json(clean).alias("payload"), F.size(clean).cast("bigint").alias("n"), F.get(F.map_values(F.map_filter(given, lambda k, v: k == "token")), F.lit(0)).isNotNull().alias("had_secret"))


@query("I3 I7 I15 I21", "SELECT event_id, strftime(ts + INTERVAL 90 SECOND, '%Y-%m-%dT%H:%M:%S') AS at, substring(event_type, 1, 4) AS short, CASE WHEN value > 100 THEN 'walked' WHEN value > 20 THEN 'survived' ELSE 'fell' END AS label, CAST(trim(split_part(' a, b ,7', ',', 3)) AS BIGINT) AS third FROM events")
def date_label(t):
    label = F.when(F.col("value") > 100, "walked").when(F.col("value") > 20, "survived").otherwise("fell")
    third = F.get(F.transform(F.split(F.lit(" a, b ,7"), ","), F.trim), F.lit(2))
    return t.events.select("event_id", F.date_format(F.col("ts") + F.expr("INTERVAL 90 SECONDS"), "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.substring("event_type", 1, 4).alias("short"), label.alias("label"), third.cast("bigint").alias("third"))


@query("H2 H3 H4", "WITH d AS (SELECT DISTINCT user_id, epoch_us(ts) // 86400000000 AS day FROM events) SELECT a.day, CASE WHEN b.user_id IS NULL THEN 'evicted' ELSE 'retained' END AS what, a.user_id FROM d a LEFT JOIN d b ON b.user_id = a.user_id AND b.day = a.day + 1 WHERE a.day < (SELECT max(day) FROM d)")
def key_sets(t):
    """Each day's users, and whether they are still there on the next."""
    days = t.events.select("user_id", F.expr("unix_micros(ts) div 86400000000").alias("day")).distinct()
    return windows.kept_keys(days, "user_id", "day").select("day", "what", "user_id")


@query("G4 G10", "SELECT event_id, user_id, value, row_number() OVER (ORDER BY user_id, event_id) AS place FROM events WHERE event_type <> 'error'")
def sort_lists(t):
    rows = t.events.filter("event_type <> 'error'")
    return windows.places(rows, "user_id", ["event_id"]).select("event_id", "user_id", "value", "place")


@query("A14", "WITH b AS (SELECT *, rank() OVER (PARTITION BY experiment_id ORDER BY inserted_at DESC) AS k FROM {batches} WHERE status <> 'completed'), s AS (SELECT batch_id, count(reward) AS n, sum(reward) AS t FROM " + ONCE + " GROUP BY batch_id) SELECT experiment_id, count(*) AS batches, coalesce(CAST(sum(n) AS BIGINT), 0) AS results, round(sum(t) / sum(n) / 30, 7) AS mean FROM b LEFT JOIN s ON s.batch_id = b.batch_id WHERE k = 1 GROUP BY experiment_id")
def aggregate_payload(t):
    last = windows.latest(t.batches().filter("status <> 'completed'"), ["experiment_id"], "inserted_at")
    s = aggregates.summary(once(t)).select("batch_id", "n", "total")
    g = last.join(s, "batch_id", "left").groupBy("experiment_id").agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("results"), F.sum("total").alias("t"))
    return g.select("experiment_id", "batches", "results", F.round(F.when(F.col("results") > 0, F.col("t") / F.col("results")) / 30, 7).alias("mean"))


@query("M5", "WITH j AS (SELECT batch_id AS job_id, CASE WHEN batch_id % 2 = 0 THEN 'ExperimentController' ELSE 'Pruner' END AS worker, batch_id % 5 + 1 AS attempt, status AS reason, experiment_id FROM {batches} WHERE batch_id % 3 = 0), e AS (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) SELECT job_id, experiment_id, concat(worker, ' failed after ', attempt, ' attempts: ', reason) AS message FROM j WHERE worker = 'ExperimentController' AND experiment_id IN (SELECT c_custkey FROM e) UNION ALL SELECT job_id, NULL, concat(worker, ' job exhausted retries: ', reason) FROM j WHERE worker <> 'ExperimentController'")
def discarded_jobs(t):
    jobs = t.batches().select(F.col("batch_id").alias("job_id"), F.expr("CASE WHEN batch_id % 2 = 0 THEN 'ExperimentController' ELSE 'Pruner' END").alias("worker"), F.expr("CASE WHEN batch_id % 3 = 0 THEN 'discard' ELSE 'failure' END").alias("state"), (F.col("batch_id") % 5 + 1).alias("attempt"), F.col("status").alias("reason"), "experiment_id")
    owners = t.customer.select(F.col("c_custkey").alias("experiment_id"), F.when(F.col("c_acctbal") < 0, "cancelled").otherwise("running").alias("status"))
    return health.discarded(jobs, owners)


CLOCK = "WITH RECURSIVE k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_type = 'purchase', value < 50) AS k, epoch_us(ts) // 1000000 AS sec, event_type = 'purchase' AS p, value < 50 AS live FROM events), s AS (SELECT user_id, CAST(0 AS BIGINT) AS k, sec AS start_sec, sec AS clock, 'running' AS verdict, CAST(0 AS BIGINT) AS pauses FROM k WHERE k = 1 UNION ALL SELECT user_id, k, start_sec, CASE WHEN NOT over AND NOT late AND paused THEN sec - 40001 WHEN p AND NOT over AND NOT late AND NOT (sec - clock > 250000) THEN sec ELSE clock END, CASE WHEN over THEN verdict WHEN late THEN 'deadline' WHEN NOT paused AND sec - clock > 250000 THEN 'stalled' ELSE 'running' END, pauses + CASE WHEN NOT over AND NOT late AND paused THEN 1 ELSE 0 END FROM (SELECT s.user_id, k.k, s.start_sec, s.clock, s.verdict, s.pauses, k.sec, k.p, s.verdict <> 'running' AS over, k.sec - s.start_sec > 2540000 AS late, k.sec - s.clock > 40000 AND NOT k.live AS paused FROM s JOIN k ON k.user_id = s.user_id AND k.k = s.k + 1) x)"


@query("J10", CLOCK + " SELECT user_id, arg_max(verdict, k) AS verdict, max(pauses) AS pauses FROM s GROUP BY user_id")
def pause_clock(t):
    ticks = t.events.select("user_id", F.unix_seconds("ts").alias("at"), (F.col("event_type") == "purchase").alias("progressed"), (F.col("value") < 50).alias("live"))
    return health.stall_clock(ticks, "user_id", 40_000, 250_000, 2_540_000)


@query("A13 B16", "WITH a AS (SELECT DISTINCT l_orderkey AS batch_id FROM lineitem UNION SELECT -1) SELECT a.batch_id, CAST(CASE WHEN b.batch_id IS NULL THEN 404 ELSE 200 END AS BIGINT) AS status, CASE WHEN b.batch_id IS NULL THEN '{\"error\":\"not_found\",\"batch_id\":' || a.batch_id || '}' ELSE '{\"batch_id\":' || b.batch_id || ',\"status\":\"' || b.status || '\"}' END AS body FROM a LEFT JOIN {batches} b ON b.batch_id = a.batch_id")
def fetch_batches(t):
    asked = t.results().select("batch_id").distinct().union(t.spark.createDataFrame([(-1,)], "batch_id bigint"))
    return read_api.fetch(t.batches().select("batch_id", "status"), asked, "batch_id", "not_found")


@query("B16", "SELECT '{\"batches\":[' || string_agg('{\"batch_id\":' || batch_id || ',\"status\":\"' || status || '\"}', ',' ORDER BY inserted_at DESC, batch_id DESC) || ']}' AS value FROM (SELECT * FROM {batches} ORDER BY inserted_at DESC, batch_id DESC LIMIT 50)")
def recent_document(t):
    recent = t.batches().select("batch_id", "status", "inserted_at")
    return read_api.document(recent, "batches", [F.desc("inserted_at"), F.desc("batch_id")], 50).withColumn("value", F.regexp_replace("value", r',"inserted_at":"[^"]*"', ""))


@query("B13", GATE + ", c AS (SELECT conv_id, k, version, best FROM g WHERE outcome = 'committed'), l AS (SELECT *, lag(best) OVER (PARTITION BY conv_id ORDER BY k) AS prev FROM c) SELECT conv_id, version, prev AS prev_reward, best AS new_reward, best - prev AS delta FROM l")
def commit_audit(t):
    return lineage.audit(_gate(t), "conv_id", "turn")


DOCUMENT = """concat('{"env_key":"k', c_nationkey, '","env_name":"', c_mktsegment, '","config":{"bits_per_dim":', c_nationkey % 4 + 2, CASE WHEN c_custkey % 2 = 0 THEN ',"max_iters":7' ELSE '' END, '}}')"""


@query("A12 I5", "SELECT c_mktsegment AS env_name, CAST(c_nationkey % 4 + 2 AS DOUBLE) AS bits, CAST(CASE WHEN c_custkey % 2 = 0 THEN 7 END AS BIGINT) AS max_iters, concat('b=', c_nationkey % 4 + 2, ' · d=1') AS label, count(*) AS n FROM customer GROUP BY 1, 2, 3, 4")
def experiment_documents(t):
    e = json_commands.experiments(t.customer.select(F.expr(DOCUMENT).alias("value")))
    return e.groupBy("env_name", F.col("config.bits_per_dim").alias("bits"), F.col("config.max_iters").cast("bigint").alias("max_iters"), signature.label(F.col("config_text")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("J14", "WITH l AS (SELECT experiment_id, batch_id FROM (SELECT *, rank() OVER (PARTITION BY experiment_id ORDER BY inserted_at DESC) AS k FROM {batches} WHERE status <> 'completed') WHERE k = 1), m AS (SELECT l.*, d.reward, d.arrived, max(d.arrived) OVER (PARTITION BY experiment_id) AS t FROM l LEFT JOIN " + ONCE + " d ON d.batch_id = l.batch_id), g AS (SELECT experiment_id, count(DISTINCT batch_id) AS batches, count(reward) AS n, sum(reward) AS s, sum(reward * reward) AS q, CAST(count(*) FILTER (arrived >= t - INTERVAL 30 DAY) AS DOUBLE) / 30 AS rate FROM m GROUP BY experiment_id), v AS (SELECT experiment_id, string_agg(batch_id::VARCHAR, ',' ORDER BY n) AS versions FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY inserted_at DESC, batch_id DESC) AS n FROM {batches}) WHERE n <= 5 GROUP BY experiment_id) SELECT g.experiment_id, batches, n, round(s / CASE WHEN n > 0 THEN n END, 6) AS mean, round(CASE WHEN n > 1 THEN sqrt(greatest(q / n - (s / n) * (s / n), 0.0::DOUBLE)) END, 3) AS sd, round(rate, 6) AS rate, versions FROM g JOIN v ON v.experiment_id = g.experiment_id")
def assembled_payload(t):
    p = aggregates.payload(t.batches(), once(t), "experiment_id", 30)
    return p.select("experiment_id", "batches", "n", F.round("mean", 6).alias("mean"), F.round("sd", 3).alias("sd"), F.round("rate", 6).alias("rate"), "versions")
