"""Queries: chunks, deliveries, groups, boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, lineage, queue, windows
from ..sources import json_commands, read_api
from .bind import Tables
from .registry import query

#: Order in which deliveries count as first: the whole row, so that it is total.
ARRIVAL = ["arrived", "reward", "worker_id", "item_id", "candidates"]
FIRST = "SELECT *, row_number() OVER (PARTITION BY batch_id, chunk_index ORDER BY arrived, reward, worker_id, item_id, candidates) AS rn FROM {results}"
#: Deliveries that count: a chunk that is delivered again is completed already.
ONCE = "(SELECT * EXCLUDE (rn) FROM (" + FIRST + ") WHERE rn = 1)"


def once(t: Tables):
    return queue.first_delivery(t.results(), ["batch_id", "chunk_index"], ARRIVAL)


@query("E1 B2 I2", "WITH n AS (SELECT p_brand AS batch_id, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 10 AS c, p_partkey FROM part) SELECT batch_id, CAST(c AS BIGINT) AS chunk_index, concat(batch_id, '_chunk_', c) AS chunk_id, count(*) AS n, CAST(min(p_partkey) AS BIGINT) AS first_item FROM n GROUP BY batch_id, c")
def chunk_plan(t: Tables):
    c = queue.chunk_plan(t.part, "p_brand", "p_partkey")
    return c.select("batch_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_id", F.size("items").cast("bigint").alias("n"), F.get("items", F.lit(0)).alias("first_item"))


SUBMITTED = "SELECT c_custkey AS batch_id, c_acctbal < -900 AS refused, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal"


@query("B1 E1 I2", "SELECT batch_id, CAST(CASE WHEN refused THEN 0 ELSE (n + 3) // 4 END AS BIGINT) AS chunks, (n + 3) // 4 AS total_chunks, CASE WHEN refused AND n > 0 THEN 'failed' WHEN n = 0 THEN 'completed' ELSE 'pending' END AS status FROM (" + SUBMITTED + ")")
def submit_batches(t: Tables):
    """Customers submit their orders as candidates: the batches' rows, and how many chunks each has."""
    asked = t.customer.select(F.col("c_custkey").alias("batch_id"), (F.col("c_acctbal") < -900).alias("refused"))
    items = t.orders.select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("item"))
    rows, chunks = queue.submit(asked, items, 4)
    n = chunks.groupBy("batch_id").agg(F.count(F.lit(1)).alias("chunks"))
    return rows.join(n, "batch_id", "left").select("batch_id", F.coalesce("chunks", F.lit(0).cast("bigint")).alias("chunks"), "total_chunks", "status")


@query("A5", "SELECT 'batch' AS what, batch_id AS id, status AS found FROM {batches} WHERE batch_id = 7 UNION ALL SELECT 'experiment', c_custkey, c_name FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'policy', c_custkey, concat(c_mktsegment, c_nationkey) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7 UNION ALL SELECT 'batch', -7, 'not_found'")
def point_lookups(t: Tables):
    """Rows by their keys; a key that nothing has is said to be not found."""
    batch = t.batches().select(F.lit("batch").alias("what"), F.col("batch_id").alias("id"), F.col("status").alias("found"))
    owner = t.customer.select(F.lit("experiment").alias("what"), F.col("c_custkey").alias("id"), F.col("c_name").alias("found"))
    policy = t.customer.select(F.lit("policy").alias("what"), F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("found"), "c_mktsegment", "c_nationkey")
    one = read_api.lookup(batch, id=7).unionByName(read_api.lookup(owner, id=7)).unionByName(read_api.lookup(policy, c_mktsegment="BUILDING", c_nationkey=7).drop("c_mktsegment", "c_nationkey"))
    return one.unionByName(read_api.or_not_found(read_api.lookup(batch, id=-7), what="batch", id=-7, found="not_found"))


@query("J2 G3 J3", "SELECT batch_id, count(*) AS n, string_agg(chunk_index::VARCHAR, ',' ORDER BY chunk_index) AS idxs FROM (" + FIRST + ") WHERE rn = 1 GROUP BY batch_id HAVING count(*) >= 4")
def chunk_assemble(t):
    once = queue.first_delivery(t.results(), ["batch_id", "chunk_index"], ARRIVAL).withColumn("idx", F.col("chunk_index"))
    got = queue.assemble(once, 4)
    return got.select("batch_id", "n", F.array_join(F.transform("items", lambda i: i["idx"].cast("string")), ",").alias("idxs"))


@query("J4", "WITH r AS (SELECT DISTINCT batch_id, chunk_index FROM {results}) SELECT k.batch_id, CAST(i AS BIGINT) AS idx, CASE WHEN r.batch_id IS NULL THEN 'missing result from oracle' END AS error FROM {batches} k CROSS JOIN range(7) g(i) LEFT JOIN r ON r.batch_id = k.batch_id AND r.chunk_index = i")
def chunk_padding(t):
    got = t.results().select("batch_id", F.col("chunk_index").alias("idx")).distinct()
    return queue.pad(got, t.batches().select("batch_id"), 7).select("batch_id", F.col("idx").cast("bigint").alias("idx"), "error")


@query("B3 J13", "SELECT batch_id, CAST(chunk_index AS BIGINT) AS chunk_index, reward, worker_id FROM (" + FIRST + ") WHERE rn = 1")
def dedup_first_write(t):
    return queue.first_delivery(t.results(), ["batch_id", "chunk_index"], ARRIVAL).select("batch_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "reward", "worker_id")


@query("E2 B7 I14", "SELECT batch_id, max(reward) AS best, arg_min(reward, item_id) FILTER (chunk_index = 0) AS baseline, count(reward) AS n, round(sum(reward), 2) AS total, round(sum(reward * reward) / 1e6, 2) AS squares_m, epoch_us(max(arrived)) AS last_us FROM " + ONCE + " GROUP BY batch_id")
def score_summary(t):
    s = aggregates.summary(once(t))
    return s.select("batch_id", "best", "baseline", "n", F.round("total", 2).alias("total"), F.round(F.col("squares") / 1e6, 2).alias("squares_m"), F.unix_micros("last_at").alias("last_us"))


@query("E3 C19", "WITH s AS (SELECT batch_id, count(reward) AS n, sum(reward) AS t, sum(reward * reward) AS q FROM " + ONCE + " GROUP BY batch_id) SELECT batch_id, round(t / n / 30, 7) AS mean, round(CASE WHEN n > 1 THEN sqrt(greatest(q / n - (t / n) * (t / n), 0.0::DOUBLE)) END / 30, 4) AS sd FROM s")
def mean_stddev(t):
    s = aggregates.summary(once(t))
    mean, sd = aggregates.mean_sd(F.col("n"), F.col("total"), F.col("squares"))
    return s.select("batch_id", F.round(mean / 30, 7).alias("mean"), F.round(sd / 30, 4).alias("sd"))


@query("A6 B14 C19", "WITH r AS (SELECT batch_id, count(DISTINCT chunk_index) AS done FROM {results} GROUP BY batch_id), p AS (SELECT b.batch_id, coalesce(done, 0) AS done, b.batch_id % 5 AS total FROM {batches} b LEFT JOIN r ON r.batch_id = b.batch_id) SELECT batch_id, CAST(done AS BIGINT) AS done, CAST(total AS BIGINT) AS total, round(CASE WHEN total > 0 THEN CAST(done AS DOUBLE) / total ELSE 1.0::DOUBLE END, 6) AS progress, done >= total AS finished FROM p")
def batch_progress(t):
    done = t.results().groupBy("batch_id").agg(F.countDistinct("chunk_index").alias("done"))
    p = t.batches().select("batch_id", (F.col("batch_id") % 5).alias("total")).join(done, "batch_id", "left").fillna({"done": 0})
    return p.select("batch_id", "done", "total", F.round(aggregates.ratio(F.col("done"), F.col("total")), 6).alias("progress"), (F.col("done") >= F.col("total")).alias("finished"))


@query("A1 G9", "SELECT batch_id, CAST(chunk_index AS BIGINT) AS chunk_index, reward FROM (" + FIRST + ") WHERE rn = 1 AND batch_id = 7 AND chunk_index > 0 ORDER BY chunk_index LIMIT 500")
def keyset_page(t):
    once = queue.first_delivery(t.results().filter("batch_id = 7"), ["batch_id", "chunk_index"], ARRIVAL)
    return queue.page(once, 7, 0, queue.page_size("500")).select("batch_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "reward")


@query("A2 A3 A4 H5 D6 D13", "WITH p AS (SELECT r.* FROM {results} r JOIN {batches} b ON b.batch_id = r.batch_id WHERE b.status = 'completed'), l AS (SELECT r.* FROM {results} r WHERE r.batch_id NOT IN (SELECT batch_id FROM p)), u AS (SELECT * FROM p UNION ALL SELECT * FROM l) SELECT batch_id, CAST(chunk_index AS BIGINT) AS chunk_index, row_number() OVER (PARTITION BY batch_id, chunk_index ORDER BY reward, item_id) - 1 AS pos, reward FROM u")
def batch_reassemble(t):
    chunks = t.results().groupBy("batch_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("reward", "item_id"))).alias("items"))
    done = t.batches().filter("status = 'completed'").select("batch_id")
    rows = queue.reassemble(chunks.join(done, "batch_id", "left_semi"), chunks)
    return rows.select("batch_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("pos").cast("bigint").alias("pos"), "item.reward")


CONTRIBUTED = "SELECT batch_id, worker_id, count(*) AS chunks, CAST(sum(candidates) AS BIGINT) AS candidates, min(arrived) AS first_at, max(arrived) AS last_at FROM " + ONCE + " GROUP BY batch_id, worker_id"


@query("B4", "SELECT batch_id, worker_id, chunks, candidates, epoch_us(first_at) AS first_us, epoch_us(last_at) AS last_us FROM (" + CONTRIBUTED + ")")
def contributions(t):
    return aggregates.contributions(once(t)).select("batch_id", "worker_id", "chunks", "candidates", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


def _named(t):
    names = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("worker_id"), F.col("n_name").alias("display_name"))
    return once(t).join(names, "worker_id")


NAMED = "SELECT c.*, n_name AS display_name FROM " + ONCE + " c JOIN supplier ON s_suppkey = worker_id JOIN nation ON n_nationkey = s_nationkey"


@query("E5", "SELECT display_name, CAST(sum(candidates) AS BIGINT) AS candidates, count(*) AS chunks, count(DISTINCT batch_id) AS batches, epoch_us(max(arrived)) AS last_us FROM (" + NAMED + ") GROUP BY display_name ORDER BY candidates DESC, display_name LIMIT 20")
def leaderboard(t):
    return aggregates.leaderboard(_named(t), "display_name").withColumn("last_us", F.unix_micros("last_at")).drop("last_at")


@query("E6", "SELECT display_name, CAST(sum(candidates) AS BIGINT) AS candidates, count(*) AS chunks, epoch_us(min(arrived)) AS first_us, epoch_us(max(arrived)) AS last_us FROM (" + NAMED + ") WHERE batch_id = 7 GROUP BY display_name")
def batch_contributors(t):
    return _named(t).filter("batch_id = 7").groupBy("display_name").agg(F.sum("candidates").cast("bigint").alias("candidates"), F.count(F.lit(1)).alias("chunks"), F.unix_micros(F.min("arrived")).alias("first_us"), F.unix_micros(F.max("arrived")).alias("last_us"))


@query("E4 C16", "SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'completed') AS completed, round(coalesce(sum(best_reward) FILTER (status = 'failed'), 0.0::DOUBLE), 2) AS failed_sum FROM {batches}")
def status_counts(t):
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return t.batches().agg(n("pending"), n("running"), n("completed"), F.round(F.coalesce(F.sum(F.when(F.col("status") == "failed", F.col("best_reward"))), F.lit(0.0)), 2).alias("failed_sum"))


@query("E4", "SELECT count(*) FILTER (status <> 'completed') AS active, count(*) FILTER (status = 'completed') AS experiments_completed, count(DISTINCT experiment_id) AS submitters FROM {batches}")
def public_status(t):
    return t.batches().agg(F.count_if(F.col("status") != "completed").alias("active"), F.count_if(F.col("status") == "completed").alias("experiments_completed"), F.countDistinct("experiment_id").alias("submitters"))


TRACKED = "SELECT b.*, b.batch_id % 5 AS total_chunks, coalesce(p.n, 0) AS completed_chunks, p.polled_at FROM {batches} b LEFT JOIN (SELECT batch_id, count(DISTINCT chunk_index) AS n, max(arrived) AS polled_at FROM {results} GROUP BY batch_id) p ON p.batch_id = b.batch_id"


def tracked(t):
    """Batches with their chunks, how many are complete, and when one was last fetched."""
    p = t.results().groupBy("batch_id").agg(F.countDistinct("chunk_index").alias("n"), F.max("arrived").alias("polled_at"))
    return t.batches().join(p, "batch_id", "left").withColumns({"total_chunks": (F.col("batch_id") % 5).cast("bigint"), "completed_chunks": F.coalesce("n", F.lit(0).cast("bigint"))}).drop("n")


GROUPS = "SELECT env_name, regexp_replace(name, '-part\\d+$', '') AS grp, count(*) AS parts, bool_and(status = 'completed') AS all_done, max(best_reward) AS best, min(inserted_at) AS first_at, max(inserted_at) AS last_at, CAST(sum(total_chunks) AS BIGINT) AS total_chunks, CAST(sum(completed_chunks) AS BIGINT) AS completed_chunks, max(polled_at) AS polled_at, CAST((array_agg(batch_id ORDER BY inserted_at, batch_id))[1] AS BIGINT) AS first_batch FROM (" + TRACKED + ") GROUP BY env_name, grp"


@query("E7 I1", "SELECT env_name, grp, parts, all_done, best, first_batch, total_chunks, completed_chunks, epoch_us(polled_at) AS polled_us FROM (" + GROUPS + ")")
def logical_groups(t):
    return aggregates.logical_groups(tracked(t)).select("env_name", "grp", "parts", "all_done", "best", "first_batch", "total_chunks", "completed_chunks", F.unix_micros("polled_at").alias("polled_us"))


@query("G5", "SELECT env_name, grp FROM (SELECT *, row_number() OVER (PARTITION BY env_name ORDER BY coalesce(polled_at, TIMESTAMP '1970-01-01') DESC, last_at DESC, grp DESC) AS rn FROM (" + GROUPS + ") WHERE NOT all_done) WHERE rn = 1")
def group_pick(t):
    return aggregates.surfaced(aggregates.logical_groups(tracked(t)).filter("NOT all_done"))


@query("E8", "SELECT env_name, count(*) AS n, max(best) AS best FROM (" + GROUPS + ") WHERE all_done GROUP BY env_name")
def history_per_env(t):
    return aggregates.logical_groups(tracked(t)).filter("all_done").groupBy("env_name").agg(F.count(F.lit(1)).alias("n"), F.max("best").alias("best"))


@query("E9 F6", "SELECT env_name, grp, best FROM (SELECT *, row_number() OVER (PARTITION BY env_name ORDER BY last_at DESC, grp DESC) AS rn FROM (" + GROUPS + ") WHERE all_done) WHERE rn = 1")
def latest_completed(t):
    g = aggregates.logical_groups(tracked(t)).filter("all_done").groupBy("env_name").agg(F.max_by(F.struct("grp", "best"), F.struct("last_at", "grp")).alias("x"))
    return g.select("env_name", "x.grp", "x.best")


@query("E11 H1 D8 E10", "WITH h AS (SELECT env_name, count(*) AS completed FROM {batches} WHERE status = 'completed' GROUP BY env_name), a AS (SELECT env_name, count(*) AS active FROM {batches} WHERE status <> 'completed' GROUP BY env_name), k AS (SELECT env_name FROM h UNION SELECT env_name FROM a) SELECT k.env_name, coalesce(completed, 0) AS completed, coalesce(active, 0) AS active FROM k LEFT JOIN h USING (env_name) LEFT JOIN a USING (env_name)")
def env_stitch(t):
    b = t.batches()
    h = b.filter("status = 'completed'").groupBy("env_name").agg(F.count(F.lit(1)).alias("completed"))
    a = b.filter("status <> 'completed'").groupBy("env_name").agg(F.count(F.lit(1)).alias("active"))
    return aggregates.stitch([h, a], [(h, {"completed": 0}), (a, {"active": 0})], "env_name")


@query("E10", "SELECT env_name, count(*) AS n FROM {batches} GROUP BY env_name")
def env_counts(t):
    return t.batches().groupBy("env_name").agg(F.count(F.lit(1)).alias("n"))


def _jobs(t):
    return t.batches().filter("status = 'pending'").select(F.col("experiment_id").alias("batch_id"), F.col("batch_id").alias("id"), "priority", F.col("inserted_at").alias("scheduled_at"), F.expr("CASE batch_id % 4 WHEN 0 THEN 'mujoco' WHEN 1 THEN 'warp' WHEN 2 THEN 'atari' END").alias("adapter"))


JOBS = "SELECT experiment_id AS batch_id, batch_id AS id, priority, inserted_at AS scheduled_at, CASE batch_id % 4 WHEN 0 THEN 'mujoco' WHEN 1 THEN 'warp' WHEN 2 THEN 'atari' END AS adapter FROM {batches} WHERE status = 'pending'"
RANKED = "SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY scheduled_at, id) AS rn FROM (" + JOBS + ")"


@query("F1 G1 D4", "SELECT id, CAST(rn AS BIGINT) AS rn FROM (" + RANKED + ") ORDER BY priority, rn, id LIMIT 1")
def fair_share_claim(t):
    return queue.claim(_jobs(t)).select("id", F.col("rn").cast("bigint").alias("rn"))


@query("F1", "SELECT id, CAST(rn AS BIGINT) AS rn FROM (" + RANKED + ") ORDER BY priority, rn, id LIMIT 50")
def fair_share_topk(t):
    return queue.claim(_jobs(t), k=50).select("id", F.col("rn").cast("bigint").alias("rn"))


@query("C12 C13 C14", "WITH f AS (SELECT *, coalesce(adapter, 'mujoco') AS ad FROM (" + JOBS + ")), c AS (SELECT *, list_position(['warp', 'mujoco'], ad) AS pref, row_number() OVER (PARTITION BY batch_id ORDER BY scheduled_at, id) AS rn FROM f WHERE ad IN ('warp', 'mujoco')) SELECT id, CAST(pref AS BIGINT) AS pref, CAST(rn AS BIGINT) AS rn FROM c ORDER BY c.pref, c.priority, c.rn, c.id LIMIT 30")
def capability_route(t):
    return queue.claim(_jobs(t), ["warp", "mujoco"], 30).select("id", "pref", F.col("rn").cast("bigint").alias("rn"))


CAPABLE = "CASE s_suppkey % 4 WHEN 0 THEN {l}'warp', 'mujoco'{r} WHEN 1 THEN {l}'atari', 'warp'{r} WHEN 2 THEN {l}'mujoco'{r} ELSE {l}'atari', 'none', 'mujoco', 'warp'{r} END"
CLAIMED = "WITH RECURSIVE f AS (SELECT *, coalesce(adapter, 'mujoco') AS ad FROM (" + JOBS + ")), n AS (SELECT *, row_number() OVER (PARTITION BY ad, batch_id ORDER BY scheduled_at, id) AS rn FROM f), q AS (SELECT id, ad, row_number() OVER (PARTITION BY ad ORDER BY priority, rn, id) AS place FROM n), room AS (SELECT count(*) FILTER (ad = 'warp') AS w, count(*) FILTER (ad = 'mujoco') AS m, count(*) FILTER (ad = 'atari') AS a FROM q), turns AS (SELECT s_suppkey AS worker_id, i AS slot, " + CAPABLE.replace("{l}", "[").replace("{r}", "]") + " AS caps, row_number() OVER (ORDER BY i, s_suppkey) AS turn FROM supplier, range(6) r(i) WHERE i < s_suppkey % 7), s AS (SELECT CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS w, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS worker_id, CAST(0 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS pref, '' AS ad UNION ALL SELECT turn, w + CASE WHEN ad = 'warp' THEN 1 ELSE 0 END, m + CASE WHEN ad = 'mujoco' THEN 1 ELSE 0 END, a + CASE WHEN ad = 'atari' THEN 1 ELSE 0 END, worker_id, slot, list_position(caps, ad), ad FROM (SELECT t.turn, s.w, s.m, s.a, t.worker_id, t.slot, t.caps, list_filter(t.caps, lambda c: CASE c WHEN 'warp' THEN s.w < room.w WHEN 'mujoco' THEN s.m < room.m WHEN 'atari' THEN s.a < room.a ELSE FALSE END)[1] AS ad FROM s JOIN turns t ON t.turn = s.turn + 1, room)) SELECT worker_id, CAST(slot AS BIGINT) AS slot, CAST(pref AS BIGINT) AS pref, q.id FROM s JOIN q ON q.ad = s.ad AND q.place = CASE s.ad WHEN 'warp' THEN s.w WHEN 'mujoco' THEN s.m ELSE s.a END WHERE s.ad IS NOT NULL"


@query("F1 C12 C13 C14 G1", CLAIMED)
def claim_round(t):
    """All workers' slots at once, equal to claiming one by one."""
    workers = t.supplier.select(F.col("s_suppkey").alias("worker_id"), (F.col("s_suppkey") % 7).alias("slots"), F.expr(CAPABLE.replace("{l}", "array(").replace("{r}", ")")).alias("capabilities"))
    got = queue.claim_all(_jobs(t), workers)
    return got.select("worker_id", F.col("slot").cast("bigint").alias("slot"), F.col("pref").cast("bigint").alias("pref"), "id")


@query("C15 D6", "WITH w AS (SELECT worker_id, max(arrived) AS beat FROM {results} GROUP BY worker_id) SELECT CAST(worker_id % 3 AS BIGINT) AS adapter, count(*) AS live FROM w WHERE beat >= TIMESTAMP '2001-08-15' GROUP BY worker_id % 3")
def live_worker(t):
    w = t.results().groupBy("worker_id").agg(F.max("arrived").alias("beat")).filter("beat >= TIMESTAMP '2001-08-15'")
    return w.groupBy((F.col("worker_id") % 3).cast("bigint").alias("adapter")).agg(F.count(F.lit(1)).alias("live"))


@query("B9", "WITH o AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), b AS (SELECT batch_id, CASE WHEN status IN ('pending', 'running') AND experiment_id IN (SELECT c_custkey FROM o) THEN 'cancelled' ELSE status END AS status, status IN ('pending', 'running') AND experiment_id IN (SELECT c_custkey FROM o) AS hit FROM {batches}), j AS (SELECT r.batch_id, CASE WHEN hit AND chunk_index % 2 = 0 THEN 'cancelled' WHEN chunk_index % 2 = 0 THEN 'available' ELSE 'executing' END AS state FROM {results} r JOIN b ON b.batch_id = r.batch_id) SELECT 'batch' AS what, status AS state, count(*) AS n FROM b GROUP BY status UNION ALL SELECT 'job', state, count(*) FROM j GROUP BY state")
def cancel_cascade(t):
    jobs = t.results().select("batch_id", F.expr("CASE WHEN chunk_index % 2 = 0 THEN 'available' ELSE 'executing' END").alias("state")).join(t.batches().select("batch_id"), "batch_id", "left_semi")
    owners = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("experiment_id"))
    b, j = queue.cancel(t.batches(), jobs, owners)
    count = lambda d, c, what: d.groupBy(F.lit(what).alias("what"), F.col(c).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return count(b, "status", "batch").unionByName(count(j, "state", "job"))


@query("B10", "WITH o AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), h AS (SELECT batch_id FROM {batches} WHERE status IN ('pending', 'running') AND experiment_id IN (SELECT c_custkey FROM o)), j AS (SELECT r.batch_id, CASE WHEN r.batch_id IN (SELECT batch_id FROM h) AND chunk_index % 3 < 2 THEN 'cancelled' WHEN chunk_index % 3 = 0 THEN 'available' WHEN chunk_index % 3 = 1 THEN 'executing' ELSE 'completed' END AS state FROM {results} r) SELECT state, count(*) AS n FROM j GROUP BY state")
def cancel_chunks(t):
    jobs = t.results().select("batch_id", F.expr("CASE chunk_index % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'executing' ELSE 'completed' END").alias("state"))
    owners = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("experiment_id"))
    _, j = queue.cancel(t.batches(), jobs, owners, also_executing=True)
    return j.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("B17 J9", "SELECT CASE WHEN status = 'pending' AND inserted_at < TIMESTAMP '2001-07-01' - INTERVAL 180 SECOND THEN 'available' ELSE CASE WHEN status = 'pending' THEN 'executing' ELSE 'completed' END END AS state, count(*) AS n FROM {batches} GROUP BY 1")
def lease_rescue(t):
    jobs = t.batches().select(F.expr("CASE WHEN status = 'pending' THEN 'executing' ELSE 'completed' END").alias("state"), F.col("inserted_at").alias("attempted_at"))
    return queue.rescue(jobs, F.lit("2001-07-01").cast("timestamp")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("D9 E17", "WITH s AS (SELECT batch_id, count(*) FILTER (reward > 50000) AS good, round(sum(reward), 2) AS total FROM {results} GROUP BY batch_id) SELECT b.batch_id, coalesce(good, 0) AS good, coalesce(total, b.best_reward) AS total FROM {batches} b LEFT JOIN s ON s.batch_id = b.batch_id")
def backfill_join(t):
    s = t.results().groupBy("batch_id").agg(F.count_if(F.col("reward") > 50000).alias("good"), F.round(F.sum("reward"), 2).alias("total"))
    return t.batches().join(s, "batch_id", "left").select("batch_id", F.coalesce("good", F.lit(0).cast("bigint")).alias("good"), F.coalesce("total", "best_reward").alias("total"))


@query("D10 C20 F8", "WITH v AS (SELECT experiment_id, inserted_at AS arrived, max(batch_id) AS version FROM {batches} GROUP BY experiment_id, inserted_at), d AS (SELECT r.batch_id, r.chunk_index, r.item_id, r.worker_id, r.arrived, b.experiment_id FROM {results} r JOIN {batches} b ON b.batch_id = r.batch_id) SELECT d.batch_id, CAST(d.chunk_index AS BIGINT) AS chunk_index, d.item_id, d.worker_id, epoch_us(d.arrived) AS at_us, v.version, epoch_us(v.arrived) AS since_us FROM d ASOF LEFT JOIN v ON v.experiment_id = d.experiment_id AND d.arrived >= v.arrived")
def version_in_force(t):
    """Each delivery with the newest batch of its experiment when it arrived."""
    b = t.batches()
    d = t.results().join(b.select("batch_id", "experiment_id"), "batch_id").select("batch_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "item_id", "worker_id", "experiment_id", "arrived")
    got = windows.as_of(d, b.select("experiment_id", F.col("inserted_at").alias("arrived"), F.col("batch_id").alias("version")), "experiment_id", "arrived")
    return got.select("batch_id", "chunk_index", "item_id", "worker_id", F.unix_micros("arrived").alias("at_us"), "version", F.unix_micros("version_arrived").alias("since_us"))


@query("A7", "SELECT batch_id, status, epoch_us(inserted_at) AS at_us FROM {batches} ORDER BY inserted_at DESC, batch_id DESC LIMIT 50")
def recent_batches(t):
    return t.batches().orderBy(F.desc("inserted_at"), F.desc("batch_id")).limit(50).select("batch_id", "status", F.unix_micros("inserted_at").alias("at_us"))


@query("B6", "WITH e AS (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE c_acctbal < -900), s AS (SELECT c.*, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS n, e.c_nationkey IS NOT NULL AS there FROM customer c LEFT JOIN e USING (c_mktsegment, c_nationkey)) SELECT c_custkey AS submission, CASE WHEN NOT there AND n = 1 THEN 'created' ELSE 'existing' END AS tag FROM s")
def policy_upsert(t):
    keys = ["env_name", "config_sig"]
    every = t.customer.select(F.col("c_custkey").alias("submission"), F.col("c_mktsegment").alias("env_name"), F.col("c_nationkey").alias("config_sig"), "c_acctbal")
    found = lineage.find_or_create(every.filter("c_acctbal < -900"), every, keys, ["submission"])
    return found.select("submission", F.when(F.col("created"), "created").otherwise("existing").alias("tag"))


@query("B5 B8", "WITH n AS (SELECT l_suppkey, max(l_shipdate) AS beat FROM lineitem GROUP BY l_suppkey) SELECT s_suppkey AS worker_id, CASE WHEN beat IS NULL THEN 'registered' ELSE 'seen' END AS state, coalesce(epoch_us(beat), 0) AS beat_us FROM supplier LEFT JOIN n ON l_suppkey = s_suppkey UNION ALL SELECT l_suppkey, 'seen', epoch_us(beat) FROM n WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def register_workers(t):
    had = t.supplier.select(F.col("s_suppkey").alias("worker_id"), F.lit("registered").alias("state"), F.lit(0).cast("bigint").alias("beat_us"))
    beats = t.results().select("worker_id", F.lit("seen").alias("state"), F.unix_micros("arrived").alias("beat_us"))
    return lineage.replace_rows(had, beats, ["worker_id"], "beat_us")


@query("L2", "WITH b AS (SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY c_mktsegment) SELECT CASE WHEN n <= 100 THEN name ELSE concat(name, '-part', p.i) END AS name, CAST(p.i * 100 AS BIGINT) AS first, CAST(least(n, (p.i + 1) * 100) AS BIGINT) AS last FROM b, range(100000) p(i) WHERE p.i * 100 < n")
def client_split(t):
    return queue.split_batches(t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), "c_mktsegment", "n", 100)


@query("L12", "WITH m AS (SELECT batch_id, status, CASE batch_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'failed' END AS wish FROM {batches}), x AS (SELECT *, (status = 'pending' AND wish IN ('running', 'failed')) OR (status = 'running' AND wish IN ('completed', 'failed')) AS ok FROM m) SELECT batch_id, CASE WHEN ok THEN wish ELSE status END AS status, CASE WHEN NOT ok AND status <> 'completed' THEN concat(status, ' can''t become ', wish) END AS error FROM x")
def status_moves(t):
    wish = F.expr("CASE batch_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'failed' END")
    status, error = lineage.moves_to(F.col("status"), wish)
    return t.batches().select("batch_id", status.alias("status"), error.alias("error"))


ENVS = "SELECT n_name AS env_name, CAST(n_nationkey % 7 AS INT) AS n_action_dims, -1.0::DOUBLE AS action_low, CAST(n_regionkey AS DOUBLE) AS action_high, CAST(100 * n_nationkey AS INT) AS max_steps FROM nation WHERE n_regionkey > 0"


@query("A11 A9", "WITH e AS (" + ENVS + ") SELECT s_suppkey AS job, n_name AS env_name, CAST(e.n_action_dims AS BIGINT) AS dims, e.action_high AS high, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 7 ELSE e.max_steps END AS BIGINT) AS steps, CASE WHEN e.env_name IS NULL THEN concat('unknown environment ', n_name) END AS error FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN e ON e.env_name = n_name")
def command_environment(t):
    envs = t.nation.filter("n_regionkey > 0").select(F.col("n_name").alias("env_name"), (F.col("n_nationkey") % 7).cast("int").alias("n_action_dims"), F.lit(-1.0).alias("action_low"), F.col("n_regionkey").cast("double").alias("action_high"), (100 * F.col("n_nationkey")).cast("int").alias("max_steps"), F.lit(0.0).alias("success_threshold"))
    jobs = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    fields = F.struct(F.col("s_suppkey").cast("string").alias("job_id"), F.lit("score").alias("cmd"), F.col("n_name").alias("env_name"), F.when(F.col("s_suppkey") % 2 == 0, 7).alias("max_steps"))
    found = json_commands.with_environment(json_commands.commands(jobs.select(F.to_json(fields).alias("value"))), envs)
    return found.select(F.col("job_id").cast("bigint").alias("job"), "env_name", F.col("n_action_dims").cast("bigint").alias("dims"), F.col("action_high").alias("high"), F.col("max_steps").cast("bigint").alias("steps"), "error")


@query("J1", "WITH j AS (SELECT batch_id, CAST(i AS INT) AS chunk_index, CASE WHEN status = 'completed' AND i = 0 THEN 'completed' ELSE 'executing' END AS state FROM {batches}, range(4) r(i) WHERE i < batch_id % 5), d AS (SELECT r.batch_id, CASE WHEN j.state IS NULL THEN 'not_found' WHEN j.state = 'completed' OR rn > 1 THEN 'already_completed' ELSE 'completed' END AS outcome FROM (" + FIRST + ") r LEFT JOIN j ON j.batch_id = r.batch_id AND j.chunk_index = r.chunk_index) SELECT batch_id, outcome, count(*) AS n FROM d GROUP BY batch_id, outcome")
def chunk_completion(t):
    chunk = F.explode(F.expr("sequence(0, CAST(batch_id % 5 AS INT) - 1)"))
    jobs = t.batches().filter("batch_id % 5 > 0").select("batch_id", "status", chunk.alias("chunk_index")).withColumn("state", F.expr("CASE WHEN status = 'completed' AND chunk_index = 0 THEN 'completed' ELSE 'executing' END"))
    return queue.complete(jobs, t.results(), ["batch_id", "chunk_index"], ARRIVAL).groupBy("batch_id", "outcome").agg(F.count(F.lit(1)).alias("n"))
