"""Queries: streams over whole tables, drained to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import stateful
from .bind import Tables
from .experiments import ISLANDS
from .registry import query

DAY = 86_400
RING = ISLANDS + ", w AS (SELECT *, epoch_us(ts) AS us FROM i), f AS (SELECT *, first_value(value) OVER r AS v0, first_value(us) OVER r AS u0 FROM w WINDOW r AS (PARTITION BY user_id, island ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)) SELECT user_id, event_id, CAST(CASE WHEN us > u0 THEN round((value - v0) * 86400::DOUBLE / ((us - u0) / 1e6)) ELSE 0 END AS BIGINT) AS rate, FALSE AS evicted FROM f"


@query("J5 F4 F2 H4", RING + " UNION ALL SELECT user_id, -1, 0, TRUE FROM events GROUP BY user_id HAVING epoch_ms(max(ts)) + 86400000 <= (SELECT epoch_ms(max(ts)) FROM events)")
def stream_rates(t: Tables):
    """Rates over a day per user, lists begun anew when a value drops; users who were silent for a day are gone."""
    got = stateful.drained(stateful.rates(t.stream("events"), "user_id", "ts", "event_id", "value", DAY, float(DAY), DAY), "rates")
    return got.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "rate", "evicted")


WAIT = 60 * DAY
CHUNKS = "WITH d AS (SELECT l_orderkey AS chunk_id, l_orderkey % 7 + 1 AS total, l_linenumber - 1 AS idx, l_extendedprice AS reward, epoch_us(l_shipdate) AS us FROM lineitem), c AS (SELECT chunk_id, max(total) AS total, min(us) AS first, (SELECT max(us) FROM d) AS now FROM d GROUP BY chunk_id), g AS (SELECT d.chunk_id, d.idx, arg_min(d.reward, (d.us, d.reward)) AS reward FROM d JOIN c ON c.chunk_id = d.chunk_id WHERE d.us <= c.first + 5184000000000 AND d.idx < c.total GROUP BY d.chunk_id, d.idx), n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY chunk_id)"


@query("J2 J4 J3 J13", CHUNKS + " SELECT c.chunk_id, CAST(r.i AS BIGINT) AS idx, g.reward, CASE WHEN g.chunk_id IS NULL THEN 'missing result from oracle' END AS error FROM c LEFT JOIN n ON n.chunk_id = c.chunk_id JOIN range(7) r(i) ON r.i < c.total LEFT JOIN g ON g.chunk_id = c.chunk_id AND g.idx = r.i WHERE coalesce(n.n, 0) = c.total OR (c.first + 5184000000000) // 1000 <= c.now // 1000")
def stream_assembly(t: Tables):
    """Chunks of one to seven items by their own totals, closed after sixty days."""
    rows = t.stream("lineitem").select(F.col("l_orderkey").alias("chunk_id"), (F.col("l_orderkey") % 7 + 1).alias("total"), (F.col("l_linenumber") - 1).alias("idx"), F.col("l_extendedprice").alias("reward"), F.col("l_shipdate").alias("arrived"))
    return stateful.drained(stateful.assembled(rows, WAIT), "assembly").withColumn("idx", F.col("idx").cast("bigint"))
