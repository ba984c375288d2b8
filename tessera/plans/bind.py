"""The test tables under the engine's roles: parquet columns cast once, timestamps to session time (UTC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """t.orders, t.lineitem, ...: lazily read; only what a query uses is scanned."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select(*(F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in df.dtypes))

    def stream(self, name: str) -> DataFrame:
        """The table as a stream."""
        from ..streaming.stateful import table_stream

        return table_stream(self.spark, f"{self.sf_dir}/{name}.parquet")

    def batches(self) -> DataFrame:
        """orders as batches."""
        status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END")
        name = F.expr("concat('exp-', o_custkey, '-part', o_orderkey % 4)")
        return self.orders.select(F.col("o_orderkey").alias("batch_id"), name.alias("name"), F.col("o_orderpriority").alias("env_name"), status.alias("status"), F.col("o_custkey").alias("experiment_id"), F.expr("CAST(substring(o_orderpriority, 1, 1) AS int)").alias("priority"), F.col("o_totalprice").alias("best_reward"), F.col("o_orderdate").alias("inserted_at"))

    def results(self) -> DataFrame:
        """lineitem as chunk deliveries, repeats included."""
        return self.lineitem.select(F.col("l_orderkey").alias("batch_id"), (F.col("l_linenumber") - 1).alias("chunk_index"), F.col("l_extendedprice").alias("reward"), F.col("l_quantity").alias("candidates"), F.col("l_suppkey").alias("worker_id"), F.col("l_partkey").alias("item_id"), F.col("l_shipdate").alias("arrived"))


#: The same roles for the oracle.
DUCK = {
    "batches": "SELECT o_orderkey AS batch_id, concat('exp-', o_custkey, '-part', o_orderkey % 4) AS name, o_orderpriority AS env_name, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status, o_custkey AS experiment_id, CAST(substring(o_orderpriority, 1, 1) AS int) AS priority, o_totalprice AS best_reward, o_orderdate AS inserted_at FROM orders",
    "results": "SELECT l_orderkey AS batch_id, l_linenumber - 1 AS chunk_index, l_extendedprice AS reward, l_quantity AS candidates, l_suppkey AS worker_id, l_partkey AS item_id, l_shipdate AS arrived FROM lineitem",
}
