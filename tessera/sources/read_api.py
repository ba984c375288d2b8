"""What a dashboard asks for, as tables and as lines of JSON; the transport is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch(table: DataFrame, asked: DataFrame, key: str, missing: str) -> DataFrame:
    """A row for each asked key: status 200 and the table's row as JSON, or 404 and an error that names the key."""
    rows = table.select(F.col(key), F.to_json(F.struct("*")).alias("body"))
    error = F.to_json(F.struct(F.lit(missing).alias("error"), F.col(key)))
    return asked.select(key).join(rows, key, "left").select(key, F.when(F.col("body").isNull(), 404).otherwise(200).cast("bigint").alias("status"), F.coalesce("body", error).alias("body"))


def document(table: DataFrame, name: str, order: list, limit: int) -> DataFrame:
    """One row, {name: [rows]}, of the first `limit` rows in order."""
    top = table.orderBy(*order).limit(limit)
    place = F.struct(F.monotonically_increasing_id().alias("_at"), F.struct("*").alias("row"))
    return top.coalesce(1).select(place.alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x")).select(F.to_json(F.struct(F.transform("x", lambda i: i["row"]).alias(name))).alias("value"))


def lookup(rows: DataFrame, /, **key) -> DataFrame:
    """The rows of a key: equalities that reach the scan."""
    for name, value in key.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    return rows


def or_not_found(rows: DataFrame, /, **row) -> DataFrame:
    """What was found, or this row if there is nothing."""
    kinds = dict(rows.dtypes)
    one = rows.sparkSession.range(1).select(*(F.lit(v).cast(kinds[k]).alias(k) for k, v in row.items()))
    there = rows.limit(1).select(F.lit(1).alias("_there"))
    return rows.unionByName(one.withColumn("_there", F.lit(1)).join(there, "_there", "left_anti").select(*rows.columns))
