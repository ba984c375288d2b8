"""Streams end where batches do."""

import time

from pyspark.sql import functions as F

from tessera.operators import aggregates
from tessera.plans.bind import Tables
from tessera.streaming import twins

SF = "/root/testdata/sf0.001"


def drained(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(90), q.stop()
    return df.sparkSession.table(name)


def test_running_summary(spark, tmp_path):
    r = Tables(spark, SF).results()
    r.repartition(3).write.parquet(str(tmp_path / "r"))
    got = drained(twins.running_summary(twins.source(spark, str(tmp_path / "r"), r.schema)), "complete", "summary")
    want = aggregates.summary(r)
    key = lambda d: {(x["batch_id"], x["best"], x["n"], round(x["total"], 2)) for x in d.collect()}
    assert key(got) == key(want)


def test_deliveries(spark, tmp_path):
    r = Tables(spark, SF).results().withColumn("arrived", F.lit("2024-01-01").cast("timestamp"))
    r.unionByName(r).repartition(3).write.parquet(str(tmp_path / "r"))
    got = drained(twins.deliveries(twins.source(spark, str(tmp_path / "r"), r.schema), ["batch_id", "chunk_index"]), "append", "deliveries")
    assert got.count() == r.select("batch_id", "chunk_index").distinct().count()


def test_assembly(spark, tmp_path):
    rows = [("a", 2, 0, 1.0), ("a", 2, 0, 1.0), ("a", 2, 1, 2.0), ("b", 3, 0, 1.0)]
    df = spark.createDataFrame(rows, "chunk_id string, total int, idx int, reward double")
    df.write.parquet(str(tmp_path / "r"))
    # a query with processing-time timeouts is never idle: wait for the row, then stop it
    q = twins.assembled(twins.source(spark, str(tmp_path / "r"), df.schema)).writeStream.outputMode("append").format("memory").queryName("chunks").start()
    until = time.time() + 90
    while not spark.table("chunks").count() and time.time() < until and q.isActive:
        time.sleep(1)
    q.stop()
    assert [tuple(x) for x in spark.table("chunks").collect()] == [("a", 2, 3.0, None)]


def test_sink_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 0, 1.0), (1, 1, 3.0)], "batch_id int, chunk_index int, reward double")
    write = twins.insert_absent_sink(str(tmp_path / "t"), ["batch_id", "chunk_index"], ["reward"])
    write(df, 0)
    write(df, 0)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, 0, 1.0), (1, 1, 3.0)]


def test_windows(spark, tmp_path):
    e = Tables(spark, SF).events
    e.write.parquet(str(tmp_path / "e"))
    stream = twins.source(spark, str(tmp_path / "e"), e.schema)
    got = drained(twins.windowed(stream, "ts", ["event_type"], "1 day"), "complete", "days")
    assert got.agg(F.sum("n")).first()[0] == e.count()


def test_telemetry_and_back_pressure(spark, tmp_path):
    e = Tables(spark, SF).events.limit(300).repartition(3)
    e.write.parquet(str(tmp_path / "e"))
    told = twins.Progress()
    spark.streams.addListener(told)
    try:
        q = twins.source(spark, str(tmp_path / "e"), e.schema, 1).writeStream.format("memory").queryName("told").trigger(availableNow=True).start()
        assert q.awaitTermination(90)
        until = time.time() + 30
        while told.rows < 300 and time.time() < until:
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(told)
    assert told.rows == 300 and told.batches >= 3 and not told.failures  # a file a batch


def test_failing_tick_keeps_the_last(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "k string, v double")
    df.write.parquet(str(tmp_path / "t"))
    stream = twins.source(spark, str(tmp_path / "t"), df.schema).withColumn("v", F.when(F.col("v") < 0, F.raise_error(F.lit("bad tick")).cast("double")).otherwise(F.col("v")))
    q = twins.snapshots(stream.groupBy("k").agg(F.sum("v").alias("v")), "ticks", 0.2)
    want, until = {("a", 3.0), ("b", 3.0)}, time.time() + 90
    while {tuple(r) for r in spark.table("ticks").collect()} != want and time.time() < until:
        time.sleep(0.3)
    spark.createDataFrame([("a", -1.0)], "k string, v double").write.mode("append").parquet(str(tmp_path / "t"))
    while q.isActive and time.time() < until:
        time.sleep(0.3)
    assert "bad tick" in str(q.exception()) and {tuple(r) for r in spark.table("ticks").collect()} == want
