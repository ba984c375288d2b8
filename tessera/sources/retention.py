"""Tables laid out by date: pruned reads, deletion by age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import path_of, written

#: A partition's name, which sorts as its dates do.
MONTH = "yyyy-MM"


def lay_out(rows: DataFrame, path: str, at: str, part: str = "part", unit: str = MONTH, files: int = 1) -> None:
    """Write the rows as Parquet in a folder per month (or other unit) of `at`, each of up to `files` files a run."""
    split = F.pmod(F.xxhash64(*rows.columns), F.lit(files))
    named = rows.withColumn(part, F.date_format(at, unit))
    named.repartition(part, split).write.partitionBy(part).mode("overwrite").parquet(path)


def read_since(spark: SparkSession, path: str, at: str, since: Column, part: str = "part", unit: str = MONTH) -> DataFrame:
    """Rows not before a time, from the folders that can have some: the scan leaves the others out."""
    rows = spark.read.option("inferSchema", "false").schema(_schema(spark, path, part)).parquet(path)
    return rows.filter((F.col(part) >= F.date_format(since, unit)) & (F.col(at) >= since))


def _schema(spark: SparkSession, path: str, part: str):
    found = spark.read.parquet(path).drop(part).schema
    return found.add(part, "string")


def _parts(spark: SparkSession, path: str, part: str) -> dict[str, object]:
    """The folders by their part's name."""
    at, system = path_of(spark, path)
    names = {f.getPath().getName(): f.getPath() for f in system.listStatus(at)}
    return {n.split("=", 1)[1]: p for n, p in names.items() if n.startswith(f"{part}=")}


def prune(spark: SparkSession, path: str, at: str, cutoff: Column, part: str = "part", unit: str = MONTH) -> int:
    """Delete the rows before the cutoff and those without a time: how many folders went or were written anew.

    Folders of earlier dates go without being read.  The cutoff's own folder is read alone, and what stays of it replaces
    it (dynamic overwrite), or it goes too if nothing does.  Running it again changes nothing.
    """
    edge = spark.range(1).select(F.date_format(cutoff, unit)).first()[0]
    parts = _parts(spark, path, part)
    old = [p for name, p in parts.items() if name < edge or name == "__HIVE_DEFAULT_PARTITION__"]
    for p in old:
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if edge not in parts:
        return len(old)
    rows = spark.read.schema(_schema(spark, path, part)).parquet(path).filter(F.col(part) == edge)
    if rows.filter(F.col(at) < cutoff).isEmpty():
        return len(old)
    kept = written(rows.filter(F.col(at) >= cutoff), "kept")
    if kept.isEmpty():
        parts[edge].getFileSystem(spark._jsc.hadoopConfiguration()).delete(parts[edge], True)
    else:
        kept.write.partitionBy(part).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return len(old) + 1
