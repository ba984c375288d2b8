"""A corpus pipeline: each stage works on all rows that the one before it kept.

Stages take nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any name;
what each does with them is what the operator that it calls says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import debruijn_dedup, exact_dedup, langid, packing, simhash
from tessera.llm.common import remove, shared_dir, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those that are null or have no letter go; those without a label get the
    predicted one."""
    return langid.without_rejects(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest id stays; a null id is the smallest, and of repeated
    rows one stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints chain up, the one with the smallest id stays; those without id stay too."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that start earlier in the corpus are cut; no document goes, and null texts stay null."""
    out = debruijn_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; a null text is empty."""
    return packing.pack(docs)


STAGES = [("language ID", identify_language), ("exact dedup", drop_copies), ("SimHash near-dedup", drop_near_copies), ("substring dedup", cut_repeats), ("best-fit packing", pack)]

#: No SQL has the classifier, the fingerprints' hash or the tokenizer: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written as Parquet and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, name.replace(" ", "-"))
        docs = written(stage(spark, docs, sf_dir), name, path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
