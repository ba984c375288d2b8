"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, debruijn_dedup, ppm, repair, runs, sharding, suffix_dedup
from .ann import nearest
from .exact_dedup import exact_groups
from .langid import identify
from .packing import pack
from .simhash import near_groups
from .warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")), present="present")


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(table(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.with_cycles(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_ppm, op3_bpe, op4_nearest, op5_simhash, op6_exact_dedup, op7_warc, op8_packing, op9_language_id, op10_debruijn_dedup, op11_repair, op12_shards, op13_runs)}

ORACLE_SQL = {
    "op6_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op7_warc": r"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h FROM pages
        ), d AS (
            SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top,
                   row_number() OVER (PARTITION BY h, page_id) AS copy FROM p
        )
        SELECT page_id, n AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(s, CAST(i // 4 * 5 + 1 AS INT), 5) AS INTEGER) >> CAST(15 - i % 4 * 5 AS INT)) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = top AND copy = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = top AND copy = 1 THEN NULL ELSE top END AS refers_to
        FROM d
    """,
    "op10_debruijn_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), p AS (
            SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w
        ), k AS (
            SELECT doc_id, pos, ws[pos] AS word, CASE WHEN pos + 19 <= len(ws) THEN array_to_string(ws[pos:pos + 19], ' ') END AS win FROM p
        ), f AS (
            SELECT doc_id, pos, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS again FROM k
        ), c AS (
            SELECT doc_id, pos, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f
        ), g AS (
            SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
    """,
}
