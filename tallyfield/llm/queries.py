"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, class_lm, decontaminate, language_id, license_scan, merkle, near_dedup, quality, secrets, simhash, simhash_groups, spelling, url_filter
from .common import table
from .oracles import manifest_sql, spelling_sql


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(table(spark, sf_dir, "documents")).drop("node")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_edited(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups.group(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r AS (
  SELECT * FROM (VALUES (1, 'block', 'com', '/en/'), (1, 'allow', 'example.com', '/en/7'), (1, 'allow', 'net', '/de/'),
                        (1, 'block', 'example.net', '/de/8'), (1, 'block', 'org', '/es/'),
                        (2, 'block', 'spam-farm.example.com', ''), (2, 'block', 'spam-farm.example.net', ''),
                        (2, 'block', 'spam-farm.example.org', ''), (2, 'block', 'casino-win.example.com', ''),
                        (2, 'block', 'casino-win.example.net', ''), (2, 'block', 'casino-win.example.org', ''),
                        (2, 'block', 'free-bets.example.com', ''), (2, 'block', 'free-bets.example.net', ''),
                        (2, 'block', 'free-bets.example.org', '')) t(tier, verdict, h, p)
), best AS (
  SELECT s.page_id, s.host, s.path, r.tier, r.verdict, r.h || r.p AS rule,
         row_number() OVER (PARTITION BY s.page_id ORDER BY r.tier, length(r.h) + length(r.p) DESC) AS rn
  FROM s LEFT JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p)
)
SELECT page_id, host, path, CASE WHEN tier = 1 THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict,
       CASE WHEN tier = 2 THEN rule END AS listed
FROM best WHERE rn = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (op1_near_dedup, op2_license_scan, op3_secret_scan, op4_decontamination, op5_url_filter, op6_class_lm, op7_quality, op8_language_id, op9_simhash, op10_bpe)
    return {f.__name__: f for f in (*operators, op11_simhash_dedup, op12_merkle_manifest, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5_SQL, "op12_merkle_manifest": manifest_sql(), "op13_spelling_variants": spelling_sql()}
