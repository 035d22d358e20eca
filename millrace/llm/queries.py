"""Queries and oracle SQL of the corpus operators; ``__spark_entry__`` adds them where this subpackage is present."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, dartminhash, decontaminate, fingerprint, language, licenses, quality, toxicity, urlfilter, warczip
from millrace.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(read_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warczip.archive_and_read(read_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: The rules that op6 judges by.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(read_table(spark, sf_dir, "pages"), rules)


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicate_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to
FROM k
"""

_OP6 = r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r
),
rules(rule_host, rule_path, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT u.page_id, u.host, u.path, rule_host || rule_path AS rule, v
  FROM u JOIN rules ON (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path)
),
b AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM m GROUP BY page_id, host, path)
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.v, 'allow') AS verdict
FROM u LEFT JOIN b ON u.page_id = b.page_id AND u.host = b.host AND u.path = b.path
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_zip": _OP3, "op6_url_filter": _OP6}
