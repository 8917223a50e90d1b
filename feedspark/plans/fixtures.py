"""Derived views over the given tables, as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    date = F.concat(F.lit("2024-01-"), F.lpad((1 + i * 7 % 28).cast("string"), 2, "0"))
    return table(spark, sf_dir, "documents").select(
        i.alias("id"),
        F.concat(F.lit("http://feed.example.com/"), "source", F.lit("/"), i.cast("string")).alias("url"),
        F.substring("text", 1, 40).alias("title"),
        F.col("source").alias("source_name"),
        F.col("text").alias("raw_text"),
        F.md5("text").alias("raw_hash"),
        F.when(i % 2 == 0, "rss").otherwise("html").alias("source_type"),
        F.concat(F.lit("rule_"), "source").alias("rule_id"),
        date.alias("date"),
        F.when(i % 5 == 0, "").otherwise(F.concat(date, F.lit(" "), F.lpad((i * 3 % 24).cast("string"), 2, "0"), F.lit(":00:00"))).alias("exact_time"),
        (i % 3 == 0).alias("is_read"),
        (i % 7 == 0).alias("is_favorite"),
        (i % 11 == 0).alias("is_deleted"),
    )


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of the articles, every tenth with a changed text."""
    a = articles(spark, sf_dir).where("id % 4 <> 0")
    return a.withColumn("raw_text", F.when(F.col("id") % 10 == 1, F.concat("raw_text", F.lit(" upd"))).otherwise(F.col("raw_text"))).withColumn("raw_hash", F.md5("raw_text"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    a = articles(spark, sf_dir)
    rows = a.select("id", "source_name", (F.col("id") % 2).alias("section"), "url", "title", F.when(F.col("id") % 9 != 0, F.col("date")).alias("dt"))
    w = Window.partitionBy("source_name", "section").orderBy(F.desc("id"))
    return rows.withColumn("position", F.row_number().over(w))


def rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("rule_"), (F.col("user_id") % 20).cast("string")).alias("rule_id"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "empty").otherwise("healthy").alias("status"),
        F.col("ts").alias("checked_at"),
        F.col("event_id").alias("check_id"),
        "user_id",
        "event_type",
        "value",
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    u = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_type").alias("event"),
        "ts",
        u.alias("install_id"),
        F.concat(u, F.lit("-"), F.col("ts").cast("date").cast("string")).alias("session_id"),
        F.concat(F.lit("v1."), (k % 4).cast("string")).alias("app_version"),
        F.when(k % 3 == 0, "darwin").when(k % 3 == 1, "windows").otherwise("linux").alias("platform"),
        F.when(k % 2 == 0, "stable").otherwise("beta").alias("channel"),
        "value",
        "props",
    )


ARTICLES = """articles AS (
  SELECT doc_id AS id, 'http://feed.example.com/' || source || '/' || CAST(doc_id AS VARCHAR) AS url, substr(text, 1, 40) AS title,
    source AS source_name, text AS raw_text, md5(text) AS raw_hash, CASE WHEN doc_id % 2 = 0 THEN 'rss' ELSE 'html' END AS source_type,
    'rule_' || source AS rule_id, '2024-01-' || lpad(CAST(1 + doc_id * 7 % 28 AS VARCHAR), 2, '0') AS date,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE '2024-01-' || lpad(CAST(1 + doc_id * 7 % 28 AS VARCHAR), 2, '0') || ' ' || lpad(CAST(doc_id * 3 % 24 AS VARCHAR), 2, '0') || ':00:00' END AS exact_time,
    doc_id % 3 = 0 AS is_read, doc_id % 7 = 0 AS is_favorite, doc_id % 11 = 0 AS is_deleted
  FROM documents)"""

INCOMING = """incoming AS (
  SELECT * REPLACE (md5(raw_text) AS raw_hash) FROM (
    SELECT * REPLACE (CASE WHEN id % 10 = 1 THEN raw_text || ' upd' ELSE raw_text END AS raw_text) FROM articles WHERE id % 4 <> 0) i)"""

CANDIDATES = """candidates AS (
  SELECT id, source_name, id % 2 AS section, url, title, CASE WHEN id % 9 <> 0 THEN date END AS dt,
    row_number() OVER (PARTITION BY source_name, id % 2 ORDER BY id DESC) AS position FROM articles)"""

CHECKS = """checks AS (
  SELECT 'rule_' || CAST(user_id % 20 AS VARCHAR) AS rule_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'empty' ELSE 'healthy' END AS status,
    ts AS checked_at, event_id AS check_id, user_id, event_type, value FROM events)"""

TELEMETRY = """telemetry AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS event, ts, CAST(user_id AS VARCHAR) AS install_id,
    CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, 'v1.' || CAST(k % 4 AS VARCHAR) AS app_version,
    CASE k % 3 WHEN 0 THEN 'darwin' WHEN 1 THEN 'windows' ELSE 'linux' END AS platform, CASE k % 2 WHEN 0 THEN 'stable' ELSE 'beta' END AS channel, value, props
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) e)"""


def sql(*views: str, then: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + then
