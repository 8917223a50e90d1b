"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = (
    "rule_id string, task_id string, task_name string, task_purpose string, url string, source_type string, enabled boolean, list_container string, item_selector string, "
    "field_selectors map<string,string>, request_headers map<string,string>, max_items int"
)
EVENT = "event_id string, event string, install_id string, session_id string, app_version string, channel string, platform string, ts string, props map<string,string>, _corrupt string"
ENTRY = "title string, link string, summary string, description string, content string, encoded string, updated string, published string, pubDate string, date string"


def read_table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """Stored records; with a declared schema only its columns are read."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{folder}/{name}.parquet")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of JSON files that hold either a list or an object with `rules`."""
    listed = f"rules array<struct<{', '.join(x.replace(' ', ':', 1) for x in RULE.split(', '))}>>, {RULE}"
    rows = spark.read.option("multiLine", True).schema(listed).json(path)
    own = F.struct(*(F.col(x.split()[0]) for x in RULE.split(", ")))
    return rows.select(F.explode(F.coalesce("rules", F.array(own))).alias("r")).select("r.*").where("rule_id is not null")


def read_events_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One row per line; a line that is no event keeps its text in `_corrupt`."""
    return spark.read.schema(EVENT).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_event_log_text(spark: SparkSession, path: str) -> DataFrame:
    """event, platform, version of every `- event | platform | version` or `- event from platform from version` of a line, and
    received, the number of every `received N` or `收到 N`; a row has either."""
    each = lambda pattern, n: F.regexp_extract_all("value", F.lit(pattern), F.lit(n))
    event = r"(?U)-\s*([\w.]+)\s*(?:\bfrom\b|\|)\s*(\w+)\s*(?:\bfrom\b|\|)\s*([\w.]+)"
    none = F.lit(None)
    events = F.transform(F.arrays_zip(each(event, 1).alias("e"), each(event, 2).alias("p"), each(event, 3).alias("v")), lambda x: F.struct(x["e"].alias("event"), x["p"].alias("platform"), x["v"].alias("version"), none.cast("long").alias("received")))
    empty = [F.lit("").alias(x) for x in ("event", "platform", "version")]
    totals = F.transform(each(r"(?i)(?:received|收到)\s*(\d+)", 1), lambda x: F.struct(*empty, x.cast("long").alias("received")))
    return spark.read.text(path).select(F.explode(F.concat(events, totals)).alias("x")).select("x.*")


def read_feed_entries(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """title, link, body, date of every entry of RSS (item) or Atom (entry) files: the first filled body and date."""
    atom = row_tag == "entry"  # there a link is an attribute
    schema = ENTRY.replace("link string", "link struct<_href:string>") if atom else ENTRY
    rows = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(schema).load(path)
    first = lambda *cs: F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cs))
    return rows.select(F.trim("title").alias("title"), F.trim("link._href" if atom else "link").alias("link"), first("content", "encoded", "summary", "description").alias("body"), first("published", "updated", "pubDate", "date").alias("date"))


def write_partitioned_events(events: DataFrame, path: str, ts: str = "ts", form: str = "json") -> None:
    """Daily folders; rows of a day are gathered first, spread over the day's hours, so that a busy day isn't one task."""
    rows = events.withColumn("event_date", F.date_format(ts, "yyyy-MM-dd"))
    rows.repartition("event_date", F.hour(ts)).write.mode("append").partitionBy("event_date").format(form).save(path)


def export_rules(rules: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """One row: rule_count and the rules (all if ids is None), an envelope to be written as JSON. Rules are configuration, a
    few thousand rows at most."""
    kept = rules if ids is None else rules.where(F.col("rule_id").isin(ids))
    return kept.agg(F.count("*").alias("rule_count"), F.array_sort(F.collect_list(F.struct("rule_id", *(c for c in rules.columns if c != "rule_id")))).alias("rules"))


def write_time_report_csv(rows: DataFrame, path: str) -> None:
    columns = ["title", "url", "category", "department", "attachment_types", "exact_time"]
    rows.select(columns).write.mode("overwrite").option("header", True).csv(path)


def read_heat_csv(spark: SparkSession, path: str, ts: str = "exact_time") -> DataFrame:
    """A CSV of publication times; rows whose time can't be read are dropped."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumn(ts, F.coalesce(F.try_to_timestamp(ts, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(ts, F.lit("yyyy-MM-dd")))).dropna(subset=[ts])


def apply_schema_evolution(rows: DataFrame, target: dict[str, str], defaults: dict[str, Column], backfill: dict[str, Column]) -> DataFrame:
    """rows in the target's columns and types: missing ones get their default, then empty ones their backfill."""
    out = rows.withColumns({c: defaults.get(c, F.lit(None)) for c in target if c not in rows.columns})
    out = out.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), v) for c, v in backfill.items()})
    return out.select(*(F.col(c).cast(t).alias(c) for c, t in target.items()))
