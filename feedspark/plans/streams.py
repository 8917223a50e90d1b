"""Queries of sources, sinks and streams. Each one writes what it reads into a new folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from feedspark.plans.fixtures import ARTICLES, CHECKS, TELEMETRY, articles, rule_checks, sql, telemetry
from feedspark.sources import io as A
from feedspark.streaming import streams as L


_OWN: dict[str, str] = {}


def folder(spark) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, one on this machine, which only a local master allows."""
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _OWN[context.applicationId] = base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def a01(spark, d):
    return A.read_table(spark, d, "customer", "c_custkey bigint, c_name string, c_mktsegment string").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.max("c_name").alias("last"))


def a02(spark, d):
    path = folder(spark)
    rules = articles(spark, d).groupBy(F.col("source_name").alias("task_name")).agg(F.max("rule_id").alias("rule_id"), F.max("url").alias("url"))
    A.export_rules(rules).select("rules").write.json(f"{path}/a")
    rules.limit(0).write.json(f"{path}/b")
    return A.read_rules(spark, f"{path}/a").select("rule_id", "task_name", "url")


def a03(spark, d):
    path = folder(spark)
    t = telemetry(spark, d).select("event_id", "event", "install_id", F.col("ts").cast("string").alias("ts"))
    bad = F.col("event_id").cast("long") % 10 == 0
    t.select(F.when(bad, F.concat(F.lit("{broken "), "event_id")).otherwise(F.to_json(F.struct("event_id", "event", "install_id", "ts"))).alias("value")).write.text(path)
    return A.read_events_ndjson(spark, path).groupBy(F.col("_corrupt").isNotNull().alias("corrupt"), "event").agg(F.count("*").alias("n"))


def a04(spark, d):
    path = folder(spark)
    t = telemetry(spark, d)
    i = F.col("event_id").cast("long")
    part = F.when(i % 3 == 0, F.lit(" from ")).otherwise(F.lit(" | "))
    one = F.concat(F.lit("- "), "event", part, "platform", part, "app_version")
    total = F.when(i % 100 == 0, F.concat(F.lit("📊 收到 "), "event_id", F.lit(" 条事件"))).otherwise(F.concat(F.lit("server: received "), "event_id", F.lit(" events")))
    lines = t.select(F.when(i % 50 == 0, total).when(i % 7 == 0, F.concat(F.lit("12:00 "), one, F.lit("; "), one)).otherwise(F.concat(F.lit("12:00 "), one)).alias("value"))
    lines.write.text(path)
    return A.read_event_log_text(spark, path).groupBy("event", "platform", "version").agg(F.count("*").alias("n"), F.sum("received").alias("received"))


def a05(spark, d):
    path = folder(spark)
    clean = F.regexp_replace(F.substring("title", 1, 30), "[<&>]", " ")
    entry = F.concat(F.lit("<item><title> "), clean, F.lit("</title><link>"), "url", F.lit("</link><description>"), F.md5("raw_text"), F.lit("</description><pubDate>"), "date", F.lit("</pubDate></item>"))
    feeds = articles(spark, d).groupBy(F.floor(F.col("id") / 500).alias("feed")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(entry), ""), F.lit("</channel></rss>")).alias("value"))
    feeds.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return A.read_feed_entries(spark, path).select("link", "body", "date")


def a06(spark, d):
    path = folder(spark)
    A.write_partitioned_events(telemetry(spark, d).select("event_id", "event", "ts"), path)
    rows = spark.read.schema("event_id string, event string, ts timestamp, event_date string").json(path)
    return rows.groupBy("event_date", "event").agg(F.count("*").alias("n"))


def a07(spark, d):
    rules = articles(spark, d).groupBy("rule_id").agg(F.count("*").alias("n"))
    return A.export_rules(rules, ["rule_src1", "rule_src3", "rule_src5"]).select("rule_count", F.array_join(F.transform("rules", lambda r: r["rule_id"]), ",").alias("ids"))


def a08(spark, d):
    path = folder(spark)
    a = articles(spark, d)
    rows = a.select(F.col("source_name").alias("title"), "url", "source_type", F.lit("c").alias("category"), F.lit("d").alias("department"), F.lit("pdf,doc").alias("attachment_types"), F.when(F.col("id") % 8 == 3, "unknown").when(F.col("id") % 8 == 5, F.col("date")).otherwise(F.col("exact_time")).alias("exact_time"))
    A.write_time_report_csv(rows, path)
    return A.read_heat_csv(spark, path).select("url", "attachment_types", F.date_format("exact_time", "yyyy-MM-dd HH:mm:ss").alias("exact_time"))


def a09(spark, d):
    path = folder(spark)
    a = articles(spark, d)
    stamp = F.when(F.col("id") % 8 == 3, "soon").when(F.col("id") % 8 == 5, F.col("date")).otherwise(F.concat("date", F.lit(" 06:07:08")))
    a.select("url", stamp.alias("seen")).write.option("header", True).csv(path)
    rows = A.read_heat_csv(spark, path, "seen")
    return rows.groupBy(F.date_format("seen", "yyyy-MM-dd HH:mm:ss").alias("seen")).agg(F.count("*").alias("n"), F.max("url").alias("last_url"))


def a10(spark, d):
    old = articles(spark, d).select("id", "raw_text", F.when(F.col("id") % 4 == 0, "").otherwise(F.col("title")).alias("summary"))
    target = {"id": "long", "raw_text": "string", "summary": "string", "raw_markdown": "string", "enhanced_markdown": "string", "is_read": "boolean"}
    fill = {"raw_markdown": F.col("raw_text"), "enhanced_markdown": F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("raw_text"))}
    out = A.apply_schema_evolution(old, target, {"is_read": F.lit(False), "raw_markdown": F.lit(""), "enhanced_markdown": F.lit("")}, fill)
    return out.select("id", "is_read", F.md5("raw_markdown").alias("raw_md5"), F.md5("enhanced_markdown").alias("enhanced_md5"))


def _written(spark, rows, files: int = 4):
    path = folder(spark)
    rows.repartition(files).write.parquet(path)
    return path, L.stream_events(spark, path, rows.schema, files=2)


def _out(spark, stream):
    return L.run_to_table(stream, folder(spark), folder(spark))


def l01(spark, d):
    props = F.create_map(F.lit("password"), F.lit("p"), F.lit("user"), F.concat(F.lit(" "), "install_id"), F.lit("more"), F.lit('{"a":[{"b":{"password":"x","n":1}}]}'))
    t = telemetry(spark, d).withColumn("session_id", F.when(F.col("event_id").cast("long") % 13 != 0, F.col("session_id"))).withColumn("props", props)
    _, s = _written(spark, t)
    out = _out(spark, L.stream_valid(s).select("event", F.map_keys("props").alias("keys"), F.col("props")["user"].alias("user"), F.col("props")["more"].alias("more")))
    return out.groupBy("event", F.array_join("keys", ",").alias("keys"), "more").agg(F.count("*").alias("n"), F.max("user").alias("last_user"))


def l02(spark, d):
    t = telemetry(spark, d).select("event_id", "event", "ts")
    _, s = _written(spark, t.unionByName(t.where("cast(event_id as long) % 3 = 0")))
    return _out(spark, L.stream_dedup(s, "400 days")).groupBy("event").agg(F.count("*").alias("n"))


def _flushed(spark, rows, flush):
    """A stream of the rows, and behind them in a later file one row that moves the watermark past them all."""
    path = folder(spark)
    rows.write.parquet(path)
    flush.write.mode("append").parquet(path)
    return L.stream_events(spark, path, rows.schema, files=10_000)


def _late(rows, **names):
    late = rows.agg(F.max("ts").alias("ts")).select(*(F.lit(v).alias(k) for k, v in names.items()), (F.col("ts") + F.expr("interval 500 days")).alias("ts"))
    return late.select(rows.columns)


def l03(spark, d):
    t = telemetry(spark, d).select("event", "ts")
    out = _out(spark, L.stream_counts(_flushed(spark, t, _late(t, event="flush")), "1 day", "400 days"))
    return out.where("event <> 'flush'").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event", "n")


def l04(spark, d):
    rate = F.when(F.col("check_id") % 5 == 0, 0.0).when(F.col("check_id") % 3 == 0, 0.4).otherwise(0.9)
    c = rule_checks(spark, d).select("rule_id", "status", "checked_at", "check_id", rate.alias("hit_rate"))
    path, out, state = folder(spark), folder(spark), folder(spark)
    at = F.unix_micros(F.col("checked_at").cast("timestamp"))
    # one number for both runs: the approximate median depends on the order in which partitions are put together
    half = c.agg(F.percentile_approx(at, 0.5)).head()[0]
    early = F.coalesce(at <= F.lit(half), F.lit(False))
    for part in (c.where(early), c.where(~early)):  # the second run goes on from the state that the first left
        part.write.mode("append").parquet(path)
        done = L.run_to_table(L.stream_health(L.stream_events(spark, path, c.schema, files=10_000)), out, state)
    return done.select("check_id", "consecutive_failures", "consecutive_empties", "is_alerting", "drifted")


def l05(spark, d):
    """Each section's older rows first; then all of them, of which those above the frontier are new."""
    a = articles(spark, d).withColumns({"section": (F.col("id") % 2).cast("string"), "dt": F.when(F.col("id") % 9 != 0, F.col("date"))})
    last = a.agg(F.max("id").alias("last"))
    rows = a.join(last).select("id", "source_name", "section", (F.col("last") - F.col("id") + 1).alias("position"), "url", "title", "dt", "last")
    details = a.select("url", F.concat("date", F.lit(" 00:00:00")).alias("detail_dt"))
    cutoffs = a.select("source_name").distinct().select("source_name", F.lit("2000-01-01 00:00:00").alias("cutoff"), F.lit(0).alias("repair_window"))
    path, store, state = folder(spark), folder(spark), folder(spark)
    for part in (rows.where("3 * id <= 2 * last"), rows):
        part.drop("last").write.mode("append").parquet(path)
        L.stream_admission(L.stream_events(spark, path, L.CANDIDATE, files=10_000), store, state, details, cutoffs).start().awaitTermination()
    stored = L.stored_articles(spark, store).select("id", "url", "effective_dt", "batch")
    ends = L.stored_frontiers(spark, store).select(F.col("url").alias("url"), F.lit(True).alias("is_frontier"))
    return stored.join(ends, "url", "left").withColumn("is_frontier", F.coalesce("is_frontier", F.lit(False)))


def l06(spark, d):
    t = telemetry(spark, d).select("install_id", "event", "ts")
    out = _out(spark, L.stream_sessions(_flushed(spark, t, _late(t, install_id="flush", event="flush")), "6 hours", "400 days"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.where("install_id <> 'flush'").select("install_id", stamp("start"), stamp("end"), "n")


_STREAK = """st AS (SELECT *, sum(CASE WHEN status <> 'error' THEN 1 ELSE 0 END) OVER w AS ge, sum(CASE WHEN status <> 'empty' THEN 1 ELSE 0 END) OVER w AS gm FROM checks WINDOW w AS (PARTITION BY rule_id ORDER BY checked_at, check_id ROWS UNBOUNDED PRECEDING)),
su AS (SELECT *, sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY rule_id, ge ORDER BY checked_at, check_id ROWS UNBOUNDED PRECEDING) AS cf, sum(CASE WHEN status = 'empty' THEN 1 ELSE 0 END) OVER (PARTITION BY rule_id, gm ORDER BY checked_at, check_id ROWS UNBOUNDED PRECEDING) AS cm FROM st)"""

QUERIES = {
    "a01_read_table": (a01, "SELECT c_mktsegment, count(*) AS n, max(c_name) AS last FROM customer GROUP BY 1"),
    "a02_read_rules": (a02, sql(ARTICLES, then="SELECT max(rule_id) AS rule_id, source_name AS task_name, max(url) AS url FROM articles GROUP BY source_name")),
    "a03_read_events_ndjson": (a03, "SELECT event_id % 10 = 0 AS corrupt, CASE WHEN event_id % 10 <> 0 THEN event_type END AS event, count(*) AS n FROM events GROUP BY 1, 2"),
    "a04_read_event_log": (
        a04,
        sql(
            TELEMETRY,
            then="""SELECT event, platform, app_version AS version, CAST(sum(CASE WHEN CAST(event_id AS BIGINT) % 7 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n, NULL::BIGINT AS received FROM telemetry WHERE CAST(event_id AS BIGINT) % 50 <> 0 GROUP BY 1, 2, 3
UNION ALL SELECT '', '', '', count(*), CAST(sum(CAST(event_id AS BIGINT)) AS BIGINT) FROM telemetry WHERE CAST(event_id AS BIGINT) % 50 = 0""",
        ),
    ),
    "a05_read_feed_entries": (a05, sql(ARTICLES, then="SELECT url AS link, md5(raw_text) AS body, date FROM articles")),
    "a06_write_partitioned_events": (a06, "SELECT strftime(ts, '%Y-%m-%d') AS event_date, event_type AS event, count(*) AS n FROM events GROUP BY 1, 2"),
    "a07_export_rules": (a07, "SELECT count(DISTINCT source) AS rule_count, string_agg(DISTINCT 'rule_' || source, ',' ORDER BY 'rule_' || source) AS ids FROM documents WHERE source IN ('src1', 'src3', 'src5')"),
    "a08_time_report_csv": (
        a08,
        sql(
            ARTICLES, "x AS (SELECT url, CASE WHEN id % 8 = 3 THEN NULL WHEN id % 8 = 5 THEN date || ' 00:00:00' ELSE nullif(exact_time, '') END AS exact_time FROM articles)",
            then="SELECT url, 'pdf,doc' AS attachment_types, exact_time FROM x WHERE exact_time IS NOT NULL",
        ),
    ),
    "a09_read_heat_csv": (
        a09,
        sql(ARTICLES, then="SELECT date || CASE WHEN id % 8 = 5 THEN ' 00:00:00' ELSE ' 06:07:08' END AS seen, count(*) AS n, max(url) AS last_url FROM articles WHERE id % 8 <> 3 GROUP BY 1"),
    ),
    "a10_schema_evolution": (a10, sql(ARTICLES, then="SELECT id, false AS is_read, md5(raw_text) AS raw_md5, md5(CASE WHEN id % 4 = 0 OR title = '' THEN raw_text ELSE title END) AS enhanced_md5 FROM articles")),
    "l01_stream_events": (l01, "SELECT event_type AS event, 'more,user' AS keys, '{\"a\":[{\"b\":{\"n\":1}}]}' AS more, count(*) AS n, max(CAST(user_id AS VARCHAR)) AS last_user FROM events WHERE event_id % 13 <> 0 GROUP BY 1"),
    "l02_stream_dedup": (l02, "SELECT event_type AS event, count(*) AS n FROM events GROUP BY 1"),
    "l03_stream_counts": (l03, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS event, count(*) AS n FROM events GROUP BY 1, 2"),
    "l04_stream_health": (
        l04,
        sql(
            CHECKS, _STREAK,
            "d AS (SELECT *, CASE WHEN check_id % 5 = 0 THEN 0.0 WHEN check_id % 3 = 0 THEN 0.4 ELSE 0.9 END AS r, row_number() OVER (PARTITION BY rule_id ORDER BY checked_at, check_id) AS k FROM checks WHERE status = 'healthy')",
            "e AS (SELECT *, min(CASE WHEN r = 0.9 THEN k END) OVER (PARTITION BY rule_id) AS good FROM d)",
            then="SELECT su.check_id, cf AS consecutive_failures, cm AS consecutive_empties, cf >= 2 OR cm >= 3 AS is_alerting, coalesce(k > good AND r < 0.9, false) AS drifted FROM su LEFT JOIN e USING (check_id)",
        ),
    ),
    "l05_stream_admission": (
        l05,
        sql(
            ARTICLES,
            then="""SELECT id, url, date || ' 00:00:00' AS effective_dt, CASE WHEN 3 * id <= 2 * (SELECT max(id) FROM articles) THEN 0 ELSE 1 END AS batch,
id = max(id) OVER (PARTITION BY source_name, id % 2) AS is_frontier FROM articles""",
        ),
    ),
    "l06_stream_sessions": (
        l06,
        """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT CAST(user_id AS VARCHAR) AS install_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    ),
}
