"""Queries of event operators with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedspark.operators import events as J
from feedspark.plans.fixtures import TELEMETRY, sql, table, telemetry


def _raw(spark, d):
    t = telemetry(spark, d)
    k = F.col("event_id").cast("long")
    return t.withColumns({"install_id": F.when(k % 11 == 0, "  ").otherwise(F.col("install_id")), "session_id": F.when(k % 13 != 0, F.col("session_id")), "event": F.when(k % 17 == 0, "").otherwise(F.col("event"))})


def j01(spark, d):
    return J.validate_events(_raw(spark, d)).groupBy("missing").agg(F.count("*").alias("n"))


def j02(spark, d):
    t = telemetry(spark, d)
    i = F.col("event_id").cast("long")
    props = F.create_map(
        F.lit("url"), F.concat(F.lit("https://Host"), (i % 5).cast("string"), F.lit(".example.com/x")), F.lit("password"), F.lit("p"), F.lit("source_name"), F.concat(F.lit(" name"), (i % 3).cast("string")),
        F.lit("source_type"), F.when(i % 2 == 0, "rss").otherwise("html"), F.lit("note_x"), F.repeat(F.lit("ab "), 100), F.lit("empty"), F.lit(" "),
    )
    more = F.create_map(F.lit(" note_x"), F.lit("first"), F.lit("list"), F.lit('[" a", "", "b", {"password": "p", "k": " v "}, "1","2","3","4","5","6","7","8","9"]'), F.lit("object"), F.lit('{"token": " t ", "url": "http://h.example.com/a", "password": "p"}'), F.lit("bare"), F.lit('{"password": "p"}'))
    id_ = i.cast("string")
    deep = F.concat(F.lit('{"a":{"password":"x","n":'), id_, F.lit(',"b":[{"API_KEY":"k","c":{"prompt":"p","d":{"html":"h","ok":true,"e":[1,2.5,[],{"note":"n"}]}}}]}}'))
    more = F.map_concat(more, F.create_map(F.lit("deep"), deep))
    props = F.when(i % 3 == 0, F.map_concat(props, more)).otherwise(props)
    out = J.sanitize_props(t.select("event_id", F.when(i % 4 == 0, "error_x").otherwise("e").alias("event"), props.alias("props")))
    return out.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("props"))


def j03(spark, d):
    return J.sample_events(telemetry(spark, d), 0.3, error="error").groupBy("event").agg(F.count("*").alias("n"))


def j04(spark, d):
    u = F.col("c_custkey")
    consent = table(spark, d, "customer").select(u.cast("string").alias("install_id"), (u % 2 == 0).alias("usage_enabled"), (u % 3 != 0).alias("error_enabled"), (u % 5 == 0).alias("killed"))
    return J.consent_filter(telemetry(spark, d), consent, error="error").groupBy("event").agg(F.count("*").alias("n"))


_NOW = "2024-01-20 00:00:00"


def _queue(spark, d):
    i = F.col("event_id")
    status = F.when(i % 3 == 0, "sent").when(i % 3 == 1, "pending").otherwise("failed")
    return table(spark, d, "events").select("event_id", status.alias("status"), F.when(i % 4 != 0, F.col("ts")).alias("next_retry_at"), F.col("ts"), F.col("event_type").alias("event"))


def j05(spark, d):
    return J.queue_stats(_queue(spark, d), F.lit(_NOW).cast("timestamp"))


def j06(spark, d):
    return J.apply_retention(_queue(spark, d), F.lit(_NOW).cast("timestamp"), {"error": 14, "view": 3}, 7, status="status", sent_at="next_retry_at", sent_days=5).groupBy("event").agg(F.count("*").alias("n"))


def j06_clear(spark, d):
    return J.clear_events(_queue(spark, d), ["sent", " "]).groupBy("status").agg(F.count("*").alias("n"))


def j07(spark, d):
    return J.event_report(telemetry(spark, d))


def j08(spark, d):
    return J.top_events(telemetry(spark, d), 3)


def j09(spark, d):
    actions = spark.createDataFrame([("click", "Clicks"), ("purchase", "Purchases"), ("never", "Never")], "event string, label string")
    return J.action_counts(telemetry(spark, d), actions)


def j10(spark, d):
    t = telemetry(spark, d)
    return J.error_counts(t, "error").withColumn("kind", F.lit("error")).unionByName(J.feature_counts(t, "i").withColumn("kind", F.lit("feature")))


def j11(spark, d):
    return J.activity_metrics(telemetry(spark, d), launch="click")


def j12(spark, d):
    return J.retention(telemetry(spark, d)).withColumn("first_day", F.col("first_day").cast("string"))


def j13(spark, d):
    return J.failure_rate_by(telemetry(spark, d), "app_version", "error")


def j14(spark, d):
    return J.rolling_metrics(table(spark, d, "events").select("event_type", "ts", "event_id", "value"), "event_type", ["ts", "event_id"], "value").select("event_id", F.floor(F.col("rolling_mean") * 1000 + 0.500001).alias("rolling_mean_thousandths"), "peak")


def j15(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events")
    runs = e.select(F.when(i % 2 == 0, "rss").otherwise("html").alias("source_type"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), F.when(F.col("event_type") == "error", F.when(i % 3 == 0, "Read timed out").when(i % 3 == 1, "Crash in X").otherwise("boom")).alias("error"), F.col("value").alias("duration"))
    return J.fetch_outcomes(runs).withColumn("mean_duration", F.floor(F.col("mean_duration") * 100 + 0.501))


QUERIES = {
    "j01_validate_events": (
        j01,
        "SELECT concat_ws(',', CASE WHEN event_id % 17 = 0 THEN 'event' END, CASE WHEN event_id % 11 = 0 THEN 'install_id' END, CASE WHEN event_id % 13 = 0 THEN 'session_id' END) AS missing, count(*) AS n FROM events GROUP BY 1",
    ),
    "j02_sanitize_props": (
        j02,
        """SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 3 = 0 THEN 'deep={"a":{"b":[{"c":{"d":{"e":[1,2.5],"ok":true}}}],"n":' || CAST(event_id AS VARCHAR) || '}};' ELSE '' END
|| CASE WHEN event_id % 2 = 0 THEN 'is_custom_source=true;' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN 'list=["a","b",{"k":"v"},"1","2","3","4","5","6","7","8"];' ELSE '' END
|| 'note_x=' || CASE WHEN event_id % 3 = 0 THEN 'first' WHEN event_id % 4 = 0 THEN trim(repeat('ab ', 100)) ELSE trim(substr(repeat('ab ', 100), 1, 240)) || '...' END
|| CASE WHEN event_id % 3 = 0 THEN ';object={"token":"t","urlDomainHash":"' || substr(sha256('h.example.com'), 1, 16) || '"}' ELSE '' END
|| CASE WHEN event_id % 2 = 0 THEN ';sourceNameHash=' || substr(sha256('name' || CAST(event_id % 3 AS VARCHAR)), 1, 16) || ';source_type=rss' ELSE ';source_name=name' || CAST(event_id % 3 AS VARCHAR) || ';source_type=html' END
|| ';urlDomainHash=' || substr(sha256('host' || CAST(event_id % 5 AS VARCHAR) || '.example.com'), 1, 16) AS props FROM events""",
    ),
    "j03_sample_events": (
        j03,
        "SELECT event_type AS event, count(*) AS n FROM events WHERE starts_with(event_type, 'error') OR CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000000 < 300000 GROUP BY 1",
    ),
    "j04_consent_filter": (
        j04,
        "SELECT event_type AS event, count(*) AS n FROM events JOIN customer ON user_id = c_custkey WHERE c_custkey % 5 <> 0 AND CASE WHEN event_type = 'error' THEN c_custkey % 3 <> 0 ELSE c_custkey % 2 = 0 END GROUP BY 1",
    ),
    "j05_queue_stats": (
        j05,
        f"""SELECT count(*) AS total, count(*) FILTER (event_id % 3 = 1) AS pending, count(*) FILTER (event_id % 3 = 2) AS failed, count(*) FILTER (event_id % 3 = 0) AS sent,
count(*) FILTER (event_id % 3 <> 0 AND (event_id % 4 = 0 OR ts <= TIMESTAMP '{_NOW}')) AS ready FROM events""",
    ),
    "j06_apply_retention": (
        j06,
        f"SELECT event_type AS event, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{_NOW}' - to_days(CASE event_type WHEN 'error' THEN 14 WHEN 'view' THEN 3 ELSE 7 END) AND NOT (event_id % 3 = 0 AND event_id % 4 <> 0 AND ts < TIMESTAMP '{_NOW}' - to_days(5)) GROUP BY 1",
    ),
    "j06_clear_events": (j06_clear, "SELECT CASE event_id % 3 WHEN 1 THEN 'pending' ELSE 'failed' END AS status, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1"),
    "j07_event_report": (
        j07,
        sql(
            TELEMETRY,
            """u AS (SELECT 'event' AS dimension, event AS value FROM telemetry UNION ALL SELECT 'platform', CASE platform WHEN 'darwin' THEN 'macOS' WHEN 'windows' THEN 'Windows' ELSE 'Linux' END FROM telemetry
              UNION ALL SELECT 'app_version', app_version FROM telemetry)""",
            then="SELECT dimension, value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY dimension), 2) AS percent FROM u GROUP BY dimension, value",
        ),
    ),
    "j08_top_events": (j08, "SELECT event_type AS event, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INTEGER) AS rank FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
    "j09_action_counts": (j09, "SELECT event_type AS event, CASE event_type WHEN 'click' THEN 'Clicks' ELSE 'Purchases' END AS label, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase', 'never') GROUP BY 1"),
    "j10_error_feature_counts": (
        j10,
        "SELECT event_type AS event, count(*) AS n, 'error' AS kind FROM events WHERE starts_with(event_type, 'error') GROUP BY 1 UNION ALL SELECT event_type, count(*), 'feature' FROM events WHERE contains(event_type, 'i') GROUP BY 1",
    ),
    "j11_activity_metrics": (
        j11,
        sql(
            TELEMETRY, "t AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, strftime(min(ts) OVER (PARTITION BY install_id), '%Y-%m-%d') AS first FROM telemetry)",
            then="""SELECT day, app_version, platform, channel, count(*) FILTER (event = 'click') AS launches, count(DISTINCT install_id) FILTER (first = day) AS installs, count(DISTINCT install_id) AS devices, count(DISTINCT session_id) AS sessions FROM t
GROUP BY GROUPING SETS ((day, app_version, platform, channel), (day, app_version), (day, platform), (day, channel), (day))""",
        ),
    ),
    "j12_retention": (
        j12,
        """WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), f AS (SELECT user_id, min(day) AS first_day FROM a GROUP BY 1), x AS (SELECT *, unnest([1, 7]) AS day_offset FROM f)
SELECT CAST(first_day AS VARCHAR) AS first_day, day_offset, count(*) AS devices, count(a.user_id) AS active, round(count(a.user_id) / count(*), 4) AS rate FROM x LEFT JOIN a ON a.user_id = x.user_id AND a.day = x.first_day + day_offset GROUP BY 1, 2""",
    ),
    "j13_failure_rate": (
        j13,
        sql(
            TELEMETRY, "g AS (SELECT app_version, count(*) AS n, count(*) FILTER (starts_with(event, 'error')) AS errors FROM telemetry GROUP BY 1)",
            then="SELECT app_version, n, errors, round(errors / n, 4) AS rate, round(errors / n - lag(errors / n) OVER (ORDER BY app_version), 4) AS jump FROM g",
        ),
    ),
    "j14_rolling_metrics": (
        j14,
        """SELECT event_id, CAST(floor(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) * 1000 + 0.500001) AS BIGINT) AS rolling_mean_thousandths,
max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM events""",
    ),
    "j15_fetch_outcomes": (
        j15,
        """SELECT CASE WHEN event_id % 2 = 0 THEN 'rss' ELSE 'html' END AS source_type, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
CASE WHEN event_type <> 'error' THEN 'none' WHEN event_id % 3 = 0 THEN 'timeout' WHEN event_id % 3 = 1 THEN 'crash' ELSE 'other' END AS error_code, count(*) AS n, CAST(floor(avg(value) * 100 + 0.501) AS BIGINT) AS mean_duration, max(value) AS max_duration FROM events GROUP BY 1, 2, 3""",
    ),
}
