"""Queries of time operators with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedspark.operators import times as D
from feedspark.plans.fixtures import ARTICLES, articles, sql, table

MIXED = """mixed AS (SELECT id, date, exact_time, CASE id % 6 WHEN 0 THEN replace(date, '-', '/') WHEN 1 THEN '2024年' || CAST(1 + id % 12 AS VARCHAR) || '月' || CAST(1 + id % 28 AS VARCHAR) || '日' WHEN 2 THEN date WHEN 3 THEN ''
    WHEN 4 THEN CAST(1 + id % 28 AS VARCHAR) || '/' || CAST(1 + id % 12 AS VARCHAR) || '/2023' ELSE 'Mar ' || CAST(1 + id % 28 AS VARCHAR) || ', 2022' END AS d,
  CASE WHEN id % 4 = 0 THEN replace(exact_time, '-', '/') WHEN id % 4 = 1 THEN substr(exact_time, 1, 16) WHEN id % 4 = 2 THEN date ELSE exact_time END AS x FROM articles)"""


def mixed(spark, d):
    i = F.col("id")
    n = lambda m: (1 + i % m).cast("string")
    text = F.when(i % 6 == 0, F.replace("date", F.lit("-"), F.lit("/"))).when(i % 6 == 1, F.concat(F.lit("2024年"), n(12), F.lit("月"), n(28), F.lit("日"))).when(i % 6 == 2, F.col("date")).when(i % 6 == 3, "")
    text = text.when(i % 6 == 4, F.concat(n(28), F.lit("/"), n(12), F.lit("/2023"))).otherwise(F.concat(F.lit("Mar "), n(28), F.lit(", 2022")))
    exact = F.when(i % 4 == 0, F.replace("exact_time", F.lit("-"), F.lit("/"))).when(i % 4 == 1, F.substring("exact_time", 1, 16)).when(i % 4 == 2, F.col("date")).otherwise(F.col("exact_time"))
    return articles(spark, d).select("id", "date", "exact_time", text.alias("d"), exact.alias("x"))


def d01(spark, d):
    return D.normalize_times(mixed(spark, d), "d", "x").select("id", "norm_date", "norm_time", "time_status")


def d02(spark, d):
    return D.backfill_times(mixed(spark, d), "d", "x").select("id", "d", "x", *(F.col(f"did_{s}").cast("int").alias(s) for s in D.STEPS))


def d02_report(spark, d):
    return D.backfill_report(D.backfill_times(mixed(spark, d), "d", "x"))


def d03(spark, d):
    return D.parse_mixed_dates(mixed(spark, d), "d").select("id", F.col("parsed_date").cast("string").alias("parsed_date"))


def d04(spark, d):
    rows = mixed(spark, d).withColumn("t", F.concat(F.lit("on "), F.when(F.col("id") % 6 == 4, F.concat((1 + F.col("id") % 12).cast("string"), F.lit("/"), (1 + F.col("id") % 28).cast("string"))).otherwise(F.col("d"))))
    return D.extract_dates_from_text(rows, "t", 2021).select("id", "found_date")


def _dated_pages(spark, d):
    i = F.col("page_id")
    day = F.concat(F.lit("2024-03-"), F.lpad((1 + i % 28).cast("string"), 2, "0"))
    extra = F.when(i % 5 == 0, F.concat(F.lit('<meta name="PubDate" content="'), day, F.lit('">'))).when(i % 5 == 1, F.concat(F.lit('<p class="info-bar">at '), day, F.lit("</p>"))).when(i % 5 == 2, F.concat(F.lit("<p>Published: "), day, F.lit("</p>"))).when(i % 5 == 3, F.concat(F.lit("<script>var ct = "), (1_700_000_000 + i * 60).cast("string"), F.lit(";</script>"))).otherwise("")
    return table(spark, d, "pages").select("page_id", F.concat(extra, "html").alias("html"))


def d05(spark, d):
    return D.page_publish_time(_dated_pages(spark, d)).select("page_id", "published")


def d06(spark, d):
    return D.time_heatmap(table(spark, d, "events"), "ts")


def d07(spark, d):
    i = F.col("id")
    a = articles(spark, d)
    links = a.select("id", F.explode(F.array(F.concat(F.lit("http://x/a."), F.when(i % 3 == 0, "pdf").otherwise("DOC")), F.concat(F.lit("http://x/b."), F.when(i % 2 == 0, "zip?x=1").otherwise("pdf#p")), F.lit("http://x/none"))).alias("url")).where("id % 7 <> 0")
    return D.attachment_types_report(links, a, "id", ["source_name", "exact_time"])


_PLAIN = lambda c: f"trim(regexp_replace(replace(translate(trim(coalesce({c}, '')), '年月/', '---'), '日', ' '), '\\s+', ' ', 'g'))"
_PAD = lambda c: f"regexp_extract({c}, '^(\\d{{4}})-(\\d{{1,2}})-(\\d{{1,2}})', 1) || '-' || lpad(regexp_extract({c}, '^(\\d{{4}})-(\\d{{1,2}})-(\\d{{1,2}})', 2), 2, '0') || '-' || lpad(regexp_extract({c}, '^(\\d{{4}})-(\\d{{1,2}})-(\\d{{1,2}})', 3), 2, '0')"
_DATE = lambda c: f"CASE WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN {_PAD(c)} ELSE '' END"
_D02 = sql(
    ARTICLES, MIXED,
    "s1 AS (SELECT id, d AS d0, coalesce(x, '') AS x0, CASE WHEN contains(d, '年') THEN replace(replace(replace(d, '年', '-'), '月', '-'), '日', '') ELSE d END AS q FROM mixed)",
    f"s2 AS (SELECT *, CASE WHEN contains(d0, '年') THEN {_DATE('q')} ELSE d0 END AS d1 FROM s1)",
    f"s3 AS (SELECT *, CASE WHEN ({_DATE('replace(d1, chr(47), chr(45))')}) <> '' THEN ({_DATE('replace(d1, chr(47), chr(45))')}) ELSE replace(d1, '/', '-') END AS d2 FROM s2)",
    "s4 AS (SELECT *, CASE WHEN d2 = '' AND regexp_matches(x0, '^\\d{4}-\\d{2}-\\d{2}') THEN substr(x0, 1, 10) ELSE d2 END AS d3, replace(x0, '/', '-') AS x1 FROM s3)",
    "s5 AS (SELECT *, CASE WHEN regexp_matches(x1, '^\\d{4}-\\d{2}-\\d{2}$') THEN x1 || ' 00:00:00' ELSE x1 END AS x2 FROM s4)",
    then="""SELECT id, d3 AS d, x2 AS x, CAST(d1 <> d0 AS INTEGER) AS cjk_date, CAST(d2 <> d1 AS INTEGER) AS slash_date, CAST(d3 <> d2 AS INTEGER) AS date_from_time, 0 AS cjk_time, CAST(x1 <> x0 AS INTEGER) AS slash_time, CAST(x2 <> x1 AS INTEGER) AS completed FROM s5""",
)

QUERIES = {
    "d01_normalize_times": (
        d01,
        sql(
            ARTICLES, MIXED,
            f"p AS (SELECT id, x AS raw, {_PLAIN('x')} AS px, {_PLAIN('d')} AS pd FROM mixed)",
            f"q AS (SELECT *, {_DATE('px')} AS dx, {_DATE('pd')} AS dd, regexp_extract(px, '^\\S+ (\\d{{2}}):(\\d{{2}})', 1) AS h, regexp_extract(px, '^\\S+ (\\d{{2}}):(\\d{{2}})', 2) AS m FROM p)",
            then="""SELECT id, CASE WHEN dd <> '' THEN dd ELSE dx END AS norm_date, CASE WHEN coalesce(nullif(dx, ''), dd) = '' THEN trim(raw) WHEN h <> '' THEN coalesce(nullif(dx, ''), dd) || ' ' || h || ':' || m || ':00' ELSE coalesce(nullif(dx, ''), dd) || ' 00:00:00' END AS norm_time,
CASE WHEN coalesce(nullif(dx, ''), dd) = '' THEN 'as_is' WHEN h <> '' THEN 'parsed' ELSE 'defaulted' END AS time_status FROM q""",
        ),
    ),
    "d02_backfill_times": (d02, _D02),
    "d02_backfill_report": (d02_report, f"SELECT sum(cjk_date) AS cjk_date, sum(slash_date) AS slash_date, sum(date_from_time) AS date_from_time, sum(cjk_time) AS cjk_time, sum(slash_time) AS slash_time, sum(completed) AS completed FROM ({_D02}) b"),
    "d03_parse_mixed_dates": (
        d03,
        sql(
            ARTICLES, MIXED,
            then="""SELECT id, CAST(CASE id % 6 WHEN 0 THEN CAST(date AS DATE) WHEN 1 THEN make_date(2024, 1 + id % 12, 1 + id % 28) WHEN 2 THEN CAST(date AS DATE) WHEN 4 THEN
CASE WHEN 1 + id % 28 > 12 THEN make_date(2023, 1 + id % 12, 1 + id % 28) ELSE make_date(2023, 1 + id % 28, 1 + id % 12) END WHEN 5 THEN make_date(2022, 3, 1 + id % 28) END AS VARCHAR) AS parsed_date FROM mixed""",
        ),
    ),
    "d04_extract_dates": (
        d04,
        sql(
            ARTICLES, MIXED,
            then="""SELECT id, CASE id % 6 WHEN 0 THEN date WHEN 1 THEN '2024-' || lpad(CAST(1 + id % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + id % 28 AS VARCHAR), 2, '0') WHEN 2 THEN date WHEN 3 THEN 'on'
WHEN 4 THEN '2021-' || lpad(CAST(1 + id % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + id % 28 AS VARCHAR), 2, '0') ELSE 'on ' || d END AS found_date FROM mixed""",
        ),
    ),
    "d05_page_publish_time": (
        d05,
        """SELECT page_id, CASE WHEN page_id % 5 < 3 THEN '2024-03-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') WHEN page_id % 5 = 3 THEN strftime(make_timestamp(CAST((1700000000 + page_id * 60) * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS published FROM pages""",
    ),
    "d06_time_heatmap": (
        d06,
        """SELECT h AS hour, b AS minute_bin, count(e.ts) AS n FROM (SELECT CAST(unnest(range(24)) AS INTEGER) AS h) x CROSS JOIN (SELECT CAST(unnest(range(0, 60, 10)) AS INTEGER) AS b) y
LEFT JOIN events e ON hour(e.ts) = h AND minute(e.ts) // 10 * 10 = b GROUP BY h, b""",
    ),
    "d07_attachment_types": (
        d07,
        sql(
            ARTICLES,
            then="""SELECT id, source_name, exact_time, CASE WHEN id % 7 = 0 THEN '' WHEN id % 6 = 0 THEN 'pdf,zip' WHEN id % 3 = 0 THEN 'pdf' WHEN id % 2 = 0 THEN 'doc,zip' ELSE 'doc,pdf' END AS types FROM articles""",
        ),
    ),
}
