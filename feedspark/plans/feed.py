"""Queries of feed operators with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedspark.operators import feed as C
from feedspark.plans.fixtures import ARTICLES, articles, sql, table

RICH = """rich AS (
  SELECT *, CASE id % 4 WHEN 0 THEN '【tagA】【' || source_name || '】' || chr(10) || substr(raw_text, 1, 30) WHEN 1 THEN '' WHEN 2 THEN substr(raw_text, 50, 40) END AS summary,
    CASE WHEN id % 6 = 0 THEN 'AI ' || substr(raw_text, 10, 20) ELSE '' END AS ai_summary, CASE WHEN id % 5 = 1 THEN '# ' || substr(raw_text, 1, 60) END AS enhanced_markdown,
    CASE id % 8 WHEN 0 THEN '["x", "y", "x"]' WHEN 1 THEN '【p】【q】' END AS ai_tags_text, CASE WHEN id % 3 = 0 THEN 'dept' || CAST(id % 4 AS VARCHAR) ELSE source_name END AS department FROM articles)"""


def rich(spark, d):
    i = F.col("id")
    part = lambda a, n: F.substring("raw_text", a, n)
    return articles(spark, d).select(
        "*",
        F.when(i % 4 == 0, F.concat(F.lit("【tagA】【"), "source_name", F.lit("】\n"), part(1, 30))).when(i % 4 == 1, "").when(i % 4 == 2, part(50, 40)).alias("summary"),
        F.when(i % 6 == 0, F.concat(F.lit("AI "), part(10, 20))).otherwise("").alias("ai_summary"),
        F.when(i % 5 == 1, F.concat(F.lit("# "), part(1, 60))).alias("enhanced_markdown"),
        F.when(i % 8 == 0, '["x", "y", "x"]').when(i % 8 == 1, "【p】【q】").alias("ai_tags_text"),
        F.when(i % 3 == 0, F.concat(F.lit("dept"), (i % 4).cast("string"))).otherwise(F.col("source_name")).alias("department"),
    )


RULES = """rules AS (SELECT 'rule_' || source AS rule_id, CAST(row_number() OVER (ORDER BY source) AS INTEGER) AS rule_order, 'http://feed.example.com/' || source || '/' || CAST(min(doc_id) AS VARCHAR) AS rule_url,
  source AS task_name, row_number() OVER (ORDER BY source) % 3 <> 0 AS enabled, CASE row_number() OVER (ORDER BY source) % 4 WHEN 0 THEN 'RSS' WHEN 1 THEN 'html' WHEN 2 THEN '' END AS source_type FROM documents GROUP BY source)"""


def rules(spark, d):
    from pyspark.sql.window import Window

    g = table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("m"))
    n = F.row_number().over(Window.orderBy("source"))
    return g.select(
        F.concat(F.lit("rule_"), "source").alias("rule_id"), n.alias("rule_order"), F.concat(F.lit("http://feed.example.com/"), "source", F.lit("/"), F.col("m").cast("string")).alias("rule_url"),
        F.col("source").alias("task_name"), (n % 3 != 0).alias("enabled"), F.when(n % 4 == 0, "RSS").when(n % 4 == 1, "html").when(n % 4 == 2, "").alias("source_type"),
    )


_TIME = "coalesce(nullif(exact_time, ''), nullif(date, '') || ' 00:00:00')"
_LIGHT = "id, url, title, source_name, raw_hash, source_type, rule_id, date, exact_time, is_read, is_favorite, is_deleted, false AS has_full_content"
_FEW = ["id", "url", "source_name"]


def c01(spark, d):
    return C.feed_page(articles(spark, d), 50, 30, ["src1", "src2", "src3"])


def c02(spark, d):
    return C.light_projection(articles(spark, d))


def c03(spark, d):
    a = articles(spark, d).select(_FEW)
    return C.source_filter(a, ["src1", "src4"]).unionByName(C.source_filter(a, [])).unionByName(C.source_filter(a, None))


def _subscribed(spark, d):
    return articles(spark, d).groupBy("source_name").agg(F.min("id").alias("ord")).where("source_name like '%1%'")


def c04(spark, d):
    return C.effective_sources(_subscribed(spark, d), rules(spark, d).select(F.col("task_name").alias("source_name"), F.col("rule_order").alias("ord"), "enabled"))


def c05(spark, d):
    order = spark.createDataFrame([("src7", 1), ("src3", 2), ("nowhere", 3)], "source_name string, ord int")
    return C.list_sources(articles(spark, d), order)


def c06(spark, d):
    return C.unread_count(articles(spark, d))


def c07(spark, d):
    return C.first_unread(articles(spark, d)).select("id", "source_name", "exact_time")


def c08(spark, d):
    return C.count_by_source(articles(spark, d))


def c09(spark, d):
    return C.latest_cursor_by_source(articles(spark, d))


QUERY = "idiot clown OR worthless AND scum OR src13"


def c10(spark, d):
    return C.search(rich(spark, d), QUERY).select("id", "source_name")


def c11(spark, d):
    from feedspark.operators.text import tags_of

    a = rich(spark, d).withColumn("ai_tags", tags_of(F.col("ai_tags_text")))
    return C.search_tagged(a, "TAGA", text="summary").unionByName(C.search_tagged(a, "q", text="summary")).select("id")


def c12(spark, d):
    hits = articles(spark, d).where(C.matches("idiot OR clown", ["raw_text"]))
    return C.search_snippets(hits, ["idiot", "clown"], ["title"]).select("id", "snippet")


def c13(spark, d):
    return C.prefix_scan(articles(spark, d), "rule_src1").select("id", "rule_id")


def c14(spark, d):
    keys = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return C.lookup(articles(spark, d), keys, "id").select(_FEW)


def c15(spark, d):
    p = C.resolve_payload(rich(spark, d))
    return p.select("id", F.array_join("tags", ",").alias("tags"), "summary_body", "summary_md", F.md5("preview_md").alias("preview_md5"), F.md5("enhanced_md").alias("enhanced_md5"), F.md5("raw_md").alias("raw_md5"))


def c16(spark, d):
    return C.source_distribution(C.feed_page(articles(spark, d), 100))


def c17(spark, d):
    a, flags = articles(spark, d).select("id", "is_read", "is_favorite", "is_deleted"), table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    for op in ("read", "toggle_favorite", "delete"):
        a = C.set_flags(a, flags, op)
    return a


def _annotations(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("article_id"), F.col("quality").cast("int").alias("style"))


def c18(spark, d):
    a, n = C.delete_cascade(articles(spark, d), _annotations(spark, d), ["rule_src1", "rule_src2"])
    return a.select(F.lit("article").alias("kind"), "id").unionByName(n.select(F.lit("annotation").alias("kind"), F.col("article_id").alias("id")))


def c19(spark, d):
    a = articles(spark, d).select("id", "rule_id", "source_type", F.lit("old").alias("prompt"))
    r = rules(spark, d).select("rule_id", F.when(F.col("rule_order") % 2 == 0, F.concat(F.lit("p"), F.col("rule_order").cast("string"))).alias("prompt"))
    return C.propagate_rule_config(a, r, ["prompt"])


def c20(spark, d):
    i = F.col("id")
    a = rich(spark, d).withColumn("rule_id", F.when(i % 3 == 0, F.col("rule_id")))
    a = a.withColumn("source_name", F.when(i % 5 == 0, "else").otherwise(F.col("source_name"))).withColumn("department", F.when(i % 2 == 0, F.concat(F.lit("src"), (i % 20).cast("string"))).otherwise("none"))
    return C.match_rule_for_article(a, rules(spark, d))


def c21(spark, d):
    return C.resolve_source_type(articles(spark, d).select("id", "rule_id", "source_type"), rules(spark, d)).select("id", "resolved_type")


_TAGS = lambda c: f"CASE WHEN starts_with(trim(coalesce({c}, '')), '【') THEN regexp_extract_all(split_part(trim({c}), chr(10), 1), '【([^】]{{1,15}})】', 1) ELSE [] END"

QUERIES = {
    "c01_feed_page": (c01, sql(ARTICLES, then=f"SELECT {_LIGHT} FROM articles WHERE NOT is_deleted AND source_name IN ('src1', 'src2', 'src3') ORDER BY {_TIME} DESC, id DESC LIMIT 50 OFFSET 30")),
    "c02_light_projection": (c02, sql(ARTICLES, then=f"SELECT {_LIGHT} FROM articles")),
    "c03_source_filter": (c03, sql(ARTICLES, then="SELECT id, url, source_name FROM articles WHERE source_name IN ('src1', 'src4') UNION ALL SELECT id, url, source_name FROM articles")),
    "c04_effective_sources": (
        c04,
        sql(
            ARTICLES, RULES,
            "u AS (SELECT 0 AS k, source_name, min(id) AS ord FROM articles WHERE source_name LIKE '%1%' GROUP BY source_name UNION ALL SELECT 1, task_name, rule_order FROM rules WHERE enabled)",
            "g AS (SELECT source_name, min(k * 1000000000 + ord) AS o FROM u GROUP BY source_name)",
            then="SELECT source_name, CAST(row_number() OVER (ORDER BY o, source_name) AS INTEGER) AS ord FROM g",
        ),
    ),
    "c05_list_sources": (
        c05,
        "SELECT source AS source_name, CAST(row_number() OVER (ORDER BY CASE source WHEN 'src7' THEN 1 WHEN 'src3' THEN 2 ELSE 9 END, source) AS INTEGER) AS ord FROM (SELECT DISTINCT source FROM documents) d",
    ),
    "c06_unread_count": (c06, sql(ARTICLES, then="SELECT source_name, count(*) FILTER (NOT is_read) AS unread FROM articles WHERE NOT is_deleted GROUP BY ROLLUP (source_name)")),
    "c07_first_unread": (c07, sql(ARTICLES, then=f"SELECT id, source_name, exact_time FROM articles WHERE NOT is_deleted AND NOT is_read QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY {_TIME} DESC, id DESC) = 1")),
    "c08_count_by_source": (c08, "SELECT source AS source_name, count(*) AS n FROM documents GROUP BY source"),
    "c09_latest_cursor": (
        c09,
        sql(ARTICLES, then=f"SELECT source_name, coalesce(nullif(exact_time, ''), date) AS cursor, date FROM articles WHERE NOT is_deleted QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY {_TIME} DESC, id DESC) = 1"),
    ),
    "c10_search": (
        c10,
        sql(
            ARTICLES, RICH,
            "t AS (SELECT *, lower(concat_ws(chr(1), title, summary, ai_summary, enhanced_markdown, raw_text, source_name, rule_id, ai_tags_text)) AS x FROM rich WHERE NOT is_deleted)",
            then=f"SELECT id, source_name FROM t WHERE (contains(x, 'idiot') AND contains(x, 'clown')) OR (contains(x, 'worthless') AND contains(x, 'scum')) OR contains(x, 'src13') ORDER BY {_TIME} DESC, id DESC LIMIT 50",
        ),
    ),
    "c11_search_tagged": (c11, sql(ARTICLES, RICH, then="SELECT id FROM rich WHERE contains(coalesce(summary, ''), '【tagA】') UNION ALL SELECT id FROM rich WHERE contains(coalesce(ai_tags_text, ''), '【q】')")),
    "c12_search_snippets": (
        c12,
        sql(
            ARTICLES,
            "h AS (SELECT id, title, raw_text, unnest(['idiot', 'clown']) AS t, unnest([1, 2]) AS k FROM articles WHERE contains(lower(raw_text), 'idiot') OR contains(lower(raw_text), 'clown'))",
            "p AS (SELECT *, strpos(lower(raw_text), t) AS pos, greatest(1, strpos(lower(raw_text), t) - 20) AS s FROM h)",
            "q AS (SELECT *, least(pos + length(t) + 30, length(raw_text) + 1) AS e FROM p)",
            then="""SELECT id, nullif(string_agg(CASE WHEN pos > 0 AND NOT contains(lower(title), t) THEN CASE WHEN s > 1 THEN '...' ELSE '' END || substr(raw_text, s, pos - s) || '**' || substr(raw_text, pos, length(t)) || '**'
|| substr(raw_text, pos + length(t), e - pos - length(t)) || CASE WHEN e <= length(raw_text) THEN '...' ELSE '' END END, ' ' ORDER BY k), '') AS snippet FROM q GROUP BY id""",
        ),
    ),
    "c13_prefix_scan": (c13, sql(ARTICLES, then="SELECT id, rule_id FROM articles WHERE NOT is_deleted AND starts_with(rule_id, 'rule_src1')")),
    "c14_lookup": (c14, sql(ARTICLES, then="SELECT id, url, source_name FROM articles WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)")),
    "c15_resolve_payload": (
        c15,
        sql(
            ARTICLES, RICH,
            f"""a AS (SELECT *, CASE id % 8 WHEN 0 THEN ['x', 'y'] WHEN 1 THEN ['p', 'q'] ELSE {_TAGS('summary')} END AS tg,
              CASE WHEN ai_summary <> '' THEN trim(ai_summary) WHEN id % 4 = 0 THEN trim(regexp_replace(trim(summary), '^[^\\n]*(\\n|$)', '')) ELSE trim(coalesce(summary, '')) END AS body FROM rich)""",
            """b AS (SELECT *, array_to_string(list_transform(tg, lambda x: '【' || x || '】'), '') AS line, trim(raw_text) AS raw_md, coalesce(nullif(trim(enhanced_markdown), ''), trim(raw_text)) AS enh FROM a)""",
            """c AS (SELECT *, coalesce(nullif(trim(summary), ''), nullif(CASE WHEN line = '' THEN body WHEN body = '' THEN line ELSE line || chr(10) || body END, ''), nullif(enh, ''), '') AS sm FROM b)""",
            then="SELECT id, array_to_string(tg, ',') AS tags, body AS summary_body, sm AS summary_md, md5(coalesce(nullif(body, ''), nullif(enh, ''), sm)) AS preview_md5, md5(enh) AS enhanced_md5, md5(raw_md) AS raw_md5 FROM c",
        ),
    ),
    "c16_source_distribution": (c16, sql(ARTICLES, then=f"SELECT source_name, count(*) AS n FROM (SELECT * FROM articles WHERE NOT is_deleted ORDER BY {_TIME} DESC, id DESC LIMIT 100) p GROUP BY source_name")),
    "c17_set_flags": (
        c17,
        sql(ARTICLES, "m AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)", then="SELECT id, is_read OR id IN (SELECT doc_id FROM m) AS is_read, is_favorite <> (id IN (SELECT doc_id FROM m)) AS is_favorite, is_deleted OR id IN (SELECT doc_id FROM m) AS is_deleted FROM articles"),
    ),
    "c18_delete_cascade": (
        c18,
        sql(
            ARTICLES, "gone AS (SELECT id FROM articles WHERE rule_id IN ('rule_src1', 'rule_src2'))",
            then="SELECT 'article' AS kind, id FROM articles WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'annotation', doc_id FROM labels WHERE doc_id NOT IN (SELECT id FROM gone)",
        ),
    ),
    "c19_propagate_rule_config": (
        c19,
        sql(ARTICLES, RULES, then="SELECT a.id, a.rule_id, a.source_type, CASE WHEN a.source_type = 'rss' AND r.rule_order % 2 = 0 THEN 'p' || CAST(r.rule_order AS VARCHAR) ELSE 'old' END AS prompt FROM articles a LEFT JOIN rules r USING (rule_id)"),
    ),
    "c20_match_rule": (
        c20,
        sql(
            ARTICLES, RULES,
            "a AS (SELECT id, url, CASE WHEN id % 3 = 0 THEN rule_id END AS rule_id, CASE WHEN id % 5 = 0 THEN 'else' ELSE source_name END AS source_name, CASE WHEN id % 2 = 0 THEN 'src' || CAST(id % 20 AS VARCHAR) ELSE 'none' END AS department FROM articles)",
            """m AS (SELECT a.id, r.rule_id, r.rule_order, CASE WHEN r.rule_id = a.rule_id THEN 1 WHEN r.rule_url = a.url THEN 2 WHEN r.enabled AND r.task_name = a.source_name THEN 3 ELSE 4 END AS p
              FROM a JOIN rules r ON r.rule_id = a.rule_id OR r.rule_url = a.url OR (r.enabled AND r.task_name = a.source_name) OR (r.enabled AND r.task_name = a.department AND a.department <> a.source_name))""",
            "b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, rule_order) = 1)",
            then="SELECT a.id, b.rule_id AS matched_rule, b.p AS priority FROM a LEFT JOIN b USING (id)",
        ),
    ),
    "c21_resolve_source_type": (
        c21,
        sql(ARTICLES, RULES, then="SELECT a.id, CASE WHEN lower(trim(r.source_type)) IN ('rss', 'html') THEN lower(trim(r.source_type)) WHEN a.source_type IN ('rss', 'html') THEN a.source_type ELSE 'html' END AS resolved_type FROM articles a LEFT JOIN rules r USING (rule_id)"),
    ),
}
