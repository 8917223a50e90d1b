"""Queries of page and profile operators with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedspark.operators import pages as G
from feedspark.operators import profiles as H
from feedspark.operators import text as X
from feedspark.plans.fixtures import ARTICLES, articles, sql, table
from feedspark.plans.text import BLOCKS, MD, md


def _pages(spark, d):
    return table(spark, d, "pages")


def _media(spark, d):
    """The pages with links, images and frames set in before what they hold."""
    i = F.col("page_id")
    n = (i % 4).cast("string")
    extra = F.concat(
        F.lit('<a href="files/doc'), n, F.lit('.pdf">Doc '), n, F.lit('</a><a href="/x/'), n, F.lit('.png">Pic</a><a href="javascript:void(0)">No</a><a href="https://other.org/download?id='), n, F.lit('">Ignore</a><a href="files/doc'), n, F.lit('.pdf">Again</a>'),
        F.when(i % 3 == 0, F.concat(F.lit('<img src="blank.gif" data-src="//cdn.site/'), n, F.lit('.jpg" alt="A" width="400" height="300"><img alt="B" src="/b.png">'))).when(i % 3 == 1, '<meta property="og:image" content="http://img.org/og.png">').otherwise(""),
        F.lit('<iframe src="/frame"></iframe><iframe src="https://elsewhere.net/f"></iframe>'),
    )
    return table(spark, d, "pages").select("page_id", "url", F.concat(extra, "html").alias("html"))


def g01(spark, d):
    links = G.page_links(_pages(spark, d))
    return links.groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.min("text").alias("first_text"), F.max("link").alias("last_link"))


def g02(spark, d):
    black = spark.createDataFrame([("Ignore",)], "name string")
    return G.page_attachments(G.page_links(_media(spark, d)), black)


def g03(spark, d):
    return G.page_images(_media(spark, d))


def g04(spark, d):
    return G.page_summary(_pages(spark, d)).select("page_id", "title", "headings", "n_links", "n_items", "n_tables", "n_articles", "n_headings", "size_after")


def g05(spark, d):
    return G.prune_html(_pages(spark, d)).select("page_id", "size_before", "size_after", F.md5("pruned_html").alias("pruned_md5"))


def g06(spark, d):
    return G.page_blocks(_pages(spark, d)).groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min("block_index").alias("first"))


_LINKED = "<a href='x'>one</a> "
#: Nested, unclosed and stray regions behind a page's own.
_NESTED = f"</nav><section>{_LINKED * 2}<Article class='y'>{_LINKED}<article>{_LINKED * 3}</article> more {_LINKED}</article> tail {_LINKED}</section></main><main>{_LINKED * 9}<nav>{_LINKED * 4}"


def g07(spark, d):
    rows = _pages(spark, d)
    return G.region_density(rows.withColumn("html", F.concat("html", F.when(F.col("page_id") % 3 == 0, _NESTED).otherwise(""))))


TEMPLATES = [("t1", "blog", ["blog."], "/en/", ["the"], ["<article>", "<nav>"], 1.0), ("t2", "shop", ["shop.", "cheap"], "page=", ["und"], ["<table"], 0.5), ("t3", "any", [], "", [], ["<footer>", "<article>", "<h1>", "<nav>"], 0.0)]


def _templates(spark):
    return spark.createDataFrame(TEMPLATES, "template_id string, profile string, domains array<string>, url_pattern string, title_words array<string>, markers array<string>, coverage double")


def g08(spark, d):
    return G.match_templates(_pages(spark, d), _templates(spark))


def g09(spark, d):
    pages = _pages(spark, d)
    return G.site_profile(pages, G.match_templates(pages, _templates(spark)))


def g10_types(spark, d):
    return G.site_type_distribution(g10(spark, d))


def g10(spark, d):
    words = spark.createDataFrame([(1, "cheap", "shop"), (2, "/en/", "english"), (3, "blog", "blog"), (4, "/fr/", "french")], "ord int, keyword string, type string")
    return G.classify_site_type(_pages(spark, d), words)


def g11(spark, d):
    return G.domain_rollup(_pages(spark, d))


def g12(spark, d):
    return G.same_site_frames(_media(spark, d))


def _thin(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.when(i % 5 == 0, "").otherwise(F.regexp_replace("text", "[^A-Z.]", "")).alias("t"), (i % 3).alias("images"), F.when(i % 4 == 0, "").otherwise(F.regexp_replace("text", "[^aeiou ]", "")).alias("detail"))


def g13(spark, d):
    e = _thin(spark, d)
    thin = G.thin_entries(e.select("doc_id", "t", "images"), "t", "images")
    return G.prefer_fuller_detail(thin, e.select("doc_id", F.col("detail").alias("t")), "doc_id", "t").select("doc_id", F.length("t").alias("n"), "from_detail")


def g14(spark, d):
    a = articles(spark, d)
    items = a.select("id", F.when(F.col("id") % 2 == 0, " ").otherwise(F.col("title")).alias("title"), F.col("date").alias("body"))
    details = a.where("id % 3 <> 0").select("id", F.concat(F.lit("D "), F.col("source_name")).alias("title"), F.when(F.col("id") % 4 == 0, "").otherwise("detail").alias("body"))
    out = [G.detail_fallback(items, details, "id", ["title", "body"], s).withColumn("strategy", F.lit(s)) for s in ("list_only", "detail_preferred", "hybrid")]
    return out[0].unionByName(out[1]).unionByName(out[2]).withColumn("title", F.trim("title"))


def g15(spark, d):
    a = articles(spark, d)
    i = F.col("id")
    fields = F.create_map(F.when(i % 3 == 0, "TITLE").when(i % 3 == 1, "name").otherwise("x"), F.col("source_name"), F.lit("Href"), F.col("url"), F.lit("pubDate"), F.when(i % 2 == 0, F.col("date")).otherwise(""))
    return G.map_fields_by_alias(a.select("id", fields.alias("f")), "f", {"title": ["title", "name"], "link": ["link", "href"], "day": ["date", "pubdate"]}).drop("f")


def h01(spark, d):
    m = md(spark, d)
    metrics = X.block_metrics(X.explode_blocks(m, "id", "t"), "id")
    rows = m.join(metrics, "id").join(articles(spark, d).select("id", "source_name"), "id").withColumn("images", F.col("id") % 5)
    return H.profile_sources(rows, "source_name", "t", "headings", "lists", "images").select("source_name", "profile", "samples", "max_body_chars", "avg_body_chars")


def _rules(spark, d):
    s = table(spark, d, "documents").select(F.col("source").alias("source_name")).distinct()
    n = F.regexp_extract("source_name", r"(\d+)", 1).cast("int")
    return s.select("source_name", F.when(n % 3 == 0, "Photo album").when(n % 3 == 1, "weekly essay").otherwise("plain").alias("task_purpose"), F.concat(F.lit("http://x/"), "source_name").alias("url"), F.when(n % 5 == 0, "longform").otherwise("").alias("profile"), F.when(n % 4 == 0, "gallery").otherwise("").alias("template"), F.when(n % 7 == 0, 99).alias("max_items"), n.alias("n"))


def h02(spark, d):
    r = _rules(spark, d)
    return H.profile_by_keywords(r, r.where("n % 2 = 0"), "source_name")


def h03(spark, d):
    r = _rules(spark, d)
    return H.resolve_strategy(r, H.profile_by_keywords(r, r.where("n % 2 = 0"), "source_name"), "source_name").select("source_name", "strategy_profile", "template", "max_items")


def h04(spark, d):
    rows = _thin(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumns({"images": F.col("doc_id") % 4, "files": F.col("doc_id") % 2})
    return H.preview_rollup(H.preview_diagnostics(rows, "t", "images", "files"), "source")


def h05(spark, d):
    e = table(spark, d, "events")
    s = e.select((F.col("user_id") % 50).alias("rule_id"), F.when(F.col("event_id") % 50 == 7, "failed").when(F.col("event_id") % 31 == 3, "empty").otherwise("passed").alias("status")).where("rule_id % 3 = 0")
    return H.detail_preview_verdict(s)


def h06(spark, d):
    a = articles(spark, d)
    s = a.select("source_name", F.create_map(F.lit("title"), F.when(F.col("id") % 100 == 7, "t").otherwise(" "), F.lit("other"), F.lit("o")).alias("f"))
    return H.rule_sample_signal(s, "source_name", "f", ["title", "date"])


_HOST = "lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1))"
_TITLE = "trim(regexp_replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_PRUNED = "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g')"
_BARE = lambda x: f"trim(regexp_replace(replace(replace(regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_SCORE = f"""SELECT page_id, template_id, profile, round(s, 1) AS score, m FROM (
  SELECT page_id, 't1' AS template_id, 'blog' AS profile, CASE WHEN contains({_HOST}, 'blog.') THEN 38.0 ELSE 0 END + CASE WHEN regexp_matches(url, '/en/') THEN 22 ELSE 0 END + CASE WHEN contains(lower({_TITLE}), 'the') THEN 6 ELSE 0 END
    + least(36, 12 * (CAST(contains(html, '<article>') AS INTEGER) + CAST(contains(html, '<nav>') AS INTEGER))) + 14 AS s, CAST(contains(html, '<article>') AS INTEGER) + CAST(contains(html, '<nav>') AS INTEGER) AS m FROM pages
  UNION ALL SELECT page_id, 't2', 'shop', CASE WHEN contains({_HOST}, 'shop.') OR contains({_HOST}, 'cheap') THEN 38.0 ELSE 0 END + CASE WHEN regexp_matches(url, 'page=') THEN 22 ELSE 0 END + CASE WHEN contains(lower({_TITLE}), 'und') THEN 6 ELSE 0 END
    + 12 * CAST(contains(html, '<table') AS INTEGER) + 7, CAST(contains(html, '<table') AS INTEGER) FROM pages
  UNION ALL SELECT page_id, 't3', 'any', least(36, 12 * k), k FROM (SELECT page_id, CAST(contains(html, '<footer>') AS INTEGER) + CAST(contains(html, '<article>') AS INTEGER) + CAST(contains(html, '<h1>') AS INTEGER) + CAST(contains(html, '<nav>') AS INTEGER) AS k FROM pages) p) x WHERE round(s, 1) >= 32"""
_RANKED = f"ranked AS (SELECT page_id, template_id, profile, score, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, m DESC, template_id) AS INTEGER) AS rank FROM ({_SCORE}) q)"
_RULES = "rules AS (SELECT source_name, n, CASE n % 3 WHEN 0 THEN 'visual' WHEN 1 THEN 'longform' ELSE 'news' END AS kind FROM (SELECT DISTINCT source AS source_name, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS n FROM documents) s)"
_THIN = "thin AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN '' ELSE regexp_replace(text, '[^A-Z.]', '', 'g') END AS t, doc_id % 3 AS images, CASE WHEN doc_id % 4 = 0 THEN '' ELSE regexp_replace(text, '[^aeiou ]', '', 'g') END AS detail FROM documents)"
_PLAIN = lambda t: f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '(?m)^\\s*([-*+]|\\d+\\.)\\s+', '', 'g'), '[*_~|`]', ' ', 'g'), '(?m)^#{{1,6}}\\s*', '', 'g'), '\\s+', ' ', 'g'))"
_PREVIEW = lambda t: f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', '\\1 ', 'g'), '\\[([^\\]]+)\\]\\(([^)]+)\\)', '\\1', 'g'), '(?m)^#{{1,6}}\\s*', '', 'g'), '(?m)^\\s*>\\s?', '', 'g'), '(?m)^\\s*([-*+]|\\d+\\.)\\s+', '', 'g'), '[*_~]', '', 'g'), '\\s+', ' ', 'g'))"

#: SQL for scheme and host of a page.
_ROOT = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"

QUERIES = {
    "g01_page_links": (
        g01,
        f"""WITH t AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)(<a\\s[^>]*>.*?</a>)', 1)) AS tag FROM pages), l AS (SELECT *, trim(regexp_extract(tag, '(?is)\\shref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM t)
SELECT page_id, 'page' AS kind, count(*) AS n, min({_BARE('tag')}) AS first_text, max(regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || href) AS last_link FROM l WHERE href <> '' GROUP BY page_id""",
    ),
    "g02_page_attachments": (
        g02,
        f"SELECT page_id, 0 AS n, 'Doc ' || CAST(page_id % 4 AS VARCHAR) AS text, {_ROOT} || regexp_extract(url, '^https?://[^/?#]+(/[^?#]*/)', 1) || 'files/doc' || CAST(page_id % 4 AS VARCHAR) || '.pdf' AS link FROM pages",
    ),
    "g03_page_images": (
        g03,
        f"""SELECT page_id, 0 AS n, regexp_extract(url, '^(https?:)', 1) || '//cdn.site/' || CAST(page_id % 4 AS VARCHAR) || '.jpg' AS src, 'A' AS alt, 400.0 AS width, 300.0 AS height, 1.3333 AS ratio, 'cdn.site' AS hostname FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 1, {_ROOT} || '/b.png', 'B', NULL, NULL, NULL, {_HOST} FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 0, 'http://img.org/og.png', '', NULL, NULL, NULL, 'img.org' FROM pages WHERE page_id % 3 = 1""",
    ),
    "g04_page_summary": (
        g04,
        f"""SELECT page_id, {_TITLE} AS title, array_to_string(list_transform(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1)[1:8], lambda x: {_BARE('x')}), ' | ') AS headings,
len(regexp_extract_all(html, '(?i)<a[\\s>]')) AS n_links, len(regexp_extract_all(html, '(?i)<li[\\s>]')) AS n_items, len(regexp_extract_all(html, '(?i)<table[\\s>]')) AS n_tables, len(regexp_extract_all(html, '(?i)<article[\\s>]')) AS n_articles,
len(regexp_extract_all(html, '(?i)<h[1-6][\\s>]')) AS n_headings, length({_PRUNED}) AS size_after FROM pages""",
    ),
    "g05_prune_html": (g05, f"SELECT page_id, length(html) AS size_before, length({_PRUNED}) AS size_after, md5({_PRUNED}) AS pruned_md5 FROM pages"),
    "g06_page_blocks": (
        g06,
        f"""WITH b AS (SELECT page_id, unnest(regexp_extract_all({_PRUNED}, '(?is)(<(?:h[1-6]|p|li|blockquote)[\\s>].*?</(?:h[1-6]|p|li|blockquote)>)', 1)) AS block, generate_subscripts(regexp_extract_all({_PRUNED}, '(?is)(<(?:h[1-6]|p|li|blockquote)[\\s>].*?</(?:h[1-6]|p|li|blockquote)>)', 1), 1) AS n FROM pages),
c AS (SELECT page_id, n, lower(regexp_extract(block, '^<([A-Za-z0-9]+)', 1)) AS tag, {_BARE('block')} AS text FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS block_index FROM c WHERE text <> '')
SELECT page_id, tag, count(*) AS n, sum(length(text)) AS chars, min(block_index) AS first FROM k GROUP BY page_id, tag""",
    ),
    "g07_region_density": (
        g07,
        f"""WITH h AS (SELECT page_id, {_PRUNED} || CASE WHEN page_id % 3 = 0 THEN '{_NESTED.replace("'", "''")}' ELSE '' END AS h FROM pages),
tags AS (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(h, '{G.REGION}') AS l FROM h)),
parts AS (SELECT page_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_split_to_array(h, '{G.REGION}') AS l FROM h)),
m AS (SELECT *, lower(regexp_extract(x, '^</?([A-Za-z]+)', 1)) AS tag, CASE WHEN starts_with(x, '</') THEN -1 ELSE 1 END AS step FROM tags),
d AS (SELECT *, sum(step) OVER (PARTITION BY page_id, tag ORDER BY i) AS depth FROM m),
o AS (SELECT a.page_id, a.i, a.tag, coalesce(min(b.i), 1000000000) AS j FROM d a LEFT JOIN d b ON b.page_id = a.page_id AND b.tag = a.tag AND b.i > a.i AND b.depth = a.depth - 1 WHERE a.step = 1 GROUP BY 1, 2, 3),
r AS (SELECT o.page_id, o.i AS n, tag, string_agg(p, ' ' ORDER BY parts.i) AS r FROM o JOIN parts ON parts.page_id = o.page_id AND parts.i > o.i AND parts.i <= o.j GROUP BY 1, 2, 3),
c AS (SELECT page_id, n, tag, len(regexp_extract_all(r, '(?i)<a\\s')) AS n_links, length({_BARE('r')}) AS text_chars FROM r)
SELECT page_id, tag, n_links, text_chars, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n_links DESC, text_chars DESC, n) AS INTEGER) AS rank FROM c WHERE n_links >= 3 QUALIFY rank <= 3""",
    ),
    "g08_match_templates": (g08, f"WITH {_RANKED} SELECT * FROM ranked WHERE rank <= 3"),
    "g09_site_profile": (g09, f"WITH {_RANKED} SELECT p.page_id, CASE WHEN r.score >= 36 THEN r.profile ELSE 'general_site' END AS profile, CASE WHEN r.score >= 36 THEN r.score ELSE 36.0 END AS confidence FROM pages p LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (page_id)"),
    "g10_classify_site_type": (
        g10,
        "SELECT page_id, CASE WHEN contains(lower(url), 'cheap') THEN 'shop' WHEN contains(lower(url), '/en/') THEN 'english' WHEN contains(lower(url), 'blog') THEN 'blog' WHEN contains(lower(url), '/fr/') THEN 'french' ELSE 'general' END AS site_type FROM pages",
    ),
    "g10_site_type_distribution": (
        g10_types,
        "WITH t AS (SELECT CASE WHEN contains(lower(url), 'cheap') THEN 'shop' WHEN contains(lower(url), '/en/') THEN 'english' WHEN contains(lower(url), 'blog') THEN 'blog' WHEN contains(lower(url), '/fr/') THEN 'french' ELSE 'general' END AS site_type FROM pages) "
        "SELECT site_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM t GROUP BY 1",
    ),
    "g11_domain_rollup": (g11, f"SELECT array_to_string(string_split(h, '.')[-2:], '.') AS domain, count(*) AS pages, count(DISTINCT h) AS hosts FROM (SELECT {_HOST} AS h FROM pages) x GROUP BY 1"),
    "g12_same_site_frames": (g12, f"SELECT page_id, 0 AS n, {_ROOT} || '/frame' AS src FROM pages"),
    "g13_thin_entries": (
        g13,
        f"""WITH {_THIN} SELECT doc_id, greatest(length(t), length(detail)) AS n, length(detail) > length(t) AS from_detail FROM thin WHERE length(t) < 160 AND NOT (length({_PLAIN('t')}) >= 120 AND images > 1)""",
    ),
    "g14_detail_fallback": (
        g14,
        sql(
            ARTICLES,
            "i AS (SELECT id, CASE WHEN id % 2 = 0 THEN ' ' ELSE title END AS t, date AS b, CASE WHEN id % 3 <> 0 THEN 'D ' || source_name END AS dt, CASE WHEN id % 3 <> 0 AND id % 4 <> 0 THEN 'detail' END AS db FROM articles)",
            then="""SELECT id, trim(t) AS title, b AS body, 'list_only' AS strategy FROM i UNION ALL SELECT id, coalesce(dt, nullif(trim(t), '')), coalesce(db, b), 'detail_preferred' FROM i
UNION ALL SELECT id, coalesce(nullif(trim(t), ''), dt), b, 'hybrid' FROM i""",
        ),
    ),
    "g15_map_fields_by_alias": (g15, sql(ARTICLES, then="SELECT id, CASE WHEN id % 3 = 2 THEN 'untitled' ELSE source_name END AS title, url AS link, CASE WHEN id % 2 = 0 THEN date ELSE '' END AS day FROM articles")),
    "h01_profile_sources": (
        h01,
        sql(
            MD, *BLOCKS, f"p AS (SELECT md.id, d.source AS source_name, length({_PREVIEW('t')}) AS n FROM md JOIN documents d ON d.doc_id = md.id)",
            "h AS (SELECT id, count(*) FILTER (type = 'title') AS hd FROM blocks GROUP BY id)",
            "g AS (SELECT source_name, count(*) AS samples, max(n) AS max_body_chars, avg(n) AS a, avg(hd) AS h, avg(id % 5) AS i FROM p JOIN h USING (id) GROUP BY source_name)",
            then="SELECT source_name, CASE WHEN i >= 3 AND a < 1000 THEN 'visual' WHEN max_body_chars >= 2600 OR a >= 1800 OR h >= 3 THEN 'longform' ELSE 'news' END AS profile, samples, max_body_chars, CAST(floor(a) AS BIGINT) AS avg_body_chars FROM g",
        ),
    ),
    "h02_profile_by_keywords": (h02, f"WITH {_RULES} SELECT source_name, kind AS profile FROM rules WHERE n % 2 <> 0"),
    "h03_resolve_strategy": (
        h03,
        f"""WITH {_RULES}, s AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'longform' WHEN n % 4 = 0 THEN 'visual' WHEN n % 2 <> 0 THEN kind ELSE 'news' END AS p FROM rules)
SELECT source_name, p AS strategy_profile, CASE WHEN n % 4 = 0 THEN 'gallery' WHEN p = 'visual' THEN 'gallery' WHEN p = 'longform' THEN 'deep_read' ELSE 'brief' END AS template, CASE WHEN n % 7 = 0 THEN 99 WHEN p = 'visual' THEN 12 WHEN p = 'longform' THEN 6 ELSE 20 END AS max_items FROM s""",
    ),
    "h04_preview_diagnostics": (
        h04,
        f"""WITH {_THIN}, p AS (SELECT source, doc_id % 4 AS i, doc_id % 2 AS f, length({_PREVIEW('t')}) AS n FROM thin),
s AS (SELECT source, CASE WHEN n = 0 THEN 'empty' WHEN n < 70 OR (i >= 3 AND n < 160) OR (i = 0 AND f = 0 AND n < 40) THEN 'warning' ELSE 'ready' END AS preview_status FROM p)
SELECT source, preview_status, count(*) AS n FROM s GROUP BY ROLLUP (source, preview_status)""",
    ),
    "h05_detail_preview_verdict": (
        h05,
        """WITH s AS (SELECT user_id % 50 AS rule_id, CASE WHEN event_id % 50 = 7 THEN 'failed' WHEN event_id % 31 = 3 THEN 'empty' ELSE 'passed' END AS status FROM events WHERE user_id % 50 % 3 = 0)
SELECT rule_id, bool_and(status = 'passed') AS passed, count(*) AS samples, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'empty') AS empty FROM s GROUP BY rule_id""",
    ),
    "h06_rule_sample_signal": (h06, "SELECT source AS source_name, bool_or(doc_id % 100 = 7) AS has_signal FROM documents GROUP BY source"),
}
