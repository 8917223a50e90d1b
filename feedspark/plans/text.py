"""Queries of text operators with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedspark.operators import text as X
from feedspark.plans.feed import RICH, RULES, rich, rules
from feedspark.plans.fixtures import ARTICLES, INCOMING, articles, incoming, sql, table

MD = """md AS (SELECT doc_id AS id, '# ' || replace(substr(text, 1, 20), chr(10), ' ') || chr(10) || chr(10) || replace(replace(substr(text, 21), chr(10), ' '), '. ', '.' || chr(10) || '- ') || chr(10) || '1. one' || chr(10) || '2. two' || chr(10) || chr(10)
  || '![pic](http://i/' || CAST(doc_id % 3 AS VARCHAR) || '.png)' || chr(10) || '![pic](http://i/x.png)' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '---' || chr(10) || '> [quoted](http://q) text' || chr(10) || '>' || chr(10) || '> more' || chr(10) || '----' || chr(10) || '* star' || chr(10) || '[](HTTP://H.org:8/p)' || chr(10) || ' [a b](/local) ' || chr(10) || '![]()' ELSE '' END AS t FROM documents)"""


def md(spark, d):
    i = F.col("doc_id")
    body = F.replace(F.replace(F.expr("substring(text, 21)"), F.lit("\n"), F.lit(" ")), F.lit(". "), F.lit(".\n- "))
    head = F.replace(F.substring("text", 1, 20), F.lit("\n"), F.lit(" "))
    tail = F.when(i % 2 == 0, "\n---\n> [quoted](http://q) text\n>\n> more\n----\n* star\n[](HTTP://H.org:8/p)\n [a b](/local) \n![]()").otherwise("")
    return table(spark, d, "documents").select(i.alias("id"), F.concat(F.lit("# "), head, F.lit("\n\n"), body, F.lit("\n1. one\n2. two\n\n![pic](http://i/"), (i % 3).cast("string"), F.lit(".png)\n![pic](http://i/x.png)"), tail).alias("t"))


def f01(spark, d):
    return X.plain_text_table(md(spark, d), "t").select("id", F.md5("plain").alias("plain_md5"), "plain_chars", "compact_chars")


def f02(spark, d):
    rows = md(spark, d).join(articles(spark, d).select("id", "raw_text"), "id").withColumn("raw", F.when(F.col("id") % 3 == 0, F.regexp_replace("raw_text", "[aeiou]", "")).otherwise(F.col("raw_text"))).withColumn("html", F.concat(F.lit("<p>"), F.replace(F.replace("raw_text", F.lit("<"), F.lit(" ")), F.lit("&"), F.lit(" ")), F.lit(" tail</p><script>var x = 1;</script>")))
    return X.best_text(rows, "raw", "t", "html").select("id", "best_from", F.length("best_text").alias("n"))


def f03(spark, d):
    return X.explode_blocks(md(spark, d), "id", "t").select("id", "block_index", "type", "level", "n_lines", F.md5("text").alias("text_md5"), "anchor", "ordered", F.md5(F.array_join("items", "|")).alias("items_md5"), "url", "alt", "hostname")


def f04(spark, d):
    return X.block_metrics(X.explode_blocks(md(spark, d), "id", "t"), "id")


def f05(spark, d):
    return X.group_adjacent_images(X.explode_blocks(md(spark, d), "id", "t"), "id").select("id", "block_index", "group", "group_size", "group_index")


def _images(spark, d):
    blocks = articles(spark, d).select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("block_index"), F.concat(F.lit("http://i/"), ((F.col("id") + k) % 3).cast("string"), F.lit(f"?v={k}" if k % 2 else "#f")).alias("url")) for k in range(4)))).alias("x")).select("id", "x.*")
    assets = articles(spark, d).select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("position"), F.concat(F.lit("http://i/"), ((F.col("id") + 2 * k) % 3).cast("string"), F.lit("?v=1" if k % 2 else "")).alias("url")) for k in range(3)))).alias("x")).select("id", "x.*")
    return blocks, assets


def f06(spark, d):
    return X.attach_assets(*_images(spark, d), "id")


def f07(spark, d):
    rows = articles(spark, d).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("☀ "), "title", F.lit("\U0001f600️"))).otherwise(F.col("title")).alias("title"))
    return X.strip_symbols(rows, ["title"])


def f08(spark, d):
    return X.extract_tags(rich(spark, d), "summary").select("id", F.array_join("tags", ",").alias("tags"), "body")


def f09(spark, d):
    return X.tag_items(rich(spark, d).withColumn("tags", X.tags_of(F.col("ai_tags_text"))), "id")


def f10(spark, d):
    rows = rich(spark, d).withColumn("tags", X.tags_of(F.col("ai_tags_text")))
    return X.compose_tagged(rows, "tags", "ai_summary").select("id", "tagged")


def f11(spark, d):
    """Texts as they are (blocks of many lines), with a blank line after each line, and with headings."""
    i, line, both = F.col("doc_id") % 4, F.lit("\n"), F.lit("\n\n")
    body = F.when(i == 0, F.col("text")).when(i == 1, F.replace("text", F.lit(". "), F.lit(".\n\n# "))).when(i == 2, F.replace("text", F.lit(". "), F.lit(".\n"))).otherwise(F.replace("text", line, both))
    c = X.chunk_documents(table(spark, d, "documents").select("doc_id", body.alias("text")), "doc_id", "text")
    return c.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


#: The folds as recursive queries that number pieces and chunks.
F11_SQL = f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, '. ', '.' || chr(10) || chr(10) || '# ')
  WHEN 2 THEN replace(text, '. ', '.' || chr(10)) ELSE replace(text, chr(10), chr(10) || chr(10)) END, '^{X.SPACES}+|{X.SPACES}+$', '', 'g') AS t FROM documents),
parts AS (SELECT doc_id, unnest(l) AS b, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(t, '\n{X.SPACES}*\n') AS l FROM t WHERE length(t) >= 7000)),
raw AS (SELECT doc_id, i, regexp_replace(b, '^{X.SPACES}+|{X.SPACES}+$', '', 'g') AS b FROM parts WHERE regexp_replace(b, '{X.SPACES}', '', 'g') <> ''),
split AS (SELECT doc_id, i, unnest(l) AS line, generate_subscripts(l, 1) AS j FROM (SELECT doc_id, i, regexp_split_to_array(b, '{X.LINE_END}') AS l FROM raw WHERE length(b) > 4600)),
lines AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, i ORDER BY j) AS j, regexp_replace(line, '{X.SPACES}+$', '') AS line FROM split WHERE regexp_replace(line, '{X.SPACES}', '', 'g') <> ''),
lf AS (SELECT doc_id, i, j, 1 AS piece, length(line) + 1 AS cur FROM lines WHERE j = 1 UNION ALL
  SELECT l.doc_id, l.i, l.j, piece + CAST(cur + length(line) + 1 > 4600 AS INT), CASE WHEN cur + length(line) + 1 > 4600 THEN 0 ELSE cur END + length(line) + 1 FROM lf JOIN lines l ON l.doc_id = lf.doc_id AND l.i = lf.i AND l.j = lf.j + 1),
pieces AS (SELECT doc_id, i, piece, regexp_replace(string_agg(line, chr(10) ORDER BY j), '^{X.SPACES}+|{X.SPACES}+$', '', 'g') AS b FROM lf JOIN lines USING (doc_id, i, j) GROUP BY 1, 2, 3
  UNION ALL SELECT doc_id, i, 1, b FROM raw WHERE length(b) <= 4600),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, piece) AS k, b FROM pieces),
bf AS (SELECT doc_id, k, 0 AS chunk_index, length(b) AS cur FROM b WHERE k = 1 UNION ALL
  SELECT b.doc_id, b.k, chunk_index + CAST(f AS INT), CASE WHEN f THEN length(b) ELSE cur + 2 + length(b) END
  FROM (SELECT b.doc_id, b.k, b.b, bf.chunk_index, bf.cur, bf.cur + 2 + length(b.b) > 4600 OR (bf.cur >= 3600 AND starts_with(b.b, '#')) AS f FROM bf JOIN b ON b.doc_id = bf.doc_id AND b.k = bf.k + 1) b),
c AS (SELECT doc_id, chunk_index, string_agg(b, chr(10) || chr(10) ORDER BY k) AS chunk FROM bf JOIN b USING (doc_id, k) GROUP BY 1, 2 UNION ALL SELECT doc_id, 0, t FROM t WHERE length(t) BETWEEN 1 AND 6999)
SELECT doc_id, chunk_index, length(chunk) AS n_chars, md5(chunk) AS chunk_md5 FROM c"""


def f12(spark, d):
    return X.recombine_chunks(table(spark, d, "conversations"), "conv_id", "turn", "text", "## Part").select("conv_id", "n_chunks", F.md5("text").alias("text_md5"))


TERMS = [("(?i)idiot|moron", "[insult]", "insult"), ("(?i)clown", "[name]", "name"), (r"\binsult\b", "rude", "again")]


def f13(spark, d):
    rows = articles(spark, d).withColumn("raw_text", F.when(F.col("id") % 2 == 0, F.replace("raw_text", F.lit("\n"), F.lit("\n\n\n"))).otherwise(F.col("raw_text")))
    return X.redact_terms(rows, TERMS, "raw_text").select("id", F.md5("redacted").alias("redacted_md5"), "hits_insult", "hits_name", "hits_again")


def f13_totals(spark, d):
    return X.redaction_totals(X.redact_terms(articles(spark, d), TERMS, "raw_text"))


def _short(spark, d):
    return incoming(spark, d).withColumn("body", F.when(F.col("id") % 6 == 1, F.substring("raw_text", 1, 8)).otherwise(F.col("raw_text"))).withColumn("images", F.col("id") % 3)


def f14(spark, d):
    return X.length_gate(_short(spark, d), "body", "images").select("id", F.md5("gated_text").alias("text_md5"))


def f15(spark, d):
    return X.processing_outcomes(_short(spark, d), articles(spark, d).where("id % 3 <> 0"), "body", "images")


def f16(spark, d):
    rows = rich(spark, d).withColumn("summary", F.when(F.col("id") % 3 == 0, "FAILED: x").otherwise(F.col("summary")))
    return X.fallback_summary(rows, "FAILED", {"rss": ["ai_summary", "enhanced_markdown", "title"], "html": ["enhanced_markdown", "title"]}).select("id", "final_summary")


def f17(spark, d):
    fields = F.create_map(F.lit("Title"), F.col("title"), F.lit("Body"), F.col("raw_text"), F.lit("none"), F.lit(" "))
    return X.field_summary(articles(spark, d).withColumn("fields", fields), "fields").select("id", "field_summary")


def f18(spark, d):
    a = articles(spark, d)
    clean = F.regexp_replace("raw_text", r"[<`!\[\]]|https?://", " ")
    rows = a.select("id", F.concat(clean, F.lit(" see "), "url", F.lit("/a/b?x=1 and `"), "url", F.lit("` or [it]("), "url", F.lit(") end")).alias("t"))
    return X.autolink(rows, "t").select("id", F.md5("linked").alias("linked_md5"), "n_links")


def f19(spark, d):
    key = X.cache_key(F.lit("summary"), F.lit("m1"), F.lit("local"), F.col("raw_text"), F.lit("p"))
    requests = incoming(spark, d).withColumn("cache_key", key).select("id", "cache_key")
    cache = articles(spark, d).where("id % 3 <> 0").withColumn("cache_key", key).select("cache_key", F.col("title").alias("result"))
    hits, misses = X.cache_misses(requests, cache)
    return hits.select("id", "cache_key", F.lit(True).alias("hit")).unionByName(misses.withColumn("hit", F.lit(False)))


def f20(spark, d):
    n = F.col("rule_order")
    r = rules(spark, d).select("rule_id", (n % 2 == 0).alias("enable_formatting"), (n % 3 == 0).alias("enable_summary"), F.lit("").alias("formatting_prompt"), F.concat(F.lit("s"), n.cast("string")).alias("summary_prompt"))
    a = rich(spark, d).withColumns({"formatting_prompt": F.when(F.col("id") % 10 == 0, "own").otherwise(""), "summary_prompt": F.lit(None).cast("string")})
    return X.enrichment_plan(a, r)


def f21(spark, d):
    a = rich(spark, d).select("id", "enhanced_markdown", "ai_summary")
    i = F.col("id")
    kind = F.when(i % 4 == 0, "full").when(i % 4 == 1, "formatting").when(i % 4 == 2, "summary").otherwise("reset")
    r = a.where("id % 3 = 0").select("id", kind.alias("kind"), F.when(i % 8 != 0, F.concat(F.lit("e"), i.cast("string"))).alias("enhanced_markdown"), F.concat(F.lit("s"), i.cast("string")).alias("ai_summary"))
    return X.apply_enrichment(a, r)


def f22(spark, d):
    i = F.col("id")
    a = articles(spark, d)
    results = a.select("id", F.when(i % 2 == 0, "failed").otherwise("done").alias("status"), F.when(i % 3 == 0, "Content Risk found").otherwise("timeout").alias("error"))
    return X.redacted_retry_set(results, a, TERMS[:2], "content risk|content_filter").select("id", F.md5("redacted").alias("redacted_md5"))


_AI = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', ' ', 'g'), '\\[([^\\]]+)\\]\\(([^)]+)\\)', '\\1', 'g'), '(?m)^#{1,6}\\s*', '', 'g'), '(?m)^\\s*>\\s?', '', 'g'), '(?m)^\\s*([-*+]|\\d+\\.)\\s+', '', 'g'), '[*_~|`]', ' ', 'g'), '\\s+', ' ', 'g'))"
_INNER = "trim(regexp_replace(trim(line), '^(#{1,6}\\s+|>\\s?|(-|\\d+\\.)\\s+)', ''))"
_IMAGE, _LINK = "'^!\\[(.*?)\\]\\((.*?)\\)$'", "'^\\[(.*?)\\]\\((.*?)\\)$'"
BLOCKS = (
    "lines AS (SELECT id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM md)",
    f"""typed AS (SELECT *, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^#{{1,6}}\\s') THEN 'title' WHEN trim(line) IN ('---', '***', '___') THEN 'divider'
      WHEN starts_with(trim(line), '>') THEN 'quote' WHEN regexp_matches(trim(line), '^(-|\\d+\\.)\\s+') THEN 'list' WHEN regexp_matches(trim(line), {_IMAGE}) THEN 'image'
      WHEN regexp_matches(trim(line), {_LINK}) THEN 'link' ELSE 'paragraph' END AS type FROM lines)""",
    """marked AS (SELECT *, type = 'list' AND regexp_matches(trim(line), '^\\d') AS ordered, CASE WHEN type = lag(type, 1, '') OVER (PARTITION BY id ORDER BY n)
      AND (type = 'list' AND regexp_matches(trim(line), '^\\d')) = lag(type = 'list' AND regexp_matches(trim(line), '^\\d'), 1, false) OVER (PARTITION BY id ORDER BY n)
      AND type IN ('list', 'quote', 'paragraph') THEN 0 ELSE 1 END AS new FROM typed)""",
    "isl AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY n) AS b FROM marked)",
    f"""grouped AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY b) - 1 AS block_index, type, max(CASE WHEN type = 'title' THEN length(regexp_extract(trim(line), '^(#+)', 1)) ELSE 0 END) AS level, count(*) AS n_lines,
      coalesce(string_agg({_INNER}, chr(10) ORDER BY n) FILTER ({_INNER} <> ''), '') AS parts, trim(string_agg(rtrim(line), chr(10) ORDER BY n)) AS whole, min(trim(line)) AS line, bool_or(ordered) AS ordered
      FROM isl WHERE type <> 'blank' GROUP BY id, b, type)""",
    f"""named AS (SELECT *, trim(CASE type WHEN 'image' THEN regexp_extract(line, {_IMAGE}, 1) WHEN 'link' THEN regexp_extract(line, {_LINK}, 1) END) AS name,
      trim(CASE type WHEN 'image' THEN regexp_extract(line, {_IMAGE}, 2) WHEN 'link' THEN regexp_extract(line, {_LINK}, 2) END) AS url FROM grouped)""",
    """blocks AS (SELECT id, block_index, type, level, n_lines, CASE type WHEN 'paragraph' THEN whole WHEN 'divider' THEN '' WHEN 'image' THEN coalesce(nullif(name, ''), '图片')
      WHEN 'link' THEN coalesce(nullif(name, ''), url) ELSE parts END AS text, ordered, replace(parts, chr(10), '|') AS items, url, lower(regexp_extract(url, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)) AS hostname FROM named)""",
)
_KEY = "sha256('summary|m1|local|' || sha256(raw_text) || '|' || sha256('p'))"
_SHORT = "short AS (SELECT *, CASE WHEN id % 6 = 1 THEN substr(raw_text, 1, 8) ELSE raw_text END AS body, id % 3 AS images FROM incoming)"

QUERIES = {
    "f01_plain_text": (f01, sql(MD, f"p AS (SELECT id, {_AI} AS plain FROM md)", then="SELECT id, md5(plain) AS plain_md5, length(plain) AS plain_chars, length(regexp_replace(plain, '\\s+', '', 'g')) AS compact_chars FROM p")),
    "f02_best_text": (
        f02,
        sql(
            MD, f"p AS (SELECT md.id, trim(CASE WHEN md.id % 3 = 0 THEN regexp_replace(d.text, '[aeiou]', '', 'g') ELSE d.text END) AS r, {_AI} AS m, trim(regexp_replace(replace(replace(d.text, '<', ' '), '&', ' ') || ' tail', '\\s+', ' ', 'g')) AS h FROM md JOIN documents d ON d.doc_id = md.id)",
            "q AS (SELECT *, length(regexp_replace(r, '\\s+', '', 'g')) AS lr, length(regexp_replace(m, '\\s+', '', 'g')) AS lm, length(regexp_replace(h, '\\s+', '', 'g')) AS lh FROM p)",
            then="SELECT id, CASE WHEN lr >= lm AND lr >= lh THEN 'raw' WHEN lm >= lh THEN 'markdown' ELSE 'html' END AS best_from, CASE WHEN lr >= lm AND lr >= lh THEN length(r) WHEN lm >= lh THEN length(m) ELSE length(h) END AS n FROM q",
        ),
    ),
    "f03_explode_blocks": (f03, sql(MD, *BLOCKS, then="""SELECT id, block_index, type, level, n_lines, md5(text) AS text_md5, CASE WHEN type = 'title' THEN coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '[^\\p{L}\\p{N}_-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-|-$', '', 'g'), ''), 'section-' || CAST(block_index + 1 AS VARCHAR)) END AS anchor,
CASE WHEN type = 'list' THEN ordered END AS ordered, CASE WHEN type = 'list' THEN md5(items) END AS items_md5, url, CASE WHEN type = 'image' THEN text END AS alt, hostname FROM blocks""")),
    "f04_block_metrics": (f04, sql(MD, *BLOCKS, then="SELECT id, count(*) FILTER (type = 'title') AS headings, count(*) FILTER (type = 'list') AS lists, count(*) FILTER (type = 'paragraph') AS paragraphs, count(*) AS blocks FROM blocks GROUP BY id")),
    "f05_group_images": (
        f05,
        sql(
            MD, *BLOCKS, "g AS (SELECT id, block_index, block_index - row_number() OVER (PARTITION BY id ORDER BY block_index) AS i FROM blocks WHERE type = 'image')",
            then="""SELECT id, block_index, CASE WHEN count(*) OVER (PARTITION BY id, i) >= 2 THEN min(block_index) OVER (PARTITION BY id, i) END AS "group", count(*) OVER (PARTITION BY id, i) AS group_size, row_number() OVER (PARTITION BY id, i ORDER BY block_index) - 1 AS group_index FROM g""",
        ),
    ),
    "f06_attach_assets": (
        f06,
        sql(
            "b AS (SELECT doc_id AS id, k AS block_index, 'http://i/' || CAST((doc_id + k) % 3 AS VARCHAR) || CASE WHEN k % 2 = 1 THEN '?v=' || CAST(k AS VARCHAR) ELSE '#f' END AS url FROM documents, (SELECT unnest([0, 1, 2, 3]) AS k) x)",
            "a AS (SELECT doc_id AS id, k AS position, 'http://i/' || CAST((doc_id + 2 * k) % 3 AS VARCHAR) || CASE WHEN k % 2 = 1 THEN '?v=1' ELSE '' END AS url FROM documents, (SELECT unnest([0, 1, 2]) AS k) x)",
            "b1 AS (SELECT *, regexp_replace(url, '#.*$', '') AS u, row_number() OVER (PARTITION BY id, regexp_replace(url, '#.*$', '') ORDER BY block_index) AS r FROM b)",
            "a1 AS (SELECT *, url AS u, row_number() OVER (PARTITION BY id, url ORDER BY position) AS r FROM a)",
            "w AS (SELECT b1.id, b1.block_index, b1.url, a1.position AS p FROM b1 LEFT JOIN a1 USING (id, u, r))",
            "b2 AS (SELECT *, regexp_replace(url, '[?#].*$', '') AS u, row_number() OVER (PARTITION BY id, regexp_replace(url, '[?#].*$', '') ORDER BY block_index) AS r FROM w WHERE p IS NULL)",
            "a2 AS (SELECT a.*, regexp_replace(a.url, '[?#].*$', '') AS u, row_number() OVER (PARTITION BY a.id, regexp_replace(a.url, '[?#].*$', '') ORDER BY a.position) AS r FROM a LEFT JOIN w ON w.id = a.id AND w.p = a.position WHERE w.p IS NULL)",
            then="SELECT id, block_index, url, p AS asset_position FROM w WHERE p IS NOT NULL UNION ALL SELECT b2.id, b2.block_index, b2.url, a2.position FROM b2 LEFT JOIN a2 USING (id, u, r)",
        ),
    ),
    "f07_strip_symbols": (f07, sql(ARTICLES, then="SELECT id, CASE WHEN id % 3 = 0 THEN ' ' || title ELSE title END AS title, CASE WHEN id % 3 = 0 THEN 3 ELSE 0 END AS removed_chars FROM articles")),
    "f08_extract_tags": (
        f08,
        sql(ARTICLES, RICH, then="SELECT id, CASE WHEN id % 4 = 0 THEN 'tagA,' || source_name ELSE '' END AS tags, CASE WHEN id % 4 = 0 THEN trim(substr(raw_text, 1, 30)) ELSE trim(coalesce(summary, '')) END AS body FROM rich"),
    ),
    "f09_tag_items": (f09, "SELECT doc_id AS id, CASE WHEN doc_id % 8 = 0 THEN CASE p WHEN 1 THEN 'x' ELSE 'y' END ELSE CASE p WHEN 1 THEN 'p' ELSE 'q' END END AS tag, p AS priority, p = 1 AS is_primary FROM documents, (SELECT unnest([1, 2]) AS p) x WHERE doc_id % 8 < 2"),
    "f10_compose_tagged": (
        f10,
        sql(
            ARTICLES, RICH, "t AS (SELECT id, CASE id % 8 WHEN 0 THEN '【x】【y】' WHEN 1 THEN '【p】【q】' ELSE '' END AS line, trim(ai_summary) AS body FROM rich)",
            then="SELECT id, CASE WHEN line = '' THEN body WHEN body = '' THEN line ELSE line || chr(10) || body END AS tagged FROM t",
        ),
    ),
    "f11_chunk_documents": (f11, F11_SQL),
    "f12_recombine_chunks": (f12, "SELECT conv_id, count(*) AS n_chunks, md5(string_agg('## Part ' || CAST(turn + 1 AS VARCHAR) || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id"),
    "f13_redact_terms": (
        f13,
        """SELECT doc_id AS id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'idiot|moron', '[insult]', 'gi'), 'clown', '[name]', 'gi'), '\\binsult\\b', 'rude', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))) AS redacted_md5,
len(regexp_extract_all(text, '(?i)idiot|moron')) AS hits_insult, len(regexp_extract_all(text, '(?i)clown')) AS hits_name, len(regexp_extract_all(regexp_replace(text, 'idiot|moron', '[insult]', 'gi'), '\\binsult\\b')) AS hits_again FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10) || chr(10)) ELSE text END AS text FROM documents) d""",
    ),
    "f13_redaction_totals": (
        f13_totals,
        """WITH h AS (SELECT len(regexp_extract_all(text, '(?i)idiot|moron')) AS a, len(regexp_extract_all(text, '(?i)clown')) AS b, len(regexp_extract_all(regexp_replace(text, 'idiot|moron', '[insult]', 'gi'), '\\binsult\\b')) AS c FROM documents)
SELECT 'insult' AS label, CAST(sum(a) AS BIGINT) AS hits, count(*) FILTER (a > 0) AS docs FROM h UNION ALL SELECT 'name', CAST(sum(b) AS BIGINT), count(*) FILTER (b > 0) FROM h UNION ALL SELECT 'again', CAST(sum(c) AS BIGINT), count(*) FILTER (c > 0) FROM h""",
    ),
    "f14_length_gate": (
        f14,
        sql(ARTICLES, INCOMING, _SHORT, "s AS (SELECT *, length(regexp_replace(body, '[ \\n]', '', 'g')) AS n FROM short)", then="SELECT id, md5(CASE WHEN n < 10 THEN '[images: ' || CAST(images AS VARCHAR) || ']' ELSE body END) AS text_md5 FROM s WHERE n >= 10 OR images > 0"),
    ),
    "f15_processing_outcomes": (
        f15,
        sql(
            ARTICLES, INCOMING, _SHORT, "old AS (SELECT url, raw_hash FROM articles WHERE id % 3 <> 0)",
            then="""SELECT CASE WHEN length(regexp_replace(s.body, '[ \\n]', '', 'g')) < 10 AND images = 0 THEN 'content_too_short' WHEN old.url IS NULL THEN 'new' WHEN old.raw_hash = s.raw_hash THEN 'unchanged' ELSE 'updated' END AS reason, count(*) AS n
FROM short s LEFT JOIN old ON s.url = old.url GROUP BY 1""",
        ),
    ),
    "f16_fallback_summary": (
        f16,
        sql(
            ARTICLES, RICH,
            then="""SELECT id, CASE WHEN id % 3 <> 0 THEN coalesce(summary, '') WHEN source_type = 'rss' THEN coalesce(nullif(trim(ai_summary), ''), nullif(trim(enhanced_markdown), ''), trim(title)) ELSE coalesce(nullif(trim(enhanced_markdown), ''), trim(title)) END AS final_summary FROM rich""",
        ),
    ),
    "f17_field_summary": (
        f17,
        sql(
            ARTICLES, "p AS (SELECT id, trim(title) AS t, trim(raw_text) AS b FROM articles)",
            then="SELECT id, '- **Body**: ' || CASE WHEN length(b) > 200 THEN substr(b, 1, 200) || '...' ELSE b END || chr(10) || '- **Title**: ' || t AS field_summary FROM p",
        ),
    ),
    "f18_autolink": (
        f18,
        sql(
            ARTICLES,
            then="SELECT id, md5(regexp_replace(raw_text, '[<`!\\[\\]]|https?://', ' ', 'g') || ' see [feed.example.com/.../a/b](' || url || '/a/b?x=1) and `' || url || '` or [it](' || url || ') end') AS linked_md5, 1 AS n_links FROM articles",
        ),
    ),
    "f19_cache_misses": (f19, sql(ARTICLES, INCOMING, f"c AS (SELECT DISTINCT {_KEY} AS k FROM articles WHERE id % 3 <> 0)", then=f"SELECT id, {_KEY} AS cache_key, {_KEY} IN (SELECT k FROM c) AS hit FROM incoming")),
    "f20_enrichment_plan": (
        f20,
        sql(
            ARTICLES, RICH, RULES,
            """p AS (SELECT a.id, r.rule_order % 2 = 0 AND coalesce(enhanced_markdown, '') = '' AS f, r.rule_order % 3 = 0 AND coalesce(ai_summary, '') = '' AS s, r.rule_order AS o,
              CAST(CASE WHEN length(raw_text) <= 7000 THEN 1 ELSE ceil(length(raw_text) / 3600.0) END AS INTEGER) AS c FROM rich a LEFT JOIN rules r USING (rule_id))""",
            then="""SELECT id, f AS needs_formatting, s AS needs_summary, CASE WHEN id % 10 = 0 THEN 'own' ELSE 'default' END AS formatting_prompt, 's' || CAST(o AS VARCHAR) AS summary_prompt, c AS n_chunks,
CASE WHEN f OR s THEN least(600, 60 + 45 * c * (CAST(f AS INTEGER) + CAST(s AS INTEGER))) ELSE 0 END AS timeout_s FROM p""",
        ),
    ),
    "f21_apply_enrichment": (
        f21,
        sql(
            ARTICLES, RICH,
            then="""SELECT id, CASE WHEN id % 3 <> 0 THEN enhanced_markdown WHEN id % 4 = 3 THEN '' WHEN id % 4 IN (0, 1) AND id % 8 <> 0 THEN 'e' || CAST(id AS VARCHAR) ELSE enhanced_markdown END AS enhanced_markdown,
CASE WHEN id % 3 <> 0 THEN ai_summary WHEN id % 4 = 3 THEN '' WHEN id % 4 IN (0, 2) THEN 's' || CAST(id AS VARCHAR) ELSE ai_summary END AS ai_summary FROM rich""",
        ),
    ),
    "f22_redacted_retry": (
        f22,
        """SELECT doc_id AS id, md5(r) AS redacted_md5 FROM (SELECT doc_id, text, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'idiot|moron', '[insult]', 'gi'), 'clown', '[name]', 'gi'), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS r FROM documents) x
WHERE doc_id % 6 = 0 AND r <> trim(regexp_replace(regexp_replace(text, '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))""",
    ),
}
