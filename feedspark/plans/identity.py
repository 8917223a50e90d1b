"""Queries of identity and upsert operators with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedspark.operators import identity as I
from feedspark.plans.fixtures import ARTICLES, INCOMING, articles, incoming, sql, table

#: The SQL of a canonical URL, for URLs without percent signs, user or port.
_TRACK = ", ".join(f"'{x}'" for x in ["_hsenc", "_hsmi", "fbclid", "from", "gclid", "igshid", "mkt_tok", "mc_cid", "mc_eid", "ref", "ref_src", "share_from", "share_source", "si", "spm", "yclid", "session", "sessionid", "jsessionid", "phpsessid"])
CANON = f"""canon AS (
  SELECT *, scheme || '://' || host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END || CASE WHEN regexp_matches(fragment, '^(item-|virtual-)') THEN '#' || fragment ELSE '' END AS canonical_url
  FROM (SELECT *, lower(regexp_extract(url, '^([^:]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS host,
      regexp_replace(regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/{{2,}}', '/', 'g'), '(.)/$', '\\1') AS path,
      regexp_extract(url, '#(.*)$', 1) AS fragment,
      array_to_string(list_sort(list_filter(list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: CASE WHEN x LIKE '%=%' OR x = '' THEN x ELSE x || '=' END),
        lambda x: x <> '' AND NOT (lower(split_part(x, '=', 1)) IN ({_TRACK})) AND NOT starts_with(lower(x), 'utm_'))), '&') AS query
    FROM pages) p)"""


def b01(spark, d):
    return I.canonical_url_groups(table(spark, d, "pages"))


def b02(spark, d):
    return I.dedup_keep_first(articles(spark, d).select("id", "source_name", "title", "date"), ["title"], ["source_name", "id"])


def b03(spark, d):
    items = articles(spark, d).select("id", "url", "source_name", "title", "date", F.col("raw_text").alias("body"), F.create_map(F.lit("Kind"), F.col("source_type"), F.lit("link"), F.col("url"), F.lit("rule"), F.col("rule_id")).alias("fields"))
    return I.fingerprint_keys(items, "url", "source_name", "title", "date", "body", "fields").select("id", "item_key")


def b04(spark, d):
    stored = articles(spark, d).where("id % 3 <> 0")
    return I.classify_changes(incoming(spark, d), stored).groupBy("source_name", "change").agg(F.count("*").alias("n"))


_MERGED = ["id", "url", "source_name", "raw_hash", "is_read", "is_favorite", "is_deleted"]


def b05(spark, d):
    stored = articles(spark, d).where("id % 3 <> 0").select(_MERGED)
    return I.merge_articles(stored, incoming(spark, d).select(_MERGED), "id", "preserve_user_state")


def b05_replace(spark, d):
    stored = articles(spark, d).where("id % 3 <> 0").select(_MERGED)
    return I.merge_articles(stored, incoming(spark, d).select(_MERGED), "id")


def b06(spark, d):
    stored = articles(spark, d).where("id % 3 <> 0").select("id", "url", "raw_hash")
    return I.insert_ignore(stored, incoming(spark, d).select("id", "url", "raw_hash"), ["url"], ["id"])


def b07(spark, d):
    return I.exists_by_key(incoming(spark, d).select("id", "url"), articles(spark, d).where("id % 3 <> 0"))


def b08(spark, d):
    a = articles(spark, d)
    cache = a.where("id % 3 <> 0").select(F.col("url").alias("cache_key"), F.col("raw_hash").alias("result"), F.col("date").alias("created_at"), F.col("date").alias("updated_at"))
    results = incoming(spark, d).select(F.col("url").alias("cache_key"), F.col("raw_hash").alias("result"))
    return I.merge_cache(cache, results, "cache_key", "result", F.lit("2024-02-01"))


def b09(spark, d):
    a = articles(spark, d).withColumn("section_name", (F.col("id") % 5).cast("string"))
    old = a.where("id % 5 < 3").groupBy("source_name", "section_name").agg(F.min_by("url", "id").alias("url"), F.min("id").alias("updated_at"))
    new = a.where("id % 5 > 1").select(F.when(F.col("id") % 13 == 0, "").otherwise(F.col("source_name")).alias("source_name"), "section_name", "url", F.col("id").alias("updated_at"))
    return I.merge_frontiers(old, new)


def b10(spark, d):
    cols = ["c_name", "c_mktsegment"]
    c = table(spark, d, "customer").select("c_custkey", *cols)
    wanted = c.where("c_custkey % 7 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 1, "OTHER").otherwise(F.col("c_mktsegment")))
    return I.sync_reference_rows(c.where("c_custkey % 5 <> 0"), wanted, "c_custkey", cols)


def _assets(spark, d, k):
    a = articles(spark, d)
    return a.select("id", F.explode(F.array(*(F.struct(F.when((F.col("id") * (i + k)) % 5 == 4, "").otherwise(F.concat(F.lit("http://img/"), ((F.col("id") * (i + k)) % 5).cast("string"))).alias("url"), F.lit("cover" if (i + k) % 4 == 0 else "body").alias("category"), F.lit(i).alias("position"), F.when((F.col("id") + i + k) % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(f"alt{i}{k}-"), F.col("source_name"))).alias("alt")) for i in range(3)))).alias("x")).select("id", "x.*")


def b11(spark, d):
    return I.merge_assets(_assets(spark, d, 1), _assets(spark, d, 2), "id", ["alt"])


def b12(spark, d):
    pick = lambda k: _assets(spark, d, k).select("id", "url", F.col("alt").alias("name"), "position")
    return I.merge_attachments(pick(1), pick(2), "id")


def b13(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lower(F.replace("c_name", F.lit(" "), F.lit("_"))), F.lit("@example.com")).alias("email"))
    again = c.where("c_custkey % 10 = 0").withColumn("email", F.upper("email"))
    bad = c.where("c_custkey % 17 = 0").withColumn("email", F.concat(F.lit("no at "), "email"))
    return I.dedup_recipients(c.unionByName(again.withColumn("c_custkey", F.col("c_custkey") + 1_000_000)).unionByName(bad), "c_custkey")


_STORED = "stored AS (SELECT * FROM articles WHERE id % 3 <> 0)"
_ASSETS = lambda k: f"""a{k} AS (SELECT id, CASE WHEN id * (i + {k}) % 5 = 4 THEN '' ELSE 'http://img/' || CAST(id * (i + {k}) % 5 AS VARCHAR) END AS url, CASE WHEN (i + {k}) % 4 = 0 THEN 'cover' ELSE 'body' END AS category, i AS position,
  CASE WHEN (id + i + {k}) % 2 = 0 THEN '' ELSE 'alt' || CAST(i AS VARCHAR) || '{k}-' || source_name END AS alt FROM articles, (SELECT unnest([0, 1, 2]) AS i) t)"""  # noqa: E731
_MERGE = lambda flags: sql(
    ARTICLES, INCOMING, _STORED,
    then=f"""SELECT id, url, source_name, raw_hash, is_read, is_favorite, is_deleted FROM stored WHERE url NOT IN (SELECT url FROM incoming)
UNION ALL SELECT i.id, i.url, i.source_name, i.raw_hash, {flags} FROM incoming i LEFT JOIN stored s ON i.url = s.url""",
)

QUERIES = {
    "b01_canonical_url_groups": (b01, f"WITH {CANON} SELECT canonical_url, count(*) AS members, min(page_id) AS first_key, arg_min(url, page_id) AS first_url FROM canon GROUP BY canonical_url"),
    "b02_dedup_keep_first": (b02, sql(ARTICLES, then="SELECT id, source_name, title, date FROM articles QUALIFY row_number() OVER (PARTITION BY title ORDER BY source_name, id) = 1")),
    "b03_fingerprint_keys": (
        b03,
        sql(
            ARTICLES,
            then=r"""SELECT id, url || '#item-' || substr(sha1(url || '||' || source_name || '||' || trim(regexp_replace(title, '\s+', ' ', 'g')) || '||' || date || '||' || trim(regexp_replace(raw_text, '\s+', ' ', 'g')) ||
'||' || '[["kind","' || source_type || '"],["rule","' || rule_id || '"]]'), 1, 16) AS item_key FROM articles""",
        ),
    ),
    "b04_classify_changes": (
        b04,
        sql(ARTICLES, INCOMING, _STORED, then="SELECT i.source_name, CASE WHEN s.url IS NULL THEN 'new' WHEN s.raw_hash = i.raw_hash THEN 'unchanged' ELSE 'updated' END AS change, count(*) AS n FROM incoming i LEFT JOIN stored s ON i.url = s.url GROUP BY ALL"),
    ),
    "b05_merge_articles": (b05, _MERGE("coalesce(s.is_read, false), coalesce(s.is_favorite, false), coalesce(s.is_deleted, false)")),
    "b05_merge_articles_replace": (b05_replace, _MERGE("false, false, false")),
    "b06_insert_ignore": (b06, sql(ARTICLES, INCOMING, _STORED, then="SELECT id, url, raw_hash FROM stored UNION ALL SELECT id, url, raw_hash FROM incoming WHERE url NOT IN (SELECT url FROM stored)")),
    "b07_exists_by_key": (b07, sql(ARTICLES, INCOMING, _STORED, then="SELECT id, url, url IN (SELECT url FROM stored) AS is_stored FROM incoming")),
    "b08_merge_cache": (
        b08,
        sql(
            ARTICLES, INCOMING, _STORED,
            then="""SELECT coalesce(s.url, i.url) AS cache_key, coalesce(i.raw_hash, s.raw_hash) AS result, coalesce(s.date, '2024-02-01') AS created_at,
CASE WHEN i.url IS NOT NULL THEN '2024-02-01' ELSE s.date END AS updated_at FROM stored s FULL JOIN incoming i ON s.url = i.url""",
        ),
    ),
    "b09_merge_frontiers": (
        b09,
        sql(
            ARTICLES,
            "a AS (SELECT *, CAST(id % 5 AS VARCHAR) AS section_name FROM articles)",
            "old AS (SELECT source_name, section_name, arg_min(url, id) AS url, min(id) AS updated_at FROM a WHERE id % 5 < 3 GROUP BY ALL)",
            "new AS (SELECT source_name, section_name, arg_max(url, id) AS url, max(id) AS updated_at FROM a WHERE id % 5 > 1 AND id % 13 <> 0 GROUP BY ALL)",
            then="SELECT * FROM new UNION ALL SELECT * FROM old WHERE (source_name, section_name) NOT IN (SELECT (source_name, section_name) FROM new)",
        ),
    ),
    "b10_sync_reference_rows": (
        b10,
        """SELECT coalesce(s.c_custkey, d.c_custkey) AS c_custkey, CASE WHEN s.c_custkey IS NULL THEN 'insert' WHEN d.c_custkey IS NULL THEN 'extra' WHEN s.c_name = d.c_name AND s.c_mktsegment = d.c_mktsegment THEN 'keep' ELSE 'update' END AS action
FROM (SELECT * FROM customer WHERE c_custkey % 5 <> 0) s FULL JOIN (SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 1 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 0) d ON s.c_custkey = d.c_custkey""",
    ),
    "b11_merge_assets": (
        b11,
        sql(
            ARTICLES, _ASSETS(1), _ASSETS(2),
            "u AS (SELECT *, position AS o FROM a1 UNION ALL SELECT *, position + 10 AS o FROM a2)",
            "g AS (SELECT id, url, min(o) AS o, CASE WHEN bool_or(category = 'cover') THEN 'cover' ELSE arg_min(category, o) END AS category, arg_min(alt, o) FILTER (alt <> '') AS alt FROM u GROUP BY id, url, CASE WHEN url = '' THEN category || ' ' || alt ELSE '' END)",
            then="SELECT id, url, category, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS position, alt FROM g",
        ),
    ),
    "b12_merge_attachments": (
        b12,
        sql(
            ARTICLES, _ASSETS(1), _ASSETS(2),
            "u AS (SELECT *, position AS o FROM a1 UNION ALL SELECT *, position + 10 AS o FROM a2)",
            "g AS (SELECT id, url, min(o) AS o, arg_min(alt, o) AS name FROM u WHERE url <> '' GROUP BY id, url)",
            then="SELECT id, url, name, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS position FROM g",
        ),
    ),
    "b13_dedup_recipients": (
        b13,
        "SELECT c_custkey, lower(replace(c_name, ' ', '_')) || '@example.com' AS email, CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 20) AS BIGINT) AS batch FROM customer",
    ),
}
