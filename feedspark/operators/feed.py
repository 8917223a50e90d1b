"""Feed queries: projection, filters, pages, search and state changes of article tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEAVY = ("raw_text", "raw_markdown", "enhanced_markdown", "content_blocks", "body_html")
#: Columns that a search looks at, where a table has them.
SEARCHED = ("title", "summary", "ai_summary", "enhanced_markdown", "raw_markdown", "raw_text", "source_name", "category", "department", "rule_id", "ai_tags_text", "attachments_text")


def effective_time(created_at: str | None = None) -> Column:
    """exact_time, else the date's midnight, else created_at; as sortable text."""
    parts = [F.nullif(F.col("exact_time"), F.lit("")), F.concat(F.nullif(F.col("date"), F.lit("")), F.lit(" 00:00:00"))]
    return F.coalesce(*parts, *([F.col(created_at).cast("string")] if created_at else []))


def visible(articles: DataFrame) -> DataFrame:
    return articles.where(~F.coalesce(F.col("is_deleted"), F.lit(False)))


def source_filter(articles: DataFrame, names: list[str] | None) -> DataFrame:
    """None: all rows; an empty list: no row; else the rows of these sources."""
    if names is None:
        return articles
    return articles.where(F.col("source_name").isin(names)) if names else articles.where(F.lit(False))


def light_projection(articles: DataFrame) -> DataFrame:
    """Without heavy columns, marked as not whole."""
    return articles.select(*(c for c in articles.columns if c not in HEAVY), F.lit(False).alias("has_full_content"))


def feed_page(articles: DataFrame, limit: int, offset: int = 0, sources: list[str] | None = None, favorites_only: bool = False, light: bool = True) -> DataFrame:
    """A page of visible rows, newest first, ties by the larger id."""
    rows = source_filter(visible(articles), sources)
    rows = rows.where("is_favorite") if favorites_only else rows
    rows = light_projection(rows) if light else rows
    return rows.orderBy(F.desc_nulls_last(effective_time()), F.desc("id")).offset(offset).limit(limit)


def effective_sources(subscribed: DataFrame, rules: DataFrame) -> DataFrame:
    """source_name, ord: sources subscribed to and of enabled rules, without repetition, in order of first mention."""
    named = subscribed.select(F.lit(0).alias("_k"), F.trim("source_name").alias("source_name"), "ord")
    ruled = rules.where("enabled").select(F.lit(1).alias("_k"), F.trim("source_name").alias("source_name"), "ord")
    first = named.unionByName(ruled).where("source_name <> ''").groupBy("source_name").agg(F.min(F.struct("_k", "ord")).alias("_o"))
    return first.select("source_name", F.row_number().over(Window.orderBy("_o", "source_name")).alias("ord"))


def list_sources(articles: DataFrame, order: DataFrame) -> DataFrame:
    """source_name, ord: sources in the configured order, the others behind by name."""
    found = articles.where("coalesce(source_name, '') <> ''").select("source_name").distinct()
    placed = found.join(order.select("source_name", F.col("ord").alias("_o")), "source_name", "left")
    return placed.select("source_name", F.row_number().over(Window.orderBy(F.asc_nulls_last("_o"), "source_name")).alias("ord"))


def unread_count(articles: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Unread visible rows by source and, with a null source, in all."""
    return source_filter(visible(articles), sources).rollup("source_name").agg(F.count_if(~F.col("is_read")).alias("unread"))


def first_unread(articles: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """The newest unread row of each source."""
    rows = source_filter(visible(articles), sources).where("not is_read")
    w = Window.partitionBy("source_name").orderBy(F.desc_nulls_last(effective_time()), F.desc("id"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def count_by_source(articles: DataFrame) -> DataFrame:
    """Stored rows of each source, deleted ones too."""
    return articles.groupBy("source_name").agg(F.count("*").alias("n"))


def latest_cursor_by_source(articles: DataFrame) -> DataFrame:
    """Newest time (exact, else the date) and newest date of each source's visible rows."""
    cursor = F.coalesce(F.nullif(F.col("exact_time"), F.lit("")), F.col("date"))
    return visible(articles).groupBy("source_name").agg(F.max_by(cursor, F.struct(effective_time(), "id")).alias("cursor"), F.max_by("date", F.struct(effective_time(), "id")).alias("date"))


def terms_of(query: str) -> list[list[str]]:
    """OR parts of AND terms; blanks also mean AND."""
    import re

    groups = [re.split(r"\s+(?:AND\s+)?", g.strip()) for g in re.split(r"\s+OR\s+", query.strip())]
    return [[t for t in g if t and t not in ("AND", "OR")] for g in groups if g != [""]]


def matches(query: str, columns: list[str], wildcards: bool = False) -> Column:
    """True where some group's terms all occur in some column, whatever the case."""

    def one(term: str) -> Column:
        out = F.lit(False)
        for c in columns:
            text = F.lower(F.coalesce(F.col(c), F.lit("")))
            out = out | (text.like(f"%{term.lower()}%") if wildcards else F.contains(text, F.lit(term.lower())))
        return out

    out = F.lit(False)
    for group in terms_of(query):
        part = F.lit(True)
        for t in group:
            part = part & one(t)
        out = out | part
    return out


def search(articles: DataFrame, query: str, sources: list[str] | None = None, favorites_only: bool = False, limit: int = 50, wildcards: bool = False) -> DataFrame:
    """Visible rows that match, newest first; a blank query gives the first page of 20."""
    if not query.strip():
        return feed_page(articles, 20, 0, sources, favorites_only, light=False)
    rows = source_filter(visible(articles), sources)
    rows = rows.where("is_favorite") if favorites_only else rows
    rows = rows.where(matches(query, [c for c in SEARCHED if c in articles.columns], wildcards))
    return rows.orderBy(F.desc_nulls_last(effective_time()), F.desc("id")).limit(limit)


def search_tagged(articles: DataFrame, term: str, tags: str = "ai_tags", text: str = "title") -> DataFrame:
    """Rows with the term inside one of their tags or of a 【tag】 of their text."""
    inside = F.exists(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("【([^】\n]{1,15})】"), F.lit(1)), lambda x: F.contains(F.lower(x), F.lit(term.lower())))
    own = F.exists(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), F.lit(term.lower())))
    return articles.where(inside | own)


def search_snippets(hits: DataFrame, terms: list[str], shown: list[str], raw: str = "raw_text", before: int = 20, after: int = 30) -> DataFrame:
    """hits with `snippet`: for each term that no shown column has, the raw text around its first place, the term marked
    by **, joined by a blank; null if there is none."""
    seen = F.lower(F.concat_ws("\n", *shown))
    body = F.coalesce(F.col(raw), F.lit(""))

    def cut(t: Column) -> Column:
        at = F.instr(F.lower(body), t)
        start = F.greatest(at - before, F.lit(1))
        end = F.least(at + F.length(t) + after, F.length(body) + 1)
        lead = F.when(start > 1, "...").otherwise("")
        tail = F.when(end <= F.length(body), "...").otherwise("")
        return F.concat(lead, F.substring(body, start, at - start), F.lit("**"), F.substring(body, at, F.length(t)), F.lit("**"), F.substring(body, at + F.length(t), end - at - F.length(t)), tail)

    own = F.filter(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: ~F.contains(seen, t) & F.contains(F.lower(body), t))
    text = F.array_join(F.transform(own, cut), " ")
    return hits.withColumn("snippet", F.nullif(text, F.lit("")))


def prefix_scan(articles: DataFrame, prefix: str, order: str = "id") -> DataFrame:
    """Visible rows whose rule begins with a prefix, latest first."""
    return visible(articles).where(F.col("rule_id").startswith(prefix)).orderBy(F.desc(order))


def lookup(articles: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of the given keys."""
    return articles.join(keys.select(key).distinct(), key, "left_semi")


def resolve_payload(articles: DataFrame) -> DataFrame:
    """articles with tags, summary_body, summary_md, preview_md, enhanced_md and raw_md from new and legacy columns."""
    from feedspark.operators.text import leading_tags, normal_tags, tag_line, tags_of, without_tags

    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in articles.columns else F.lit("")
    first = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))
    rows = articles.withColumns({"_s": text("summary"), "_own": normal_tags(tags_of(F.col("ai_tags_text"))) if "ai_tags_text" in articles.columns else F.array().cast("array<string>")})
    rows = rows.withColumn("tags", F.when(F.size("_own") > 0, F.col("_own")).otherwise(leading_tags(F.col("_s"))))
    rows = rows.withColumn("summary_body", first(text("ai_summary"), without_tags(F.col("_s"))))
    rows = rows.withColumn("raw_md", first(text("raw_markdown"), text("raw_text")))
    tagged = F.when(F.size("tags") == 0, F.col("summary_body")).when(F.col("summary_body") == "", tag_line(F.col("tags"))).otherwise(F.concat(tag_line(F.col("tags")), F.lit("\n"), F.col("summary_body")))
    rows = rows.withColumn("enhanced_md", first(text("enhanced_markdown"), F.col("raw_md")))
    rows = rows.withColumn("summary_md", first(F.col("_s"), tagged, F.col("enhanced_md")))
    return rows.withColumn("preview_md", first(F.col("summary_body"), F.col("enhanced_md"), F.col("summary_md"))).drop("_s", "_own")


def source_distribution(page: DataFrame) -> DataFrame:
    """Rows of each source on a page."""
    return page.groupBy("source_name").agg(F.count("*").alias("n"))


def set_flags(articles: DataFrame, keys: DataFrame, op: str) -> DataFrame:
    """op: read, toggle_favorite or delete, for the rows whose id is among the keys."""
    marked = articles.join(keys.select("id").distinct().withColumn("_m", F.lit(True)), "id", "left").withColumn("_m", F.coalesce("_m", F.lit(False)))
    change = {"read": ("is_read", F.col("_m") | F.col("is_read")), "toggle_favorite": ("is_favorite", F.col("is_favorite") != F.col("_m")), "delete": ("is_deleted", F.col("_m") | F.col("is_deleted"))}
    return marked.withColumn(*change[op]).select(articles.columns)


def delete_cascade(articles: DataFrame, annotations: DataFrame, rule_ids: list[str], hard: bool = True) -> tuple[DataFrame, DataFrame]:
    """Articles and annotations after deleting rules' articles: dropped with their annotations, or only flagged."""
    gone = articles.where(F.col("rule_id").isin(rule_ids))
    if not hard:
        return articles.withColumn("is_deleted", F.col("is_deleted") | F.coalesce(F.col("rule_id").isin(rule_ids), F.lit(False))), annotations
    return articles.where(~F.coalesce(F.col("rule_id").isin(rule_ids), F.lit(False))), annotations.join(gone.select(F.col("id").alias("article_id")), "article_id", "left_anti")


def propagate_rule_config(articles: DataFrame, rules: DataFrame, columns: list[str]) -> DataFrame:
    """Copy rules' columns to their rss articles; null leaves the article's value."""
    own = rules.select("rule_id", *(F.col(c).alias(f"_{c}") for c in columns))
    pick = {c: F.when((F.col("source_type") == "rss") & F.col(f"_{c}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return articles.join(own, "rule_id", "left").withColumns(pick).select(articles.columns)


def match_rule_for_article(articles: DataFrame, rules: DataFrame) -> DataFrame:
    """id, rule_id, priority: the rule by its id, else by URL, else an enabled one by name of the source, else of a department
    other than the source; the first in order of the rules. Four equi-joins, each against one row a key."""
    first = lambda rows, key: rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(F.col(key).alias("_k")).agg(F.min(F.struct("rule_order", "rule_id")).alias("_r"))
    on = rules.where("enabled")
    keyed = [("rule_id", first(rules, "rule_id")), ("url", first(rules, "rule_url")), ("source_name", first(on, "task_name")), ("department", first(on, "task_name"))]
    out = articles.select("id", *(c for c, _ in keyed))
    for n, (c, r) in enumerate(keyed, 1):
        out = out.join(r.select(F.col("_k").alias(f"_k{n}"), F.col("_r").alias(f"_r{n}")), F.col(c) == F.col(f"_k{n}"), "left")
    out = out.withColumn("_r4", F.when(F.col("department") != F.col("source_name"), F.col("_r4")))
    which = F.when(F.col("_r1").isNotNull(), 1).when(F.col("_r2").isNotNull(), 2).when(F.col("_r3").isNotNull(), 3).when(F.col("_r4").isNotNull(), 4)
    return out.select("id", F.coalesce("_r1", "_r2", "_r3", "_r4")["rule_id"].alias("matched_rule"), which.alias("priority"))


def resolve_source_type(articles: DataFrame, rules: DataFrame) -> DataFrame:
    """articles with `resolved_type`: the rule's type if it is rss or html, else the article's, else html."""
    known = lambda c: F.when(F.lower(F.trim(F.col(c))).isin("rss", "html"), F.lower(F.trim(F.col(c))))
    own = rules.select("rule_id", F.col("source_type").alias("_t"))
    return articles.join(own, "rule_id", "left").withColumn("resolved_type", F.coalesce(known("_t"), known("source_type"), F.lit("html"))).drop("_t")
