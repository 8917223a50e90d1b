"""Analytics over tables of web pages, by pattern expressions on their HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedspark.functions.urls import host, part, registrable

FILES = r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|rar|7z|tar|gz|csv|wps)(?:[?#]|$)"
IMAGES = r"(?i)\.(jpe?g|png|gif|webp|bmp|svg)(?:[?#]|$)"
_html = lambda c="html": F.coalesce(F.col(c), F.lit(""))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag's text; empty where it is absent."""
    return F.regexp_extract(tag, f"(?is)\\s{name}\\s*=\\s*[\"']([^\"']*)[\"']", 1)


def bare(text: Column) -> Column:
    """Text without tags, the common references decoded, white space single."""
    t = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(to))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def absolute(base: Column, link: Column) -> Column:
    """A link against its page's URL."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(part(base, 3), "[^/]*$", "")
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(part(base, 1), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("#") | link.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def page_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, n, text, link, kind (attachment, image, page): one row per anchor; script links are skipped."""
    tags = F.regexp_extract_all(_html(), F.lit(r"(?is)(<a\s[^>]*>.*?</a>)"), F.lit(1))
    rows = pages.select(key, "url", F.posexplode(tags).alias("n", "tag"))
    rows = rows.withColumn("href", F.trim(_attribute(F.col("tag"), "href"))).where("href <> '' and not lower(href) like 'javascript:%'")
    link = absolute(F.col("url"), F.col("href"))
    kind = F.when(F.col("href").rlike(FILES) | F.col("href").rlike("(?i)download"), "attachment").when(F.col("href").rlike(IMAGES), "image").otherwise("page")
    return rows.select(key, "n", bare(F.col("tag")).alias("text"), link.alias("link"), kind.alias("kind"))


def page_attachments(links: DataFrame, blacklist: DataFrame, key: str = "page_id") -> DataFrame:
    """Attachments once per page and link, the first by place, without blacklisted names (name)."""
    rows = links.where("kind = 'attachment'").join(blacklist.select(F.col("name").alias("text")), "text", "left_anti")
    w = Window.partitionBy(key, "link").orderBy("n")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, "n", "text", "link")


def page_images(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, n, src, alt, width, height, ratio, hostname: images with lazy sources preferred; the page's og or twitter image if it
    has none."""
    tags = F.regexp_extract_all(_html(), F.lit(r"(?is)(<img\s[^>]*>)"), F.lit(1))
    meta = F.regexp_extract(_html(), r"(?is)<meta[^>]*(?:og:image|twitter:image)[^>]*content=[\"']([^\"']+)[\"']", 1)
    fallback = F.when(meta != "", F.array(F.concat(F.lit('<img src="'), meta, F.lit('">')))).otherwise(F.array().cast("array<string>"))
    rows = pages.select(key, "url", F.posexplode(F.when(F.size(tags) > 0, tags).otherwise(fallback)).alias("n", "tag"))
    t = F.col("tag")
    src = F.coalesce(*(F.nullif(F.trim(_attribute(t, a)), F.lit("")) for a in ("data-src", "data-original", "data-lazy-src", "src")))
    size = lambda a: F.nullif(F.regexp_extract(_attribute(t, a), r"^(\d+)", 1), F.lit("")).cast("double")
    out = rows.withColumns({"src": src, "alt": _attribute(t, "alt"), "width": size("width"), "height": size("height")}).where("src is not null and not src like 'data:%'")
    full = absolute(F.col("url"), F.col("src"))
    return out.select(key, "n", full.alias("src"), "alt", "width", "height", F.when(F.col("height") > 0, F.round(F.col("width") / F.col("height"), 4)).alias("ratio"), host(full).alias("hostname"))


PRUNED = r"(?is)<(script|style|noscript|iframe|canvas|svg)\b[^>]*>.*?</\1\s*>"


def pruned(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), PRUNED, "")


def prune_html(pages: DataFrame) -> DataFrame:
    """pages with pruned_html, size_before and size_after."""
    return pages.withColumn("pruned_html", pruned(_html())).withColumns({"size_before": F.length(_html()), "size_after": F.length("pruned_html")})


def page_summary(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Title, description, canonical link, first eight headings, counts of elements and size after pruning."""
    h = _html()
    count = lambda t: F.regexp_count(h, F.lit(f"(?i)<{t}[\\s>]"))
    heads = F.transform(F.slice(F.regexp_extract_all(h, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1)), 1, 8), bare)
    return pages.select(
        key,
        bare(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.regexp_extract(h, r"(?is)<meta[^>]*name=[\"']description[\"'][^>]*content=[\"']([^\"']*)[\"']", 1).alias("description"),
        F.regexp_extract(h, r"(?is)<link[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']*)[\"']", 1).alias("canonical"),
        F.array_join(heads, " | ").alias("headings"),
        *(count(t).alias(n) for t, n in (("a", "n_links"), ("li", "n_items"), ("table", "n_tables"), ("article", "n_articles"), ("h[1-6]", "n_headings"))),
        F.length(pruned(h)).alias("size_after"),
        F.round(F.length(pruned(h)) / F.greatest(F.length(h), F.lit(1)), 4).alias("ratio"),
    )


def page_blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, block_index, tag, text: headings, paragraphs, list items and quotes in order."""
    blocks = F.regexp_extract_all(pruned(_html()), F.lit(r"(?is)(<(?:h[1-6]|p|li|blockquote)[\s>].*?</(?:h[1-6]|p|li|blockquote)>)"), F.lit(1))
    rows = pages.select(key, F.posexplode(blocks).alias("n", "block"))
    rows = rows.select(key, "n", F.lower(F.regexp_extract("block", r"^<([A-Za-z0-9]+)", 1)).alias("tag"), bare(F.col("block")).alias("text")).where("text <> ''")
    return rows.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("n")) - 1).alias("block_index"), "tag", "text")


#: Tags of regions, opening and closing.
REGION = r"(?is)</?(?:article|main|section|nav)(?:[\s/][^>]*)?>"


def page_regions(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, n, tag, html: every region (article, main, section, nav), nested ones too, with what lies inside but for region tags.

    A page's region tags are numbered and get the running depth of their name; an opening tag ends at the first later tag of its name that
    is one level up, or at the page's end if it is never closed."""
    h = pruned(_html())
    rows = pages.select(key, F.split(h, REGION, -1).alias("_parts"), F.regexp_extract_all(h, F.lit(REGION), F.lit(0)).alias("_tags"))
    named = F.transform("_tags", lambda x: F.struct(F.lower(F.regexp_extract(x, "^</?([A-Za-z]+)", 1)).alias("name"), F.when(x.startswith("</"), -1).otherwise(1).alias("step")))
    rows = rows.withColumn("_tags", named)
    depth = lambda m, i: F.aggregate(F.slice("_tags", 1, i + 1), F.lit(0), lambda d, k: d + F.when(k["name"] == m["name"], k["step"]).otherwise(0))
    rows = rows.withColumn("_tags", F.transform("_tags", lambda m, i: F.struct(m["name"].alias("name"), m["step"].alias("step"), i.alias("i"), depth(m, i).alias("depth"))))

    def region(m: Column) -> Column:
        ends = F.filter("_tags", lambda k: (k["i"] > m["i"]) & (k["name"] == m["name"]) & (k["depth"] == m["depth"] - 1))
        to = F.coalesce(F.get(ends, 0)["i"], F.size("_tags"))
        return F.struct(m["i"].alias("n"), m["name"].alias("tag"), F.array_join(F.slice("_parts", m["i"] + 2, to - m["i"]), " ").alias("html"))

    found = F.transform(F.filter("_tags", lambda m: m["step"] == 1), region)
    return rows.select(key, F.explode(found).alias("r")).select(key, "r.*")


def region_density(pages: DataFrame, key: str = "page_id", least: int = 3, most: int = 3) -> DataFrame:
    """key, rank, tag, n_links, text_chars: regions (article, main, section, nav, nested ones too) with enough links, the densest first."""
    rows = page_regions(pages, key).select(key, "n", "tag", F.regexp_count("html", F.lit(r"(?i)<a\s")).alias("n_links"), F.length(bare(F.col("html"))).alias("text_chars"))
    w = Window.partitionBy(key).orderBy(F.desc("n_links"), F.desc("text_chars"), "n")
    return rows.where(F.col("n_links") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("n")


def match_templates(pages: DataFrame, templates: DataFrame, key: str = "page_id", least: float = 32.0, most: int = 3) -> DataFrame:
    """key, rank, template_id, score of the best templates (template_id, profile, domains, url_pattern, title_words, markers, coverage)
    of every page. Templates are a small broadcast table; each page meets each once."""
    h, domain = _html(), host(F.col("url"))
    title = F.lower(bare(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    seen = pages.select(key, "url", h.alias("_h"), domain.alias("_d"), title.alias("_t"))
    both = seen.join(F.broadcast(templates), F.lit(True))
    hit = lambda xs, c: F.exists(xs, lambda x: F.contains(F.col(c), F.lower(x)))
    markers = F.size(F.filter("markers", lambda m: F.contains(F.col("_h"), m)))
    score = (
        F.when(hit("domains", "_d"), 38.0).otherwise(0.0)
        + F.when((F.col("url_pattern") != "") & F.regexp_like(F.col("url"), F.col("url_pattern")), 22.0).otherwise(0.0)
        + F.when(hit("title_words", "_t"), 6.0).otherwise(0.0)
        + F.least(12.0 * markers, F.lit(36.0))
        + F.round(14 * F.col("coverage"), 1)
    )
    rows = both.select(key, "template_id", "profile", F.round(score, 1).alias("score"), markers.alias("n_markers")).where(F.col("score") >= least)
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("n_markers"), "template_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("n_markers")


def site_profile(pages: DataFrame, matches: DataFrame, key: str = "page_id") -> DataFrame:
    """key, profile, confidence: by domain and page structure, or the best template's profile if it scores as high."""
    h, domain = _html(), host(F.col("url"))
    title = bare(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))
    edu = F.contains(domain, F.lit("edu.cn"))
    rules = [
        (F.contains(domain, F.lit("gov.cn")), "government_portal", 80.0),
        (edu & title.rlike("学院|书院|研究院|实验室"), "college_department", 84.0),
        (edu, "university_portal", 78.0),
        (h.rlike(r"class=\"[^\"]*(entry-content|post-list)|<article[^>]*class=\"[^\"]*post"), "content_cms", 68.0),
        (h.rlike(r"class=\"[^\"]*(listbox|news-list|article-list)"), "campus_cms", 62.0),
    ]
    name, score = F.lit("general_site"), F.lit(36.0)
    for when, n, s in reversed(rules):
        name, score = F.when(when, n).otherwise(name), F.when(when, s).otherwise(score)
    best = matches.where("rank = 1").select(key, F.col("profile").alias("_p"), F.col("score").alias("_s"))
    rows = pages.select(key, name.alias("_n"), score.alias("_c")).join(best, key, "left")
    better = F.coalesce(F.col("_s") >= F.col("_c"), F.lit(False))
    return rows.select(key, F.when(better, F.col("_p")).otherwise(F.col("_n")).alias("profile"), F.when(better, F.col("_s")).otherwise(F.col("_c")).alias("confidence"))


def pieces_of(text: Column, lengths: list[int]) -> Column:
    """The different substrings of a text that have one of the lengths."""
    long = F.length(text)
    of = lambda n: F.when(long >= n, F.transform(F.sequence(F.lit(1), long - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *(of(n) for n in lengths)))


def classify_site_type(pages: DataFrame, keywords: DataFrame, key: str = "page_id") -> DataFrame:
    """key, site_type: the type of the first keyword (ord, keyword, type) that occurs in the URL, else general.

    A URL's pieces of the keywords' lengths are joined with the keywords, so that work grows with URLs and lengths, not with the number of
    keywords."""
    lengths = sorted(r[0] for r in keywords.select(F.length("keyword")).distinct().collect() if r[0] is not None)
    pieces = pages.select(key, F.explode(pieces_of(F.lower("url"), lengths)).alias("keyword"))
    hits = pieces.join(keywords, "keyword").groupBy(key).agg(F.min_by("type", "ord").alias("site_type"))
    return pages.select(key).join(hits, key, "left").withColumn("site_type", F.coalesce("site_type", F.lit("general")))


def site_type_distribution(classified: DataFrame) -> DataFrame:
    """site_type, n, percent."""
    g = classified.groupBy("site_type").agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 2))


def domain_rollup(pages: DataFrame) -> DataFrame:
    """domain, pages, hosts by registrable domain."""
    h = host(F.col("url"))
    return pages.groupBy(registrable(h).alias("domain")).agg(F.count("*").alias("pages"), F.count_distinct(h).alias("hosts"))


def same_site_frames(pages: DataFrame, key: str = "page_id", most: int = 3) -> DataFrame:
    """key, n, src: frames of the page's own registrable domain, the first few."""
    tags = F.regexp_extract_all(_html(), F.lit(r"(?is)(<i?frame\s[^>]*>)"), F.lit(1))
    rows = pages.select(key, "url", F.posexplode(tags).alias("n", "tag")).withColumn("src", absolute(F.col("url"), F.trim(_attribute(F.col("tag"), "src"))))
    own = rows.where(registrable(host(F.col("src"))) == registrable(host(F.col("url"))))
    w = Window.partitionBy(key).orderBy("n")
    return own.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select(key, "n", "src")


def thin_entries(entries: DataFrame, markdown: str, images: str) -> DataFrame:
    """Entries of less than 160 characters of Markdown, unless 120 plain characters and several images make up for it."""
    from feedspark.operators.text import plain

    return entries.where((F.length(F.coalesce(F.col(markdown), F.lit(""))) < 160) & ~((F.length(plain(F.col(markdown))) >= 120) & (F.col(images) > 1)))


def prefer_fuller_detail(entries: DataFrame, details: DataFrame, key: str, text: str) -> DataFrame:
    """entries whose text is the detail's where that is longer."""
    rows = entries.join(details.select(key, F.col(text).alias("_d")), key, "left")
    fuller = F.coalesce(F.length("_d"), F.lit(0)) > F.coalesce(F.length(text), F.lit(0))
    return rows.withColumns({text: F.when(fuller, F.col("_d")).otherwise(F.col(text)), "from_detail": fuller}).drop("_d")


def detail_fallback(items: DataFrame, details: DataFrame, key: str, columns: list[str], strategy: str) -> DataFrame:
    """items resolved against their detail rows: list_only keeps the list's columns, detail_preferred takes the detail's where
    they aren't empty, hybrid fills empty ones from the detail."""
    if strategy == "list_only":
        return items
    filled = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    rows = items.join(details.select(key, *(F.col(c).alias(f"_{c}") for c in columns)), key, "left")
    order = (lambda c: (f"_{c}", c)) if strategy == "detail_preferred" else (lambda c: (c, f"_{c}"))
    return rows.withColumns({c: F.coalesce(*(filled(x) for x in order(c))) for c in columns}).select(items.columns)


def map_fields_by_alias(items: DataFrame, fields: str, aliases: dict[str, list[str]], default_title: str = "untitled") -> DataFrame:
    """items with a column for each name: the value of its first alias among the fields' keys, whatever the case; of keys that
    differ by case alone the first filled one in order."""
    entries = F.array_sort(F.transform(F.map_entries(F.col(fields)), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["key"].alias("o"), e["value"].alias("v"))))
    rows = items.withColumn("_m", entries)
    filled = lambda a: F.get(F.filter("_m", lambda e: (e["k"] == a.lower()) & (F.trim(F.coalesce(e["v"], F.lit(""))) != "")), 0)["v"]
    new = {n: F.coalesce(*(F.trim(filled(a)) for a in names), F.lit(default_title if n == "title" else "")) for n, names in aliases.items()}
    return rows.withColumns(new).drop("_m")
