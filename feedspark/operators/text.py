"""Text derivation over document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EMOJI = "[\\x{1F1E6}-\\x{1F1FF}\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}\\x{FE0F}\\x{200D}]"
TAG = "【([^】\n]{1,15})】"
_none = lambda: F.array().cast("array<string>")


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def plain(text: Column, mode: str = "ai") -> Column:
    """Markdown or HTML as plain text; ai: images go; preview: their alternative text stays."""
    # fixed values: the patterns and their order, which decides where they overlap
    steps = [
        (r"!\[([^\]]*)\]\(([^)]+)\)", " " if mode == "ai" else "$1 "),
        (r"\[([^\]]+)\]\(([^)]+)\)", "$1"),
        (r"(?i)</?(?:loc|date|contact)[^>]*>", ""),
        (r"(?m)^#{1,6}\s*", ""),
        (r"(?m)^\s*>\s?", ""),
        (r"(?m)^\s*[-*+]\s+", ""),
        (r"(?m)^\s*\d+\.\s+", ""),
        ("`", " " if mode == "ai" else ""),
        (r"[*_~|]", " ") if mode == "ai" else (r"[*_~]", ""),
        (r"<[^>]+>", " "),
        (r"\s+", " "),
    ]
    out = _text(text)
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def plain_text_table(docs: DataFrame, text: str = "text", mode: str = "ai") -> DataFrame:
    """docs with plain, plain_chars and compact_chars (without white space)."""
    return docs.withColumn("plain", plain(F.col(text), mode)).withColumns({"plain_chars": F.length("plain"), "compact_chars": F.length(F.regexp_replace("plain", r"\s+", ""))})


def best_text(docs: DataFrame, raw: str, markdown: str, html: str) -> DataFrame:
    """docs with best_text and best_from: the longest of raw, markdown and html text without white space; ties: the first."""
    bare = F.regexp_replace(_text(html), r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    three = {"raw": F.trim(_text(raw)), "markdown": plain(F.col(markdown)), "html": F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " "))}
    rows = docs.withColumns({f"_{k}": v for k, v in three.items()})
    size = {k: F.length(F.regexp_replace(f"_{k}", r"\s+", "")) for k in three}
    which = F.when((size["raw"] >= size["markdown"]) & (size["raw"] >= size["html"]), "raw").when(size["markdown"] >= size["html"], "markdown").otherwise("html")
    rows = rows.withColumn("best_from", which)
    best = F.when(F.col("best_from") == "raw", F.col("_raw")).when(F.col("best_from") == "markdown", F.col("_markdown")).otherwise(F.col("_html"))
    return rows.withColumn("best_text", best).drop(*(f"_{k}" for k in three))


IMAGE, LINK = r"^!\[(.*?)\]\((.*?)\)$", r"^\[(.*?)\]\((.*?)\)$"


def line_type(line: Column) -> Column:
    t = F.trim(line)
    return (
        F.when(t == "", "blank")
        .when(t.rlike(r"^#{1,6}\s"), "title")
        .when(t.isin("---", "***", "___"), "divider")
        .when(t.startswith(">"), "quote")
        .when(t.rlike(r"^(-|\d+\.)\s+"), "list")
        .when(t.rlike(IMAGE), "image")
        .when(t.rlike(LINK), "link")
        .otherwise("paragraph")
    )


def explode_blocks(docs: DataFrame, key: str, text: str, unnamed: str = "图片") -> DataFrame:
    """key, block_index, type, level, n_lines, text, anchor (of a title: its letters and digits in lower case, or its place),
    ordered and items (of a list), url, alt and hostname (of an image or link): Markdown lines gathered in blocks. Neighbouring lines of a
    numbered or other list, a quote or a paragraph are one block; blank lines part blocks.

    A text stays one row: its lines are typed, the places where blocks begin are found, and each block is a slice; nothing is shuffled."""
    from feedspark.functions.urls import part

    lines = F.split(F.regexp_replace(_text(text), "\r\n?", "\n"), "\n")
    typed = F.transform(lines, lambda x: F.struct(x.alias("line"), line_type(x).alias("type"), F.trim(x).rlike(r"^\d").alias("ordered")))

    def begins(r: Column, i: Column) -> Column:
        last = F.get("_rows", i - 1)
        goes_on = r["type"].isin("quote", "paragraph") | ((r["type"] == "list") & (last["ordered"] == r["ordered"]))
        return (i == 0) | (last["type"] != r["type"]) | ~goes_on

    rows = docs.select(key, typed.alias("_rows"))
    starts = F.transform("_rows", lambda r, i: F.when(begins(r, i), i))
    rows = rows.withColumn("_starts", F.filter(starts, lambda i: i.isNotNull()))
    own = F.transform("_starts", lambda s, k: F.slice("_rows", s + 1, F.coalesce(F.get("_starts", k + 1), F.size("_rows")) - s))
    rows = rows.select(key, F.posexplode(F.filter(own, lambda x: x[0]["type"] != "blank")).alias("block_index", "_own"))
    inner = lambda x: F.trim(F.regexp_replace(F.trim(x["line"]), r"^(#{1,6}\s+|>\s?|(-|\d+\.)\s+)", ""))
    rows = rows.withColumns({"type": F.col("_own")[0]["type"], "n_lines": F.size("_own"), "_line": F.trim(F.col("_own")[0]["line"])})
    rows = rows.withColumn("_parts", F.filter(F.transform("_own", inner), lambda x: x != ""))
    kind = lambda *t: F.col("type").isin(*t)
    bracket = lambda n: F.trim(F.when(kind("image"), F.regexp_extract("_line", IMAGE, n)).otherwise(F.regexp_extract("_line", LINK, n)))
    named, url = F.nullif(bracket(1), F.lit("")), bracket(2)
    paragraph = F.trim(F.array_join(F.transform("_own", lambda x: F.rtrim(x["line"])), "\n"))
    words = F.when(kind("paragraph"), paragraph).when(kind("image"), F.coalesce(named, F.lit(unnamed))).when(kind("link"), F.coalesce(named, url)).when(kind("divider"), "").otherwise(F.array_join("_parts", "\n"))
    rows = rows.withColumn("text", words)
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim("text")), r"[^\p{L}\p{N}_-]+", "-"), "-{2,}", "-")
    anchor = F.coalesce(F.nullif(F.regexp_replace(slug, "^-|-$", ""), F.lit("")), F.concat(F.lit("section-"), (F.col("block_index") + 1).cast("string")))
    level = F.when(kind("title"), F.length(F.regexp_extract("_line", "^(#+)", 1))).otherwise(0)
    return rows.select(
        key, "block_index", "type", level.alias("level"), "n_lines", "text", F.when(kind("title"), anchor).alias("anchor"), F.when(kind("list"), F.col("_own")[0]["ordered"]).alias("ordered"),
        F.when(kind("list"), F.col("_parts")).alias("items"), F.when(kind("image", "link"), url).alias("url"), F.when(kind("image"), F.col("text")).alias("alt"), F.when(kind("image", "link"), F.lower(part(url, 2))).alias("hostname"),
    )


def block_metrics(blocks: DataFrame, key: str) -> DataFrame:
    kinds = {"headings": "title", "lists": "list", "paragraphs": "paragraph"}
    return blocks.groupBy(key).agg(*(F.count_if(F.col("type") == t).alias(n) for n, t in kinds.items()), F.count("*").alias("blocks"))


def group_adjacent_images(blocks: DataFrame, key: str) -> DataFrame:
    """Image blocks with group (its first block's index, null for a single image), group_size and group_index."""
    w = Window.partitionBy(key).orderBy("block_index")
    images = blocks.where("type = 'image'").withColumn("_i", F.col("block_index") - F.row_number().over(w))
    run = Window.partitionBy(key, "_i")
    out = images.withColumns({"group_size": F.count("*").over(run), "group_index": F.row_number().over(run.orderBy("block_index")) - 1, "_first": F.min("block_index").over(run)})
    return out.withColumn("group", F.when(F.col("group_size") >= 2, F.col("_first"))).drop("_i", "_first")


def attach_assets(blocks: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """Image blocks (key, block_index, url) with asset_position: the n-th block of a URL without fragment takes its n-th asset;
    blocks left over do the same by URL without query among assets left over."""

    def paired(b: DataFrame, a: DataFrame, name: Column) -> DataFrame:
        bb = b.withColumn("_u", name).withColumn("_r", F.row_number().over(Window.partitionBy(key, "_u").orderBy("block_index")))
        aa = a.withColumn("_u", name).withColumn("_r", F.row_number().over(Window.partitionBy(key, "_u").orderBy("position"))).select(key, "_u", "_r", F.col("position").alias("asset_position"))
        return bb.join(aa, [key, "_u", "_r"], "left").select(key, "block_index", "url", "asset_position")

    whole = paired(blocks, assets, F.regexp_replace("url", "#.*$", ""))
    done = whole.where("asset_position is not null")
    rest = assets.join(done.select(key, F.col("asset_position").alias("position")), [key, "position"], "left_anti")
    again = paired(whole.where("asset_position is null").drop("asset_position"), rest, F.regexp_replace("url", "[?#].*$", ""))
    return done.unionByName(again)


def strip_symbols(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with emoji removed from the columns and `removed_chars`."""
    new = {c: F.regexp_replace(_text(c), EMOJI, "") for c in columns}
    gone = sum((F.length(_text(c)) - F.length(new[c]) for c in columns), F.lit(0))
    return docs.withColumns({"removed_chars": gone} | new)


def normal_tags(tags: Column) -> Column:
    """At most three distinct non-empty tags of at most 15 characters."""
    clean = F.transform(F.coalesce(tags, _none()), lambda x: F.substring(F.trim(F.regexp_replace(x, "[【】]", "")), 1, 15))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: x != "")), 1, 3)


def leading_tags(text: Column) -> Column:
    """Tags of a text that begins with 【."""
    first = F.split(F.trim(_text(text)), "\n")[0]
    return F.when(F.trim(_text(text)).startswith("【"), normal_tags(F.regexp_extract_all(first, F.lit(TAG), F.lit(1)))).otherwise(_none())


def without_tags(text: Column) -> Column:
    """The text behind a leading line of tags; the whole text if there is none."""
    whole = F.trim(_text(text))
    return F.when(F.size(leading_tags(text)) > 0, F.trim(F.regexp_replace(whole, "^[^\n]*(\n|$)", ""))).otherwise(whole)


def tags_of(raw: Column) -> Column:
    """A JSON list of strings, else the text's 【tags】."""
    listed = F.from_json(F.trim(_text(raw)), "array<string>")
    return F.when(F.trim(_text(raw)).startswith("[") & listed.isNotNull(), listed).otherwise(F.regexp_extract_all(_text(raw), F.lit(TAG), F.lit(1)))


def tag_line(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda x: F.concat(F.lit("【"), x, F.lit("】"))), "")


def extract_tags(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumns({"tags": leading_tags(F.col(text)), "body": without_tags(F.col(text))})


def tag_items(docs: DataFrame, key: str, tags: str = "tags") -> DataFrame:
    return docs.select(key, F.posexplode(normal_tags(F.col(tags))).alias("_n", "tag")).select(key, "tag", (F.col("_n") + 1).alias("priority"), (F.col("_n") == 0).alias("is_primary"))


def compose_tagged(docs: DataFrame, tags: str, body: str) -> DataFrame:
    """docs with `tagged`: a line of tags, then the body."""
    line, rest = tag_line(normal_tags(F.col(tags))), F.trim(_text(body))
    return docs.withColumn("tagged", F.when(line == "", rest).when(rest == "", line).otherwise(F.concat(line, F.lit("\n"), rest)))


#: White space and line ends as Python's str methods know them.
SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def _packed(parts: Column, sep: str, full) -> Column:
    """parts (an array of non-empty texts) in order, joined by sep until full(open text, next part)."""
    start = F.struct(_none().alias("done"), F.lit("").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        cut = (acc["open"] != "") & full(acc["open"], part)
        joined = F.when(cut | (acc["open"] == ""), part).otherwise(F.concat(acc["open"], F.lit(sep), part))
        return F.struct(F.when(cut, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), joined.alias("open"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def chunk_documents(docs: DataFrame, key: str, text: str, trigger: int = 7000, target: int = 3600, hard: int = 4600) -> DataFrame:
    """key, chunk_index, chunk: texts of `trigger` characters or more in chunks of at most `hard`, shorter ones whole; none for an empty text.
    Blocks are parted by blank lines. A block above `hard` becomes pieces of whole lines joined by one line feed (a longer line stays
    whole). Blocks are packed in order up to `hard`; in front of a heading a chunk ends once it has `target` characters."""
    body = _strip(_text(text))
    stripped = lambda parts: F.filter(F.transform(parts, _strip), lambda x: x != "")

    def pieces(block: Column) -> Column:
        lines = F.transform(F.filter(F.split(block, LINE_END), lambda x: _strip(x) != ""), lambda x: F.regexp_replace(x, f"{SPACES}+$", ""))
        return stripped(_packed(lines, "\n", lambda now, line: F.length(now) + 1 + F.length(line) + 1 > hard))

    blocks = stripped(F.split(body, f"\n{SPACES}*\n"))
    blocks = F.flatten(F.transform(blocks, lambda b: F.when(F.length(b) > hard, pieces(b)).otherwise(F.array(b))))
    full = lambda now, b: (F.length(now) + 2 + F.length(b) > hard) | ((F.length(now) >= target) & b.startswith("#"))
    chunks = F.when(body == "", _none()).when(F.length(body) < trigger, F.array(body)).otherwise(_packed(blocks, "\n\n", full))
    return docs.select(key, F.posexplode(chunks).alias("chunk_index", "chunk"))


def recombine_chunks(chunks: DataFrame, key: str, index: str, text: str, heading: str | None = None) -> DataFrame:
    """Chunks of each document in order as one text, each under a heading with its number if asked for."""
    name = F.concat(F.lit(heading), F.lit(" "), (F.col(index) + 1).cast("string"), F.lit("\n")) if heading else F.lit("")
    parts = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.concat(name, F.trim(_text(text))).alias("t"))))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"), F.count("*").alias("n_chunks"))


def redact_terms(docs: DataFrame, dictionary: list[tuple[str, str, str]], text: str) -> DataFrame:
    """docs with `redacted` and one column hits_<label> for each label of the ordered (pattern, replacement, label) list. Runs of
    blanks become one, of line feeds at most two stay."""
    now, hits = _text(text), {}
    for pattern, to, label in dictionary:
        hits[f"hits_{label}"] = hits.get(f"hits_{label}", F.lit(0)) + F.regexp_count(now, F.lit(pattern))
        now = F.regexp_replace(now, pattern, to)
    return docs.withColumns({"redacted": F.trim(F.regexp_replace(F.regexp_replace(now, "[ \t]{2,}", " "), "\n{3,}", "\n\n"))} | hits)


def redaction_totals(redacted: DataFrame) -> DataFrame:
    """label, hits, docs (with a hit) over all documents, from the hits_ columns."""
    own = [c for c in redacted.columns if c.startswith("hits_")]
    sums = redacted.agg(*(F.sum(c).alias(c) for c in own), *(F.count_if(F.col(c) > 0).alias(f"docs_{c}") for c in own))
    each = F.array(*(F.struct(F.lit(c[5:]).alias("label"), F.col(c).alias("hits"), F.col(f"docs_{c}").alias("docs")) for c in own))
    return sums.select(F.explode(each).alias("x")).select("x.*")


def length_gate(docs: DataFrame, text: str, images: str, least: int = 10) -> DataFrame:
    """Documents of at least so many characters without blanks and line feeds; shorter ones with images stay with a marker."""
    size = F.length(F.regexp_replace(_text(text), "[ \n]", ""))
    kept = docs.where((size >= least) | (F.col(images) > 0))
    return kept.withColumn("gated_text", F.when(size < least, F.concat(F.lit("[images: "), F.col(images).cast("string"), F.lit("]"))).otherwise(F.col(text)))


def processing_outcomes(docs: DataFrame, stored: DataFrame, text: str, images: str, least: int = 10) -> DataFrame:
    """reason, n: content_too_short, invalid_url, new, updated or unchanged."""
    from feedspark.operators.identity import classify_changes

    size = F.length(F.regexp_replace(_text(text), "[ \n]", ""))
    judged = classify_changes(docs, stored)
    reason = F.when((size < least) & (F.col(images) == 0), "content_too_short").otherwise(F.col("change"))
    return judged.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def fallback_summary(docs: DataFrame, marker: str, candidates: dict[str, list[str]]) -> DataFrame:
    """docs with final_summary: where the summary begins with the failure marker, the first non-empty column of the list for
    its source type."""
    first = lambda cs: F.coalesce(*(F.nullif(F.trim(_text(c)), F.lit("")) for c in cs), F.lit(""))
    out = F.lit("")
    for kind, cs in candidates.items():
        out = F.when(F.col("source_type") == kind, first(cs)).otherwise(out)
    return docs.withColumn("final_summary", F.when(_text("summary").startswith(marker), out).otherwise(_text("summary")))


def field_summary(items: DataFrame, fields: str, most: int = 200) -> DataFrame:
    """items with field_summary: a line `- **key**: value` for each non-empty field in order of keys, values cut."""
    cut = lambda v: F.when(F.length(v) > most, F.concat(F.substring(v, 1, most), F.lit("..."))).otherwise(v)
    kept = F.array_sort(F.filter(F.map_entries(F.col(fields)), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != ""))
    return items.withColumn("field_summary", F.array_join(F.transform(kept, lambda e: F.concat(F.lit("- **"), e["key"], F.lit("**: "), cut(F.trim(e["value"])))), "\n"))


_LINK = r"(?s)`[^`]*`|!?\[[^\]]*\]\([^)]*\)|<[^>]+>|https?://[^\s<>()\[\]]+"


def autolink(docs: DataFrame, text: str, longest: int = 48) -> DataFrame:
    """docs with `linked` and n_links: bare URLs become labelled links; code, links and tags stay as they are."""
    body = _text(text)
    found = F.regexp_extract_all(body, F.lit(f"({_LINK})"), F.lit(1))
    between = F.split(body, _LINK, -1)

    def link(x: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(x, "^https?://", ""), "[?#].*$", "")
        parts = F.filter(F.split(bare, "/"), lambda p: p != "")
        label = F.when(F.size(parts) > 3, F.concat(parts[0], F.lit("/.../"), F.array_join(F.slice(parts, F.size(parts) - 1, 2), "/"))).otherwise(F.array_join(parts, "/"))
        return F.when(x.rlike("^https?://"), F.concat(F.lit("["), F.substring(label, 1, longest), F.lit("]("), x, F.lit(")"))).otherwise(x)

    pairs = F.zip_with(between, F.transform(found, link), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return docs.withColumns({"linked": F.array_join(pairs, ""), "n_links": F.size(F.filter(found, lambda x: x.rlike("^https?://")))})


def cache_key(scope: Column, model: Column, endpoint: Column, content: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("|", scope, model, endpoint, F.sha2(_text(content), 256), F.sha2(_text(prompt), 256)), 256)


def cache_misses(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached result, misses) of requests with a cache_key."""
    return requests.join(cache.groupBy("cache_key").agg(F.max("result").alias("result")), "cache_key"), requests.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def enrichment_plan(articles: DataFrame, rules: DataFrame, trigger: int = 7000, target: int = 3600) -> DataFrame:
    """id, needs_formatting, needs_summary, prompts, n_chunks and timeout_s by the article's rule; an article's own prompt wins."""
    own = rules.select("rule_id", "enable_formatting", "enable_summary", F.col("formatting_prompt").alias("_f"), F.col("summary_prompt").alias("_s"))
    rows = articles.join(own, "rule_id", "left")
    size = F.length(_text("raw_text"))
    chunks = F.when(size <= trigger, 1).otherwise(F.ceil(size / target)).cast("int")
    fmt = F.coalesce("enable_formatting", F.lit(False)) & (_text("enhanced_markdown") == "")
    summ = F.coalesce("enable_summary", F.lit(False)) & (_text("ai_summary") == "")
    prompt = lambda a, r: F.coalesce(F.nullif(_text(a), F.lit("")), F.nullif(_text(r), F.lit("")), F.lit("default"))
    return rows.select(
        "id", fmt.alias("needs_formatting"), summ.alias("needs_summary"), prompt("formatting_prompt", "_f").alias("formatting_prompt"), prompt("summary_prompt", "_s").alias("summary_prompt"),
        chunks.alias("n_chunks"), F.when(fmt | summ, F.least(F.lit(600), 60 + 45 * chunks * (fmt.cast("int") + summ.cast("int")))).otherwise(0).alias("timeout_s"),
    )


def apply_enrichment(articles: DataFrame, results: DataFrame) -> DataFrame:
    """Write results back by id: kind full takes both columns, formatting and summary one each, reset empties both."""
    rows = articles.join(results.select("id", "kind", F.col("enhanced_markdown").alias("_e"), F.col("ai_summary").alias("_s")), "id", "left")
    kind = F.coalesce("kind", F.lit(""))
    new = {
        "enhanced_markdown": F.when(kind == "reset", "").when(kind.isin("full", "formatting") & F.col("_e").isNotNull(), F.col("_e")).otherwise(F.col("enhanced_markdown")),
        "ai_summary": F.when(kind == "reset", "").when(kind.isin("full", "summary") & F.col("_s").isNotNull(), F.col("_s")).otherwise(F.col("ai_summary")),
    }
    return rows.withColumns(new).select(articles.columns)


def redacted_retry_set(results: DataFrame, docs: DataFrame, dictionary: list[tuple[str, str, str]], markers: str, key: str = "id") -> DataFrame:
    """key, redacted of failed results whose error names a content risk and whose text changes when redacted."""
    failed = results.where((F.col("status") == "failed") & F.lower(_text("error")).rlike(markers)).select(key).distinct()
    return redact_terms(docs.join(failed, key, "left_semi"), dictionary, "raw_text").where(F.col("redacted") != F.trim(F.regexp_replace(F.regexp_replace(_text("raw_text"), "[ \t]{2,}", " "), "\n{3,}", "\n\n"))).select(key, "redacted")
