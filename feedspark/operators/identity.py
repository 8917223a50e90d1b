"""Identity, deduplication and upserts of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedspark.functions.urls import canonical


def canonical_url_groups(rows: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """One row per canonical URL: members and the smallest key with its URL."""
    return rows.groupBy(canonical(F.col(url)).alias("canonical_url")).agg(F.count("*").alias("members"), F.min(key).alias("first_key"), F.min_by(url, key).alias("first_url"))


def dedup_keep_first(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\s\\u3000]+", " "))


def fingerprint_keys(items: DataFrame, page_url: str, source: str, title: str, date: str, body: str, fields: str) -> DataFrame:
    """`item_key`: page URL and 16 digits of SHA-1 over source, title, date, body and the sorted fields that hold no link."""
    pairs = F.transform(F.map_entries(F.coalesce(F.col(fields), F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(_clean(e["key"])).alias("k"), _clean(e["value"]).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda e: (e["k"] != "") & (e["v"] != "") & ~e["k"].rlike("url|link|href")))
    text = F.concat(F.lit("["), F.array_join(F.transform(kept, lambda e: F.concat(F.lit('["'), e["k"], F.lit('","'), e["v"], F.lit('"]'))), ","), F.lit("]"))
    page = canonical(F.col(page_url), keep_virtual=False)
    parts = F.filter(F.array(page, *(_clean(F.col(c)) for c in (source, title, date, body)), text), lambda x: x != "")
    print_ = F.substring(F.sha1(F.array_join(parts, "||")), 1, 16)
    return items.withColumn("item_key", F.concat(page, F.lit("#item-"), print_))


def classify_changes(incoming: DataFrame, stored: DataFrame, url: str = "url", hash_: str = "raw_hash") -> DataFrame:
    """incoming with `change`: new, updated, unchanged or invalid_url, by canonical URL and content hash."""
    old = stored.select(canonical(F.col(url)).alias("_key"), F.col(hash_).alias("_old")).groupBy("_key").agg(F.max("_old").alias("_old"), F.lit(True).alias("_there"))
    rows = incoming.withColumn("_key", canonical(F.col(url))).join(old, "_key", "left")
    change = F.when(F.col("_key") == "", "invalid_url").when(F.col("_there").isNull(), "new").when(F.col("_old").eqNullSafe(F.col(hash_)), "unchanged").otherwise("updated")
    return rows.withColumn("change", change).drop("_key", "_old", "_there")


def merge_articles(stored: DataFrame, incoming: DataFrame, order: str, on_update: str = "replace", flags: tuple[str, ...] = ("is_read", "is_favorite", "is_deleted")) -> DataFrame:
    """Upsert by canonical URL; the last incoming row in `order` wins. replace: flags fall back to false;
    preserve_user_state: flags of the stored row stay."""
    new = dedup_keep_first(incoming.withColumn("_key", canonical(F.col("url"))).where("_key <> ''"), ["_key"], [F.desc(order)])
    old = stored.withColumn("_key", canonical(F.col("url")))
    if on_update == "preserve_user_state":
        kept = old.groupBy("_key").agg(*(F.max(f).alias(f"_{f}") for f in flags))
        new = new.join(kept, "_key", "left").withColumns({f: F.coalesce(f"_{f}", F.lit(False)) for f in flags})
    else:
        new = new.withColumns({f: F.lit(False) for f in flags})
    rest = old.join(new.select("_key"), "_key", "left_anti")
    return rest.select(stored.columns).unionByName(new.select(stored.columns))


def insert_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Stored rows win; of incoming rows with one key the first stays."""
    new = dedup_keep_first(incoming, keys, order).join(stored.select(keys), keys, "left_anti")
    return stored.unionByName(new.select(stored.columns))


def exists_by_key(rows: DataFrame, stored: DataFrame, url: str = "url") -> DataFrame:
    """rows with `is_stored`."""
    known = stored.select(canonical(F.col(url)).alias("_key")).distinct().withColumn("_there", F.lit(True))
    return rows.withColumn("_key", canonical(F.col(url))).join(known, "_key", "left").withColumn("is_stored", F.coalesce("_there", F.lit(False))).drop("_key", "_there")


def merge_cache(cache: DataFrame, results: DataFrame, key: str, value: str, now: Column) -> DataFrame:
    """Upsert that keeps created_at and refreshes updated_at of changed keys."""
    new = results.groupBy(key).agg(F.max(value).alias("_new"))  # of several results for a key the largest
    both = cache.join(new, key, "full_outer")
    return both.select(key, F.coalesce("_new", value).alias(value), F.coalesce("created_at", now).alias("created_at"), F.when(F.col("_new").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"))


def merge_frontiers(frontiers: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (source_name, section_name): the latest row, of equally late ones the largest URL; rows without source or URL are
    dropped."""
    good = new.where("coalesce(trim(source_name), '') <> '' and coalesce(trim(url), '') <> ''")
    good = good.groupBy("source_name", "section_name").agg(F.max_by("url", F.struct("updated_at", "url")).alias("url"), F.max("updated_at").alias("updated_at"))
    rest = frontiers.join(good.select("source_name", "section_name"), ["source_name", "section_name"], "left_anti")
    return rest.select("source_name", "section_name", "url", "updated_at").unionByName(good)


def sync_reference_rows(stored: DataFrame, desired: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and `action`: insert, update (some column differs), keep or extra (only stored)."""
    s = stored.select(F.col(key), F.struct(*columns).alias("_s"))
    d = desired.select(F.col(key), F.struct(*columns).alias("_d"))
    both = s.join(d, key, "full_outer")
    action = F.when(F.col("_s").isNull(), "insert").when(F.col("_d").isNull(), "extra").when(F.col("_s").eqNullSafe(F.col("_d")), "keep").otherwise("update")
    return both.select(key, action.alias("action"))


def merge_assets(primary: DataFrame, fallback: DataFrame, doc: str, attributes: list[str]) -> DataFrame:
    """Two lists of assets (doc, url, category, position, attributes) as one: of assets of one URL, or without one of equal
    attributes, the first occurrence wins, its empty attributes are filled by later ones, and `cover` overrides the category."""
    rows = primary.withColumn("_list", F.lit(0)).unionByName(fallback.withColumn("_list", F.lit(1)))
    order = F.struct("_list", "position")
    filled = [F.min_by(F.col(a), F.when(F.coalesce(F.col(a), F.lit("")) != "", order)).alias(a) for a in attributes]
    same = F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.to_json(F.struct("category", *attributes)))
    out = rows.groupBy(doc, F.coalesce("url", F.lit("")).alias("url"), same.alias("_same")).agg(F.min(order).alias("_o"), F.min_by("category", order).alias("_c"), F.max((F.col("category") == "cover").cast("int")).alias("_cover"), *filled)
    w = Window.partitionBy(doc).orderBy("_o")
    return out.select(doc, "url", F.when(F.col("_cover") == 1, "cover").otherwise(F.col("_c")).alias("category"), (F.row_number().over(w) - 1).alias("position"), *attributes)


def merge_attachments(a: DataFrame, b: DataFrame, doc: str) -> DataFrame:
    """Both lists of attachments (doc, url, name, position), without repeated or empty URLs, numbered anew."""
    rows = a.withColumn("_list", F.lit(0)).unionByName(b.withColumn("_list", F.lit(1))).where("coalesce(trim(url), '') <> ''")
    first = dedup_keep_first(rows, [doc, "url"], ["_list", "position"])
    return first.withColumn("position", F.row_number().over(Window.partitionBy(doc).orderBy("_list", "position")) - 1).drop("_list")


EMAIL = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"


def dedup_recipients(recipients: DataFrame, order: str, size: int = 20) -> DataFrame:
    """Valid addresses once each whatever their case, first spelling kept, with the number of their batch."""
    good = recipients.withColumn("email", F.trim("email")).where(F.col("email").rlike(EMAIL) & (F.length("email") <= 254))
    first = good.groupBy(F.lower("email").alias("_k")).agg(F.min_by("email", order).alias("email"), F.min(order).alias(order)).drop("_k")
    return numbered(first, order, ["email"], "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def numbered(rows: DataFrame, order: str, ties: list[str], name: str, width: int = 50_000) -> DataFrame:
    """Gapless numbers from 1 by a whole-numbered column: rows are numbered inside stretches of `width` values and
    moved by the rows of the stretches before, so only counts by stretch meet in one place."""
    parts = rows.withColumn("_b", F.floor(F.col(order) / width))
    w = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("_b").agg(F.count("*").alias("_c")).select("_b", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(order, *ties))
    return parts.withColumn(name, own).join(before, "_b").withColumn(name, F.col(name) + F.col("_before")).drop("_b", "_before")
