"""Source profiles and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.operators.text import plain

#: Words that hint at a source's kind, and what each kind defaults to.
VISUAL = ["图集", "相册", "摄影", "画报", "gallery", "photo", "album"]
LONGFORM = ["专栏", "深度", "长文", "博客", "blog", "column", "essay", "newsletter", "weekly"]
DEFAULTS = {"visual": ("gallery", 12), "longform": ("deep_read", 6), "news": ("brief", 20)}


def profile_sources(docs: DataFrame, source: str, text: str, headings: str, lists: str, images: str) -> DataFrame:
    """source, profile and signals of its samples."""
    rows = docs.withColumn("_n", F.length(plain(F.col(text), "preview")))
    g = rows.groupBy(source).agg(F.count("*").alias("samples"), F.avg("_n").alias("_avg"), F.max("_n").alias("max_body_chars"), F.avg(headings).alias("_h"), F.avg(lists).alias("_l"), F.avg(images).alias("_i"))
    profile = F.when((F.col("_i") >= 3) & (F.col("_avg") < 1000), "visual").when((F.col("max_body_chars") >= 2600) | (F.col("_avg") >= 1800) | (F.col("_h") >= 3), "longform").otherwise("news")
    return g.select(source, profile.alias("profile"), "samples", "max_body_chars", F.floor("_avg").alias("avg_body_chars"), F.round("_h", 2).alias("avg_headings"), F.round("_l", 2).alias("avg_lists"), F.round("_i", 2).alias("avg_images"))


def profile_by_keywords(rules: DataFrame, profiles: DataFrame, source: str) -> DataFrame:
    """source, profile of rules without samples, by words in name, purpose and URL; news if none hints."""
    rest = rules.join(profiles.select(source).distinct(), source, "left_anti")
    text = F.lower(F.concat_ws(" ", source, "task_purpose", "url"))
    return rest.select(source, F.when(text.rlike("|".join(VISUAL)), "visual").when(text.rlike("|".join(LONGFORM)), "longform").otherwise("news").alias("profile"))


def resolve_strategy(rules: DataFrame, profiles: DataFrame, source: str) -> DataFrame:
    """rules with strategy_profile (explicit, else of the explicit template, else inferred, else news), template and max_items."""
    by_template = F.lit(None).cast("string")
    for name, (template, _) in DEFAULTS.items():
        by_template = F.when(F.col("template") == template, name).otherwise(by_template)
    rows = rules.join(profiles.select(source, F.col("profile").alias("_p")), source, "left")
    rows = rows.withColumn("strategy_profile", F.coalesce(F.nullif(F.col("profile"), F.lit("")), by_template, "_p", F.lit("news")))
    template, most = F.lit(""), F.lit(0)
    for name, (t, n) in DEFAULTS.items():
        template = F.when(F.col("strategy_profile") == name, t).otherwise(template)
        most = F.when(F.col("strategy_profile") == name, n).otherwise(most)
    return rows.withColumns({"template": F.coalesce(F.nullif(F.col("template"), F.lit("")), template), "max_items": F.coalesce("max_items", most)}).drop("_p")


def preview_diagnostics(docs: DataFrame, text: str, images: str, attachments: str) -> DataFrame:
    """docs with body_chars, warnings and preview_status."""
    n = F.length(plain(F.col(text), "preview"))
    warnings = F.when(n == 0, F.array(F.lit("body_missing"))).otherwise(
        F.array_compact(F.array(F.when(n < 70, "body_short"), F.when((F.col(images) >= 3) & (n < 160), "image_heavy"), F.when((F.col(images) == 0) & (F.col(attachments) == 0) & (n < 40), "media_missing")))
    )
    rows = docs.withColumns({"body_chars": n, "warnings": warnings})
    return rows.withColumn("preview_status", F.when(F.col("body_chars") == 0, "empty").when(F.size("warnings") > 0, "warning").otherwise("ready"))


def preview_rollup(diagnosed: DataFrame, source: str) -> DataFrame:
    """Documents by source and status, by source, and in all."""
    return diagnosed.rollup(source, "preview_status").agg(F.count("*").alias("n"))


def detail_preview_verdict(samples: DataFrame, rule: str = "rule_id") -> DataFrame:
    """rule, passed (every sample passed), and samples by status."""
    return samples.groupBy(rule).agg(F.bool_and(F.col("status") == "passed").alias("passed"), F.count("*").alias("samples"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "empty").alias("empty"))


def rule_sample_signal(samples: DataFrame, rule: str, fields: str, preferred: list[str]) -> DataFrame:
    """rule, has_signal: whether any sample has a value in a preferred field."""
    some = F.exists(F.array(*map(F.lit, preferred)), lambda k: F.trim(F.coalesce(F.try_element_at(F.col(fields), k), F.lit(""))) != "")
    return samples.groupBy(rule).agg(F.bool_or(some).alias("has_signal"))
