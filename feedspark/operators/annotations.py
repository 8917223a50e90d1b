"""Annotation tables: spans of an article's text in a view mode, with a style."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Modes that a regenerated result makes void.
INVALIDATES = {"rss_full": ["enhanced", "summary"], "rss_formatting": ["enhanced", "summary"], "rss_reset": ["enhanced", "summary"]}


def annotations_for(annotations: DataFrame, articles: DataFrame, mode: str | None = None) -> DataFrame:
    """Annotations of the given articles (id), ordered by offsets."""
    rows = annotations.join(articles.select(F.col("id").alias("article_id")).distinct(), "article_id", "left_semi")
    rows = rows.where(F.col("view_mode") == mode) if mode else rows
    return rows.orderBy("article_id", "start_offset", "end_offset", "id")


def clamped(edits: DataFrame) -> DataFrame:
    """Offsets with start >= 0 and end >= start; styles normalised."""
    start = F.greatest(F.coalesce("start_offset", F.lit(0)), F.lit(0)).cast("long")
    color = F.lower(F.trim(F.coalesce("color", F.lit(""))))
    return edits.withColumns({"start_offset": start, "end_offset": F.greatest(F.coalesce("end_offset", F.lit(0)), start).cast("long"), "color": F.when(color == "", "yellow").otherwise(color)})


def merge_annotations(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits update stored rows of the same (id, article_id); others are inserted."""
    new = clamped(edits).select(stored.columns)
    return stored.join(new.select("id", "article_id"), ["id", "article_id"], "left_anti").select(stored.columns).unionByName(new)


def delete_annotations(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """Without rows of the keys: by id, or by article_id and view_mode, whichever columns the keys have."""
    on = [c for c in ("id", "article_id", "view_mode") if c in keys.columns]
    return stored.join(keys.select(on).distinct(), on, "left_anti").select(stored.columns)


def invalidate_annotations(annotations: DataFrame, regenerated: DataFrame) -> DataFrame:
    """Without annotations of the modes that each regenerated article's kind (article_id, kind) makes void."""
    modes = F.array(F.lit("summary"))
    for kind, names in INVALIDATES.items():
        modes = F.when(F.col("kind") == kind, F.array(*map(F.lit, names))).otherwise(modes)
    void = regenerated.select("article_id", F.explode(modes).alias("view_mode")).distinct()
    return annotations.join(void, ["article_id", "view_mode"], "left_anti").select(annotations.columns)
