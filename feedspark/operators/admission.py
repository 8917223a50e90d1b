"""Incremental admission: which candidates of a crawl are new work.

Candidates: source_name, section, position (order in the section), url, title, dt (list time as text, may be null). Scans that
stop somewhere number a section's rows, find the first row that stops, and keep those before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedspark.operators.series import SLICES, before, same, sliced

SECTION = ["source_name", "section"]


def drop_title_noise(candidates: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Candidates whose trimmed title isn't blacklisted (title)."""
    black = blacklist.select(F.trim("title").alias("_t")).distinct()
    return candidates.withColumn("_t", F.trim("title")).join(black, "_t", "left_anti").drop("_t")


def today_filter(candidates: DataFrame, today: str) -> DataFrame:
    """Undated candidates and those of today."""
    return candidates.where(F.col("dt").isNull() | (F.substring("dt", 1, 10) == today))


def cold_start_top_n(candidates: DataFrame, quotas: DataFrame, parts: int = 64, slices: int = SLICES) -> DataFrame:
    """For sources with a quota (source_name, quota; null: unlimited): URLs once across sections, newest first, undated last,
    then in order of encounter, up to the quota, with their `rank`.

    The best of each of many parts of a source go first, so that of a source with a quota only a quota a part is left; a source without one is
    ranked in slices of time (the digits of dt, an ISO text) whose counts are summed."""
    rows = _once(candidates, candidates.columns).join(quotas, "source_name")
    order, within = [F.desc_nulls_last("dt"), "section", "position"], F.col("quota").isNull() | (F.col("rank") <= F.col("quota"))
    part = rows.withColumn("_p", F.pmod(F.xxhash64("url"), F.lit(parts)))
    near = part.withColumn("rank", F.row_number().over(Window.partitionBy("source_name", "_p").orderBy(*order))).where(within)
    digits = F.rpad(F.regexp_replace(F.substring("dt", 1, 19), "[^0-9]", ""), 14, "0")
    near = sliced(near.withColumn("_d", F.coalesce(-digits.try_cast("long"), F.lit(1))), "_d", slices)
    keys = ["source_name", "_slice"]
    near = near.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    counts = near.groupBy(*keys).agg(F.max("_i").alias("n"))
    counts = counts.select(*(F.col(k).alias(f"{k}_") for k in keys), F.coalesce(F.sum("n").over(before(keys[:1])), F.lit(0)).alias("_before"))
    ranked = near.join(counts, same(keys)).withColumn("rank", (F.col("_i") + F.col("_before")).cast("int"))
    return ranked.where(within).select(*candidates.columns, "rank")


def cold_start_frontiers(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """source_name, section, url: the last selected row of each section, else its first row."""
    last = selected.groupBy(*SECTION).agg(F.max_by("url", "position").alias("_last"))
    first = candidates.groupBy(*SECTION).agg(F.min_by("url", "position").alias("_first"))
    return first.join(last, SECTION, "left").select(*SECTION, F.coalesce("_last", "_first").alias("url"))


def time_cutoff(sources: DataFrame, cursors: DataFrame, mode: str, now: str) -> DataFrame:
    """source_name, cutoff: today: two hours before midnight; continuous: the newest stored cursor (source_name, cursor)."""
    if mode == "today":
        midnight = F.date_trunc("day", F.lit(now).cast("timestamp_ntz"))
        return sources.select("source_name", F.date_format(midnight - F.expr("interval 2 hours"), "yyyy-MM-dd HH:mm:ss").alias("cutoff"))
    return sources.select("source_name").join(cursors.select("source_name", F.col("cursor").alias("cutoff")), "source_name", "left")


def admit_incremental(candidates: DataFrame, stored: DataFrame, frontiers: DataFrame, details: DataFrame, cutoffs: DataFrame, grace: int = 3, slices: int = SLICES) -> DataFrame:
    """Candidates to submit, with `unique_index` and `effective_dt`.

    cutoffs: source_name, cutoff, repair_window. A section with a frontier is scanned down to it; without one, the first stored
    URL, or list-dated row at or below the cutoff, behind the repair window ends it. Undated rows, and rows of the cutoff's day
    without a time, take their detail's time; a detail-dated row at or below the cutoff is only skipped; of rows
    without any time `grace` are taken.

    The scan has two levels: a section's positions are cut in slices, each a window of its own that counts its rows and its rows without any time;
    sums over the slices before carry both counts on; the first stop of a section is a minimum. So a section of any length uses many tasks."""
    rows = _once(candidates.where("coalesce(url, '') <> ''"), candidates.columns)
    rows = rows.join(stored.select("url").distinct().withColumn("_stored", F.lit(True)), "url", "left")
    rows = rows.join(frontiers.select(*SECTION, F.col("url").alias("_frontier")), SECTION, "left").join(cutoffs, "source_name", "left").join(details.groupBy("url").agg(F.max("detail_dt").alias("detail_dt")), "url", "left")
    same_day = (F.substring("dt", 1, 10) == F.substring("cutoff", 1, 10)) & (F.rpad(F.coalesce(F.substring("dt", 12, 8), F.lit("")), 8, "0").isin("00000000", "00:00:00")) & (F.substring("cutoff", 12, 8) != "00:00:00")
    listed = F.when(F.length("dt") == 10, F.concat("dt", F.lit(" 00:00:00"))).otherwise(F.col("dt"))
    rows = rows.withColumn("_stored", F.coalesce("_stored", F.lit(False)))
    rows = rows.withColumn("effective_dt", F.when(F.col("dt").isNull() | F.coalesce(same_day, F.lit(False)), F.coalesce("detail_dt", listed)).otherwise(listed))
    rows = _counted(rows, ~F.col("_stored") & F.col("effective_dt").isNull(), slices)
    rows = rows.withColumns({"_at": F.col("_frontier").isNotNull() & (F.col("url") == F.col("_frontier")), "_window": F.col("_frontier").isNotNull() | (F.col("unique_index") <= F.coalesce("repair_window", F.lit(0)))})
    old = F.coalesce(F.col("effective_dt") <= F.col("cutoff"), F.lit(False)) & ~F.col("_window")
    spent = F.col("_none") & (F.col("_undated") > grace)
    stop = (F.col("_stored") & (F.col("_at") | ~F.col("_window"))) | (~F.col("_stored") & ((old & F.col("dt").isNotNull()) | (F.col("_at") & ~spent)))
    stops = rows.where(stop).groupBy(*SECTION).agg(F.min("unique_index").alias("_stop"))
    stops = stops.select(*(F.col(c).alias(f"{c}_") for c in SECTION), "_stop")
    kept = rows.where(~F.col("_stored") & ~spent & ~old).join(stops, same(SECTION), "left").where(F.col("_stop").isNull() | (F.col("unique_index") < F.col("_stop")))
    return kept.select(*candidates.columns, "unique_index", "effective_dt")


def _once(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of a source's rows of one URL the first by section and position; an aggregate, so that tasks combine their rows before the shuffle."""
    others = [c for c in columns if c not in ("source_name", "url")]
    first = F.min_by(F.struct(*others), F.struct("section", "position")).alias("x")
    return rows.groupBy("source_name", "url").agg(first).select("source_name", "url", "x.*").select(columns)


def _counted(rows: DataFrame, undated: Column, slices: int) -> DataFrame:
    """rows with unique_index (number in the section), _none (undated) and _undated (number of undated rows so far)."""
    keys = [*SECTION, "_slice"]
    rows = sliced(rows.withColumn("_none", undated), "position", slices)
    w = Window.partitionBy(*keys).orderBy("position")
    rows = rows.withColumns({"_i": F.row_number().over(w), "_u": F.sum(F.col("_none").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    past = before(SECTION)
    sums = rows.groupBy(*keys).agg(F.max("_i").alias("i"), F.max("_u").alias("u"))
    sums = sums.select(*(F.col(k).alias(f"{k}_") for k in keys), *(F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"_before_{c}") for c in "iu"))
    rows = rows.join(sums, same(keys)).drop(*(f"{k}_" for k in keys))
    return rows.withColumns({"unique_index": (F.col("_i") + F.col("_before_i")).cast("int"), "_undated": F.col("_u") + F.col("_before_u")})


def auto_seed_frontiers(candidates: DataFrame, frontiers: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """source_name, section, url, stops: the first URL of each section without a frontier becomes one; the section stops there
    unless that row is newer than the cutoff."""
    missing = candidates.where("coalesce(url, '') <> ''").join(frontiers, SECTION, "left_anti")
    first = missing.groupBy(*SECTION).agg(F.min_by(F.struct("url", "dt"), "position").alias("x"))
    rows = first.join(cutoffs.select("source_name", "cutoff"), "source_name", "left")
    return rows.select(*SECTION, "x.url", (~F.coalesce(F.col("x.dt") > F.col("cutoff"), F.lit(False))).alias("stops"))


def source_run_summary(runs: DataFrame) -> DataFrame:
    """source_name (null: all), status, new_items, errors, seconds, warnings (number), skipped (names of the sources that a run
    passed over): error if there are errors and nothing new. runs: source_name, new_items, is_error, seconds, warning (text or
    null), is_skipped."""
    warned, passed = F.count_if(F.trim(F.coalesce("warning", F.lit(""))) != ""), F.array_sort(F.collect_set(F.when(F.col("is_skipped"), F.col("_name"))))
    sums = [F.sum("new_items").alias("new_items"), F.count_if("is_error").alias("errors"), F.sum("seconds").alias("seconds")]
    g = runs.withColumn("_name", F.col("source_name")).rollup("source_name").agg(*sums, warned.alias("warnings"), passed.alias("skipped"))
    return g.withColumn("status", F.when((F.col("errors") > 0) & (F.col("new_items") == 0), "error").when(F.col("new_items") > 0, "success").otherwise("empty"))
