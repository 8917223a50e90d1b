"""Continuous forms of event, health and admission operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.operators.admission import admit_incremental
from feedspark.operators.events import sanitize_props, valid_events
from feedspark.operators.identity import merge_articles, merge_frontiers
from feedspark.operators.rules import drift_steps


def stream_events(spark: SparkSession, path: str, schema: str, form: str = "parquet", files: int = 100) -> DataFrame:
    """Files of a folder as a stream; `files` of them a batch at most."""
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files).load(path)


def _timed(events: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """A watermark on the event time, which watermarks take as an instant."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_valid(events: DataFrame, props: str | None = "props") -> DataFrame:
    """Rows with all required fields, as they come, with sanitised properties (a map; None: there are none)."""
    valid = valid_events(events)
    return sanitize_props(valid, props) if props else valid


def stream_dedup(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per event_id among repeats within the watermark."""
    return _timed(events, delay).dropDuplicatesWithinWatermark(["event_id"])


def stream_counts(events: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Events by tumbling window; later rows than the watermark are dropped."""
    g = _timed(events, delay).groupBy(F.window("ts", window), "event").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "event", "n")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Events and time span of each install's sessions, parted by a gap."""
    g = _timed(events, delay).groupBy("install_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return g.select("install_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


HEALTH = "rule_id string, check_id long, status string, consecutive_failures long, consecutive_empties long, is_alerting boolean, drifted boolean"


def _streak(hit: pd.Series, before: int) -> pd.Series:
    """Length of the run of hits that ends at each row; before: of the run that the rows go on with."""
    block = (~hit).cumsum()
    return hit.groupby(block).cumsum() + (block == 0) * hit * before


def _health(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    failures, empties, base = state.get if state.exists else (0, 0, None)
    rows = pd.concat(list(frames)).sort_values(["checked_at", "check_id"])
    error, empty = _streak(rows["status"] == "error", failures).astype(int), _streak(rows["status"] == "empty", empties).astype(int)
    healthy = rows["status"] == "healthy"
    drifted = pd.Series(False, rows.index)
    drifted[healthy], base = drift_steps(rows.loc[healthy, "hit_rate"].tolist(), base)
    state.update((int(error.iloc[-1]), int(empty.iloc[-1]), base))
    yield pd.DataFrame({"rule_id": key[0], "check_id": rows["check_id"], "status": rows["status"], "consecutive_failures": error, "consecutive_empties": empty, "is_alerting": (error >= 2) | (empty >= 3), "drifted": drifted})


def stream_health(checks: DataFrame) -> DataFrame:
    """Streaks and drift (of hit_rate at healthy checks) after each check, from two counters and a baseline a rule. Checks of one
    batch are taken in order of time; a task holds a rule's checks of one batch, which `files` of stream_events bounds."""
    return checks.groupBy("rule_id").applyInPandasWithState(_health, HEALTH, "failures long, empties long, base double", "append", "NoTimeout")


CANDIDATE = "id long, source_name string, section string, position long, url string, title string, dt string"
ADMITTED = "id long, source_name string, section string, url string, title string, effective_dt string, batch long, is_read boolean, is_favorite boolean, is_deleted boolean"
FRONTIER = "source_name string, section_name string, url string, updated_at long"


def _kept(spark: SparkSession, store: str, part: str, schema: str, before: int | None = None) -> DataFrame:
    """What batches have stored (before one of them)."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{store}/{part}")
    if before is None:
        return rows
    return rows.where(F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(-?\d+)/", 1).cast("long") < before)


def stored_articles(spark: SparkSession, store: str) -> DataFrame:
    """The snapshot of admitted articles: of one canonical URL the row of the last batch."""
    rows = _kept(spark, store, "articles", ADMITTED)
    return merge_articles(rows.limit(0), rows, order="batch", on_update="preserve_user_state")


def stored_frontiers(spark: SparkSession, store: str) -> DataFrame:
    """The last frontier of each section."""
    rows = _kept(spark, store, "frontiers", FRONTIER)
    return merge_frontiers(rows.limit(0), rows)


def stream_admission(candidates: DataFrame, store: str, checkpoint: str, details: DataFrame, cutoffs: DataFrame, grace: int = 3):
    """Each batch's candidates (CANDIDATE) through incremental admission against what is stored; admitted rows join the snapshot, and
    the first row of each section becomes its frontier. Returns the stream writer. A batch appends its own folder, so one that runs
    again replaces what it wrote; of stored articles only URLs are read."""
    spark = candidates.sparkSession
    for part, schema in (("articles", ADMITTED), ("frontiers", FRONTIER)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{store}/{part}/batch=-1")

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        known = _kept(session, store, "articles", ADMITTED, number).select("url")
        old = _kept(session, store, "frontiers", FRONTIER, number)
        frontiers = merge_frontiers(old.limit(0), old).select("source_name", F.col("section_name").alias("section"), "url")
        new = admit_incremental(rows, known, frontiers, details, cutoffs, grace)
        flags = {c: F.lit(False) for c in ("is_read", "is_favorite", "is_deleted")}
        own = new.withColumns({"batch": F.lit(number).cast("long")} | flags)
        own.select([x.split()[0] for x in ADMITTED.split(", ")]).write.mode("overwrite").parquet(f"{store}/articles/batch={number}")
        first = rows.where("coalesce(url, '') <> ''").groupBy("source_name", F.col("section").alias("section_name")).agg(F.min_by("url", F.struct("position", "url")).alias("url"))
        first.withColumn("updated_at", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{store}/frontiers/batch={number}")

    return candidates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now into Parquet files, and read them."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
