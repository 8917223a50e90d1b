"""Product-event analytics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Properties that are never kept, properties that hold links, events that are never sampled away.
SECRET_KEYS = ["api_key", "apikey", "password", "smtp_password", "smtppassword", "prompt", "summary_prompt", "formatting_prompt", "raw_text", "rawtext", "raw_markdown", "rawmarkdown", "markdown", "body", "content", "html", "selector", "selectors", "note", "note_text"]
URL_KEYS = ["url", "download_url", "target_url", "feed_url", "page_url", "source_url"]
CRITICAL_EVENTS = ["app_launch", "app_exit", "startup_check_result", "update_check_result", "update_available", "update_download_click", "source_fetch_result", "ai_summary_result", "ai_regenerate_request", "ai_regenerate_result", "custom_rule_test_result", "custom_rule_save_result"]
PLATFORM_NAMES = {"darwin": "macOS", "windows": "Windows", "linux": "Linux"}
REQUIRED = ["event_id", "event", "install_id", "session_id"]


def _filled(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""


def validate_events(raw: DataFrame) -> DataFrame:
    """raw with `missing`: the required fields that are null or blank, joined; empty for a valid row."""
    return raw.withColumn("missing", F.concat_ws(",", *(F.when(~_filled(c), F.lit(c)) for c in REQUIRED)))


def valid_events(raw: DataFrame) -> DataFrame:
    return validate_events(raw).where("missing = ''").drop("missing")


#: Events whose name begins like this are errors.
ERROR = "error_"
PROPS = "map<string,string>"


def _first_by_key(entries: Column) -> Column:
    """Entries (key, value) as a map; of equal keys the first stays."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(entries, lambda e: e["key"] == k), 0)["value"]))


def _cut(value: Column, most: Column) -> Column:
    v = F.trim(value)
    return F.when(F.length(v) > most, F.concat(F.rtrim(F.substring(v, F.lit(1), most)), F.lit("..."))).otherwise(F.nullif(v, F.lit("")))


def _hashed(v: Column) -> Column:
    return F.substring(F.sha2(v, 256), 1, 16)


def _is_link(key: Column) -> Column:
    return F.lower(key).isin(URL_KEYS) | F.lower(key).endswith("_url")


def _is_kept(e: Column) -> Column:
    return (F.trim(e["key"]) != "") & ~F.lower(F.trim(e["key"])).isin(SECRET_KEYS) & e["value"].isNotNull() & (F.trim(e["value"]) != "")


def _json_cleaner(secret: frozenset[str], links: frozenset[str]):
    """A Pandas UDF over (JSON texts, longest text): each list or object without secrets on any level, null if nothing is left."""

    def run(texts: pd.Series, longest: pd.Series) -> pd.Series:
        import hashlib
        import json
        from urllib.parse import urlsplit

        def digest(value: object) -> str | None:
            text = str(value).strip()
            return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:16] if text else None

        def host(value: object) -> str | None:
            try:
                return urlsplit(str(value).strip()).hostname
            except ValueError:
                return None

        def fields(own: dict, most: int) -> dict:
            custom = bool(own.get("is_custom_source")) or str(own.get("source_type") or "").strip().lower() == "rss" or bool(str(own.get("rule_id") or "").strip())
            out = {}
            for key, value in ((k.strip(), v) for k, v in own.items()):
                low = key.lower()
                if not key or low in secret:
                    continue
                if low in links or low.endswith("_url"):
                    name, value = f"{key}DomainHash", digest(host(value) or "")
                elif key == "source_name" and custom:
                    name, value = "sourceNameHash", None if value is None else digest(value)
                else:
                    name, value = key, clean(value, most)
                if value is not None and value != "" and value != {}:
                    out.setdefault(name, value)
            return out | {"is_custom_source": True} if custom else out

        def clean(value: object, most: int) -> object:
            if isinstance(value, dict):
                return fields(value, most)
            if isinstance(value, list):
                kept = (clean(x, most) for x in value[:12])
                return [x for x in kept if x is not None and x not in ("", [], {})]
            if isinstance(value, str):
                text = value.strip()
                return text[:most].rstrip() + "..." if len(text) > most else text
            return value

        def one(text: str, most: int) -> str | None:
            try:
                value = json.loads(text, parse_constant=lambda _: None)
            except ValueError:
                return text[:most].rstrip() + "..." if len(text) > most else text  # no JSON, but text
            except RecursionError:
                return None
            left = clean(value, most)
            return None if left == {} else json.dumps(left, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

        return pd.Series([None if own is None else [one(t, int(m)) for t in own] for own, m in zip(texts, longest, strict=True)])

    return F.pandas_udf(run, "array<string>")


def sanitize_props(events: DataFrame, props: str = "props", event: str = "event", longest: int = 240, longest_error: int = 360, error: str = ERROR) -> DataFrame:
    """props (map<string,string>, lists and objects as JSON) without secrets; links become a hash of their host, names of custom
    sources a hash; text is trimmed and cut, longer for errors. Lists and objects are cleaned by the same rules on every level and keep
    their numbers and booleans: of a list the first 12 items stay; JSON nested too deep to be read is left out. Of keys that only blanks tell
    apart the first in order stays.

    Plain values are column expressions. Values that begin like a list or an object pass a Pandas UDF, as Spark's functions on VARIANT can't
    descend to any depth (nested by hand to eight levels they took 52 s in place of 4 for 100,000 events)."""
    from feedspark.functions.urls import host

    p = F.coalesce(F.col(props), F.create_map().cast(PROPS))
    has = lambda k: F.coalesce(F.get(F.filter(F.map_entries(p), lambda e: F.trim(e["key"]) == k), 0)["value"], F.lit(""))
    custom = (has("is_custom_source") == "true") | (F.lower(F.trim(has("source_type"))) == "rss") | (F.trim(has("rule_id")) != "")
    most = F.when(F.col(event).startswith(error), longest_error).otherwise(longest)

    def entry(e: Column) -> Column:
        k, v = F.trim(e["key"]), F.trim(e["value"])
        link, named = _is_link(k), F.col("_custom") & (k == "source_name")
        name = F.when(link, F.concat(k, F.lit("DomainHash"))).when(named, "sourceNameHash").otherwise(k)
        nested = ~link & ~named & (v.startswith("{") | v.startswith("["))
        value = F.when(link, F.when(host(v) != "", _hashed(host(v)))).when(named, _hashed(v)).when(~nested, _cut(v, most))
        return F.struct(name.alias("key"), e["key"].alias("own"), value.alias("value"), F.when(nested, v).alias("json"))

    rows = events.withColumn("_custom", custom).withColumn("_all", F.transform(F.filter(F.map_entries(p), _is_kept), entry))
    nested = F.filter("_all", lambda e: e["json"].isNotNull())
    rows = rows.withColumn("_plain", F.filter("_all", lambda e: e["json"].isNull())).withColumn("_all", nested)
    cleaner = _json_cleaner(frozenset(SECRET_KEYS), frozenset(URL_KEYS))
    rows = rows.withColumn("_json", cleaner(F.when(F.size("_all") > 0, F.transform("_all", lambda e: e["json"])), most))
    same = lambda e, value: F.struct(e["key"].alias("key"), e["own"].alias("own"), value.alias("value"))
    opened = F.coalesce(F.zip_with("_all", "_json", same), F.array().cast("array<struct<key:string,own:string,value:string>>"))
    all_ = F.concat(F.transform("_plain", lambda e: same(e, e["value"])), opened)
    clean = F.filter(all_, lambda e: e["value"].isNotNull() & ~(F.col("_custom") & (e["key"] == "is_custom_source")))
    mark = F.struct(F.lit("is_custom_source").alias("key"), F.lit("").alias("own"), F.lit("true").alias("value"))
    rows = rows.withColumn("_all", F.array_sort(F.when(F.col("_custom"), F.concat(clean, F.array(mark))).otherwise(clean)))
    return rows.withColumn(props, _first_by_key(F.col("_all"))).drop("_custom", "_all", "_plain", "_json")


def sample_events(events: DataFrame, rate: float, event: str = "event", key: str = "event_id", error: str = ERROR) -> DataFrame:
    """Errors and critical events always, others by a hash of their id, so that a higher rate keeps a superset."""
    bucket = F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("long") % 1_000_000
    return events.where(F.col(event).startswith(error) | F.col(event).isin(CRITICAL_EVENTS) | (bucket < int(rate * 1_000_000)))


def consent_filter(events: DataFrame, consent: DataFrame, error: str = ERROR) -> DataFrame:
    """Events that their install agrees to: errors by error_enabled, others by usage_enabled, none behind `killed`; installs
    without a row agree to nothing."""
    rows = events.join(consent, "install_id")
    return rows.where(~F.col("killed") & F.when(F.col("event").startswith(error), F.col("error_enabled")).otherwise(F.col("usage_enabled"))).select(events.columns)


def queue_stats(queue: DataFrame, now: Column) -> DataFrame:
    waiting = F.col("status").isin("pending", "failed")
    return queue.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "failed", "sent")), F.count_if(waiting & (F.coalesce("next_retry_at", now) <= now)).alias("ready"))


def apply_retention(events: DataFrame, now: Column, days: dict[str, int], default: int, ts: str = "ts", kind: str = "event", status: str | None = None, sent_at: str = "sent_at", sent_days: int = 7) -> DataFrame:
    """Rows younger than the days of their class (default: other classes); with a status column, without those sent longer ago
    than sent_days."""
    keep = F.lit(default)
    for name, n in days.items():
        keep = F.when(F.col(kind) == name, n).otherwise(keep)
    rows = events.where(F.col(ts) >= now - F.make_dt_interval(keep))
    if status is None:
        return rows
    return rows.where(~F.coalesce((F.col(status) == "sent") & (F.col(sent_at) < now - F.make_dt_interval(F.lit(sent_days))), F.lit(False)))


def clear_events(queue: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """The queue without the rows of the given statuses; without any, nothing is left."""
    named = [x.strip() for x in statuses or [] if x.strip()]
    return queue.where(~F.coalesce(F.col("status").isin(named), F.lit(False))) if named else queue.limit(0)


def event_report(events: DataFrame) -> DataFrame:
    """dimension, value, n, percent by event, platform (display name) and version, in one pass over grouping sets."""
    names = F.create_map(*(F.lit(x) for kv in PLATFORM_NAMES.items() for x in kv))
    rows = events.select("event", F.coalesce(F.try_element_at(names, F.col("platform")), F.col("platform")).alias("platform"), "app_version")
    g = rows.groupingSets([["event"], ["platform"], ["app_version"]], "event", "platform", "app_version").agg(F.grouping_id().alias("_g"), F.count("*").alias("n"))
    which = F.when(F.col("_g") == 3, "event").when(F.col("_g") == 5, "platform").otherwise("app_version")
    share = 100 * F.col("n") / F.sum("n").over(Window.partitionBy("dimension"))
    return g.select(which.alias("dimension"), F.coalesce("event", "platform", "app_version").alias("value"), "n").withColumn("percent", F.round(share, 2))


def top_events(events: DataFrame, n: int = 10) -> DataFrame:
    best = events.groupBy("event").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "event")))


def action_counts(events: DataFrame, actions: DataFrame) -> DataFrame:
    """event, label, n of listed actions (event, label) that occur."""
    return events.join(actions, "event").groupBy("event", "label").agg(F.count("*").alias("n"))


def error_counts(events: DataFrame, error: str = ERROR) -> DataFrame:
    return events.where(F.col("event").startswith(error)).groupBy("event").agg(F.count("*").alias("n"))


def feature_counts(events: DataFrame, part: str = "ai_") -> DataFrame:
    return events.where(F.contains("event", F.lit(part))).groupBy("event").agg(F.count("*").alias("n"))


def activity_metrics(events: DataFrame, launch: str = "app_launch", approximate: bool = False) -> DataFrame:
    """day, app_version, platform, channel (null: all) with launches, installs (devices first seen that day), devices and
    sessions: in all, by each of them, and by all three."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    first = events.groupBy("install_id").agg(F.min("ts").cast("date").alias("_first"))
    rows = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).join(first, "install_id", "left")
    new = F.when(F.date_format("_first", "yyyy-MM-dd") == F.col("day"), F.col("install_id"))
    dims = ["app_version", "platform", "channel"]
    g = rows.withColumn("_new", new).groupingSets([["day", *dims], *(["day", x] for x in dims), ["day"]], "day", *dims)
    return g.agg(F.count_if(F.col("event") == launch).alias("launches"), distinct("_new").alias("installs"), distinct("install_id").alias("devices"), distinct("session_id").alias("sessions"))


def retention(events: DataFrame, days: tuple[int, ...] = (1, 7)) -> DataFrame:
    """first_day, day_offset, devices, active, rate: share of a day's first-seen devices that were active so many days later."""
    active = events.select("install_id", F.to_date("ts").alias("day")).distinct()
    first = active.groupBy("install_id").agg(F.min("day").alias("first_day"), F.collect_set("day").alias("days"))
    rows = first.select("first_day", "days", F.explode(F.array(*map(F.lit, days))).alias("day_offset"))
    back = F.array_contains("days", F.date_add("first_day", F.col("day_offset")))
    g = rows.groupBy("first_day", "day_offset").agg(F.count("*").alias("devices"), F.count_if(back).alias("active"))
    return g.withColumn("rate", F.round(F.col("active") / F.col("devices"), 4))


def failure_rate_by(events: DataFrame, dimension: str, error: str = ERROR) -> DataFrame:
    """Error share of each value of a dimension and its jump against the value before."""
    g = events.groupBy(dimension).agg(F.count("*").alias("n"), F.count_if(F.col("event").startswith(error)).alias("errors"))
    rate = F.col("errors") / F.col("n")
    return g.withColumn("rate", F.round(rate, 4)).withColumn("jump", F.round(rate - F.lag(rate).over(Window.orderBy(dimension)), 4))


def rolling_metrics(samples: DataFrame, key: str, order: list[str], value: str, n: int = 60, bucket: str = "day", width: int = 50_000) -> DataFrame:
    """samples with the mean of the last n samples and the peak so far, by series. order: a time and what breaks its ties.

    A series of any length is cut: counts by time bucket (a unit of date_trunc) number its rows, stretches of `width` numbers are
    windows of their own, the last n - 1 rows of a stretch also go before the next, and peaks of earlier stretches are
    carried on. So a task holds a bucket or a stretch of a series."""
    rows = samples.withColumn("_b", F.date_trunc(bucket, order[0]))
    run = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(key, "_b").agg(F.count("*").alias("_c")).select(F.col(key).alias("_k"), F.col("_b").alias("_at"), F.coalesce(F.sum("_c").over(run), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) - 1
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_at"))
    numbered = rows.withColumn("_i", own).join(before, same).withColumn("_i", F.col("_i") + F.col("_before")).drop("_b", "_k", "_at", "_before")
    numbered = numbered.withColumn("_s", F.floor(F.col("_i") / width))
    lent = F.when(F.col("_i") % width >= width - (n - 1), F.array("_s", F.col("_s") + 1)).otherwise(F.array("_s"))
    spread = numbered.withColumn("_t", F.explode(lent))
    w = Window.partitionBy(key, "_t").orderBy("_i")
    within = F.max(F.when(F.col("_s") == F.col("_t"), F.col(value))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rolled = spread.withColumns({"rolling_mean": F.round(F.avg(value).over(w.rowsBetween(1 - n, 0)), 6), "_peak": within}).where("_s = _t")
    past = Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    peaks = numbered.groupBy(key, "_s").agg(F.max(value).alias("_m")).select(F.col(key).alias("_k"), F.col("_s").alias("_p"), F.max("_m").over(past).alias("_high"))
    joined = rolled.join(peaks, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_s") == F.col("_p")))
    return joined.withColumn("peak", F.greatest("_peak", "_high")).select(*samples.columns, "rolling_mean", "peak")


def fetch_outcomes(runs: DataFrame) -> DataFrame:
    """Runs by source type, status and error code (timeout, crash, other or none) with duration statistics."""
    text = F.lower(F.coalesce("error", F.lit("")))
    code = F.when(text == "", "none").when(text.rlike("timeout|timed out"), "timeout").when(text.rlike("crash|exception"), "crash").otherwise("other")
    g = runs.groupBy("source_type", "status", code.alias("error_code"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("duration"), 4).alias("mean_duration"), F.max("duration").alias("max_duration"))
