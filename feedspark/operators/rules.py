"""Quality, health and versions of extraction rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from feedspark.operators.series import SLICES, before, same, sliced

DROP, LEAST, ALERT_FAILURES, ALERT_EMPTIES, VERSIONS = 0.5, 0.6, 2, 3, 20
#: Words that tell kinds of failures apart.
NETWORK = "timeout|timed out|超时|network|连接|connection|dns|ssl|证书|proxy|403|404|429|500|502|503|504|请求网页|浏览器验证"
REQUIRED = ["rule_id", "task_name", "url", "source_type"]


def field_hit_stats(items: DataFrame, rule: str, fields: str) -> DataFrame:
    """rule, field, hit_count, total_count, hit_rate of map<field,value> items."""
    rows = items.select(rule, F.explode(fields).alias("field", "value"))
    g = rows.groupBy(rule, "field").agg(F.count_if(F.trim(F.coalesce("value", F.lit(""))) != "").alias("hit_count"), F.count("*").alias("total_count"))
    return g.withColumn("hit_rate", F.round(F.col("hit_count") / F.col("total_count"), 4))


def detect_field_drift(current: DataFrame, baseline: DataFrame, rule: str = "rule_id") -> DataFrame:
    """rule, field, baseline_rate, current_rate, reason of fields that lost hits against the baseline."""
    b = baseline.where(F.col("hit_rate") >= LEAST).select(rule, "field", F.col("hit_rate").alias("baseline_rate"))
    both = current.select(rule, "field", F.col("hit_rate").alias("current_rate")).join(b, [rule, "field"])
    reason = F.when(F.col("current_rate") <= 0, "field_missing").when(F.round(F.col("baseline_rate") - F.col("current_rate"), 4) >= DROP, "hit_rate_drop")
    return both.withColumn("reason", reason).where("reason is not null")


def _is_drifted(base: float | None, rate: float) -> bool:
    return base is not None and base >= LEAST and (rate <= 0 or round(base - rate, 4) >= DROP)


def drift_steps(rates: list[float], base: float | None) -> tuple[list[bool], float | None]:
    """Which of the checks in order lost hits against the last clean one, and the baseline behind them."""
    out = []
    for rate in rates:
        drifted = _is_drifted(base, rate)
        out.append(drifted)
        if not drifted:
            base = rate
    return out, base


def _carried(table: list[tuple[float, float]], rate: float) -> list[tuple[float, float]]:
    table = [(r, base if _is_drifted(base, rate) else rate) for r, base in table]
    return table if table and rate <= table[-1][0] else [*table, (rate, rate)]


def drift_map(rates: list[float], table: list[tuple[float, float]] | None = None) -> list[tuple[float, float]]:
    """What a stretch of checks makes of any baseline in front of it, as (rate, outgoing baseline) with rising rates: the first rate
    against which the incoming baseline isn't drifted tells the outgoing one; if there is none, the baseline stays. The outgoing baselines of all
    cases are carried along together; each check that is clean for several of them makes them one. table: that of the checks before."""
    table = table or []
    for rate in rates:
        table = _carried(table, rate)
    return table


def outgoing(table: list[tuple[float, float]], base: float | None) -> float | None:
    return next((out for rate, out in table if not _is_drifted(base, rate)), base)


def _stretches(frames: Iterator[pd.DataFrame], rule: str) -> Iterator[tuple[object, int, pd.DataFrame, bool]]:
    """(rule, slice, rows, whether they begin the stretch) of sorted batches."""
    last = None
    for frame in frames:
        for (name, at), own in frame.groupby([rule, "_slice"], sort=False, dropna=False):
            key = (None if pd.isna(name) else name, int(at))
            yield *key, own, key != last
            last = key


def _mapped(rule: str):
    """The map of each stretch, as a row behind its last check."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, table = None, []
        row = lambda: pd.DataFrame({rule: [key[0]], "_slice": [key[1]], "rates": [[r for r, _ in table]], "bases": [[b for _, b in table]]})
        for name, at, own, begins in _stretches(frames, rule):
            if begins and key is not None:
                yield row()
            key, table = (name, at), drift_map(own["hit_rate"].tolist(), None if begins else table)
        if key is not None:
            yield row()

    return run


def _composed(rule: str):
    """The baseline in front of each stretch of a rule, from the maps before it."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own, base, bases = own.sort_values("_slice"), None, []
        for rates, outs in zip(own["rates"], own["bases"], strict=True):
            bases.append(base)
            base = outgoing(list(zip(rates, outs, strict=True)), base)
        return pd.DataFrame({f"{rule}_": own[rule], "_slice_": own["_slice"], "base": pd.Series(bases, own.index, dtype="float64")})

    return run


def _flagged(rule: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = None
        for _, _, own, begins in _stretches(frames, rule):
            if begins:
                base = None if pd.isna(own["base"].iloc[0]) else float(own["base"].iloc[0])
            flags, base = drift_steps(own["hit_rate"].tolist(), base)
            yield own[[rule, "checked_at", "check_id"]].assign(drifted=flags)

    return run


def drift_history(checks: DataFrame, rule: str = "rule_id", slices: int = SLICES) -> DataFrame:
    """rule, checked_at, check_id, drifted of each rule's healthy checks (hit_rate): the baseline moves on only at clean checks.

    A rule's checks are cut in stretches of time. A first pass makes each stretch a map from the baseline before it to the one behind it (a few
    thresholds), the maps of a rule are put together in order, and a second pass takes all stretches at once, each from its own
    baseline. So a rule with a third of all checks uses as many tasks as it has stretches; a task streams sorted batches."""
    own = checks.where("status = 'healthy'").select(rule, "checked_at", "check_id", F.col("hit_rate").cast("double").alias("hit_rate"))
    rows = sliced(own, "checked_at", slices)
    keys, order = [rule, "_slice"], [rule, "_slice", "checked_at", "check_id"]
    types = rows.schema
    maps = T.StructType([types[rule], types["_slice"], *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("rates", "bases"))])
    tables = rows.repartition(*keys).sortWithinPartitions(*order).mapInPandas(_mapped(rule), maps)
    schema = T.StructType([T.StructField(f"{rule}_", types[rule].dataType), T.StructField("_slice_", types["_slice"].dataType), T.StructField("base", T.DoubleType())])
    bases = tables.groupBy(rule).applyInPandas(_composed(rule), schema)
    based = rows.join(bases, same(keys), "left").drop(f"{rule}_", "_slice_")
    ordered = based.repartition(*keys).sortWithinPartitions(*order)
    return ordered.mapInPandas(_flagged(rule), T.StructType([*(types[c] for c in (rule, "checked_at", "check_id")), T.StructField("drifted", T.BooleanType())]))


def failure_kind(status: str = "status", message: str = "message"):
    m = F.lower(F.trim(F.coalesce(F.col(message), F.lit(""))))
    return (
        F.when(F.col(status).isin("healthy", "empty"), F.col(status))
        .when(m == "", "unknown_error")
        .when(F.contains(m, F.lit("未找到列表容器")), "list_container_drift")
        .when(F.contains(m, F.lit("未找到列表项")), "item_selector_drift")
        .when(m.rlike("cancelled|canceled|取消"), "cancelled")
        .when(m.rlike("selector|选择器"), "selector_error")
        .when(m.rlike(NETWORK), "network_error")
        .otherwise("unknown_error")
    )


def classify_failures(checks: DataFrame) -> DataFrame:
    """kind, n."""
    return checks.groupBy(failure_kind().alias("kind")).agg(F.count("*").alias("n"))


def health_streaks(checks: DataFrame, rule: str = "rule_id", slices: int = SLICES) -> DataFrame:
    """checks with consecutive_failures, consecutive_empties, last_success, last_failure and is_alerting after each check.

    A rule's checks are cut in slices of time, each a window of its own. A slice hands on its number of checks, the run it ends with, whether
    another status broke that run, and its last times; a run that reaches back to a slice's start goes on with what the slices before it hand on."""
    rows = sliced(checks, "checked_at", slices)
    keys = [rule, "_slice"]
    w = Window.partitionBy(*keys).orderBy("checked_at", "check_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    status = {"failures": "error", "empties": "empty"}
    last = lambda *s: F.last(F.when(F.col("status").isin(*s), F.col("checked_at")), ignorenulls=True)
    own = {"_n": F.row_number().over(w), "_success": last("healthy", "empty").over(so_far), "_failure": last("error").over(so_far)}
    rows = rows.withColumns(own)
    other = lambda s: F.max(F.when(~F.col("status").eqNullSafe(s), F.col("_n"))).over(so_far)
    rows = rows.withColumns({f"_{name}": other(s) for name, s in status.items()})  # the last check of another status
    ends = rows.groupBy(*keys).agg(F.max("_n").alias("n"), *(F.max(f"_{c}").alias(c) for c in (*status, "success", "failure")))
    past = before(keys[:1])
    total = F.sum("n").over(past)
    hand = ends.withColumn("_all", F.coalesce(total, F.lit(0)))
    run = lambda c: F.max(F.when(F.col(c).isNotNull(), F.col("_all") + F.col(c))).over(past)
    carried = {f"_c_{c}": F.col("_all") - F.coalesce(run(c), F.lit(0)) for c in status} | {f"_c_{c}": F.max(c).over(past) for c in ("success", "failure")}
    hand = hand.withColumns(carried).select(F.col(rule).alias(f"{rule}_"), F.col("_slice").alias("_slice_"), *carried)
    rows = rows.join(hand, same(keys), "left")
    count = lambda c: F.when(F.col(f"_{c}").isNull(), F.col("_n") + F.col(f"_c_{c}")).otherwise(F.col("_n") - F.col(f"_{c}"))
    rows = rows.withColumns({f"consecutive_{c}": count(c) for c in status} | {f"last_{c}": F.coalesce(f"_{c}", f"_c_{c}") for c in ("success", "failure")})
    rows = rows.withColumn("is_alerting", (F.col("consecutive_failures") >= ALERT_FAILURES) | (F.col("consecutive_empties") >= ALERT_EMPTIES))
    return rows.select(*checks.columns, "consecutive_failures", "consecutive_empties", "last_success", "last_failure", "is_alerting")


def current_health(checks: DataFrame, rule: str = "rule_id") -> DataFrame:
    """The state after each rule's last check, by aggregation alone."""
    at = F.struct("checked_at", "check_id")
    last_not = lambda s: F.max(F.when(F.col("status") != s, at))
    ends = checks.groupBy(rule).agg(F.max_by("status", at).alias("status"), F.max("checked_at").alias("checked_at"), last_not("error").alias("_e"), last_not("empty").alias("_m"))
    rows = checks.select(rule, at.alias("_at"), F.col("status").alias("_s")).join(ends, rule)
    run = lambda s, edge: F.count_if((F.col("_s") == s) & (F.col(edge).isNull() | (F.col("_at") > F.col(edge))))
    return rows.groupBy(rule, "status", "checked_at").agg(run("error", "_e").alias("consecutive_failures"), run("empty", "_m").alias("consecutive_empties"))


def health_summary(health: DataFrame, source_type: str | None = None, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Totals by status, and the rules that need attention: most failures first, then the earliest check; of one source type if
    it is named (column source_type)."""
    if source_type is not None:
        health = health.where(F.col("source_type") == source_type)
    totals = health.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("healthy", "empty", "error")))
    bad = health.where((F.col("consecutive_failures") > 0) | (F.col("consecutive_empties") > 0))
    return totals, bad.orderBy(F.desc("consecutive_failures"), "checked_at", "rule_id").limit(most)


#: What a selector may hold, and what each adds to 60 points.
STABILITY = [
    (r"^#|\[id=", 20.0),
    (r"(?i)article|section|main|nav|aside|ul|ol|li|time|header|footer", 15.0),
    (r"data-", 25.0),
    (r"aria-", 15.0),
    (r"(?i)news|article|list|item|post|content|title|date", 10.0),
    (r"css-[a-z0-9]+|style-[a-z0-9]+|sc-[a-zA-Z]+|_[a-f0-9]{5,}|[a-z]+-\d+[a-z]*$", -30.0),
    (r":nth-child|:nth-of-type|:first-child|:last-child", -25.0),
    (r"\*", -20.0),
    (r"(?s)>.*>.*>", -10.0),
]


def selector_stability(selector):
    """0 to 100: how likely a selector survives a redesign; each step down costs 3 points, 15 at most."""
    score = F.lit(60.0) - F.least(3.0 * F.regexp_count(selector, F.lit("[> ]")), F.lit(15.0))
    for pattern, points in STABILITY:
        score = score + F.when(selector.rlike(pattern), points).otherwise(0.0)
    return F.when(F.coalesce(selector, F.lit("")) == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def stability_score(selectors: DataFrame, rule: str = "rule_id") -> DataFrame:
    """rule, score (mean over its fields' selectors), rating."""
    g = selectors.groupBy(rule).agg(F.round(F.avg(selector_stability(F.col("selector"))), 2).alias("score"))
    return g.withColumn("rating", F.when(F.col("score") >= 80, "excellent").when(F.col("score") >= 60, "good").when(F.col("score") >= 40, "fair").otherwise("at_risk"))


def vote_best_rule(candidates: DataFrame, source: str) -> DataFrame:
    """The best candidate rule of each source (rule_id, n_rows, filled, fields, stability)."""
    score = F.least(10.0 * F.col("n_rows"), F.lit(40.0)) + F.when((F.col("n_rows") > 0) & (F.col("fields") > 0), 20.0 * F.col("filled") / F.col("fields")).otherwise(0.0) + 0.4 * F.col("stability")
    w = Window.partitionBy(source).orderBy(F.desc("score"), "rule_id")
    return candidates.withColumn("score", F.round(score, 4)).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(source, "rule_id", "score")


def version_history(log: DataFrame, rule: str = "rule_id", snapshot: str = "snapshot") -> DataFrame:
    """rule, version_id, saved_at, rank: saves that changed the snapshot, the newest 20 of each rule."""
    w = Window.partitionBy(rule).orderBy("saved_at", "version_id")
    rows = log.withColumn("_h", F.md5(F.to_json(snapshot))).withColumn("_p", F.lag("_h").over(w)).where("_p is null or _p <> _h")
    back = Window.partitionBy(rule).orderBy(F.desc("saved_at"), F.desc("version_id"))
    return rows.withColumn("rank", F.row_number().over(back)).where(F.col("rank") <= VERSIONS).select(rule, "version_id", "saved_at", "rank")


def restore_versions(rules: DataFrame, versions: DataFrame, pins: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(rules with pinned snapshots restored, versions with the replaced snapshots added as rollback versions)."""
    wanted = pins.join(versions.select("rule_id", "version_id", F.col("snapshot").alias("_s")), ["rule_id", "version_id"]).select("rule_id", "_s")
    rows = rules.join(wanted, "rule_id", "left")
    added = rows.where("_s is not null").select("rule_id", F.concat(F.lit("rollback-"), "rule_id", F.lit("-"), F.lit(now)).alias("version_id"), F.lit(now).alias("saved_at"), F.lit("rollback").alias("reason"), "snapshot")
    return rows.withColumn("snapshot", F.coalesce("_s", "snapshot")).drop("_s"), versions.unionByName(added)


def import_rules(stored: DataFrame, incoming: DataFrame, overwrite: bool) -> DataFrame:
    """rule_id, outcome, missing of each incoming rule: invalid, added, updated or skipped."""
    missing = F.concat_ws(",", *(F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(c)) for c in REQUIRED))
    rows = incoming.withColumn("missing", missing).join(stored.select("rule_id", F.lit(True).alias("_there")), "rule_id", "left")
    return rows.select("rule_id", F.when(F.col("missing") != "", "invalid").when(F.col("_there").isNull(), "added").when(F.lit(overwrite), "updated").otherwise("skipped").alias("outcome"), "missing")


def normalize_rules(rules: DataFrame) -> DataFrame:
    """rules with split AI flags from the legacy one, no html-only fields for rss, and header text as a map."""
    rss = F.lower(F.coalesce("source_type", F.lit("html"))) == "rss"
    legacy = F.coalesce("enable_ai", F.lit(False))
    headers = F.str_to_map(F.regexp_replace(F.trim(F.coalesce("headers_text", F.lit(""))), r"\s*\n\s*", "\n"), F.lit("\n"), F.lit(":"))
    clean = F.map_filter(F.transform_values(headers, lambda k, v: F.trim(v)), lambda k, v: (F.trim(k) != "") & v.isNotNull())
    return rules.withColumns(
        {
            "source_type": F.when(rss, "rss").otherwise("html"),
            "enable_formatting": F.coalesce("enable_formatting", legacy),
            "enable_summary": F.coalesce("enable_summary", legacy),
            "list_container": F.when(~rss, F.col("list_container")),
            "item_selector": F.when(~rss, F.col("item_selector")),
            "headers": clean,
        }
    ).drop("headers_text", "enable_ai")
