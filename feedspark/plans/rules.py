"""Queries of admission, rule and annotation operators with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedspark.operators import admission as E
from feedspark.operators import annotations as K
from feedspark.operators import rules as R
from feedspark.plans.fixtures import ARTICLES, CANDIDATES, CHECKS, articles, candidates, rule_checks, sql, table

def _source_number():
    return F.regexp_extract("source_name", r"(\d+)", 1).cast("int")


def _quotas(spark, d):
    s = articles(spark, d).select("source_name").distinct()
    return s.where(_source_number() % 2 == 0).select("source_name", F.when(_source_number() % 4 == 0, 10).when(_source_number() % 6 == 0, 1).alias("quota"))


def e01(spark, d):
    return E.cold_start_top_n(candidates(spark, d), _quotas(spark, d)).select("id", "rank")


def e02(spark, d):
    c = candidates(spark, d)
    return E.cold_start_frontiers(c, E.cold_start_top_n(c, _quotas(spark, d)))


def e03(spark, d):
    from feedspark.operators.feed import latest_cursor_by_source

    a = articles(spark, d)
    s = a.select("source_name").distinct()
    today = E.time_cutoff(s, None, "today", "2024-01-20 10:30:00").withColumn("mode", F.lit("today"))
    return today.unionByName(E.time_cutoff(s, latest_cursor_by_source(a), "continuous", "").withColumn("mode", F.lit("continuous")))


CUTOFF = "2024-01-10 06:00:00"


def _parts(spark, d):
    c = candidates(spark, d)
    stored = c.where("id % 4 = 1")
    frontiers = c.where((_source_number() % 2 == 0) & (F.col("id") % 10 == 7)).groupBy("source_name", "section").agg(F.max_by("url", "id").alias("url"))
    details = c.where("id % 18 = 0 or dt = '2024-01-10'").select("url", F.when(F.col("id") % 5 != 0, F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("id") * 5 % 28).cast("string"), 2, "0"), F.lit(" 08:00:00"))).alias("detail_dt"))
    cutoffs = c.select("source_name").distinct().select("source_name", F.lit(CUTOFF).alias("cutoff"), F.when(_source_number() % 3 == 0, 20).otherwise(10).alias("repair_window"))
    return c, stored, frontiers, details, cutoffs


def e04(spark, d):
    return E.admit_incremental(*_parts(spark, d)).select("id", "unique_index", "effective_dt")


def e05(spark, d):
    c = candidates(spark, d)
    black = c.where("id < 40").select(F.concat(F.lit(" "), "title").alias("title"))
    return E.drop_title_noise(c, black).groupBy("source_name").agg(F.count("*").alias("n"))


def e06(spark, d):
    return E.today_filter(candidates(spark, d), "2024-01-08").select("id", "dt")


def e07(spark, d):
    c, _, frontiers, _, cutoffs = _parts(spark, d)
    return E.auto_seed_frontiers(c, frontiers, cutoffs)


def e08(spark, d):
    ev = table(spark, d, "events")
    runs = ev.select(F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")).alias("source_name"), F.when(F.col("user_id") % 40 % 3 == 0, F.col("event_id") % 2).otherwise(0).alias("new_items"), ((F.col("event_type") == "error") & (F.col("user_id") % 40 % 2 == 0)).alias("is_error"), (F.col("event_id") % 7).alias("seconds"), F.when(F.col("event_id") % 9 == 0, "slow").when(F.col("event_id") % 9 == 1, " ").alias("warning"), (F.col("user_id") % 40 == F.col("event_id") % 45).alias("is_skipped"))
    return E.source_run_summary(runs).withColumn("skipped", F.array_join("skipped", ","))


def _items(spark, d):
    a = articles(spark, d)
    return a.select("rule_id", F.col("id").alias("id"), F.create_map(F.lit("title"), F.when(F.col("id") % 10 == 3, "").otherwise(F.col("title")), F.lit("date"), F.when(F.col("id") % 3 == 0, F.col("date")).otherwise(" "), F.lit("body"), F.when(_source_number() % 2 == 0, F.lit("x"))).alias("f"), "source_name")


def i01(spark, d):
    return R.field_hit_stats(_items(spark, d), "rule_id", "f")


def i02(spark, d):
    items = _items(spark, d).withColumn("f", F.map_from_arrays(F.map_keys("f"), F.transform(F.map_values("f"), lambda v: F.when((F.col("id") < 200) | (F.col("id") % 4 == 0), F.lit("v")).otherwise(F.when(_source_number() % 3 == 0, F.lit("")).otherwise(v)))))
    return R.detect_field_drift(R.field_hit_stats(items.where("id >= 200"), "rule_id", "f"), R.field_hit_stats(items.where("id < 200"), "rule_id", "f"))


def i02_history(spark, d):
    c = rule_checks(spark, d).where("status = 'healthy'").withColumn("hit_rate", F.when(F.col("check_id") % 5 == 0, 0.0).when(F.col("check_id") % 3 == 0, 0.4).otherwise(0.9))
    return R.drift_history(c).groupBy("rule_id").agg(F.count_if("drifted").alias("drifts"), F.count("*").alias("checks"))


def _checks(spark, d):
    k = F.col("check_id")
    message = F.when(k % 7 == 0, "").when(k % 7 == 1, "Connection reset").when(k % 7 == 2, "bad selector .x").when(k % 7 == 3, "未找到列表容器").when(k % 7 == 4, "Cancelled by user").when(k % 7 == 5, "HTTP 503").otherwise("boom")
    return rule_checks(spark, d).withColumn("message", message)


def i03(spark, d):
    return R.classify_failures(_checks(spark, d))


def i04(spark, d):
    return R.health_streaks(rule_checks(spark, d)).select("check_id", "consecutive_failures", "consecutive_empties", F.date_format("last_success", "yyyy-MM-dd HH:mm:ss").alias("last_success"), F.date_format("last_failure", "yyyy-MM-dd HH:mm:ss").alias("last_failure"), "is_alerting")


def i05(spark, d):
    _, attention = R.health_summary(R.current_health(rule_checks(spark, d)))
    return attention.withColumn("checked_at", F.date_format("checked_at", "yyyy-MM-dd HH:mm:ss"))


def i05_rss(spark, d):
    """The RSS rules alone: those of an even number."""
    health = R.current_health(rule_checks(spark, d))
    kind = F.when(F.regexp_extract("rule_id", "([0-9]+)", 1).cast("int") % 2 == 0, "rss").otherwise("html")
    return R.health_summary(health.withColumn("source_type", kind), "rss")[0]


def i05_totals(spark, d):
    return R.health_summary(R.current_health(rule_checks(spark, d)))[0]


SELECTORS = ["#main > ul.news-list li", ".css-1a2b3c div > p > a > b", "article[data-id] time", "td:nth-child(2)", "*", ".x", "a.mt-4", "[aria-label=x] .title"]


def i06(spark, d):
    pick = F.element_at(F.array(*map(F.lit, SELECTORS)), (F.col("k") % 8 + 1).cast("int"))
    rows = articles(spark, d).select(F.concat(F.lit("r"), (F.col("id") % 30).cast("string")).alias("rule_id"), (F.col("id") % 30 + F.floor(F.col("id") / 30)).alias("k")).select("rule_id", pick.alias("selector"))
    return R.stability_score(rows)


def i07(spark, d):
    c = articles(spark, d).select("source_name", F.concat(F.lit("r"), F.col("id").cast("string")).alias("rule_id"), (F.col("id") % 6).alias("n_rows"), (F.col("id") % 4).alias("filled"), F.lit(4).alias("fields"), (F.col("id") * 37 % 101).cast("double").alias("stability"))
    return R.vote_best_rule(c, "source_name")


def i08(spark, d):
    log = rule_checks(spark, d).select("rule_id", F.concat(F.lit("v"), F.lpad(F.col("check_id").cast("string"), 8, "0")).alias("version_id"), F.date_format("checked_at", "yyyy-MM-dd HH:mm:ss").alias("saved_at"), F.struct((F.col("check_id") % 3).alias("a"), F.col("status").alias("b")).alias("snapshot"))
    return R.version_history(log)


def i09(spark, d):
    a = articles(spark, d)
    rules = a.groupBy("rule_id").agg(F.max("title").alias("snapshot"))
    versions = a.select("rule_id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("version_id"), F.col("exact_time").alias("saved_at"), F.lit("save").alias("reason"), F.col("title").alias("snapshot"))
    pins = a.groupBy("rule_id", "source_name").agg(F.concat(F.lit("v"), F.min("id").cast("string")).alias("version_id")).where(_source_number() % 2 == 0).select("rule_id", "version_id")
    restored, after = R.restore_versions(rules, versions, pins, "2024-02-01")
    return restored.select("rule_id", F.lit("rule").alias("version_id"), "snapshot").unionByName(after.where("reason = 'rollback'").select("rule_id", "version_id", "snapshot"))


def i10(spark, d):
    incoming = articles(spark, d).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("rule_id"), F.when(F.col("id") % 5 == 0, " ").otherwise(F.col("title")).alias("task_name"), F.when(F.col("id") % 7 == 0, "").otherwise(F.col("url")).alias("url"), "source_type")
    stored = incoming.where("cast(substring(rule_id, 2) as int) % 3 = 0").select("rule_id")
    both = [R.import_rules(stored, incoming, o).withColumn("overwrite", F.lit(o)) for o in (True, False)]
    return both[0].unionByName(both[1])


def i11(spark, d):
    r = articles(spark, d).select("id", F.when(F.col("id") % 3 == 0, "RSS").when(F.col("id") % 3 == 1, "html").alias("source_type"), (F.col("id") % 2 == 0).alias("enable_ai"), F.when(F.col("id") % 5 == 0, True).alias("enable_formatting"), F.lit(None).cast("boolean").alias("enable_summary"), F.lit(".list").alias("list_container"), F.lit("li").alias("item_selector"), F.concat(F.lit("Accept: x \n User-Agent:"), "source_name").alias("headers_text"))
    return R.normalize_rules(r).select("id", "source_type", "enable_formatting", "enable_summary", "list_container", F.element_at("headers", "User-Agent").alias("agent"), F.element_at("headers", "Accept").alias("accept"))


def _annotations(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select(k.alias("id"), (F.col("user_id") % 300).alias("article_id"), F.when(k % 3 == 0, "enhanced").when(k % 3 == 1, "summary").otherwise("raw").alias("view_mode"), (k % 50).alias("start_offset"), (k % 50 + 5).alias("end_offset"), F.lit("green").alias("color"))


def k01(spark, d):
    return K.annotations_for(_annotations(spark, d), articles(spark, d).where("is_favorite"), "summary")


def k02(spark, d):
    a = _annotations(spark, d)
    edits = a.where("id % 4 = 0").withColumns({"id": F.when(F.col("id") % 8 == 0, F.col("id")).otherwise(F.col("id") + 1_000_000), "start_offset": F.col("start_offset") - 10, "end_offset": F.col("end_offset") - 20, "color": F.when(F.col("id") % 16 == 0, " RED ").otherwise("")})
    return K.merge_annotations(a, edits)


def k03(spark, d):
    a = _annotations(spark, d)
    one = K.delete_annotations(a, a.where("id % 5 = 0").select("id"))
    return K.delete_annotations(one, a.where("article_id < 50").select("article_id", F.lit("raw").alias("view_mode"))).select("id")


def k04(spark, d):
    done = articles(spark, d).where("id < 200").select(F.col("id").alias("article_id"), F.when(F.col("id") % 2 == 0, "rss_full").otherwise("summary_only").alias("kind"))
    return K.invalidate_annotations(_annotations(spark, d), done).groupBy("view_mode").agg(F.count("*").alias("n"))


_SN = "CAST(regexp_extract(source_name, '(\\d+)', 1) AS INTEGER)"
_TOP = f"""top AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_name ORDER BY dt DESC NULLS LAST, section, position) AS INTEGER) AS rank FROM candidates WHERE {_SN} % 2 = 0
  QUALIFY CASE WHEN {_SN} % 4 = 0 THEN rank <= 10 WHEN {_SN} % 6 = 0 THEN rank <= 1 ELSE true END)"""
_FRONT = f"fr AS (SELECT source_name, section, arg_max(url, id) AS furl FROM candidates WHERE {_SN} % 2 = 0 AND id % 10 = 7 GROUP BY ALL)"
_ANN = "ann AS (SELECT event_id AS id, user_id % 300 AS article_id, CASE event_id % 3 WHEN 0 THEN 'enhanced' WHEN 1 THEN 'summary' ELSE 'raw' END AS view_mode, event_id % 50 AS start_offset, event_id % 50 + 5 AS end_offset, 'green' AS color FROM events)"
_STREAK = """st AS (SELECT *, sum(CASE WHEN status <> 'error' THEN 1 ELSE 0 END) OVER w AS ge, sum(CASE WHEN status <> 'empty' THEN 1 ELSE 0 END) OVER w AS gm FROM checks WINDOW w AS (PARTITION BY rule_id ORDER BY checked_at, check_id ROWS UNBOUNDED PRECEDING)),
su AS (SELECT *, sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY rule_id, ge ORDER BY checked_at, check_id ROWS UNBOUNDED PRECEDING) AS cf, sum(CASE WHEN status = 'empty' THEN 1 ELSE 0 END) OVER (PARTITION BY rule_id, gm ORDER BY checked_at, check_id ROWS UNBOUNDED PRECEDING) AS cm FROM st)"""
_F = lambda where, val: f"SELECT 'rule_' || source AS rule_id, field, round(count(*) FILTER (hit) / count(*), 4) AS rate FROM (SELECT source, doc_id, field, {val} AS hit FROM documents, (SELECT unnest(['title', 'date', 'body']) AS field) f WHERE {where}) x GROUP BY ALL"
_HIT = "CASE field WHEN 'title' THEN doc_id % 10 <> 3 AND trim(substr(text, 1, 40)) <> '' WHEN 'date' THEN doc_id % 3 = 0 ELSE CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 2 = 0 END"
_HIT2 = f"CASE WHEN doc_id < 200 OR doc_id % 4 = 0 THEN true WHEN CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 3 = 0 THEN false ELSE {_HIT} END"

QUERIES = {
    "e01_cold_start_top_n": (e01, sql(ARTICLES, CANDIDATES, _TOP, then="SELECT id, rank FROM top")),
    "e02_cold_start_frontiers": (
        e02,
        sql(
            ARTICLES, CANDIDATES, _TOP, "l AS (SELECT source_name, section, arg_max(url, position) AS u FROM top GROUP BY ALL)", "f AS (SELECT source_name, section, arg_min(url, position) AS u FROM candidates GROUP BY ALL)",
            then="SELECT source_name, section, coalesce(l.u, f.u) AS url FROM f LEFT JOIN l USING (source_name, section)",
        ),
    ),
    "e03_time_cutoff": (
        e03,
        sql(
            ARTICLES, "c AS (SELECT source_name, coalesce(nullif(exact_time, ''), date) AS cutoff FROM articles WHERE NOT is_deleted QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY coalesce(nullif(exact_time, ''), date || ' 00:00:00') DESC, id DESC) = 1)",
            then="SELECT DISTINCT source_name, '2024-01-19 22:00:00' AS cutoff, 'today' AS mode FROM articles UNION ALL SELECT source_name, cutoff, 'continuous' FROM (SELECT DISTINCT source_name FROM articles) s LEFT JOIN c USING (source_name)",
        ),
    ),
    "e04_admit_incremental": (
        e04,
        sql(
            ARTICLES, CANDIDATES, _FRONT,
            f"""r AS (SELECT c.*, position AS u, id % 4 = 1 AS st, furl IS NOT NULL AND furl = url AS at_f, furl IS NOT NULL OR position <= CASE WHEN {_SN} % 3 = 0 THEN 20 ELSE 10 END AS win,
              CASE WHEN (dt IS NULL OR dt = '2024-01-10') AND (id % 18 = 0 OR dt = '2024-01-10') AND id % 5 <> 0 THEN '2024-01-' || lpad(CAST(1 + id * 5 % 28 AS VARCHAR), 2, '0') || ' 08:00:00' ELSE dt || ' 00:00:00' END AS eff
              FROM candidates c LEFT JOIN fr USING (source_name, section))""",
            "q AS (SELECT *, sum(CASE WHEN NOT st AND eff IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY source_name, section ORDER BY u) AS un, coalesce(eff <= '2024-01-10 06:00:00', false) AND NOT win AS old FROM r)",
            "s AS (SELECT *, NOT st AND eff IS NULL AND un > 3 AS spent FROM q)",
            "t AS (SELECT *, min(CASE WHEN (st AND (at_f OR NOT win)) OR (NOT st AND ((old AND dt IS NOT NULL) OR (at_f AND NOT spent))) THEN u END) OVER (PARTITION BY source_name, section) AS stop FROM s)",
            then="SELECT id, CAST(u AS INTEGER) AS unique_index, eff AS effective_dt FROM t WHERE (stop IS NULL OR u < stop) AND NOT st AND NOT spent AND NOT old",
        ),
    ),
    "e05_drop_title_noise": (e05, sql(ARTICLES, then="SELECT source_name, count(*) AS n FROM articles WHERE trim(title) NOT IN (SELECT trim(title) FROM articles WHERE id < 40) GROUP BY source_name")),
    "e06_today_filter": (e06, sql(ARTICLES, CANDIDATES, then="SELECT id, dt FROM candidates WHERE dt IS NULL OR dt = '2024-01-08'")),
    "e07_auto_seed_frontiers": (
        e07,
        sql(ARTICLES, CANDIDATES, _FRONT, then=f"SELECT source_name, section, url, NOT coalesce(dt > '{CUTOFF}', false) AS stops FROM candidates WHERE position = 1 AND (source_name, section) NOT IN (SELECT (source_name, section) FROM fr)"),
    ),
    "e08_source_run_summary": (
        e08,
        """WITH r AS (SELECT 's' || CAST(user_id % 40 AS VARCHAR) AS source_name, CASE WHEN user_id % 40 % 3 = 0 THEN event_id % 2 ELSE 0 END AS ni, event_type = 'error' AND user_id % 40 % 2 = 0 AS er, event_id % 7 AS sec, event_id % 9 = 0 AS wa, user_id % 40 = event_id % 45 AS sk FROM events),
g AS (SELECT source_name, sum(ni) AS new_items, count(*) FILTER (er) AS errors, sum(sec) AS seconds, count(*) FILTER (wa) AS warnings, coalesce(string_agg(DISTINCT r.source_name, ',' ORDER BY r.source_name) FILTER (sk), '') AS skipped FROM r GROUP BY ROLLUP (r.source_name))
SELECT *, CASE WHEN errors > 0 AND new_items = 0 THEN 'error' WHEN new_items > 0 THEN 'success' ELSE 'empty' END AS status FROM g""",
    ),
    "i01_field_hit_stats": (
        i01,
        f"SELECT 'rule_' || source AS rule_id, field, count(*) FILTER (hit) AS hit_count, count(*) AS total_count, round(count(*) FILTER (hit) / count(*), 4) AS hit_rate FROM (SELECT source, field, {_HIT} AS hit FROM documents, (SELECT unnest(['title', 'date', 'body']) AS field) f) x GROUP BY ALL",
    ),
    "i02_field_drift": (
        i02,
        f"""WITH c AS ({_F('doc_id >= 200', _HIT2)}), b AS ({_F('doc_id < 200', _HIT2)})
SELECT rule_id, field, b.rate AS baseline_rate, c.rate AS current_rate, CASE WHEN c.rate <= 0 THEN 'field_missing' ELSE 'hit_rate_drop' END AS reason FROM c JOIN b USING (rule_id, field) WHERE b.rate >= 0.6 AND (c.rate <= 0 OR round(b.rate - c.rate, 4) >= 0.5)""",
    ),
    "i02_drift_history": (
        i02_history,
        sql(
            CHECKS, "h AS (SELECT rule_id, checked_at, check_id, CASE WHEN check_id % 5 = 0 THEN 0.0 WHEN check_id % 3 = 0 THEN 0.4 ELSE 0.9 END AS r FROM checks WHERE status = 'healthy')",
            "f AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY checked_at, check_id) AS k FROM h)",
            "m AS (SELECT *, min(CASE WHEN r = 0.9 THEN k END) OVER (PARTITION BY rule_id) AS good FROM f)",
            then="SELECT rule_id, count(*) FILTER (k > good AND r < 0.9) AS drifts, count(*) AS checks FROM m GROUP BY rule_id",
        ),
    ),
    "i03_classify_failures": (
        i03,
        sql(
            CHECKS,
            then="""SELECT CASE WHEN status <> 'error' THEN status ELSE CASE check_id % 7 WHEN 1 THEN 'network_error' WHEN 2 THEN 'selector_error' WHEN 3 THEN 'list_container_drift' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'network_error' ELSE 'unknown_error' END END AS kind, count(*) AS n FROM checks GROUP BY 1""",
        ),
    ),
    "i04_health_streaks": (
        i04,
        sql(
            CHECKS, _STREAK,
            then="""SELECT check_id, cf AS consecutive_failures, cm AS consecutive_empties, strftime(max(CASE WHEN status <> 'error' THEN checked_at END) OVER w, '%Y-%m-%d %H:%M:%S') AS last_success, strftime(max(CASE WHEN status = 'error' THEN checked_at END) OVER w, '%Y-%m-%d %H:%M:%S') AS last_failure,
cf >= 2 OR cm >= 3 AS is_alerting FROM su WINDOW w AS (PARTITION BY rule_id ORDER BY checked_at, check_id ROWS UNBOUNDED PRECEDING)""",
        ),
    ),
    "i05_health_summary": (
        i05,
        sql(
            CHECKS, _STREAK, "l AS (SELECT * FROM su QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY checked_at DESC, check_id DESC) = 1)",
            then="SELECT rule_id, status, strftime(checked_at, '%Y-%m-%d %H:%M:%S') AS checked_at, cf AS consecutive_failures, cm AS consecutive_empties FROM l WHERE cf > 0 OR cm > 0 ORDER BY cf DESC, l.checked_at, rule_id LIMIT 5",
        ),
    ),
    "i05_health_totals": (
        i05_totals,
        sql(CHECKS, "l AS (SELECT * FROM checks QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY checked_at DESC, check_id DESC) = 1)", then="SELECT count(*) AS total, count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'error') AS error FROM l"),
    ),
    "i05_health_totals_rss": (
        i05_rss,
        sql(CHECKS, "l AS (SELECT * FROM checks QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY checked_at DESC, check_id DESC) = 1)", then="SELECT count(*) AS total, count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'error') AS error FROM l WHERE CAST(regexp_extract(rule_id, '([0-9]+)', 1) AS INTEGER) % 2 = 0"),
    ),
    "i06_stability_score": (
        i06,
        f"""WITH s AS (SELECT 'r' || CAST(doc_id % 30 AS VARCHAR) AS rule_id, [93.0, 5.0, 100.0, 35.0, 40.0, 60.0, 30.0, 82.0][CAST((doc_id % 30 + doc_id // 30) % 8 + 1 AS INTEGER)] AS s FROM documents), g AS (SELECT rule_id, round(avg(s), 2) AS score FROM s GROUP BY 1)
SELECT rule_id, score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'at_risk' END AS rating FROM g""",
    ),
    "i07_vote_best_rule": (
        i07,
        """WITH c AS (SELECT source AS source_name, 'r' || CAST(doc_id AS VARCHAR) AS rule_id, round(least(10.0 * (doc_id % 6), 40) + CASE WHEN doc_id % 6 > 0 THEN 5.0 * (doc_id % 4) ELSE 0 END + 0.4 * (doc_id * 37 % 101), 4) AS score FROM documents)
SELECT source_name, rule_id, CAST(score AS DOUBLE) AS score FROM c QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY score DESC, rule_id) = 1""",
    ),
    "i08_version_history": (
        i08,
        sql(
            CHECKS, "l AS (SELECT rule_id, 'v' || lpad(CAST(check_id AS VARCHAR), 8, '0') AS version_id, strftime(checked_at, '%Y-%m-%d %H:%M:%S') AS saved_at, CAST(check_id % 3 AS VARCHAR) || status AS h FROM checks)",
            "p AS (SELECT *, lag(h) OVER (PARTITION BY rule_id ORDER BY saved_at, version_id) AS b FROM l)", "c AS (SELECT * FROM p WHERE b IS NULL OR b <> h)",
            then="SELECT rule_id, version_id, saved_at, CAST(row_number() OVER (PARTITION BY rule_id ORDER BY saved_at DESC, version_id DESC) AS INTEGER) AS rank FROM c QUALIFY rank <= 20",
        ),
    ),
    "i09_restore_versions": (
        i09,
        sql(
            ARTICLES, "r AS (SELECT rule_id, max(title) AS snapshot, arg_min(title, id) AS pinned, CAST(regexp_extract(rule_id, '(\\d+)', 1) AS INTEGER) % 2 = 0 AS p FROM articles GROUP BY rule_id)",
            then="SELECT rule_id, 'rule' AS version_id, CASE WHEN p THEN pinned ELSE snapshot END AS snapshot FROM r UNION ALL SELECT rule_id, 'rollback-' || rule_id || '-2024-02-01', snapshot FROM r WHERE p",
        ),
    ),
    "i10_import_rules": (
        i10,
        """SELECT 'r' || CAST(doc_id AS VARCHAR) AS rule_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 OR trim(substr(text, 1, 40)) = '' THEN 'invalid' WHEN doc_id % 3 <> 0 THEN 'added' WHEN o THEN 'updated' ELSE 'skipped' END AS outcome,
concat_ws(',', CASE WHEN doc_id % 5 = 0 OR trim(substr(text, 1, 40)) = '' THEN 'task_name' END, CASE WHEN doc_id % 7 = 0 THEN 'url' END) AS missing, o AS overwrite FROM documents, (SELECT unnest([true, false]) AS o) x""",
    ),
    "i11_normalize_rules": (
        i11,
        "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'rss' ELSE 'html' END AS source_type, doc_id % 5 = 0 OR doc_id % 2 = 0 AS enable_formatting, doc_id % 2 = 0 AS enable_summary, CASE WHEN doc_id % 3 <> 0 THEN '.list' END AS list_container, source AS agent, 'x' AS accept FROM documents",
    ),
    "k01_annotations_for": (k01, f"WITH {_ANN} SELECT * FROM ann WHERE view_mode = 'summary' AND article_id IN (SELECT doc_id FROM documents WHERE doc_id % 7 = 0)"),
    "k02_merge_annotations": (
        k02,
        f"""WITH {_ANN}, e AS (SELECT CASE WHEN id % 8 = 0 THEN id ELSE id + 1000000 END AS id, article_id, view_mode, greatest(0, start_offset - 10) AS start_offset, greatest(greatest(0, start_offset - 10), end_offset - 20) AS end_offset, CASE WHEN id % 16 = 0 THEN 'red' ELSE 'yellow' END AS color FROM ann WHERE id % 4 = 0)
SELECT * FROM ann WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.id = ann.id AND e.article_id = ann.article_id) UNION ALL SELECT * FROM e""",
    ),
    "k03_delete_annotations": (k03, f"WITH {_ANN} SELECT id FROM ann WHERE id % 5 <> 0 AND NOT (view_mode = 'raw' AND article_id < 50)"),
    "k04_invalidate_annotations": (
        k04,
        f"WITH {_ANN} SELECT view_mode, count(*) AS n FROM ann WHERE NOT (article_id < 200 AND (view_mode = 'summary' OR (view_mode = 'enhanced' AND article_id % 2 = 0))) GROUP BY view_mode",
    ),
}
