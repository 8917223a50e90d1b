"""Time normalisation of text columns, and time reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_text = lambda c: F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _plain(text: Column) -> Column:
    """年, 月 and / as -, 日 gone, white space single."""
    return F.trim(F.regexp_replace(F.replace(F.translate(text, "年月/", "---"), F.lit("日"), F.lit(" ")), r"\s+", " "))


def _date(text: Column) -> Column:
    """YYYY-MM-DD of a text that begins with a date, else empty."""
    g = lambda n: F.regexp_extract(text, r"^(\d{4})-(\d{1,2})-(\d{1,2})", n)
    return F.when(g(1) != "", F.concat(g(1), F.lit("-"), F.lpad(g(2), 2, "0"), F.lit("-"), F.lpad(g(3), 2, "0"))).otherwise("")


def _clock(text: Column) -> Column:
    """HH:MM:SS behind the date of a text, else empty."""
    g = lambda n: F.regexp_extract(text, r"^\S+[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2}))?", n)
    return F.when(g(1) != "", F.concat(F.lpad(g(1), 2, "0"), F.lit(":"), F.lpad(g(2), 2, "0"), F.lit(":"), F.lpad(F.coalesce(F.nullif(g(3), F.lit("")), F.lit("0")), 2, "0"))).otherwise("")


def normalize_times(articles: DataFrame, date: str = "date", exact: str = "exact_time") -> DataFrame:
    """articles with norm_date, norm_time and time_status: parsed, defaulted (a date without time gets midnight) or as_is."""
    x, d = _plain(_text(exact)), _plain(_text(date))
    day = F.coalesce(F.nullif(_date(x), F.lit("")), _date(d))
    norm_date = F.when(_date(d) != "", _date(d)).when(_date(x) != "", _date(x)).otherwise("")
    clock = _clock(x)
    norm_time = F.when((day != "") & (clock != ""), F.concat(day, F.lit(" "), clock)).when(day != "", F.concat(day, F.lit(" 00:00:00"))).otherwise(_text(exact))
    status = F.when((day != "") & (clock != ""), "parsed").when(day != "", "defaulted").otherwise("as_is")
    return articles.withColumns({"norm_date": norm_date, "norm_time": norm_time, "time_status": status})


STEPS = ["cjk_date", "slash_date", "date_from_time", "cjk_time", "slash_time", "completed"]


def backfill_times(articles: DataFrame, date: str = "date", exact: str = "exact_time") -> DataFrame:
    """The six ordered rewrites, with a flag for each step that changed the row."""
    cjk = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c), "[年月]", "-"), "日", " "), r"\s+$", "")
    pad = lambda c: F.when(_date(c) != "", F.concat(_date(c), F.regexp_replace(c, r"^\d{4}-\d{1,2}-\d{1,2}", ""))).otherwise(c)
    rows = articles.withColumns({date: _text(date), exact: _text(exact)})
    steps = [
        (date, lambda: F.when(F.col(date).rlike("年"), pad(cjk(date))).otherwise(F.col(date))),
        (date, lambda: pad(F.replace(F.col(date), F.lit("/"), F.lit("-")))),
        (date, lambda: F.when((F.col(date) == "") & F.col(exact).rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(exact, 1, 10)).otherwise(F.col(date))),
        (exact, lambda: F.when(F.col(exact).rlike("年"), pad(F.regexp_replace(cjk(exact), r"\s+", " "))).otherwise(F.col(exact))),
        (exact, lambda: pad(F.replace(F.col(exact), F.lit("/"), F.lit("-")))),
        (exact, lambda: F.when(F.col(exact).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(exact, F.lit(" 00:00:00"))).otherwise(F.col(exact))),
    ]
    for name, (c, new) in zip(STEPS, steps, strict=True):
        rows = rows.withColumn("_new", new()).withColumn(f"did_{name}", F.col("_new") != F.col(c)).withColumn(c, F.col("_new")).drop("_new")
    return rows


def backfill_report(rows: DataFrame) -> DataFrame:
    """Rows changed by each step."""
    return rows.agg(*(F.count_if(f"did_{s}").alias(s) for s in STEPS))


def parse_mixed_date(text: Column) -> Column:
    """Best-effort date: CJK, year first, day or month first (a first number above 12 is the day), English month
    names, the first three numbers if the first has four digits, else null."""
    g = lambda p, n: F.regexp_extract(text, p, n)
    make = lambda y, m, d: F.try_to_date(F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    cjk, iso, us = r"(\d{4})年(\d{1,2})月(\d{1,2})日", r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})"
    named, behind = r"(?i)\b(" + "|".join(_MONTHS) + r")[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})", r"(?i)(\d{1,2})\s+(" + "|".join(_MONTHS) + r")[a-z]*\.?,?\s+(\d{4})"
    numbers = r"^\D*(\d{4})\D+(\d{1,2})\D+(\d{1,2})(?!\d)"
    month = lambda m: F.array_position(F.lit(_MONTHS), F.lower(m)).cast("string")
    first = F.try_to_number(F.nullif(g(us, 1), F.lit("")), F.lit("99"))
    day_first = F.coalesce(first > 12, F.lit(False))
    return F.coalesce(
        F.when(g(cjk, 1) != "", make(g(cjk, 1), g(cjk, 2), g(cjk, 3))),
        F.when(g(iso, 1) != "", make(g(iso, 1), g(iso, 2), g(iso, 3))),
        F.when(g(us, 3) != "", F.when(day_first, make(g(us, 3), g(us, 2), g(us, 1))).otherwise(make(g(us, 3), g(us, 1), g(us, 2)))),
        F.when(g(named, 1) != "", make(g(named, 3), month(g(named, 1)), g(named, 2))),
        F.when(g(behind, 2) != "", make(g(behind, 3), month(g(behind, 2)), g(behind, 1))),
        F.when(F.regexp_extract(text, numbers, 1) != "", make(g(numbers, 1), g(numbers, 2), g(numbers, 3))),
    )


def parse_mixed_dates(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("parsed_date", parse_mixed_date(_text(column)))


def extract_dates_from_text(rows: DataFrame, column: str, default_year: int) -> DataFrame:
    """rows with found_date: the first full date, CJK date or month and day with the default year; else the text."""
    t = _text(column)
    g = lambda p, n: F.regexp_extract(t, p, n)
    join = lambda y, m, d: F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
    full, cjk, cjk_day, day = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", r"(\d{4})年(\d{1,2})月(\d{1,2})日?", r"(\d{1,2})月(\d{1,2})日", r"(?:^|[^\d])(\d{1,2})[-/](\d{1,2})(?:[^\d]|$)"
    year = F.lit(str(default_year))
    found = F.when(g(full, 1) != "", join(g(full, 1), g(full, 2), g(full, 3))).when(g(cjk, 1) != "", join(g(cjk, 1), g(cjk, 2), g(cjk, 3)))
    return rows.withColumn("found_date", found.when(g(cjk_day, 1) != "", join(year, g(cjk_day, 1), g(cjk_day, 2))).when(g(day, 1) != "", join(year, g(day, 1), g(day, 2))).otherwise(t))


def page_publish_time(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with published: PubDate meta, else an info bar's date, else a labelled date in the first 1000 characters of text,
    else a script's epoch `ct`, else its publish_time."""
    h = F.coalesce(F.col(html), F.lit(""))
    g = lambda t, p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    date = r"(\d{4}-\d{1,2}-\d{1,2}(?: \d{1,2}:\d{2}(?::\d{2})?)?)"
    head = F.substring(F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " "), 1, 1000)
    epoch = g(h, r"\bct\s*=\s*[\"']?(\d{10})")
    return pages.withColumn(
        "published",
        F.coalesce(
            g(h, r"(?i)<meta[^>]*name=[\"']PubDate[\"'][^>]*content=[\"']([^\"']+)[\"']"),
            g(h, r"(?is)class=[\"'][^\"']*info[^\"']*[\"'][^>]*>[^<]*?" + date),
            g(head, r"(?:发布时间|日期|时间|Published|Date)\s*[:：]\s*" + date),
            F.date_format(F.timestamp_seconds(epoch.cast("long")), "yyyy-MM-dd HH:mm:ss"),
            g(h, r"publish_time\s*[=:]\s*[\"']([^\"']+)[\"']"),
        ),
    )


def time_heatmap(rows: DataFrame, ts: str) -> DataFrame:
    """hour, minute_bin, n on the full grid of 24 hours and ten-minute bins."""
    spark = rows.sparkSession
    grid = spark.range(24 * 6).select(F.floor(F.col("id") / 6).cast("int").alias("hour"), (F.col("id") % 6 * 10).cast("int").alias("minute_bin"))
    counts = rows.where(F.col(ts).isNotNull()).groupBy(F.hour(ts).alias("hour"), (F.floor(F.minute(ts) / 10) * 10).cast("int").alias("minute_bin")).agg(F.count("*").alias("n"))
    return grid.join(F.broadcast(counts), ["hour", "minute_bin"], "left").select("hour", "minute_bin", F.coalesce("n", F.lit(0)).alias("n"))


def attachment_types_report(links: DataFrame, pages: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Distinct file extensions of each page's links, sorted and joined, with the page's columns."""
    ext = F.lower(F.regexp_extract(F.col("url"), r"\.([A-Za-z0-9]{1,5})(?:[?#]|$)", 1))
    kinds = links.withColumn("_e", ext).where("_e <> ''").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("_e")), ",").alias("types"))
    return pages.select(key, *columns).join(kinds, key, "left").withColumn("types", F.coalesce("types", F.lit("")))
