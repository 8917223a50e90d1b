"""Golden cases that the tables can't supply, and properties."""

from pyspark.sql import functions as F

from feedspark.functions.urls import canonical
from feedspark.operators import admission, identity, pages, text, times
from feedspark.operators import events as ev


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


def test_canonical_url(spark):
    cases = {
        " HTTP://User:pw@News.Example.COM:80//a//b/?utm_source=x&b=2&amp;A=1&from=y#top ": "http://news.example.com/a/b?A=1&b=2",
        "https://x.org:443/": "https://x.org/",
        "https://x.org:8443/p/#item-3": "https://x.org:8443/p#item-3",
        "http://x.org/?q=a b&e": "http://x.org/?e=&q=a+b",
        "": "",
    }
    for raw, want in cases.items():
        got = one(spark, raw, canonical)
        assert got == want
        assert one(spark, got, canonical) == got


def test_changes_and_merge_are_stable(spark):
    cols = "id long, url string, raw_hash string, is_read boolean, is_favorite boolean, is_deleted boolean"
    stored = spark.createDataFrame([(1, "http://a/x?utm_id=3", "h1", True, True, False), (2, "http://a/y", "h2", True, False, True)], cols)
    new = spark.createDataFrame([(3, "http://a/x", "h9", False, False, False), (4, "http://a/z", "h4", False, False, False), (5, "", "h5", False, False, False)], cols)
    assert {r["id"]: r["change"] for r in identity.classify_changes(new, stored).collect()} == {3: "updated", 4: "new", 5: "invalid_url"}
    once = identity.merge_articles(stored, new, "id", "preserve_user_state")
    assert {(r["id"], r["is_read"], r["is_favorite"]) for r in once.collect()} == {(2, True, False), (3, True, True), (4, False, False)}
    assert sorted(identity.merge_articles(once, new, "id", "preserve_user_state").collect()) == sorted(once.collect())
    assert {(r["id"], r["is_read"]) for r in identity.merge_articles(stored, new, "id").collect()} == {(2, True), (3, False), (4, False)}


def test_fingerprint_ignores_order_and_links(spark):
    rows = spark.createDataFrame([({"b": "2", "A": " 1 "}, 1), ({"A": "1", "b": "2", "Link": "x"}, 2), ({"A": "1"}, 3)], "f map<string,string>, id int")
    rows = rows.select("id", F.lit("http://p/#x").alias("p"), F.lit("s").alias("s"), F.lit("t").alias("t"), F.lit("").alias("d"), F.lit(None).cast("string").alias("b"), "f")
    keys = {r["id"]: r["item_key"] for r in identity.fingerprint_keys(rows, "p", "s", "t", "d", "b", "f").collect()}
    assert keys[1] == keys[2] != keys[3] and keys[1].startswith("http://p/#item-")


def test_recipients(spark):
    rows = spark.createDataFrame([(1, " A@x.org "), (2, "a@X.org"), (3, "bad"), (4, "b@y.com"), (5, None)], "k long, email string")
    assert [(r["k"], r["email"], r["batch"]) for r in identity.dedup_recipients(rows, "k", 1).orderBy("k").collect()] == [(1, "A@x.org", 0), (4, "b@y.com", 1)]


def test_dates(spark):
    cases = {"2024年3月5日": "2024-03-05", "2024.3.5": "2024-03-05", "25/12/2023": "2023-12-25", "12/25/2023": "2023-12-25", "5 March 2022": "2022-03-05", "Mar. 5, 2022": "2022-03-05", "2024-02-31": None, "": None, "none": None}
    for raw, want in cases.items():
        got = one(spark, raw, times.parse_mixed_date)
        assert (str(got) if got else None) == want, raw


def test_tags(spark):
    rows = spark.createDataFrame([("【a】【b】【a】【c】【d】\nbody",), ("no 【a】",), (None,)], "t string")
    got = [(r["tags"], r["body"]) for r in text.extract_tags(rows, "t").collect()]
    assert got == [(["a", "b", "c"], "body"), ([], "no 【a】"), ([], "")]


def chunked(raw, trigger=7000, target=3600, hard=4600):
    """The packing rules, block by block."""
    import re

    whole = (raw or "").strip()
    if len(whole) < trigger:
        return [whole] if whole else []
    blocks = []
    for block in (b.strip() for b in re.split(r"\n\s*\n", whole)):
        if len(block) <= hard:
            blocks += [block] if block else []
            continue
        piece, size = [], 0
        for line in (x.rstrip() for x in block.splitlines() if x.strip()):
            if piece and size + len(line) + 1 > hard:
                blocks.append("\n".join(piece).strip())
                piece, size = [], 0
            piece.append(line)
            size += len(line) + 1
        blocks.append("\n".join(piece).strip())
    out = []
    for block in blocks:
        if out and not (len(out[-1]) + 2 + len(block) > hard or (len(out[-1]) >= target and block.startswith("#"))):
            out[-1] += "\n\n" + block
        else:
            out.append(block)
    return out


def test_chunks(spark):
    """Limits, headings, long lines, odd white space; chunks put together give the blocks back."""
    import random

    rnd = random.Random(3)
    ends = ["\n", "\n\n", "\n \t\n", "\r\n\r\n", "\n\u3000\n", "\x0b", "\u2028", " \n"]
    texts = [None, "", " \n ", "short", "x" * 6999, "x" * 7000, "\n\n".join(["y" * 2000] * 4), "\n".join(["z" * 99] * 80), ("z" * 99 + "\n") * 80 + "\n" + "# h\n\n" * 3, "w" * 5000 + "\n" + "v" * 5000]
    texts += ["".join(rnd.choice(["", "# ", "  "]) + "é" * rnd.randint(0, 900) + rnd.choice(ends) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in text.chunk_documents(rows, "id", "t").orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    assert [got.get(i, []) for i in range(len(texts))] == [chunked(t) for t in texts]
    assert [len(c) for c in got[6]] == [4002, 4002] and "".join("".join(got[8]).split()) == "".join(texts[8].split())
    whole = {r["id"]: r["text"] for r in text.recombine_chunks(text.chunk_documents(rows, "id", "t"), "id", "chunk_index", "chunk").collect()}
    assert all("".join(whole[i].split()) == "".join(t.split()) for i, t in enumerate(texts) if i in whole)


def test_autolink(spark):
    rows = spark.createDataFrame([("see https://a.org/x/y/z?q=1 and `https://b.org` [t](https://c.org)",), ("",)], "t string")
    got = [(r["linked"], r["n_links"]) for r in text.autolink(rows, "t").collect()]
    assert got == [("see [a.org/.../y/z](https://a.org/x/y/z?q=1) and `https://b.org` [t](https://c.org)", 1), ("", 0)]


def test_sampling_is_monotone(spark):
    e = spark.range(2000).select(F.col("id").cast("string").alias("event_id"), F.when(F.col("id") % 50 == 0, "error_x").otherwise("view").alias("event"))
    low, high = ({r["event_id"] for r in ev.sample_events(e, p).collect()} for p in (0.1, 0.4))
    assert low < high and len({str(i) for i in range(0, 2000, 50)} - low) == 0


def crawl(spark, rows):
    return spark.createDataFrame([("s", 0, i + 1, u, u, d) for i, (u, d) in enumerate(rows)], "source_name string, section int, position int, url string, title string, dt string")


def admitted(spark, rows, stored=(), frontier=None, details=(), cutoff="2024-01-10 06:00:00", window=2):
    s = spark.createDataFrame([(u,) for u in stored], "url string")
    f = spark.createDataFrame([("s", 0, frontier)] if frontier else [], "source_name string, section int, url string")
    d = spark.createDataFrame(list(details), "url string, detail_dt string")
    c = spark.createDataFrame([("s", cutoff, window)], "source_name string, cutoff string, repair_window int")
    return [r["url"] for r in admission.admit_incremental(crawl(spark, rows), s, f, d, c).orderBy("position").collect()]


def test_admission(spark):
    new = "2024-01-12"
    assert admitted(spark, [("a", new), ("b", new), ("c", new), ("d", new)], stored=["c"]) == ["a", "b"]  # a stored URL behind the window stops
    assert admitted(spark, [("a", new), ("b", new), ("c", new)], stored=["a"]) == ["b", "c"]  # inside the window it doesn't
    assert admitted(spark, [("a", new), ("b", new), ("c", new), ("d", new)], stored=["b"], frontier="d") == ["a", "c"]  # down to the frontier
    assert admitted(spark, [("a", new), ("b", new), ("c", "2024-01-01"), ("d", new)]) == ["a", "b"]  # a list date at the cutoff stops
    assert admitted(spark, [("a", new), ("b", new), ("c", None), ("d", new)], details=[("c", "2024-01-01 00:00:00")]) == ["a", "b", "d"]  # a detail's is skipped
    assert admitted(spark, [(c, None) for c in "abcde"]) == ["a", "b", "c"]  # three without any time
    assert admitted(spark, [("a", "2024-01-10"), ("b", new)], details=[("a", "2024-01-10 09:00:00")], window=0) == ["a", "b"]  # the cutoff's day asks the detail


def test_empty_and_null_pages(spark):
    rows = spark.createDataFrame([(1, "http://a/b", None), (2, "http://a/b", "")], "page_id long, url string, html string")
    assert pages.page_links(rows).count() == 0 and pages.page_images(rows).count() == 0 and pages.page_blocks(rows).count() == 0
    assert [r["n_links"] for r in pages.page_summary(rows).collect()] == [0, 0]
    assert pages.page_links(rows.limit(0)).count() == 0


def test_properties_with_equal_keys_lists_and_objects(spark):
    rows = spark.createDataFrame(
        [("error_x", {"a": "1", " a": "2", "list": '["x", "", {"password": "p", "url": "http://H.org/a"}]', "o": '{"token": " t ", "prompt": "p"}', "none": '{"html": "x"}'}), ("e", None)],
        "event string, props map<string,string>",
    )
    got = {r["event"]: r["props"] for r in ev.sanitize_props(rows).collect()}
    assert got["e"] == {}
    assert got["error_x"]["a"] == "2" and got["error_x"]["o"] == '{"token":"t"}' and "none" not in got["error_x"]
    assert "password" not in got["error_x"]["list"] and "H.org" not in got["error_x"]["list"] and '"x"' in got["error_x"]["list"]


def _reference_props(value, most, custom_of=None):
    """The rules for properties, read one value at a time."""
    import hashlib
    from urllib.parse import urlparse

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()[:16]
    if isinstance(value, dict):
        custom = bool(value.get("is_custom_source")) or str(value.get("source_type") or "").strip().lower() == "rss" or bool(str(value.get("rule_id") or "").strip())
        out = {}
        for key, v in value.items():
            key = key.strip()
            if not key or key.lower() in ev.SECRET_KEYS or v is None:
                continue
            if key.lower() in ev.URL_KEYS or key.lower().endswith("_url"):
                host = (urlparse(str(v).strip()).hostname or "").lower()
                if host:
                    out[key + "DomainHash"] = sha(host)
            elif key == "source_name" and custom:
                if str(v).strip():
                    out["sourceNameHash"] = sha(str(v).strip())
            else:
                inner = _reference_props(v, most)
                if inner not in (None, "", {}):
                    out[key] = inner
        return out | {"is_custom_source": True} if custom else out
    if isinstance(value, list):
        return [x for x in (_reference_props(v, most) for v in value[:12]) if x not in (None, "", [], {})]
    if isinstance(value, str):
        text = value.strip()
        return text[:most].rstrip() + "..." if len(text) > most else text
    return value


def test_no_secret_at_any_depth(spark):
    """Random objects of up to six levels come out as the rules say, and no secret is left."""
    import json
    import random

    rnd = random.Random(5)
    keys = ["a", "b", "password", "API_KEY", "url", "target_url", "source_name", "source_type", "rule_id", "is_custom_source", "n"]

    def make(depth):
        kind = rnd.random()
        if depth and kind < 0.45:
            return {k: make(0 if k in ("source_name", "url", "target_url") else depth - 1) for k in rnd.sample(keys, 4)}
        if depth and kind < 0.65:
            return [make(depth - 1) for _ in range(rnd.randint(0, 14))]
        if depth == 0:
            return rnd.choice(["", " x ", "https://H.org/q?a=b", "secret" * 50, "it's \"q\" \\ é"])
        return rnd.choice([1, 2.5, -7, True, False, None, "", " x ", "rss", "RSS", "secret" * 50])

    values = [make(6) for _ in range(300)] + [[make(4) for _ in range(14)] for _ in range(50)]
    rows = spark.createDataFrame([(i, "e", {"x": json.dumps(v)}) for i, v in enumerate(values)], "i int, event string, props map<string,string>")
    got = {r["i"]: r["props"].get("x") for r in ev.sanitize_props(rows).collect()}
    for i, v in enumerate(values):
        if not isinstance(v, (dict, list)):
            continue
        want = _reference_props(v, 240)
        assert (json.loads(got[i]) if got[i] else {}) == want, (v, got[i])
        assert "password" not in (got[i] or "").lower() and "api_key" not in (got[i] or "").lower()
    deep = lambda n, inner: inner if n == 0 else {"a": deep(n - 1, inner)}
    odd = [json.dumps(deep(n, {"password": "x", "n": 1})) for n in range(12)] + ["[" * 100_000 + "]" * 100_000, '{"a":1,"a":2,"password":"x"}', '[{"a":1,"a":2,"password":"x"}]', '{"password":', "[password"]
    rows = spark.createDataFrame([(i, "e", {"x": v}) for i, v in enumerate(odd)], "i int, event string, props map<string,string>")
    got = {r["i"]: r["props"].get("x") for r in ev.sanitize_props(rows).collect()}
    assert [json.loads(got[n]) for n in range(12)] == [deep(n, {"n": 1}) for n in range(12)]
    assert got[12] is None and got[13] == '{"a":2}' and got[14] == '[{"a":2}]' and got[15] == '{"password":' and got[16] == "[password"  # the last two are no JSON, but text


def test_fields_whose_keys_differ_by_case(spark):
    rows = spark.createDataFrame([(1, {"Title": " ", "title": "b", "LINK": "u"})], "id long, f map<string,string>")
    got = pages.map_fields_by_alias(rows, "f", {"title": ["title"], "link": ["href", "link"]}).first()
    assert (got["title"], got["link"]) == ("b", "u")


def test_rolling_metrics_in_stretches(spark):
    """Small stretches and a series in one bucket give what one window over the series gives."""
    from pyspark.sql import Window

    rows = spark.range(500).selectExpr("case when id % 3 > 0 then 'a' else 'b' end as s", "timestamp_seconds(id * 7919 % 40000) as ts", "id", "cast(id * 37 % 101 as double) as v")
    w = Window.partitionBy("s").orderBy("ts", "id")
    want = {r["id"]: (round(r["m"], 5), r["p"]) for r in rows.select("id", F.avg("v").over(w.rowsBetween(-6, 0)).alias("m"), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("p")).collect()}
    for bucket, width in (("hour", 7), ("day", 20), ("minute", 1000)):
        got = ev.rolling_metrics(rows, "s", ["ts", "id"], "v", n=7, bucket=bucket, width=width).collect()
        assert {r["id"]: (round(r["rolling_mean"], 5), r["peak"]) for r in got} == want and len(got) == 500


def test_drift_goes_on_over_batches():
    from feedspark.operators.rules import drift_steps

    rates = [0.3, 0.9, 0.4, 0.0, 0.5, 0.45, 0.9]
    whole = drift_steps(rates, None)
    assert whole == ([False, False, True, True, False, False, False], 0.9)
    for k in range(len(rates)):
        first, base = drift_steps(rates[:k], None)
        rest, end = drift_steps(rates[k:], base)
        assert (first + rest, end) == whole


def test_drift_maps_put_together():
    """Maps of stretches, put together at any cuts, give the fold's baseline on random series."""
    import random

    from feedspark.operators.rules import drift_map, drift_steps, outgoing

    rnd = random.Random(7)
    for _ in range(1000):
        rates = [round(rnd.choice([0.0, rnd.random(), 0.59, 0.6, 1.0, 0.1, 0.10001]), rnd.randint(1, 5)) for _ in range(rnd.randint(0, 40))]
        base = want = rnd.choice([None, 0.0, 0.3, 0.6, 0.95, 1.0])
        cuts = sorted(rnd.randint(0, len(rates)) for _ in range(3))
        for a, b in zip([0, *cuts], [*cuts, len(rates)], strict=True):
            base = outgoing(drift_map(rates[a:b]), base)
        assert base == drift_steps(rates, want)[1]


def test_hot_rule_in_slices(spark):
    """Streaks and drift of one long series, a short one and one without a name, in slices and as a fold."""
    from feedspark.operators import rules

    raw = spark.range(3000).selectExpr(
        "id as check_id", "case when id % 10 < 7 then 'hot' when id % 10 = 7 then null else concat('r', id % 40) end as rule_id", "timestamp_seconds(cast(hash(id) % 5000 as long)) as checked_at",
        "case when pmod(hash(id, 1), 10) < 4 then 'error' when pmod(hash(id, 1), 10) < 7 then 'empty' else 'healthy' end as status", "pmod(hash(id, 2), 11) / 10D as hit_rate",
    )
    rows = sorted(raw.collect(), key=lambda r: (r["checked_at"], r["check_id"]))
    streak, drift, state = {}, {}, {}
    for r in rows:
        e, m, s, f, base = state.get(r["rule_id"], (0, 0, None, None, None))
        e, m = (e + 1 if r["status"] == "error" else 0), (m + 1 if r["status"] == "empty" else 0)
        s, f = (s, r["checked_at"]) if r["status"] == "error" else (r["checked_at"], f)
        if r["status"] == "healthy":
            flags, base = rules.drift_steps([r["hit_rate"]], base)
            drift[r["check_id"]] = flags[0]
        state[r["rule_id"]] = (e, m, s, f, base)
        streak[r["check_id"]] = (e, m, s, f, e >= 2 or m >= 3)
    for slices in (1, 7, 64):
        got = rules.health_streaks(raw, slices=slices).collect()
        assert {r["check_id"]: (r["consecutive_failures"], r["consecutive_empties"], r["last_success"], r["last_failure"], r["is_alerting"]) for r in got} == streak and len(got) == 3000
        got = rules.drift_history(raw, slices=slices).collect()
        assert {r["check_id"]: r["drifted"] for r in got} == drift and len(got) == len(drift)
    cut = rules.sliced(raw, "checked_at").where("rule_id = 'hot'").groupBy("_slice").count()
    assert cut.count() > 50 and cut.agg(F.max("count")).first()[0] < 100
    assert rules.health_streaks(raw.limit(0)).count() == 0 and rules.drift_history(raw.limit(0)).count() == 0


def test_long_section_in_slices(spark):
    """A section of two thirds of all rows, scanned in slices, admits what a scan row by row does."""
    import random

    rnd = random.Random(11)
    schema = "source_name string, section int, position int, url string, title string, dt string"
    for case in range(3):
        rows, n = [], 1200
        for i in range(n):
            section = 0 if i % 3 else 1 + i % 20
            dt = rnd.choice([None] * (case + 1) + ["2024-01-12", "2024-01-11 08:00:00"] * 6 + ["2024-01-09"] * (case == 2))
            rows.append(("s", section, i + 1, f"u{rnd.randint(0, 2 * n)}" if rnd.random() < 0.95 else rnd.choice([None, ""]), "t", dt))
        stored = {f"u{i}" for i in range(0, 2 * n, 50 if case else 5000)}
        frontier = {0: "u7"} if case == 1 else {}
        details = {f"u{i}": "2024-01-09 10:00:00" if i % 2 else "2024-01-12 10:00:00" for i in range(0, 2 * n, 3)}
        cutoff, window, grace = "2024-01-10 06:00:00", 2, 3
        once, want = {}, []
        for r in sorted((r for r in rows if r[3]), key=lambda r: (r[1], r[2])):
            once.setdefault(r[3], r)
        for section in {r[1] for r in once.values()}:
            undated = 0
            for index, (_, _, _, url, _, dt) in enumerate(sorted((r for r in once.values() if r[1] == section), key=lambda r: r[2]), 1):
                inside = section in frontier or index <= window
                at = frontier.get(section) == url
                effective = (dt + " 00:00:00" if dt and len(dt) == 10 else dt) or details.get(url)
                if url in stored:
                    if at or not inside:
                        break
                    continue
                undated += effective is None
                spent, old = effective is None and undated > grace, effective is not None and effective <= cutoff and not inside
                if (old and dt is not None) or (at and not spent):
                    break
                if not spent and not old:
                    want.append((section, url, index, effective))
        df = lambda data, kinds: spark.createDataFrame(data, kinds)
        tables = [df([(u,) for u in stored], "url string"), df([("s", k, v) for k, v in frontier.items()], "source_name string, section int, url string"), df(list(details.items()), "url string, detail_dt string"), df([("s", cutoff, window)], "source_name string, cutoff string, repair_window int")]
        for slices in (1, 9, 64):
            got = admission.admit_incremental(df(rows, schema), *tables, grace=grace, slices=slices).collect()
            assert sorted((r["section"], r["url"], r["unique_index"], r["effective_dt"]) for r in got) == sorted(want)
    quotas = df([("s", None)], "source_name string, quota int")
    order = sorted(once.values(), key=lambda r: (r[5] is None, [-ord(c) for c in r[5] or ""] + [1], r[1], r[2]))
    got = admission.cold_start_top_n(df([r for r in rows if r[3]], schema), quotas, slices=16).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and [r["url"] for r in got] == [r[3] for r in order]


def test_nested_regions(spark):
    """Random nested, unclosed and stray regions against a stack."""
    import random
    import re

    rnd = random.Random(4)
    htmls = [None, "", "<section></section>", "<article>a<section>b</section> more</article>"]
    htmls += ["".join(rnd.choice(["<section>", "<ARTICLE a='b'>", "</section>", "</article >", "<nav>", "</nav>", "<p>", "<sections>", f"t{i} "]) for i in range(rnd.randint(1, 40))) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")
    got = {}
    for r in pages.page_regions(rows).collect():
        got.setdefault(r["page_id"], []).append((r["n"], r["tag"], r["html"]))
    for i, html in enumerate(htmls):
        open_, want = {}, []
        tags, parts = re.findall(pages.REGION, html or ""), re.split(pages.REGION, html or "")
        for n, tag in enumerate(tags):
            name = re.match("</?([a-z]+)", tag.lower())[1]
            if not tag.startswith("</"):
                open_.setdefault(name, []).append(n)
            elif open_.get(name):
                at = open_[name].pop()
                want.append((at, name, " ".join(parts[at + 1 : n + 1])))
        want += [(at, name, " ".join(parts[at + 1 :])) for name, left in open_.items() for at in left]
        assert sorted(got.get(i, [])) == sorted(want)


def test_many_keywords(spark):
    """A thousand keywords, found as by looking for each; no nested loop."""
    import random

    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("ab/.") for _ in range(n))
    keywords = [(i, word(rnd.randint(1, 12)), f"t{i}") for i in range(1000)]
    urls = [(i, None if i == 3 else word(rnd.randint(0, 60)).upper()) for i in range(200)]
    words = spark.createDataFrame(keywords[500:], "ord int, keyword string, type string")
    out = pages.classify_site_type(spark.createDataFrame(urls, "page_id int, url string"), words)
    want = {i: next((t for _, k, t in keywords[500:] if u is not None and k in u.lower()), "general") for i, u in urls}
    assert {r["page_id"]: r["site_type"] for r in out.collect()} == want
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    none = pages.classify_site_type(spark.createDataFrame(urls, "page_id int, url string"), words.limit(0))
    assert {r["site_type"] for r in none.collect()} == {"general"}
