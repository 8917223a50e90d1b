"""Benchmark decontamination with a positional inverted index, on DataFrame operations only.

The index keeps, for the terms that the search needs, postings (term, doc, position) of the training texts; terms that no
benchmark window can need aren't stored. Every window of a benchmark item is looked up by its two rarest words in the
corpus: postings are shifted by the word's place in the item, so that equal shifts (diagonals) of one document
and item meet, and only diagonals on which two rarest words agree are compared word by word with the document's own
words. What matches is exact; proximity matches are runs of an item's rare words that lie close together in a document without
having to be in line.

Scale: texts are cut into words where they are scanned, and words that a bitmap of the chosen terms rules out are dropped before
anything is exploded. Items of equal words are one sequence with a list of ids, and a window that a sequence
repeats is looked up at its first place alone, so neither repeated items nor repeated words multiply lookups. Texts with
a candidate are joined with their candidates by shuffle; all others, told apart by a second bitmap, only count their
words. Bitmaps have at most LONGEST bits; lists of terms are broadcast if they hold few bytes. A passage that
many documents share adds one candidate for each document and diagonal, never pairs of documents.

Defined results: null and empty texts have no words and no hit; a document's repeated rows and rows without an id each
get the result of their own text, however long; an item without words has no window; an item of fewer words than a window
is one window; repeated items are found each under its id, and so are different texts under one item_id (which counts once);
empty tables give an empty result or no hit; extra columns are ignored, or kept if they are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm import common as C

#: What parts words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
CHOICE = 4
ANCHORS = 2
#: Most bits of a bitmap (512 KB).
LONGEST = 1 << 22
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Words of a text with A-Z as a-z; null for null. Lower-casing pure ASCII has a fast way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), GAP), "")


def sequences(benchmark: DataFrame, window: int) -> DataFrame:
    """seq, words, ids (those of all items of these words, as strings), starts (of each different window the first place), as a
    stored table."""
    own = benchmark.select(F.col("item_id").cast("string").alias("id"), tokens(F.col("text").cast("string")).alias("words"))
    own = own.where("id is not null and size(words) > 0").groupBy("words").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    own = C.checkpointed(own.withColumn("seq", F.monotonically_increasing_id()))
    places = own.select("seq", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))).alias("s"))
    first = places.groupBy("seq", F.slice("words", F.col("s") + 1, F.lit(window)).alias("w")).agg(F.min("s").alias("s"))
    starts = first.groupBy("seq").agg(F.array_sort(F.collect_list("s")).alias("starts"))
    return C.checkpointed(own.join(starts, "seq"))


def item_terms(own: DataFrame) -> DataFrame:
    """seq, place, term: one row per word of a sequence."""
    return own.select("seq", F.posexplode("words").alias("place", "term"))


def rarest_places(places: DataFrame, own: DataFrame, window: int, most: int) -> DataFrame:
    """seq, place, term: of the given places (seq, place, term, df) those that are among the `most` rarest of some different
    window (ties: the longer term, then the earlier place)."""
    ranked = places.groupBy("seq").agg(F.collect_list(F.struct("df", (-F.length("term")).alias("short"), "place", "term")).alias("w")).join(own.select("seq", "starts"), "seq")
    starts = ranked.select("seq", F.explode("starts").alias("s"), "w")
    inside = F.array_sort(F.filter("w", lambda x: (x["place"] >= F.col("s")) & (x["place"] < F.col("s") + window)))
    return starts.select("seq", F.explode(F.slice(inside, 1, most)).alias("x")).select("seq", "x.place", "x.term").distinct()


def bitmap(values: DataFrame, longest: int = LONGEST):
    """A test that is true for every value of the one column and few others: a bitmap of hashes, of a size that the
    number of values sets up to `longest` bits, as a constant of the plan."""
    bits = min(longest, 1 << max(10, (20 * max(values.count(), 1)).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    cells = values.select(at(F.col(values.columns[0])).alias("h")).groupBy(F.floor(F.col("h") / 64).cast("int").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("b"))
    words = [0] * (bits // 64)
    for r in cells.collect():
        words[r["i"]] = r["b"]
    whole = F.from_json(F.lit("[" + ",".join(map(str, words)) + "]"), "array<bigint>")  # one text, which the optimizer folds to one constant

    def test(column: Column) -> Column:
        place = at(column)
        return F.get(whole, F.floor(place / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))) != 0

    return test


def postings(words: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of the given distinct terms: term, doc, position (from 0). A bitmap drops most other words
    within their text's array, before they become rows."""
    wanted = bitmap(terms)
    found = F.filter(F.transform("words", lambda x, i: F.when(wanted(x), F.struct(i.alias("position"), x.alias("term")))), lambda x: x.isNotNull())
    rows = words.select("doc", F.explode(found).alias("x")).select("doc", "x.position", "x.term")
    return rows.join(C.few(terms), "term")


def positional_index(docs: DataFrame, own: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The stored index of the words that may be a window's rarest, and the places of each window's rarest words. docs: doc, text.

    Words that the benchmark itself repeats are left out where a window has CHOICE rarer ones; of these, the counts of the
    index over the whole corpus pick the ANCHORS rarest."""
    words = docs.select("doc", tokens(F.col("text").cast("string")).alias("words"))
    all_ = item_terms(own)
    choice = C.checkpointed(rarest_places(all_.join(all_.groupBy("term").agg(F.count("*").alias("df")), "term"), own, window, CHOICE))
    terms = C.checkpointed(choice.select("term").distinct())
    index = C.checkpointed(postings(words, terms))
    counts = terms.join(index.groupBy("term").agg(F.count("*").alias("df")), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
    return index, C.checkpointed(rarest_places(choice.join(counts, "term"), own, window, ANCHORS))


def candidates(index: DataFrame, places: DataFrame, own: DataFrame) -> DataFrame:
    """doc, seq, shift: diagonals on which at least two rarest words agree (one where the sequence has one)."""
    met = index.join(places, "term").groupBy("doc", "seq", (F.col("position") - F.col("place")).alias("shift")).agg(F.count("*").alias("n"))
    return met.join(own.select("seq", F.size("words").alias("len")), "seq").where(F.col("n") >= F.least(F.lit(ANCHORS), F.col("len"))).select("doc", "seq", "shift")


def _found(words: Column, x: Column, window: int) -> Column:
    """Places in the document at which a window of a sequence (words, starts) occurs on one of its diagonals (shifts)."""
    item, long = x["words"], F.least(F.size(x["words"]), F.lit(window))
    fits = lambda s, d: (s + d >= 0) & (s + d + long <= F.size(words)) & (F.slice(words, F.greatest(s + d, F.lit(0)) + 1, long) == F.slice(item, s + 1, long))
    return F.flatten(F.transform(x["shifts"], lambda d: F.transform(F.filter(x["starts"], lambda s: fits(s, d)), lambda s: s + d)))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (doc_id alone by default), n_words, hits: array of (item_ids, starts, length), the exact windows found in
    every document. Rows without an id are looked up by a hash of their text; rows that share a key only share
    candidates, as each row's own words are compared."""
    own = sequences(benchmark, window)
    key = F.coalesce(F.col("doc_id").try_cast("long"), F.xxhash64(F.col("text").cast("string")))
    index, places = positional_index(docs.select(key.alias("doc"), "text"), own, window)
    near = candidates(index, places, own).groupBy("doc", "seq").agg(F.collect_list("shift").alias("shifts")).join(own, "seq")
    by_doc = C.checkpointed(near.groupBy("doc").agg(F.collect_list(F.struct("ids", "shifts", "words", "starts")).alias("near")))
    whole = docs.select(F.struct(*(keep or ["doc_id"])).alias("row"), key.alias("doc"), F.col("text").cast("string").alias("text"))
    maybe = F.coalesce(bitmap(by_doc.select("doc"))(F.col("doc")), F.lit(False))
    words = tokens(F.col("text"))
    some = whole.where(maybe).join(by_doc, "doc", "left").select("row", words.alias("words"), "near")
    hits = F.transform(F.coalesce("near", F.array()), lambda x: F.struct(x["ids"].alias("item_ids"), _found(F.col("words"), x, window).alias("starts"), F.least(F.size(x["words"]), F.lit(window)).alias("length")))
    count = lambda w: F.coalesce(F.size(w), F.lit(0)).cast("long").alias("n_words")
    some = some.select("row", count(F.col("words")), F.filter(hits, lambda x: F.size(x["starts"]) > 0).alias("hits"))
    none = whole.where(~maybe).select("row", count(words), F.array().cast(some.schema["hits"].dataType).alias("hits"))
    return some.unionByName(none).select("row.*", "n_words", "hits")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 8, least: int = 3, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, start, end, n_terms: stretches of a document in which at least `least` rare words of one item
    occur with neighbouring diagonals no more than `slop` apart, in or out of line."""
    from pyspark.sql import Window

    own = sequences(benchmark, window)
    index, places = positional_index(docs.select(F.col("doc_id").alias("doc"), "text").where("doc is not null"), own, window)
    met = index.join(places, "term").withColumn("shift", F.col("position") - F.col("place"))
    w = Window.partitionBy("doc", "seq").orderBy("shift", "position")
    gap = F.coalesce(F.col("shift") - F.lag("shift").over(w) > slop, F.lit(True)).cast("int")
    runs = met.withColumn("new", gap).withColumn("run", F.sum("new").over(w))
    out = runs.groupBy("doc", "seq", "run").agg(F.min("position").alias("start"), (F.max("position") + 1).alias("end"), F.count_distinct("place").alias("n_terms"))
    found = out.where(F.col("n_terms") >= least).join(own.select("seq", "ids"), "seq")
    return found.select(F.col("doc").alias("doc_id"), F.explode("ids").alias("item_id"), "start", "end", "n_terms")


def hit_report(matches: DataFrame) -> DataFrame:
    """All columns but hits, with n_words, n_hit (distinct word positions inside matches), n_items, items_sha256, contaminated."""
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["item_ids"]))))
    spots = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.flatten(F.transform(x["starts"], lambda s: F.sequence(s, s + x["length"] - 1))))))
    own = [c for c in matches.columns if c not in ("n_words", "hits")]
    out = matches.select(*own, "n_words", F.size(spots).cast("long").alias("n_hit"), ids.alias("ids"))
    return out.select(
        *own,
        "n_words",
        "n_hit",
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return hit_report(phrase_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


#: The same in DuckDB, by comparing every window.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bs),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) x WHERE len(w) >= n),
hit AS (SELECT DISTINCT ds.doc_id, ds.i, ds.n, bw.item_id FROM ds JOIN bw ON ds.n = bw.n AND array_to_string(ds.w[ds.i:ds.i + ds.n - 1], ' ') = bw.k),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) x GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN found USING (doc_id)
"""
