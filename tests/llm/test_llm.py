"""Training-data operators against brute force, round trips and held-out accuracy, and their edge cases."""

import gzip
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedspark.llm import decontam, html_text, lang_id, near_dup, packing, quality, sharding, token_records, toxicity, warc
from feedspark.llm import common as C
from feedspark.llm.components import connected_components

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, words string"
ODD = [None, "", " \n\t ", "Ab", "x\0y \0", "a a a a a a a a a", "é É ß İ Σ 日本語 мир", "w " * 3000, "1 2 3 4 5 6", "same text here it is", "same text here it is", "x" * 50_000, "a  <|endoftext|> b.<|startoftext|>,c <|ENDOFTEXT|>", "a\u00a0 b \u3000c\n\nd\ne, f.\n g\u2028h\n\u0301i \u0301j\r\nk\t l\n<|x|>m it's, 'tis.'s"]
SPACE, LOWER = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows, nulls in every column, and extra columns with clashing names."""
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", None, 0.5, "w") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id at all", None, None, None, None, None)], DOC)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def shingles(text, k):
    w = SPACE.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in sets}


def test_quality_counts(spark, docs, labels, odd):
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        raw = texts(df)
        for r in quality.features(df).collect():
            t = raw[r["doc_id"]] or ""
            w = SPACE.findall(t)
            lines = [x for x in t.split("\n") if SPACE.search(x)]
            grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
            twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 500 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
            cover = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 8)}
            want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
    assert quality.judge(odd, labels).count() == odd.count()
    assert quality.judge(odd.limit(0), labels.limit(0)).count() == 0


def test_quality_rules_learn(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.judge(d, lab.where(~C.held_out())).join(lab, "doc_id")
    for part in (got, got.where(C.held_out())):  # held-out labels weren't seen in learning
        bad, good = part.where("quality = 0"), part.where("quality = 1 and not base_failed")
        assert bad.where("not kept").count() >= 0.95 * bad.count()
        assert good.where("kept").count() >= 0.99 * good.count()


def test_toxicity(spark, odd, labels):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.op1_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert sum(bool(r["evidence"]) for r in rows) >= 0.97 * len(rows)  # clean texts have neighbours too
    assert {e["toxic"] for r in rows for e in r["evidence"]} == {0, 1}
    toxic = {r["doc_id"]: r["toxic"] for r in lab.collect()}
    held = [(r["predicted"], toxic[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    caught, clean = [p for p, y, _ in held if y], [p for p, y, _ in held if not y]
    assert sum(caught) >= 0.6 * len(caught) and sum(clean) <= 0.05 * len(clean)
    assert sum((s - y) ** 2 for _, y, s in held) / len(held) < 0.06  # calibrated
    got = toxicity.score_documents(odd, labels).collect()
    assert len(got) == odd.count()
    assert len({r["score"] for r in got if not r["evidence"]}) == 1 and all(0 <= r["score"] <= 1 for r in got)
    out = toxicity.score_documents(d.limit(5), lab.limit(0)).collect()
    assert {r["score"] for r in out} == {0.0}
    assert toxicity.score_documents(odd.limit(0), labels.limit(0)).count() == 0


def test_toxicity_against_brute_force(spark, docs, labels):
    """Weights, neighbours, votes and calibration, computed plainly."""
    import math

    both = docs.unionByName(spark.createDataFrame([(50_000, None, None, None, None), (50_001, "zzzz", None, None, None)], docs.schema))
    got = {r["doc_id"]: r for r in toxicity.score_documents(both, labels, examples=60, k=5).collect()}
    raw = texts(both)
    mine = {r["doc_id"]: r["toxic"] for r in labels.withColumn("h", C.held_out()).where("not h").orderBy(F.xxhash64("doc_id")).limit(60).collect()}
    terms = {i: toxicity.terms_of(t) for i, t in raw.items()}
    n = len(raw)
    df = {t: sum(t in x for x in terms.values()) for t in set().union(*(terms[i] for i in mine))}
    share = sum(mine.values()) / len(mine)
    half = {r["doc_id"] for r in spark.createDataFrame([(i,) for i in mine], "doc_id long").where(toxicity._weighs()).collect()}
    part = sum(mine[i] for i in half) / len(half)

    def weight(t):
        held = [mine[i] for i in half if t in terms[i]]
        z = abs(sum(held) - len(held) * part) / math.sqrt(max(len(held) * part * (1 - part), 1e-9))
        return math.log(1 + n / (1 + df[t])) * (0.03 + 0.97 * min(max((z - 3) / 5, 0), 1))

    w = {t: weight(t) for t in df}
    vec = {i: {t: (1 + math.log(c)) * w[t] for t, c in x.items() if w.get(t)} for i, x in terms.items()}
    norm = {i: math.sqrt(sum(v * v for v in x.values())) for i, x in vec.items()}

    def vote(i, but=None):
        near = sorted(((-sum(v * vec[j].get(t, 0) for t, v in vec[i].items()) / (norm[i] * norm[j]), j) for j in mine if j != but and norm[i] and norm[j]), key=lambda x: (round(x[0], 6), x[1]))
        near = [(-s, j) for s, j in near if s < 0][:5]
        return (0.05 * share + sum(s * s * mine[j] for s, j in near)) / (0.05 + sum(s * s for s, _ in near)), near

    unseen = [i for i in mine if i not in half]
    x, y = toxicity.isotonic(np.array([vote(i, i)[0] for i in unseen]), np.array([float(mine[i]) for i in unseen]))
    for i, r in got.items():
        value, near = vote(i)
        assert [(e["doc_id"], e["toxic"]) for e in r["evidence"]] == [(j, mine[j]) for _, j in near]
        assert all(abs(e["similarity"] - s) < 1e-6 for e, (s, _) in zip(r["evidence"], near, strict=True))
        assert abs(r["score"] - np.interp(value, x, y)) < 1e-4


def test_toxicity_of_few_examples(spark):
    """A table of seven texts, three of them labelled: each text that shares a word has neighbours."""
    rows = [(i, t) for i, t in enumerate(["you vile fool", "a calm day", "vile vile fool", "the day is calm", "zzz", None, "fool"], 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1 - i % 2) for i in range(1, 8)], "doc_id long, toxic int")
    for weighted in (True, False):
        got = {r["doc_id"]: r for r in toxicity.score_documents(d, lab, weighted=weighted).collect()}
        learned = {r["doc_id"] for r in lab.where(~C.held_out()).collect()}
        words_of = {i: set(toxicity.terms_of(t)) for i, t in rows}
        for i, r in got.items():
            assert {e["doc_id"] for e in r["evidence"]} == {j for j in learned if words_of[i] & words_of[j]}


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(900):
        w = rng.random(rng.integers(1, 8))
        vectors.append((np.sort(rng.choice(60, len(w), replace=False)), w / np.linalg.norm(w)))
    indexes = [toxicity.BlockMaxIndex(vectors, np.arange(900), np.zeros(900, np.int64), 60, n) for n in (0, 7, 60)]
    dense = np.zeros((900, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for _ in range(50):
        terms = np.sort(rng.choice(60, 5, replace=False))
        q = rng.random(5)
        q /= np.linalg.norm(q)
        score = dense[:, terms] @ q
        want = sorted((-round(float(s), 6), i) for i, s in enumerate(score) if s > 0)[:16]
        for index in indexes:
            rows, cosines = index.nearest(terms, q, 16)
            assert index.ids[rows].tolist() == [i for _, i in want]
            assert np.allclose(cosines, [-s for s, _ in want], atol=2e-6)


def test_sharding(spark, docs, odd):
    for df, per in ((docs, 50_000), (docs, 16), (odd, 4)):
        rows = sharding.interleave(df, shards=7, per_bucket=per).collect()
        n = df.count()
        assert len(rows) == n
        by = {}
        for r in rows:
            by.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        assert max(map(len, by.values())) - min(len(by.get(i, [])) for i in range(7)) <= 1
    raw = texts(docs)
    rows = sharding.interleave(docs, shards=7).collect()
    assert all(r["text_crc32"] == zlib.crc32(raw[r["doc_id"]].encode()) and r["size"] == len(raw[r["doc_id"]].encode()) + 16 for r in rows)
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["fraction"] for r in order] == sorted(r["fraction"] for r in rows)
    assert sharding.interleave(docs.limit(0)).count() == 0


def contamination(text, windows):
    w = WORD.findall((text or "").translate(LOWER))
    hit, items = set(), set()
    for size in {len(k) for k in windows}:
        for i in range(len(w) - size + 1):
            if (k := tuple(w[i : i + size])) in windows:
                hit.update(range(i, i + size))
                items |= windows[k]
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def test_decontamination(spark, docs, odd):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "same TEXT here"), (901, ""), (902, None), (903, "w w w w w w w w w w w w w w w"), (904, "text here it")], "item_id long, text string"))
    windows = windows_of((r["item_id"], r["text"]) for r in bench.collect())
    both = docs.select("doc_id", "text").unionByName(odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    raw = texts(both)
    for r in decontam.hit_report(decontam.phrase_matches(both, bench)).collect():
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == contamination(raw[r["doc_id"]], windows)
    assert decontam.phrase_matches(odd, bench).count() == odd.count()
    assert decontam.hit_report(decontam.phrase_matches(docs, bench.limit(0))).where("n_hit > 0").count() == 0
    near = decontam.proximity_matches(both, bench).where("doc_id < 100000")
    exact = decontam.phrase_matches(docs, bench.where("item_id < 900")).where("size(hits) > 0").select("doc_id")
    assert exact.join(near, "doc_id", "left_anti").count() == 0


def windows_of(items):
    out = {}
    for i, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for k in range(max(1, len(w) - 12)) if w else ():
            out.setdefault(tuple(w[k : k + 13]), set()).add(i)
    return out


def test_decontamination_of_repeated_and_common_items(spark):
    item = [f"t{i}" for i in range(20)]
    a = "a " * 40
    items = [(i, " ".join(item[k : k + 13])) for k in range(0, 8) for i in range(100 * k, 100 * k + k)]  # k copies of the k-th window
    items += [(5000, "the of and to in is it the of and to in is it"), (5000, "other text under one id with more than thirteen words in it to see"), (5001, a), (5002, "a b a b a b a b a b a b a b a b"), (5003, "a"), (5004, "a a")]
    texts_ = [" ".join(item), " ".join(item[3:17]), a * 20, "b a " * 30, "x " + "the of and to in is it " * 9, "other text under one id with more than thirteen words in it to see", "b b b", "z a z"]
    texts_ += [" ".join(item[k : k + 13]) for k in range(8)]
    rows = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    windows = windows_of(items)
    got = decontam.hit_report(decontam.phrase_matches(rows, spark.createDataFrame(items, "item_id long, text string"))).collect()
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == contamination(texts_[r["doc_id"]], windows), texts_[r["doc_id"]]
    assert len(got) == len(texts_)


def test_near_duplicates(spark, docs, odd):
    base = [f"w{i}" for i in range(200)]
    chain = [(10_000 + k, " ".join([f"e{k}x{j}" if j < 4 * k else w for j, w in enumerate(base)])) for k in range(12)]  # each links with its neighbours only
    many = docs.select("doc_id", "text").unionByName(spark.createDataFrame(chain, "doc_id long, text string")).unionByName(odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    sets = {i: shingles(t, 4) for i, t in texts(many).items()}
    want = components(sets)
    for r in near_dup.near_duplicates(many, k=4).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert near_dup.near_duplicates(odd).count() == odd.count()
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 3000):
        common, a, b = (rng.integers(1, 1 << 63, m, dtype=np.uint64) for m in (4 * n, n, n))
        x, y = near_dup.sketch(np.concatenate([common, a]), 1024), near_dup.sketch(np.concatenate([common, b]), 1024)
        assert abs((x == y).mean() - 4 / 6) < 0.08
        assert (near_dup.sketch(common, 1024) == near_dup.sketch(common[::-1].copy(), 1024)).all()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103)], "a long, b long")
    got = {r["node"]: r["comp"] for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}


def test_language(spark, odd):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lang_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where(C.held_out()).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    got = {r["doc_id"]: r["lang_pred"] for r in lang_id.identify(odd).collect()}
    assert all(got[i] == "und" for i in (0, 1, 2, 8)) and got[3] != "und"
    assert lang_id.identify(odd.limit(0)).count() == 0


def test_language_against_brute_force(spark, docs):
    """Frequent n-grams by plain counting, exact sets in place of the filter."""
    from collections import Counter

    rows = docs.withColumn("held", C.held_out()).collect()

    def grams(text, n):
        word = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
        word = " " + " ".join(word.split()) + " " if word.strip() else " "
        return [g for i in range(len(word) - n + 1) if " " not in (g := word[i : i + n])[1:-1]]

    def order(g):  # the operator's order of equally frequent n-grams
        codes = np.array([ord(c) if c != " " else 0 for c in g], np.uint32)
        return int(lang_id._grams(codes, len(g))[0].view(np.int64)[0])

    top = {}
    for lang in {r["lang"] for r in rows if r["lang"]}:
        for n in lang_id.ORDERS:
            counts = Counter(g for r in rows if r["lang"] == lang and not r["held"] for g in grams(r["text"], n))
            top[lang, n] = set(sorted(counts, key=lambda g: (-counts[g], order(g)))[: lang_id.GRAMS // len(lang_id.ORDERS)])
    got = {r["doc_id"]: r for r in lang_id.identify(docs).collect()}
    for r in rows:
        found = {lang: sum(g in top[lang, n] for n in lang_id.ORDERS for g in grams(r["text"], n)) for lang in sorted({k for k, _ in top})}
        best = max(found, key=lambda x: found[x])
        assert abs(got[r["doc_id"]]["score"] - max(found.values()) / max(sum(found.values()), 1)) < 0.02
        if sorted(found.values())[-1] > 1.1 * sorted(found.values())[-2]:
            assert got[r["doc_id"]]["lang_pred"] == best


def test_language_sample_is_the_smallest_hashes(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "a").when(F.col("id") < 300, "b").otherwise("c").alias("lang"))
    got = {(r["lang"], r["doc_id"]) for r in lang_id.sample(rows, 150).collect()}
    want = set()
    for lang in "abc":
        want |= {(lang, r["doc_id"]) for r in rows.where(F.col("lang") == lang).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id").limit(150).collect()}
    assert got == want


def test_bloom_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    made = lang_id.Filter([f"l{i:02d}" for i in range(70)], cells=1 << 14)
    grams = {i: rng.integers(1, 1 << 63, 50, dtype=np.uint64) for i in (0, 5, 69)}
    for i, g in grams.items():
        made.add(i, g)
    made.close()
    for i, g in grams.items():
        assert ((made.masks(g)[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()


def test_packing(spark, docs, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        raw, pieces, seqs = texts(df), {}, {}
        for r in packing.pack_documents(df, path).collect():
            pieces.setdefault(r["doc_id"], []).append(r)
            seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total = 0
        for i, t in raw.items():
            own = sorted(pieces[i], key=lambda r: r["piece"])
            ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist()
            assert ids == lib.encode(t or "", add_special_tokens=False).ids + [2]
            assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
            assert all(r["length"] == 1024 for r in own[1:]) and 0 < own[0]["length"] <= 1024
            total += len(ids)
        for s in seqs.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 1024
        if df is docs:
            assert len(seqs) <= 1.06 * total / 1024 + 1
    assert packing.pack_documents(odd.limit(0), path).count() == 0


def test_sum_of_squares_takes_the_smallest_sum():
    rng = np.random.default_rng(2)
    p = packing.SumOfSquares(20, 0)
    gaps = {}
    for length in rng.integers(1, 21, 300):
        length = int(length)
        square = lambda g: sum(n * n for n in np.bincount([x for x in g if 0 < x], minlength=21))
        options = [square([*gaps.values(), 20 - length])] + [square([v - length if k == b else v for k, v in gaps.items()]) for b, x in gaps.items() if x >= length]
        where, offset = p.place(length)
        assert offset == 20 - gaps.get(where, 20)
        gaps[where] = gaps.get(where, 20) - length
        assert square(list(gaps.values())) == min(options)


def test_token_records(spark, docs, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        folder = C.shared_folder(spark, "tokens")
        token_records.write_records(df, folder, path)
        index = token_records.read_index(spark, folder)
        got = {r["doc_id"]: r for r in token_records.read_records(index, folder).collect()}
        at = 0
        for i, t in sorted(texts(df).items()):
            ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
            assert np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist() == ids and got[i]["start"] == at
            at += len(ids)
        assert token_records.read_shuffled(index, folder, 3).count() == df.count()
    folder, many = C.shared_folder(spark, "tokens"), docs.select(F.when(F.col("doc_id") > 160, F.col("doc_id")).when(F.col("doc_id") > 120, 60).alias("doc_id"), "text")
    token_records.write_records(many, folder, path)
    rows = token_records.read_records(token_records.read_index(spark, folder), folder).orderBy("start").collect()
    assert [r["doc_id"] or 0 for r in rows] == sorted((r["doc_id"] or 0) for r in many.collect())
    want = sorted(((r["doc_id"] or 0), lib.encode(r["text"], add_special_tokens=False).ids + [1]) for r in many.collect())
    assert sorted(((r["doc_id"] or 0), np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in rows) == want
    assert len({r["part"] for r in token_records.read_index(spark, folder).where("doc_id is null").collect()}) > 1
    folder = C.shared_folder(spark, "tokens")
    token_records.write_records(odd.limit(0), folder, path)
    assert token_records.read_index(spark, folder).count() == 0
    data = bytearray(token_records.frame(token_records.pack_ids(7, b"\1\0\0\0")))
    assert token_records.unpack_ids(token_records.unframe(bytes(data))) == (7, b"\1\0\0\0")
    for i in range(len(data)):
        data[i] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(bytes(data))
        data[i] ^= 1


def test_main_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    import html as entities

    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        want = " ".join(entities.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", re.sub(r"<[^>]*\Z", "", body)))).split())
        assert got[r["page_id"]] == want
    field = html_text.learn(pages)
    page = (
        '<html><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies.</div><article><h1>Real title</h1><p>First text &amp; more, with words. Yes.</p>'
        '<form><p>Your mail</p></form><p>Second paragraph of text.<script>var x="</p>";</script></p><div class="comments"><p>Nice article, thanks for it. I liked it.</p></div></article>'
        '<aside><p>Elsewhere on this site, other things. Look.</p></aside><footer>&copy; x</footer></body></html>'
    )
    assert html_text.main_text(page, field) == "Real title First text & more, with words. Yes. Second paragraph of text."
    rows = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "y"), (2, "u", "", "y"), (None, "u", "<p>t", "z")], "page_id long, url string, html string, text string")
    assert [r["text"] for r in html_text.extract(rows.where("page_id is not null")).collect()] == ["", "", ""]
    assert html_text.extract(rows.limit(0)).count() == 0


def test_main_text_without_semantic_elements(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = F.regexp_replace("html", "(?i)</article>", "</div>")
    want = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for open_tag, least in (('<div class="content">', 0.9), ('<div class="post-body">', 0.9), ("<div>", 0.4)):
        got = {r["page_id"]: r["text"] for r in html_text.extract(pages.withColumn("html", F.regexp_replace(plain, "(?i)<article>", open_tag))).collect()}
        assert sum(got[i] == t for i, t in want.items()) >= least * len(want), open_tag
    long = "<article>" + "<div>" * 500 + "".join(f"<p>Sentence {i} of a long page, with words in it.</p>" for i in range(5000))
    rows = html_text.extract(spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string")).collect()
    assert rows[0]["text"].startswith("Sentence 0 of") and rows[0]["text"].endswith("Sentence 4999 of a long page, with words in it.")


def test_field_is_the_maximum_of_its_likelihood():
    rows, labels = [["x"], ["m"], ["y"], ["m"]], [1, 1, 0, 0]
    field = html_text.train([(rows, labels)] * 4, rounds=800, l2=1e-2)

    def score(y):
        out = field.start[y[0]] + sum(field.moves[a][b] for a, b in itertools.pairwise(y))
        return out + sum(field.weights[k][field.index[f]] for k, row in zip(y, rows, strict=True) for f in row)

    def value():
        every = [score(y) for y in itertools.product((0, 1), repeat=4)]
        own = sum((x**2).sum() for x in (field.weights, field.moves, field.start))
        return score(labels) - np.logaddexp.reduce(every) - 1e-2 / 2 * own

    best = value()
    assert field.decode(rows) == labels == list(max(itertools.product((0, 1), repeat=4), key=score))
    for x in (field.weights, field.moves, field.start):
        for i in np.ndindex(x.shape):
            for step in (-0.05, 0.05):
                x[i] += step
                assert value() < best
                x[i] -= step


def test_warc_audit(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").unionByName(spark.createDataFrame([(10_001, None, None), (None, "u\nv", "x")], "page_id long, url string, html string"))
    folder, copy = C.shared_folder(spark, "warc"), C.shared_folder(spark, "warc")
    index = warc.write_warc(pages.repartition(3), folder)
    warc.copy_files(index, folder, copy)
    assert warc.audit(index, folder, copy).where("status <> 'ok'").count() == 0
    broken = C.shared_folder(spark, "warc")
    warc.copy_files(index, folder, broken, F.col("page_id").isin(3, 40))
    bad = warc.audit(index, folder, broken, fanout=4).where("status <> 'ok'")
    assert {r["page_id"] for r in bad.collect()} == {3, 40}
    assert warc.audit(index, folder, C.shared_folder(spark, "none")).where("status = 'ok'").count() == 0
    assert warc.surplus(index, copy).count() == warc.surplus(index, broken).count() == 0
    from pathlib import Path

    file = sorted(Path(copy.removeprefix("file:")).glob("*.warc.gz"))[0]
    size = file.stat().st_size
    with file.open("ab") as f:
        f.write(b"more")
    assert [(r["file"], r["offset"], r["length"]) for r in warc.surplus(index, copy).collect()] == [(file.name, size, 4)]
    one = warc.merkle_tree(index, folder)
    assert warc.root(one, folder) != warc.root(warc.merkle_tree(index, copy), copy)
    (Path(broken.removeprefix("file:")) / "extra.warc.gz").write_bytes(b"x")
    assert [(r["file"], r["length"]) for r in warc.surplus(index, broken).collect()] == [("extra.warc.gz", 1)]
    assert warc.root(one, folder) == warc.root(warc.merkle_tree(index, folder), folder) != warc.root(one, broken)
    twice = warc.write_warc(pages.unionByName(pages).withColumn("part", F.lit("x")).withColumn("hash", F.lit("y")), C.shared_folder(spark, "warc"))
    assert twice.count() == 2 * pages.count()
    read = {r["page_id"]: bytes(r["block"]) for r in warc.read_warc(index.withColumn("status", F.lit("")), folder).collect()}
    assert read == {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert gzip.decompress(warc.record(1, "http://a", b"x")).startswith(b"WARC/1.1\r\n")
    empty = warc.write_warc(pages.limit(0), C.shared_folder(spark, "warc"))
    assert warc.audit(empty, folder, copy).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now, ids = docs, []
    for _, stage in P.STAGES[:-1]:
        now = C.checkpointed(stage(spark, now, sf))
        assert now.columns == docs.columns
        ids.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert all(b <= a for a, b in itertools.pairwise(ids)) and 0 < len(ids[-1]) < docs.count()
    raw = texts(now)
    sets = {i: shingles(t, 5) for i, t in raw.items()}
    assert all(i == c for i, c in components({i: s for i, s in sets.items() if len(s) < 400}).items())
    packed = P.best_fit_packing(spark, now, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids[-1]


def test_pipeline_of_odd_rows(spark, odd):
    """Nulls in every column, repeated rows, odd and long texts, extra columns with clashing names, and empty tables."""
    import corpus_pipeline as P

    docs = odd.withColumns({c: F.lit("x") for c in ("kept", "hits", "n_words", "row", "doc", "print", "component_id", "evidence")})
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns, name
        rows = [tuple(r) for r in got.collect()]
        assert set(rows) <= {tuple(r) for r in docs.collect()}
        if name in ("toxicity", "benchmark decontamination"):
            assert len(rows) == docs.count()  # none is toxic, none is contaminated
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert P.best_fit_packing(spark, docs, DATA).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert P.best_fit_packing(spark, docs.limit(0), DATA).count() == 0


def test_near_duplicates_of_one_id(spark):
    """Different texts under one id are documents of their own; copies under other ids join them."""
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = spark.createDataFrame([(5, base), (5, other), (9, base), (9, base + " more"), (2, other), (None, base)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dup.near_duplicates(rows, k=4).collect())
    assert got == [(0, 0, True), (2, 2, True), (5, 2, False), (5, 5, True), (9, 5, False), (9, 5, False)]


def test_pipeline_decides_row_by_row(spark):
    import corpus_pipeline as P

    def left(stage, rows):
        own = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return sorted((r["doc_id"] or -1, r["text"]) for r in stage(spark, own.repartition(3), DATA).collect())

    good, other = (" ".join(f"{a}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60)) for a in ("plain", "other"))
    assert left(P.quality_rules, [(None, "too short"), (7, "too short"), (7, good), (8, good)]) == [(7, good), (8, good)]
    copies = [(None, good), (None, good), (5, good), (5, good), (3, other), (9, good), (9, other), (9, other + " " + good), (4, ""), (4, ""), (None, "")]
    assert left(P.near_duplicates, copies) == [(-1, ""), (3, other), (4, ""), (5, good), (9, other + " " + good)]
    assert left(P.near_duplicates, [(None, good), (None, good)]) == [(-1, good)]
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("length(text) > 100").first()["text"]
    assert left(P.decontamination, [(None, item), (7, item), (7, good), (None, good)]) == [(-1, good), (7, good)]
    larger = "/root/testdata/sf0.01"
    d, lab = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_documents(d, lab).join(d, "doc_id").orderBy("score", "doc_id").select("text", "score").collect()
    clean, toxic = scored[0], scored[-1]
    assert clean["score"] < toxicity.THRESHOLD <= toxic["score"]
    rows = d.select("doc_id", "text").unionByName(spark.createDataFrame([(None, toxic["text"]), (7_000_000, toxic["text"]), (7_000_000, clean["text"])], "doc_id long, text string"))
    kept = P.toxicity_filter(spark, rows, larger).where("doc_id is null or doc_id = 7000000").collect()
    assert [(r["doc_id"], r["text"]) for r in kept] == [(7_000_000, clean["text"])]


def test_decontamination_of_rows_without_an_id(spark):
    item = " ".join(f"word{i}" for i in range(30))
    rows = spark.createDataFrame([(None, item), (None, "before " + item), (None, "clean text"), (None, None), (1, item), (1, "clean text")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontam.hit_report(decontam.phrase_matches(rows, bench)).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"]) for r in got) == [(0, 0, 0), (0, 2, 0), (0, 30, 30), (0, 31, 30), (1, 2, 0), (1, 30, 30)]


def test_blocks_keep_all_text():
    def text(page):
        return " ".join(b.text for b in html_text.leaf_blocks(page))

    assert text('<p>a <svg class="x"/>b</p><p>c <svg><title/><path d="1"/></svg>d</p><p>e <svg><g>f</p><p>g') == "a b c d e f g"
    assert text("<p>a <button>b</p><p>c <object>d</p><p>e <template>f</p>") == "a b c d e f"
    assert text("<p>a <math><mi>x</mi><mn>2</mn></math> b <object>c</object> <video-player>d</video-player> <select-x>e</p>") == "a x2 b c d e"
    assert text("<p>a<script>b</p></scripty>c</script> d <template><p>e</p></template>f</p><style>g") == "a d f"
    deep = "<section>" * 300 + "<div>x</div>" * 3 + "</section>" * 299
    assert [b.depth for b in html_text.leaf_blocks(f'<article class="k">{deep}y</section>z</article>w')] == [302, 302, 302, 2, 1, 0]
    many = 50_000
    assert len(html_text.leaf_blocks("<p>" + "".join(f"<x-y>{i}" for i in range(many)))) == many


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_in_joined_calls(name):
    """New pieces go to the library many in a call, and each text gets the ids that it has alone; texts with marks of special tokens, too."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from feedspark.llm import tokens

    rng = np.random.default_rng(5)
    parts = [" a", " b́e", "  ", "\n", ".", ",x", "<", "|", "<|", "<|endoftext|>", "|>", "endoftext", " été's", "　", " ", " 12", "!!", "\U0001f600", "\t"]
    texts = ["", " ", "<|endoftext|>", "<|endof", "text|>", *("".join(rng.choice(parts, n)) for n in rng.integers(1, 12, 300)), *(f"plain{i} words{i}, and{i}." for i in range(500))]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    coder = tokens.PieceEncoder(public_tokenizers.path(name))
    calls = []

    class Counting:
        def encode_batch_fast(self, strings, **kw):
            calls.extend(strings)
            return plain.encode_batch_fast(strings, **kw)

    coder.tokenizer = Counting()
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    for _ in range(2):
        ids, at = coder.encode(data, offs)
        for k, text in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert sum("<|" not in c for c in calls) < 300  # of more than 1,500 new pieces
