"""Hard negatives, the n-gram join and whitening against brute force, and their edge cases."""

import itertools
import math

import numpy as np
import pytest

from feedspark.llm import hard_negatives, ngram_join, whitening
from feedspark.llm import vectors as V

DATA = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, label int, x string, score double"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, numbers that aren't finite, short and empty vectors, ties, repeated rows, clashing names."""
    rows = [(i, [float((i * 7) % 5) / 4, float(i % 3) - 1, 0.25], i % 2, None, None) for i in range(0, 230, 5)]
    rows += [(100, None, 1, "a", 1.0), (105, [NAN, 0.0, 0.0], 1, "a", 1.0), (110, [INF, 0.0, 0.0], 0, "b", None), (200, [None, 1.0, 0.0], 0, "b", None)]
    rows += [(None, [1.0, 1.0, 1.0], 0, None, None), (300, [1.0, 1.0, 1.0], None, None, None), (400, [1.0], 1, None, None), (500, [], 0, None, None), (600, [0.5, -0.5, 0.25], 1, None, None)]
    return spark.createDataFrame([*rows, rows[3], rows[4], rows[20], rows[-1]], VEC)


def plain(df):
    """(vec_id, label, x) of the usable rows."""
    rows = [r for r in df.collect() if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    d = max((len(r["embedding"]) for r in rows), default=0)
    return [(r["vec_id"], r["label"], [math.floor(256 * c) for c in r["embedding"]] + [0] * (d - len(r["embedding"]))) for r in rows]


def mined(rows, every=100, positives=5, negatives=10):
    rows = [r for r in rows if r[0] is not None and r[1] is not None]
    out = []
    for a, label, x in {(i, lab, tuple(x)) for i, lab, x in rows if i % every == 0}:
        scored = sorted(((-sum(p * q for p, q in zip(x, y, strict=True)), i, lab) for i, lab, y in rows if i != a), key=lambda s: s[:2])
        for s, p, _ in [z for z in scored if z[2] == label][:positives]:
            fit = [z for z in scored if z[2] != label and 30 * -s <= 100 * -z[0] <= 90 * -s][:negatives]
            out += [(a, p, n, i, -s, -t) for n, (t, i, _) in enumerate(fit, 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives(spark, odd, monkeypatch):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    for block, group in ((8_192, 4_096), (7, 2)):
        monkeypatch.setattr(hard_negatives, "BLOCK", block)
        for df in (table, odd, odd.limit(0), odd.where("vec_id % 100 > 0")):
            got = sorted(tuple(r[c] for c in COLUMNS) for r in hard_negatives.hard_negatives(df, group=group).collect())
            assert got == mined(plain(df))
    assert got == []


def test_scores_beyond_double_precision(spark):
    rows = [(i, [float((i + 1) * 2**12 + i), float(i)], i % 2) for i in range(0, 400, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r[c] for c in COLUMNS) for r in hard_negatives.hard_negatives(df).collect()) == mined(plain(df))


def test_whitening(spark, odd):
    for df in (spark.read.parquet(f"{DATA}/embeddings.parquet"), odd):
        rows = plain(df)
        fit = np.unique(np.array([x for *_, x in rows], float), axis=0)
        n, sums = len(fit), [sum(int(v) for v in c) for c in fit.T]
        covariance = np.cov(fit.T, bias=True)
        values, axes = np.linalg.eigh(covariance)
        values, axes = values[::-1], axes[:, ::-1]
        got = whitening.whitened(df).collect()
        k = max(r["component"] for r in got)
        assert len(got) == k * len(rows) and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
        by = {}
        for r in got:
            by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], r["whitened"])
        for i, _, x in rows:
            deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
            want = (np.array(x) - np.array(sums) / n) @ axes[:, :k] / np.sqrt(values[:k])
            have = np.array([by[i, deviation][c] for c in range(1, k + 1)])
            assert np.allclose(np.abs(have), np.abs(want), atol=1e-8)
        explained = {r["component"]: r["explained"] for r in got}
        assert np.allclose([explained[c] for c in range(1, k + 1)], values[:k] / np.trace(covariance), rtol=1e-9)
    assert whitening.whitened(odd.limit(0)).count() == 0 and whitening.whitened(odd.where("vec_id = 600")).count() == 0


def test_characteristic_polynomial(spark):
    """Equal, zero and far apart eigenvalues; the polynomial against exact fractions."""
    rng = np.random.default_rng(1)
    a = [[int(v) for v in row] for row in rng.integers(-50, 50, (4, 6))]
    gram = [[sum(r[i] * r[j] for r in a) for j in range(6)] for i in range(6)]  # rank 4
    for matrix in (gram, [[5 * (i == j) for j in range(4)] for i in range(4)], [[10 ** (6 * i) * (i == j) for j in range(4)] for i in range(4)], [[7]]):
        d = len(matrix)
        poly = whitening.characteristic(spark, matrix)
        power, want = [[int(i == j) for j in range(d)] for i in range(d)], [1]  # Faddeev and Le Verrier
        for k in range(1, d + 1):
            power = [[sum(matrix[i][m] * power[m][j] for m in range(d)) for j in range(d)] for i in range(d)]
            c = -sum(power[i][i] for i in range(d)) // k
            want.append(c)
            power = [[power[i][j] + c * (i == j) for j in range(d)] for i in range(d)]
        assert poly == want[::-1]
        axes, values, _ = whitening.components(spark, matrix, 4)
        exact = np.linalg.eigvalsh(np.array(matrix, float))[::-1]
        assert np.allclose(values, exact[: len(values)], rtol=1e-9) and len(values) == min(4, np.linalg.matrix_rank(np.array(matrix, float), tol=1e-6))
        assert np.allclose(axes @ axes.T, np.eye(len(values)), atol=1e-14)
        assert np.allclose(np.array(matrix, float) @ axes.T, axes.T * values, rtol=1e-12, atol=1e-9 * exact[0])
    assert [whitening.roots_above([-6, 11, -6, 1], a) for a in (0, 1, 2, 3)] == [3, 2, 1, 0]
    assert all(whitening._is_prime(p) == all(p % q for q in range(2, math.isqrt(p) + 1)) for p in range(3, 999, 2)) and len(whitening.primes(1 << 200)) == 7


def test_large_entries_are_exact(spark):
    rows = [(i, [float(2**30 + i * 12345), float(-(2**30) + i * i), float(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n, s, m = whitening.scatter(V.whole_numbers(df, "vec_id"), 3)
    x = [[int(256 * c) for c in v] for _, v in rows]
    assert n == 40 and s == [sum(c) for c in zip(*x, strict=True)]
    assert m == [[40 * sum(v[i] * v[j] for v in x) - s[i] * s[j] for j in range(3)] for i in range(3)]
    assert all(r["deviation"] is None or r["deviation"] < 1 << 63 for r in whitening.whitened(df).collect())


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def joined(rows, k, percent):
    """n_shingles, component and links of each row (doc_id, text), by all pairs."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[root(a)] = root(b)
            links[a] += 1
            links[b] += 1
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((doc, len(s), least.get(root(i)) if doc is not None else None, n) for i, ((doc, _), s, n) in enumerate(zip(rows, sets, links, strict=True))), key=str)


def check_join(df, k, percent, **options):
    want = joined([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], k, percent)
    got = ngram_join.jaccard_join(df, k, percent, counted=True, **options).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got), key=str) == want
    rows = ngram_join.jaccard_join(df, k, percent, **options).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str) == sorted((w[:3] for w in want), key=str)


def test_join_of_odd_rows(spark):
    texts = [None, "", " \n", "one", "One", "one two", "same text here it is", "Same TEXT here it is", "w " * 5_000, "é É ß 日本語 мир x y", "a b c d e f g h i j k l", "a b c d e f g h i j k l m"]
    rows = [(i, t, "s", 0.5, "w") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[6], (3, "other text of an id", None, None, None), (None, "same text here it is", None, None, None)], "doc_id long, text string, source string, set double, print string")
    check_join(df, 4, 85)
    check_join(df, 2, 50)
    assert ngram_join.jaccard_join(df.limit(0)).count() == 0


def test_join_of_near_copies_and_shared_passages(spark, monkeypatch):
    """Groups of two, crowded tokens of three groups: chains of near copies, and passages that many texts share."""
    monkeypatch.setattr(ngram_join, "CROWD", 3)
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base, passage = list(rng.choice(vocabulary, 120)), list(rng.choice(vocabulary, 40))
    texts = []
    for i in range(60):  # a chain: each differs from the one before by a few words
        at = rng.integers(0, 120, 1 + i % 3)
        for j in at:
            base[j] = str(rng.choice(vocabulary))
        texts.append(" ".join(base))
    texts += [" ".join([*rng.choice(vocabulary, rng.integers(3, 80)), *passage, *rng.choice(vocabulary, 10)]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_join(df, 4, 85, members=2)
    check_join(df, 3, 80, members=4, tokens=300)


def test_prefixes_share_a_token():
    """Of two sets at the threshold, whatever the order, the prefixes meet."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, percent = int(rng.integers(1, 60)), int(rng.integers(50, 100))
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.95], rng.integers(0, 1 << 62, rng.integers(0, 3)).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if both and 100 * both >= percent * (len(x) + len(y) - both):
            common = np.sort(rng.choice(x, len(x) // 2, replace=False)) if len(x) > 1 else np.zeros(0, np.uint64)
            assert len(np.intersect1d(ngram_join._prefix(x, percent, common), ngram_join._prefix(y, percent, common)))


def test_largest_bitmap(spark):
    """The largest bitmap of decontamination lets all of its values pass, and is one constant of the plan."""
    from pyspark.sql import functions as F

    from feedspark.llm import decontam

    values = spark.range(220_000).select((F.col("id") * 3).alias("v"))
    test = decontam.bitmap(values)
    rows = spark.range(660_000).where(test(F.col("id")))
    plan = rows._jdf.queryExecution().optimizedPlan()
    assert "from_json" not in plan.toString() and "jsontostructs" not in plan.toString().lower()
    assert rows.where("id % 3 = 0").count() == 220_000 and rows.count() < 280_000


def test_roots_keep_what_is_joined():
    """Joined nodes stay together in whatever order, and a join within a component is none."""
    from feedspark.llm.ngram_join import _Roots, _stars

    rng = np.random.default_rng(3)
    for _ in range(50):
        roots, plain = _Roots(), {v: {v} for v in range(30)}
        for a, b in rng.integers(0, 30, (25, 2)).tolist():
            assert roots.join(a, b) == (plain[a] is not plain[b])
            whole = plain[a] | plain[b]
            plain.update(dict.fromkeys(whole, whole))
        assert sorted(_stars(roots, list(range(30)))) == [(v, min(plain[v]), None) for v in range(30) if len(plain[v]) > 1]


def test_join_rounds_take_only_new_links(spark, monkeypatch):
    """Near copies that one group settles take no part in the rounds of connected components."""
    from feedspark.llm import ngram_join

    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(120)]
    taken, plain = [], ngram_join.connected_components

    def counting(links):
        taken.append(links.where("a <> b").distinct().count())
        return plain(links)

    monkeypatch.setattr(ngram_join, "connected_components", counting)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85, members=40).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 120
    assert taken and sum(taken) < 12  # 119 links join the 120 sets


def test_join_opens_only_members_that_may_be_linked(spark, monkeypatch):
    """Groups of short texts that share their smallest shingle: unions of their bitmaps are full, and yet only the linked sets are compared."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    passages = [f"p{i} q{i} r{i} s{i}" for i in range(20_000)]
    data, offs = np.frombuffer("".join(passages).encode(), np.uint8), np.cumsum([0, *map(len, passages)])
    common = passages[int(np.argmin([own[0] for own in ngram_join.C.shingle_sets(data, offs, 4)]))]
    rows = [(i, " ".join([common, *(f"w{v}" for v in rng.integers(0, 9_999, rng.integers(20, 40)))])) for i in range(119)]
    rows.append((119, rows[5][1] + " x"))
    monkeypatch.setattr(ngram_join, "FREQUENT", 1_000)
    compared, plain = [], ngram_join.Join._opened

    def counting(self, pairs, run):
        if run is ngram_join._joined:
            compared.append(pairs.agg(F.sum(F.size("members_a") + F.size("members_b"))).first()[0] or 0)
        return plain(self, pairs, run)

    monkeypatch.setattr(ngram_join.Join, "_opened", counting)
    for members in (1, 10):
        compared.clear()
        got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, members=members).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [w[:3] for w in sorted(joined(rows, 4, 85))]
        assert compared and sum(compared) <= 4


def test_bitmaps_and_sketches_lose_no_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, percent = int(rng.integers(1, 400)), int(rng.integers(50, 100))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 62, rng.integers(0, 9)).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        linked = both and 100 * both >= percent * (len(x) + len(y) - both)
        sizes, maps = [np.array([len(s)]) for s in (x, y)], [ngram_join._widths([len(s)], np.frombuffer(ngram_join._bitmap(s), np.uint8)) for s in (x, y)]
        for a, b in ((0, 1), (1, 0)):
            assert not linked or ngram_join._reaching(sizes[a], maps[a], sizes[b], maps[b], percent).all()
        lacks = sum((p & ~q).bit_count() for p, q in zip(*([v % (1 << 64) for v in ngram_join._sketch(s)] for s in (x, y)), strict=True))
        assert lacks <= len(np.setdiff1d(x, y))
