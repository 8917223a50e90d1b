"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and their beginnings of 4 and 5 letters. Every whole text is a vector over the terms that a labelled example holds; a term weighs
(1 + ln tf) * ln(1 + N / (1 + df)), with df and N counted over the whole corpus, times a factor of FLOOR to 1 that tells how clearly
half of the examples tie the term to the label, either way (its z score; `weighted` turns it off). No term is left out, whether rare, common
or by its label. Examples lie in an inverted index cut into blocks; a block's largest weights bound the cosine of every example in
it, so that blocks which can't reach the k-th best so far are skipped and the k nearest are still exact. The `dense` terms with the longest postings
are a matrix instead, whose products with a batch of texts are exact parts of all cosines and of the bounds. The labels of the nearest,
weighted with the squared cosine, give a vote, which isotonic regression calibrates on leave-one-out votes of the other half of the
examples, whose labels gave no weight. The nearest examples, toxic or clean, are the evidence.

Bounds (all parameters): `examples` labelled rows (those with the smallest hash of their id), `vocabulary` terms (those that most
examples hold). The index therefore has a fixed largest size and is broadcast. Everything else covers all rows: one pass
cuts texts into term numbers, which are stored; a second counts document frequencies, with one row a term and task to sum; a third
scores, without shuffle. The votes for the calibration are taken in tasks as well.

Defined results: a null or empty text, and one that shares no term with an example, has no neighbour and gets the score of a vote
that equals the share of toxic examples; a table of few examples is treated as a large one (with one example, each text that shares a term with it
has it as its neighbour); very long texts are scored whole; repeated rows get equal scores; ties between
examples go to the smaller id; of clashing labels of one id toxic counts, of different texts under one id the first in order is
the example; an empty table gives an empty result; without labels the score is 0; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.llm import common as C

EXAMPLES = 3_000
VOCABULARY = 200_000
#: Terms that are a matrix, and texts that are multiplied with it at once.
DENSE, BATCH = 2_048, 128
PREFIXES = (4, 5)
#: Weight of a term that the labels say nothing about; and the z scores from which and up to which the weight grows to 1.
FLOOR = 0.03
Z_FROM, Z_TO = 3.0, 8.0
#: Weight of the share of toxic examples in a vote.
PRIOR = 0.05
THRESHOLD = 0.3
BLOCK = 64
FIRST_BLOCKS = 8
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> Counter:
    """Words in lower case and, marked with ^, their beginnings, with counts."""
    found = Counter(_WORD.findall(text.lower())) if text else Counter()
    out = Counter(found)
    for word, n in found.items():
        for k in PREFIXES:
            if len(word) > k:
                out["^" + word[:k]] += n
    return out


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
            own = list(terms_of(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([toxic] * len(own), pa.int32())], ["term", "toxic"])


class Vocabulary:
    """Numbers of terms. The vocabulary's own words have a table of their terms' numbers (-1: none); other words only have beginnings."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.known: dict[str, int] | None = None

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.__init__(terms)

    def _build(self) -> None:
        self.parts = [(k, {t[1:]: i for i, t in enumerate(self.terms) if t[0] == "^" and len(t) == k + 1}) for k in PREFIXES]
        words = [(t, i) for i, t in enumerate(self.terms) if t[0] != "^"]
        self.known = {w: n for n, (w, _) in enumerate(words)}
        self.table = np.array([[i, *self._beginnings(w)] for w, i in words], np.int64).reshape(len(words), 1 + len(PREFIXES))

    def _beginnings(self, word: str) -> list[int]:
        return [part.get(word[:k], -1) if len(word) > k else -1 for k, part in self.parts]

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, in order, and counts of a text's terms."""
        if self.known is None:
            self._build()
        words = _WORD.findall(text.lower()) if text else []
        rows = list(map(self.known.get, words))
        others = [i for w, r in zip(words, rows, strict=True) if r is None for i in self._beginnings(w)]
        found = np.concatenate([self.table[[r for r in rows if r is not None]].ravel(), np.array(others, np.int64)]) if words else np.zeros(0, np.int64)
        own = np.sort(found[found >= 0])
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        return own[first], np.diff(np.append(first, len(own)))


_LISTS = "terms array<int>, counts array<int>"


def _vectors(shared, keep: list[str]):
    """Term numbers (each less the one before) and counts of each text, with the columns to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for b in batches:
            found = [vocabulary.vector(x.as_py()) for x in b.column("text")]
            ends = pa.array(np.cumsum([0, *(len(t) for t, _ in found)], dtype=np.int32))
            steps = [(np.diff(t, prepend=0), n) for t, n in found]
            flat = (np.concatenate([f[i] for f in steps] or [np.zeros(0)]).astype(np.int32) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat)], [*keep, "terms", "counts"])

    return run


def _terms(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The term numbers of all texts of a batch, and where each text's begin and end."""
    size = b.column("terms").value_lengths().to_numpy().astype(np.int64)
    ends = np.append(0, np.cumsum(size))
    total = np.append(0, np.cumsum(b.column("terms").flatten().to_numpy().astype(np.int64)))
    return total[1:] - np.repeat(total[ends[:-1]], size), ends


def _read(b: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a batch."""
    terms, ends = _terms(b)
    counts = b.column("counts").flatten().to_numpy().astype(np.int64)
    return [(terms[i:j], counts[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _frequencies(n_terms: int):
    """Documents that hold each term, and all documents (term -1), summed over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(n_terms, np.int64), 0
        for b in batches:
            docs += b.num_rows
            total += np.bincount(_terms(b)[0], minlength=n_terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(total[held], docs))], ["term", "n"])

    return run


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i] to start[i] + size[i] - 1 for every i, one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(size.sum())


class BlockMaxIndex:
    """Unit vectors of examples in blocks; for each term its postings, cut at blocks, and its largest weight in each block. The `dense`
    terms with most postings are a matrix."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, labels: np.ndarray, n_terms: int, dense: int = DENSE):
        """vectors: terms and weights of each example, stored in single precision; the order by heaviest term lets blocks hold like
        vectors."""
        heavy = [int(t[w.argmax()]) if len(t) else -1 for t, w in vectors]
        order = np.lexsort((ids, heavy)) if len(ids) else np.zeros(0, np.int64)
        self.ids, self.labels = ids[order], labels[order]
        self.blocks = -(-len(order) // BLOCK)
        vectors = [vectors[i] for i in order]
        row = np.repeat(np.arange(len(order)), [len(t) for t, _ in vectors]).astype(np.int64)
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)])
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)]).astype(np.float32)
        most = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:dense]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[most] = np.arange(len(most))
        self.matrix = np.zeros((len(most), len(order)), np.float32)
        thick = self.column[term] >= 0
        self.matrix[self.column[term[thick]], row[thick]] = weight[thick]
        row, term, weight = row[~thick], term[~thick], weight[~thick]
        by = np.lexsort((row, term))
        self.rows, self.weights, term = row[by].astype(np.int32), weight[by], term[by]
        block = self.rows // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        self.block, self.start = block[at].astype(np.int32), np.append(at, len(term))
        self.largest = np.maximum.reduceat(self.weights, at) if len(at) else np.zeros(0, np.float32)
        self.entry = np.searchsorted(term[at], np.arange(n_terms + 1))

    def dense_part(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the dense terms add to the cosines of all examples with each vector."""
        own = np.zeros((len(vectors), len(self.matrix)), np.float32)
        for i, (terms, weights) in enumerate(vectors):
            column = self.column[terms]
            own[i, column[column >= 0]] = weights[column >= 0]
        return own @ self.matrix

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples that share a term, in order; but: a row that doesn't count; base: the vector's
        dense_part. The blocks of the largest bounds set the k-th cosine; then every block that may reach it is opened, and no other."""
        if not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0)
        score = (self.dense_part([(terms, weights)])[0] if base is None else base).astype(np.float64)
        bound = np.maximum.reduceat(score, np.arange(0, len(score), BLOCK))
        thin = self.column[terms] < 0
        terms, weights = terms[thin], weights[thin]
        size = self.entry[terms + 1] - self.entry[terms]
        entries = _spans(self.entry[terms], size)
        own = np.repeat(weights.astype(np.float32), size)
        block = self.block[entries]
        bound += np.bincount(block, self.largest[entries] * own, self.blocks)
        open_ = np.zeros(self.blocks, bool)
        now = np.argpartition(-bound, FIRST_BLOCKS)[:FIRST_BLOCKS] if self.blocks > FIRST_BLOCKS else np.arange(self.blocks)
        while len(now):
            mask = np.zeros(self.blocks, bool)
            mask[now] = True
            open_ |= mask
            keep = mask[block]
            e = entries[keep]
            count = self.start[e + 1] - self.start[e]
            at = _spans(self.start[e], count)
            score += np.bincount(self.rows[at], self.weights[at] * np.repeat(own[keep], count), len(score))
            if but >= 0:
                score[but] = 0
            floor = -np.partition(-score, k - 1)[k - 1] if len(score) > k else 0.0
            now = np.flatnonzero(~open_ & (bound > 0) & (bound >= floor - 1e-6))
        found = np.flatnonzero((score > 0) & (score >= floor - 1e-7))
        found = found[np.lexsort((self.ids[found], -np.round(score[found], 6)))][:k]
        return found, np.minimum(score[found], 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit by pooling adjacent violators; points for linear interpolation."""
    blocks: list[list[float]] = []
    for a, b in sorted(zip(x.tolist(), y.tolist(), strict=True)):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] >= blocks[-1][0]):
            s, n, _, hi = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + s * n) / (last[1] + n)
            last[1] += n
            last[3] = hi
    return np.array([v for b in blocks for v in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in (0, 1)])


def label_weights(held: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """FLOOR to 1 by the z score of the toxic share among the examples that hold a term (held, toxic: examples and toxic ones)."""
    share = n_toxic / max(n, 1)
    z = np.abs(toxic - held * share) / np.sqrt(np.maximum(held * share * (1 - share), 1e-9))
    return FLOOR + (1 - FLOOR) * np.clip((z - Z_FROM) / (Z_TO - Z_FROM), 0, 1)


class Model:
    """Votes of the nearest examples and their calibration."""

    def __init__(self, weight: np.ndarray, vectors: list, ids: np.ndarray, labels: np.ndarray, k: int):
        """weight: of each term; vectors: terms and counts of each example."""
        self.weight, self.k = weight, k
        self.base = float(labels.mean()) if len(labels) else 0.0
        self.index = BlockMaxIndex([self.unit(*v) for v in vectors], ids, labels, len(weight))
        self.row = {int(i): n for n, i in enumerate(self.index.ids)}
        self.x, self.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """votes: leave-one-out votes of examples."""
        if len(votes):
            self.x, self.y = isotonic(votes, labels.astype(float))

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms with a weight, and the unit vector."""
        w = (1 + np.log(np.maximum(counts, 1))) * self.weight[terms]
        keep = w > 0
        return terms[keep], w[keep] / max(math.sqrt(float(w @ w)), 1e-300)

    def votes(self, own: list[tuple[np.ndarray, np.ndarray]], but: list[int] | None = None) -> Iterator[tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """The vote on each text (terms and counts), and the ids, cosines and labels of its neighbours; but: for each text an example
        that doesn't count."""
        for at in range(0, len(own), BATCH):
            vectors = [self.unit(*v) for v in own[at : at + BATCH]]
            parts = self.index.dense_part(vectors)
            for i, (vector, base) in enumerate(zip(vectors, parts, strict=True), at):
                rows, cosines = self.index.nearest(*vector, self.k, -1 if but is None else self.row.get(but[i], -1), base)
                labels, weights = self.index.labels[rows], cosines**2
                raw = (PRIOR * self.base + float(weights @ labels)) / (PRIOR + float(weights.sum()))
                yield raw, (self.index.ids[rows], cosines, labels)

    def scores(self, own: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        for raw, near in self.votes(own):
            yield float(np.clip(np.interp(raw, self.x, self.y), 0, 1)), near


EVIDENCE = "array<struct<doc_id:long,similarity:double,toxic:int>>"


def _scored(shared, carry: list[str]):
    names = ["doc_id", "similarity", "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            scores, near = zip(*shared.value.scores(_read(b)), strict=True)
            ends = np.cumsum([0, *(len(x[0]) for x in near)], dtype=np.int32)
            flat = [np.concatenate([x[i] for x in near]) for i in range(3)]
            flat = pa.StructArray.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.float64()), pa.array(flat[2].astype(np.int32))], names)
            evidence = pa.ListArray.from_arrays(pa.array(ends), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), evidence, *(b.column(c) for c in carry)], ["doc_id", "score", "evidence", *carry])

    return run


def _own_votes(shared):
    """Leave-one-out votes of examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes = [v for v, _ in shared.value.votes(_read(b), b.column("doc_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(votes, pa.float64())], ["doc_id", "toxic", "vote"])

    return run


def _weighs(doc_id: str = "doc_id") -> Column:
    """The half of the examples whose labels weigh terms."""
    return F.xxhash64(F.col(doc_id), F.lit("weigh")) % 2 == 0


def _examples(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """doc_id, toxic, text of at most `bound` labelled documents outside the held-out part, stored."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    few = own.where(~C.held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return C.checkpointed(docs.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, vocabulary: int = VOCABULARY, k: int = 16, weighted: bool = True) -> tuple[Model, DataFrame]:
    """The model, and the vectors of all documents: the columns of docs but text, terms, counts, stored, so that texts are cut into terms once.
    docs: doc_id, text and others. weighted: whether the examples' labels weigh terms."""
    context = docs.sparkSession.sparkContext
    sample = _examples(docs.select("doc_id", "text"), labels, examples)
    side = F.when(_weighs(), F.col("toxic"))  # null: an example that only counts the term
    counted = C.mapped(sample.select("text", side.alias("toxic")), _example_terms, "term string, toxic int").groupBy("term")
    counted = counted.agg(F.count("*").alias("all"), F.count("toxic").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    chosen = counted.orderBy(F.desc("all"), "term").limit(vocabulary).toArrow()
    terms = Vocabulary(chosen.column("term").to_pylist())
    shared = context.broadcast(terms)
    keep = [c for c in docs.columns if c != "text"]
    schema = lambda own, names: T.StructType([*(own.schema[c] for c in names), *T.StructType.fromDDL(_LISTS).fields])
    stored = C.checkpointed(C.mapped(docs, _vectors(shared, keep), schema(docs, keep)), "zstd")
    own_vectors = C.checkpointed(C.mapped(sample, _vectors(shared, ["doc_id", "toxic"]), schema(sample, ["doc_id", "toxic"])))
    shared.destroy()  # every job that read it has ended
    counts = C.mapped(stored.select("terms"), _frequencies(len(terms.terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df, at = np.zeros(len(terms.terms) + 1), counts.column("term").to_numpy()
    df[at] = counts.column("n").to_numpy()  # the number of documents, at -1, takes the last place
    n_docs, df = df[-1], df[:-1]
    rows = own_vectors.orderBy("doc_id").toArrow()
    ids, own = rows.column("doc_id").to_numpy().astype(np.int64), rows.column("toxic").to_numpy().astype(np.int64)
    vectors = [v for b in rows.to_batches() for v in _read(b)]
    weight = np.log(1 + n_docs / (1 + df))
    if weighted:
        half = sample.where(_weighs()).agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        weight = weight * label_weights(*(chosen.column(c).to_numpy().astype(float) for c in ("n", "toxic")), *half)
    model = Model(weight, vectors, ids, own, k)
    shared = context.broadcast(model)
    unseen = own_vectors.where(~_weighs()) if weighted else own_vectors
    votes = C.mapped(unseen, _own_votes(shared), "doc_id long, toxic int, vote double").orderBy("doc_id").toArrow()
    model.calibrate(votes.column("vote").to_numpy(), votes.column("toxic").to_numpy())
    shared.destroy()
    return model, stored


def score_documents(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, **how) -> DataFrame:
    """doc_id, score (0 to 1), evidence (nearest examples with cosine and label) and the columns to carry, one row per document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"own_{c}") for c in carry or []))
    model, stored = fit(own, labels, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    C.release()
    schema = T.StructType.fromDDL(f"doc_id long, score double, evidence {EVIDENCE}")
    names = [f"own_{c}" for c in carry or []]
    for c in names:
        schema = schema.add(own.schema[c])
    scored = C.mapped(stored, _scored(shared, names), schema)
    return scored.select("doc_id", "score", "evidence", *(F.col(n).alias(c) for n, c in zip(names, carry or [], strict=True)))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, labels)
    return scored.select("doc_id", C.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
