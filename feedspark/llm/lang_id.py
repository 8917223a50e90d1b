"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds every language's frequent letter n-grams: a cell keeps one bit for each language, an
n-gram sets its language's bit in `hashes` cells, and the AND of an n-gram's cells names all languages that
contain it at once. A text's n-grams are looked up, bits are counted by language, the counts are corrected for the
filter's false positives, and the language with the largest corrected count wins.

Learning is bounded by parameters: `per_language` documents (those with the smallest hash of their id) and `grams`
n-grams for each language; the filter's size is fixed and it travels with the task. Predicting is a projection
without shuffle over whole texts, vectorised over chunks of about a million code points.

Defined results: `und` with score 0 if a text is null, empty or has no letter, or if no language was learned; a text
whose n-grams are all unknown gets the most frequent language with score 0; ties go to the first language by
code; very long texts are read whole; rows that share an id are learned from together, and repeated rows get equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedspark.llm import common as C

ORDERS = (3, 4)
PER_LANGUAGE = 1_500
GRAMS = 12_000
CELLS = 1 << 20
HASHES = 2
_CHUNK = 1 << 20


@cache
def _folded() -> np.ndarray:
    """Code point -> its lower-case letter, 0 if it is no letter."""
    return np.fromiter((ord(chr(i).lower()[0]) if chr(i).isalpha() else 0 for i in range(0x110000)), np.uint32, 0x110000)


def _text_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for b in batches:
        texts = [x or "" for x in b.column("text").to_pylist()]
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= _CHUNK):
                size += len(texts[to])
                to += 1
            yield b.slice(at, to - at), texts[at:to]
            at = to


def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters with one 0 between words, and where each document begins in them (and the end)."""
    codes = _folded()[np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = codes != 0
    keep[0] = True
    keep[1:] |= codes[:-1] != 0
    place = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    starts = np.cumsum([1, *(len(x) + 1 for x in texts)])
    return codes[keep], place[np.minimum(starts, len(codes))]


def _grams(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-grams that have a separator at most at their ends, and the place of their second letter."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(size, n, np.uint64)
    good = np.ones(size, bool)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + codes[i : i + size]
            if 0 < i < n - 1:
                good &= codes[i : i + size] != 0
    at = np.flatnonzero(good)
    return C.mix(h[at]), at + 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of n-grams by language, summed over a chunk."""
    for part, texts in _text_chunks(batches):
        langs = np.array(part.column("lang").to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            codes, _ = _stream([t for t, x in zip(texts, langs, strict=True) if x == lang])
            for n in ORDERS:
                grams, counts = np.unique(_grams(codes, n)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(np.full(len(grams), n, np.int32)), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "order", "gram", "n"])


class Filter:
    """The bit-sliced Bloom filter. languages: sorted codes."""

    def __init__(self, languages: list[str], cells: int = CELLS, hashes: int = HASHES):
        self.languages, self.size, self.hashes = languages, cells, hashes
        self.cells = np.zeros((cells, -(-max(len(languages), 1) // 64)), np.uint64)
        self.false = np.zeros(len(languages))

    def _places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(self.hashes):
            yield (C.mix(grams + np.uint64(0x9E3779B97F4A7C15) * np.uint64(i + 1)) % np.uint64(self.size)).astype(np.int64)

    def add(self, lang: int, grams: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            for at in self._places(grams):
                self.cells[at, lang // 64] |= np.uint64(1 << (lang % 64))

    def close(self) -> Filter:
        """Note the chance that an n-gram of none is found, by language."""
        for i in range(len(self.languages)):
            self.false[i] = ((self.cells[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** self.hashes
        return self

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """All languages of each n-gram, as bits."""
        out = None
        with np.errstate(over="ignore"):
            for at in self._places(grams):
                out = self.cells[at] if out is None else out & self.cells[at]
        return out


def sample(known: DataFrame, per_language: int) -> DataFrame:
    """doc_id, lang of the `per_language` rows of each language with the smallest hash of their id. Counts by language first set a
    bound of the hash that at least so many rows stay below (but for 6 standard deviations), so that no task ranks more."""
    top = 1 << 40
    own = known.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(top)).alias("h"))
    most = F.col("n") * 1.0 / (per_language + 6 * per_language**0.5 + 36)
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (top / F.greatest(most, F.lit(1.0))).alias("below"))
    near = own.join(C.few(C.checkpointed(sizes)), "lang").where("h <= below")
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    return near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).select("doc_id", "lang")


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, grams: int = GRAMS) -> tuple[Filter, str | None]:
    """The filter and the most frequent language, from rows with a language outside the held-out part."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(~C.held_out())
    few = C.checkpointed(sample(known, per_language).select("doc_id").distinct())
    picked = known.join(C.few(few), "doc_id", "left_semi").select("text", "lang")
    counts = C.mapped(picked, _counted, "lang string, order int, gram long, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang", "order").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= grams // len(ORDERS)).select("lang", "gram").toPandas()
    languages = sorted(top["lang"].unique())
    made = Filter(languages)
    for i, lang in enumerate(languages):
        made.add(i, top.loc[top["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64))
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(1).collect()
    return made.close(), most[0]["lang"] if most else None


def _predicted(made: Filter, usual: str | None):
    n_lang = len(made.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _text_chunks(batches):
            codes, starts = _stream(texts)
            found, all_ = np.zeros((len(texts), n_lang)), np.zeros(len(texts))
            for n in ORDERS:
                grams, at = _grams(codes, n)
                edge = np.searchsorted(at, starts)
                all_ += edge[1:] - edge[:-1]
                masks = made.masks(grams)
                for i in range(n_lang):
                    total = np.zeros(len(grams) + 1, np.int64)
                    np.cumsum((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), out=total[1:])
                    found[:, i] += total[edge[1:]] - total[edge[:-1]]
            letters = C.per_doc(codes != 0, starts) > 0
            true = np.maximum(found - all_[:, None] * made.false, 0) / (1 - made.false) if n_lang else found
            best = true.argmax(axis=1) if n_lang else np.zeros(len(texts), int)
            top = true.max(axis=1) if n_lang else np.zeros(len(texts))
            score = np.where(top > 0, top / np.maximum(true.sum(axis=1), 1e-9), 0.0)
            langs = [("und" if not ok or usual is None else made.languages[b] if t > 0 else usual) for ok, b, t in zip(letters, best, top, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.where(letters, np.clip(score, 0, 1), 0.0))], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, **how) -> DataFrame:
    """doc_id, lang_pred, score, one row per document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    made, usual = learn(own, **how)
    return C.mapped(own.select("doc_id", "text"), _predicted(made, usual), "doc_id long, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    out = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", C.held_out().alias("held_out"), "lang_pred", "score")
