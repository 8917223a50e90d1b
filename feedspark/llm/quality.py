"""Quality rules: a learned decision list.

`features` measures every whole text in one pass. `learn` grows and prunes threshold conjunctions by
sequential covering on the measured features of labelled documents, and `as_column` turns the ordered list
into one Spark conditional expression, so that applying it is a projection without shuffle.

Defined results: a null or empty text has zero of everything (so the base rule rejects it); rows are judged
one by one, so repeated rows and ties get equal verdicts; very long texts are measured whole, each in a chunk of its own; an
empty table gives an empty result; with no label of either class the list is empty and only the base rule decides; of
clashing labels of one id the rejection counts, of different texts under one id the one of the smallest counts; extra
columns are ignored, or kept if they are named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.llm import common as C

MAX_LABELLED = 20_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in "!?"]] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_words", "n_upper", "n_letters", "n_digits", "n_exclaims"]
SCHEMA = [T.StructField(c, T.LongType()) for c in ("doc_id", *COUNTS)]
WINDOW = 8

#: Features that rules may test, each a ratio that doesn't grow with a text's length.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "echoes_per_word": ("n_same_words", "n_words"),
    "upper_per_letter": ("n_upper", "n_letters"),
    "digits_per_char": ("n_digits", "word_chars"),
    "exclaims_per_word": ("n_exclaims", "n_words"),
}


def _measured(carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts in _measure(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *counts, *(rows.column(c) for c in carry)], ["doc_id", *COUNTS, *carry])

    return run


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
    for rows, data, offs in C.chunks(batches, "text"):
        n = len(offs) - 1
        w = C.words(data, offs, False)
        n_words = np.bincount(w.doc, minlength=n)
        lines = C.lines(data, offs)
        in_words = np.zeros(len(data) + 1, np.int64)
        np.cumsum(w.inside, out=in_words[1:])
        full = in_words[lines.end] > in_words[lines.start]
        by_doc = lambda piece: C.mix(piece.doc.astype(np.uint64) + np.uint64(1))
        line_doc = lines.doc[full]
        _, first = C.group_sizes(lines.hash[full] ^ by_doc(lines)[full])
        same = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        grams = C.windows(w.hash, WINDOW)
        own = w.doc[: len(grams)]
        inside = own == w.doc[WINDOW - 1 : WINDOW - 1 + len(grams)]
        at = np.flatnonzero(inside)
        sizes, _ = C.group_sizes(grams[at] ^ by_doc(w)[at])
        twice = at[sizes > 1]
        cover = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
        repeated = np.cumsum(cover)[:-1] > 0
        out = {
            "n_words": n_words,
            "word_chars": C.per_doc(w.inside & ((data & 0xC0) != 0x80), offs),
            "n_symbols": C.per_doc(_SYMBOL[data], offs),
            "n_dup_lines": np.bincount(line_doc[~first], minlength=n),
            "n_repeat_words": np.bincount(w.doc[repeated], minlength=n),
            "n_lines": np.bincount(line_doc, minlength=n),
            "n_same_words": np.bincount(w.doc[1:][same], minlength=n),
            "n_upper": C.per_doc(_UPPER[data], offs),
            "n_letters": C.per_doc(_LETTER[data], offs),
            "n_digits": C.per_doc(_DIGIT[data], offs),
            "n_exclaims": C.per_doc(_END[data], offs),
        }
        yield rows, [pa.array(out[c].astype(np.int64)) for c in COUNTS]


def features(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, counts of every whole text and the columns to carry, one row per document; no shuffle."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(carry or []))
    schema = T.StructType([*SCHEMA])
    for c in carry or []:
        schema = schema.add(own.schema[c])
    return C.mapped(own, _measured(carry or []), schema)


def ratio(name: str) -> Column:
    top, bottom = RATIOS[name]
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


@dataclass(frozen=True)
class Rule:
    """Reject a document if all tests (feature, '<=' or '>=', threshold) hold."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(table.values()))), bool)
        for name, sign, x in self.tests:
            out &= table[name] <= x if sign == "<=" else table[name] >= x
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, x in self.tests:
            out = out & (ratio(name) <= x if sign == "<=" else ratio(name) >= x)
        return out


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, cuts: int = 64, most: int = 3) -> list[tuple[str, str, float]]:
    """Add the test of the greatest information gain until no clean row is covered."""
    tests: list[tuple[str, str, float]] = []
    live = np.ones(len(bad), bool)
    while live.any() and (~bad[live]).any() and len(tests) < most:
        p, n = bad[live].sum(), (~bad[live]).sum()
        base, best = np.log2(p / (p + n)) if p else -np.inf, (1e-9, None)
        for name, x in table.items():
            own = x[live]
            values = np.unique(np.quantile(own, np.linspace(0, 1, cuts)))
            mids = (values[1:] + values[:-1]) / 2
            for sign in ("<=", ">="):
                for cut in mids:
                    hit = own <= cut if sign == "<=" else own >= cut
                    pos, all_ = bad[live][hit].sum(), hit.sum()
                    if pos and (gain := pos * (np.log2(pos / all_) - base)) > best[0]:
                        best = (gain, (name, sign, float(cut)))
        if best[1] is None:
            break
        tests.append(best[1])
        live &= Rule((best[1],), 0, 0).holds(table)
    return tests


def learn(sample: pd.DataFrame, min_precision: float = 0.95, min_covered: int = 3, most: int = 24, tries: int = 8, seed: int = 7) -> list[Rule]:
    """Sequential covering: draw a split, grow a rule on two thirds of the labelled rows, prune its last tests on the other third,
    keep it if it is precise over both parts together, drop the rows that it covers, and go on; stop when `tries` splits in a row
    give no such rule. How the list does on labels that took no part is for tests to say.

    sample: columns of COUNTS and `quality` (0: reject).
    """
    if sample.empty:
        return []
    table = {name: (sample[a] / sample[b].clip(lower=1)).to_numpy(float) for name, (a, b) in RATIOS.items()}
    bad = sample["quality"].to_numpy() == 0
    rng = np.random.default_rng(seed)
    left, rules, failed = np.ones(len(sample), bool), [], 0
    part = lambda m: {k: v[m] for k, v in table.items()}
    while len(rules) < most and failed < tries and left[bad].sum() >= min_covered:
        grow = rng.random(len(sample)) < 2 / 3
        g, held = left & grow, left & ~grow
        tests = _grow(part(g), bad[g]) if bad[g].any() else []
        worth = []
        for k in range(len(tests), 0, -1):
            hit = Rule(tuple(tests[:k]), 0, 0).holds(part(held))
            p, n = (bad[held] & hit).sum(), (~bad[held] & hit).sum()
            worth.append(((p - n) / max(p + n, 1), k))
        tests = tests[: max(worth, key=lambda x: x[0])[1]] if worth else []
        hit = Rule(tuple(tests), 0, 0).holds(table) & left
        precision = (hit & bad).sum() / max(hit.sum(), 1)
        if not tests or precision < min_precision or (hit & bad).sum() < min_covered:
            failed += 1
            continue
        failed = 0
        rules.append(Rule(tuple(tests), float(precision), int(hit.sum())))
        left &= ~hit
    return rules


def as_column(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: false for the first rule that holds, else true."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(), F.lit(False))
    for r in rules[1:]:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> pd.DataFrame:
    """Counts and label of at most `bound` labelled documents, one row an id: those with the smallest hash of their id."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    few = C.checkpointed(own.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    rows = features(docs.select("doc_id", "text").join(F.broadcast(few.select("doc_id")), "doc_id", "left_semi"))
    one = rows.groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("x")).select("doc_id", "x.*")
    return one.join(F.broadcast(few), "doc_id").orderBy("doc_id").toPandas()


def judge(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, carry: list[str] | None = None, **how) -> DataFrame:
    """One row per document: doc_id, its counts, the columns to carry, base_failed, rejected_by (number of the rule, else null), kept."""
    rules = learn(labelled_sample(docs, labels, bound), **how)
    which = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        which = F.when(rules[i].column(), F.lit(i)).otherwise(which)
    return features(docs, carry).select("*", base_failed().alias("base_failed"), which.alias("rejected_by"), (~base_failed() & as_column(rules)).alias("kept"))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
