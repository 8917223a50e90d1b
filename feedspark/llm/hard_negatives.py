"""Hard negatives by vertical scans of column blocks (BOND: branch and bound on decomposed vectors).

Vectors of whole numbers are stored once as blocks of some thousand rows, ordered by label and laid out dimension by dimension, with each
dimension's smallest and largest entry. A scan takes an anchor's dimensions by falling magnitude, a few at a time: what the read
dimensions add is exact, what the others can add lies between sums of minima and maxima, and a candidate leaves the bitmap when these bounds
put it out of every window that is still open. What stays to the last dimension has its exact score. Two scans are made: one for each
anchor's best rows of its own label (the positives), one for the best rows of other labels in each positive's window. Within a task the best rows so
far bound the later blocks.

Scale: anchors are taken in groups of at most `group` rows, whose matrix (at most `group` x d numbers) goes to the tasks as a broadcast; every
group is one pass over the stored blocks, so that neither anchors nor rows are ever in one place. A task returns at most its best rows for each
anchor and window; ranks over tasks are windows that Spark limits before the shuffle.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite entry take no part; a shorter vector is filled
with zeros; other rows are rows with another id, so copies of a row under its id are no positives of it; repeated rows are ranked one by one, but
equal anchors (id, label and vector) count once; of rows with equal score and id the order doesn't matter; a positive score below zero has an
empty window; an empty table gives an empty result; extra columns are ignored. Scores must fit in 64 bits, else an error is raised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedspark.llm import common as C
from feedspark.llm.vectors import grid, grids, whole_numbers

#: Rows of a block, and dimensions that a scan reads before it looks at the bounds.
BLOCK, STEP = 8_192, 8
_BLOCKS = "ids binary, labels binary, vectors binary, n int"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by label, dimension by dimension."""
    held, rows = [], 0

    def block() -> pa.RecordBatch:
        ids, labels, x = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort([ids, labels])
        parts = [ids[order], labels[order], np.ascontiguousarray(x[order].T)]
        small = np.abs(x).max(initial=0) < 1 << 15
        parts[2] = parts[2].astype(np.int16 if small else np.int64)
        return pa.RecordBatch.from_arrays([*(pa.array([p.tobytes()], pa.binary()) for p in parts), pa.array([len(ids)], pa.int32())], [c.split()[0] for c in _BLOCKS.split(", ")])

    for batch, x in grids(batches):
        held.append((batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), x))
        rows += len(x)
        if rows >= BLOCK:
            yield block()
            held, rows = [], 0
    if held:
        yield block()


def _read(batches: Iterator[pa.RecordBatch], d: int):
    """ids, labels, columns (d by n), smallest and largest entry of each dimension."""
    for batch in batches:
        for i in range(batch.num_rows):
            n = batch.column("n")[i].as_py()
            ids, labels, raw = (batch.column(c)[i].as_buffer() for c in ("ids", "labels", "vectors"))
            columns = np.frombuffer(raw, np.int16 if raw.size == 2 * d * n else np.int64).reshape(d, n).astype(np.int64)
            yield np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), columns, columns.min(axis=1), columns.max(axis=1)


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


class Scan:
    """A vertical scan of one block for one anchor."""

    def __init__(self, anchor: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray):
        size = int(np.abs(anchor).max(initial=0)) * max(int(np.abs(low).max(initial=0)), int(np.abs(high).max(initial=0))) * max(1, len(anchor))
        if size >= 1 << 63:
            raise ValueError("scores beyond 64 bits")
        kind = np.float64 if size < 1 << 53 else np.int64
        self.order = np.argsort(-np.abs(anchor), kind="stable")
        self.anchor, self.columns, self.kind = anchor[self.order].astype(kind), columns, kind
        ends = np.stack([anchor * low, anchor * high])[:, self.order]
        rest = lambda v: np.append(np.cumsum(v[::-1])[::-1], 0)
        self.least, self.most = rest(ends.min(axis=0)), rest(ends.max(axis=0))

    def run(self, rows: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Those of the rows that stay, and their scores. keep(least, most): which candidates can still be among the wanted."""
        score = np.zeros(len(rows), self.kind)
        for at in range(0, len(self.order), STEP):
            dims = self.order[at : at + STEP]
            score = score + self.anchor[at : at + STEP] @ self.columns[np.ix_(dims, rows)].astype(self.kind)
            to = at + len(dims)
            alive = keep(score + self.least[to], score + self.most[to])
            if not alive.all():
                rows, score = rows[alive], score[alive]
            if not len(rows):
                break
        return rows, score.astype(np.int64)


def _best(rows: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """(score, id) by falling score, then by id."""
    return sorted(rows, key=lambda r: (-r[0], r[1]))[:k]


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    if len(score) > k:
        least = _kth(score, k)
        score, ids = score[score >= least], ids[score >= least]
    order = np.lexsort([ids, -score])[:k]
    return list(zip(score[order].tolist(), ids[order].tolist(), strict=True))


def _emit(rows: list[tuple], names: str) -> Iterator[pa.RecordBatch]:
    kinds = [(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in names.split(", ")]
    for at in range(0, len(rows), 1_000):
        columns = zip(*rows[at : at + 1_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


_FOUND = "anchor int, window int, score long, vec_id long"
_MINED = "anchor int, anchor_id long, window int, positive_id long, positive_score long, score long, vec_id long"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _positives(anchors, most: int):
    """Each task's best rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own_labels, matrix = anchors.value
        best: list[list[tuple[int, int]]] = [[] for _ in own_ids]
        for ids, labels, columns, low, high in _read(batches, matrix.shape[1]):
            starts, ends = np.searchsorted(labels, own_labels, "left"), np.searchsorted(labels, own_labels, "right")
            for a in np.flatnonzero(ends > starts):
                rows = np.arange(starts[a], ends[a])
                rows = rows[ids[rows] != own_ids[a]]
                so_far = best[a][most - 1][0] if len(best[a]) == most else -np.inf
                rows, score = Scan(matrix[a], columns, low, high).run(rows, lambda least, top, s=so_far: top >= max(s, _kth(least, most)))
                best[a] = _best(best[a] + _first(score, ids[rows], most), most)
        yield from _emit([(a, 0, s, i) for a, x in enumerate(best) for s, i in x], _FOUND)

    return run


def _negatives(anchors, windows, most: int):
    """Each task's best rows of other labels in each window. windows: for each anchor (rank and id of the positive, its score, smallest and
    largest score of a negative)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, own_labels, matrix = anchors.value
        best = {(a, w): [] for a, own in windows.value.items() for w, *_ in own}
        for ids, labels, columns, low, high in _read(batches, matrix.shape[1]):
            for a, own in windows.value.items():
                rows = np.flatnonzero(labels != own_labels[a])
                floors = [max(x, best[a, w][most - 1][0] if len(best[a, w]) == most else x) for w, _, _, x, _ in own]

                def keep(least, top, own=own, floors=floors):
                    alive = np.zeros(len(least), bool)
                    for (*_, x, y), so_far in zip(own, floors, strict=True):
                        sure = least[(least >= x) & (top <= y)]
                        alive |= (top >= max(so_far, _kth(sure, most))) & (least <= y)
                    return alive

                rows, score = Scan(matrix[a], columns, low, high).run(rows, keep)
                for w, _, _, x, y in own:
                    inside = (score >= x) & (score <= y)
                    best[a, w] = _best(best[a, w] + _first(score[inside], ids[rows[inside]], most), most)
        yield from _emit([(a, int(anchor_ids[a]), w, p, t, s, i) for a, own in windows.value.items() for w, p, t, *_ in own for s, i in best[a, w]], _MINED)

    return run


def _ranked(found: DataFrame, most: int) -> DataFrame:
    over = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= most)


def _mined(blocks: DataFrame, own: pa.Table, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
    """Results of one group of anchors, stored."""
    context = blocks.sparkSession.sparkContext
    ids, labels, matrix = own["vec_id"].to_numpy(), own["label"].to_numpy(), grid(own["x"])
    anchors = context.broadcast((ids, labels, matrix))
    found = _ranked(C.mapped(blocks, _positives(anchors, positives), _FOUND), positives).collect()
    windows: dict[int, list[tuple]] = {}
    for r in sorted(found, key=lambda r: (r["anchor"], r["rank"])):
        low, high = -(-window[0] * r.score // 100), window[1] * r.score // 100
        if low <= high:
            windows.setdefault(r.anchor, []).append((r["rank"], r.vec_id, r.score, low, high))
    spread = context.broadcast(windows)
    rows = _ranked(C.mapped(blocks, _negatives(anchors, spread, negatives), _MINED), negatives)
    names = {"anchor_id": "anchor_id", "positive_id": "positive_id", "rank": "rank", "vec_id": "negative_id", "positive_score": "positive_score", "score": "negative_score"}
    stored = C.checkpointed(rows.select(*(F.col(k).alias(v) for k, v in names.items())))
    anchors.destroy()
    spread.destroy()
    return stored


def hard_negatives(
    embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), group: int = 4_096
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. embeddings: vec_id, label, embedding; anchors are the rows whose id
    is divisible by `every`; window: percent of the positive's score that a negative's score may have."""
    columns = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label")]
    rows = whole_numbers(embeddings.where("vec_id is not null and label is not null"), *columns)
    blocks = C.checkpointed(C.mapped(rows, _blocks, _BLOCKS))
    anchors = rows.where(F.col("vec_id") % every == 0).distinct()
    anchors = C.checkpointed(anchors)
    count, d = anchors.agg(F.count("*"), F.max(F.size("x"))).first()
    groups = -(-count // max(1, min(group, C.BROADCAST_BYTES // (8 * max(1, d or 1)))))
    part = F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(max(1, groups)))
    out = None
    for i in range(groups):
        own = anchors.where(part == i).orderBy("vec_id").toArrow()
        if own.num_rows:
            found = _mined(blocks, own, positives, negatives, window)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else embeddings.sparkSession.createDataFrame([], OUT)


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label))


#: The same in DuckDB, by all inner products.
OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(c::DOUBLE * 256) FOR c IN embedding] AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
