"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document is the set of its k-word shingles. The sketch places the set's elements in t bins in rounds: round
i < t hashes every element to some bin, round t + b puts every element in bin b, and a bin keeps the smallest
(round, value). After 2 t rounds every coordinate is filled, and equal coordinates estimate the Jaccard
similarity with the concentration bounds of independent hashing. `bands` groups of `rows` coordinates are
hashed; documents that share one are compared on their full sets.

Scale: equal sets collapse to one node before banding, so that large groups of copies cost one sketch. Within a bucket only
links that can join two components are tested. Stars come first: in each bucket the most popular member (the one
whose buckets are largest, so near the middle of its group) is compared with all members of other components; the next star
takes its hub outside the bucket's largest component, and stars go on as long as they join components. Last, the
members outside the largest component are compared with the members of other components, but only pairs that parity bits
don't rule out: bit j tells whether an odd number of elements hash to j, so two sets differ in at least as many elements
as bits differ. That bound is strict, and nearly exact for sets of up to about 1,000 elements; no link is lost to it.
In a bucket of n members of which m stay apart, that last step costs m * n comparisons of 256 bytes in generated code,
and set comparisons only for what is left. With 32 bands of 4 rows a pair at similarity 0.8 is missed with a chance of 5e-8.
Shingles are compared by 64-bit hashes, whole sets told apart by 128 bits.

Defined results: null and empty texts have an empty set and are linked with nothing; a repeated row is a copy; rows that
share a doc_id but not their text are nodes of their own; an empty table gives an empty result; extra columns are
ignored; a very long text is handled whole, in one task's chunk; a row without an id gives a row whose component is null and
which is linked with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm import common as C
from feedspark.llm.components import connected_components

#: Bits of the parity bitmap, in 64-bit words.
WORDS = 32
#: Stars go on while one of them takes at least this share off the pairs that are left.
GAIN = 0.2
_ROUND = C.mix(np.arange(1, 1 + 4096, dtype=np.uint64))


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes; t: a power of two, 2048 at most."""
    bits = t.bit_length() - 1
    none = np.iinfo(np.uint64).max
    best = np.full(t, none, np.uint64)
    at, step = 0, max(1, int(np.ceil(t * (np.log(t) + 2) / len(elements))))
    while (best == none).any():
        if at < t:
            rounds = np.arange(at, min(at + step, t))
            h = C.mix(elements[None, :] ^ _ROUND[rounds][:, None])
            place = h >> np.uint64(64 - bits)
        else:
            rounds = np.arange(t, 2 * t)
            h = C.mix(elements[None, :] ^ _ROUND[rounds][:, None]).min(axis=1)[:, None]
            place = (rounds - t).astype(np.uint64)[:, None]
        value = (h << np.uint64(bits)) >> np.uint64(2 * bits + 1)
        key = (place << np.uint64(64 - bits)) | (rounds.astype(np.uint64)[:, None] << np.uint64(63 - 2 * bits)) | value
        key = np.sort(key, axis=None)
        own = key >> np.uint64(64 - bits)
        first = np.ones(len(key), bool)
        first[1:] = own[1:] != own[:-1]
        bins = own[first].astype(np.int64)
        best[bins] = np.minimum(best[bins], key[first])
        at = rounds[-1] + 1
    return best


def _band_keys(coords: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = C.mix(coords[: bands * rows].reshape(bands, rows) + np.arange(rows, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))
    with np.errstate(over="ignore"):
        return C.mix(grid.sum(axis=1, dtype=np.uint64) + C.mix(np.arange(bands, dtype=np.uint64)))


def _parity(elements: np.ndarray) -> bytes:
    """Bit j: whether an odd number of elements falls to j."""
    at = (elements >> np.uint64(64 - (64 * WORDS).bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * WORDS) & 1).astype(np.uint8)).tobytes()


def _print(elements: np.ndarray) -> bytes | None:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def _sketched(k: int, bands: int, rows: int):
    t = 1 << (bands * rows - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[bytes, bytes]] = {}
        for part, data, offs in C.chunks(batches, "text"):
            sizes, prints, keys, parity = [], [], [], []
            for own in C.shingle_sets(data, offs, k):
                sizes.append(len(own))
                mark = _print(own)
                if mark and mark not in known:
                    if len(known) > 4_000:
                        known.clear()
                    known[mark] = _band_keys(sketch(own, t), bands, rows).astype(">u8").tobytes(), _parity(own)
                prints.append(mark)
                keys.append(known[mark][0] if mark else None)
                parity.append(known[mark][1] if mark else None)
            columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (prints, keys, parity))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "print", "bands", "parity"])

    return run


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame, k: int = 5, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, print (128 bits of the whole set), bands (8 bytes for each band), parity (a bitmap of the set)."""
    return C.mapped(_own(docs), _sketched(k, bands, rows), "doc_id long, n_shingles long, print binary, bands binary, parity binary")


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for part, data, offs in C.chunks(batches, "text"):
            ids, prints, sets = [], [], []
            for i, own in zip(part.column("doc_id").to_pylist(), C.shingle_sets(data, offs, k), strict=True):
                mark = _print(own)
                if mark and (i, mark) not in seen:  # a repeated row is needed once
                    seen.add((i, mark))
                    ids.append(i)
                    prints.append(mark)
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "print", "set"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for x, y in zip(part.column("set_a"), part.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], ["a", "b"])

    return run


class Linker:
    """Exact verification of pairs on the full sets of the documents that share a bucket."""

    def __init__(self, docs: DataFrame, members: DataFrame, reps: DataFrame, k: int, percent: int):
        used = C.checkpointed(reps.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "print"))
        texts = _own(docs).join(C.few(C.checkpointed(used.select("doc_id").distinct())), "doc_id", "left_semi")
        sets = C.mapped(texts, _sets(k), "doc_id long, print binary, set binary")
        self.sets = C.checkpointed(sets.join(used, ["doc_id", "print"]).select("rep", "set"))
        self.percent = percent

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose similarity reaches the threshold, as a stored table."""
        x, y = (self.sets.select(F.col("rep").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
        both = pairs.join(y, "b").join(x, "a").select("a", "b", "set_a", "set_b")
        return C.checkpointed(C.mapped(both, _linked(self.percent), "a long, b long"))


def _could_link(x: str, y: str, percent: int):
    """Sizes that allow the similarity."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _sizes(members: DataFrame) -> DataFrame:
    """key, major (its largest component), minor (members of others), all: the buckets with several components."""
    by = members.groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp")).alias("m"), F.sum("count").alias("all"), F.count("*").alias("n"))
    return by.where("n > 1").select("key", F.col("m.comp").alias("major"), (F.col("all") - F.col("m.count")).alias("minor"), "all")


def _star(members: DataFrame, sizes: DataFrame | None, percent: int) -> DataFrame:
    """Pairs of one member of each bucket with the members outside its component: the most popular one (at first of all,
    later of those outside the largest component), so that a group's buckets mostly agree on it."""
    pick = F.max(F.struct("popular", F.xxhash64("rep").alias("h"), F.col("rep").alias("p"), F.col("size").alias("p_size"), F.col("comp").alias("p_comp")))
    free = members if sizes is None else members.join(sizes.select("key", "major"), "key").where("comp <> major")
    hubs = free.groupBy("key").agg(pick.alias("x")).select("key", "x.p", "x.p_size", "x.p_comp")
    apart = members.join(hubs, "key").where(F.col("comp") != F.col("p_comp")).where(_could_link("size", "p_size", percent))
    return apart.select(F.col("p").alias("a"), F.col("rep").alias("b")).distinct()


def _rest(members: DataFrame, sizes: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """In each bucket, pairs of the members outside its largest component with the members of other components, each pair in
    the first band that it shares, unless parity bits rule the similarity out."""
    words = [F.conv(F.hex(F.substring("parity", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"w{i}") for i in range(WORDS)]
    marks = reps.select("rep", "bands", *words)
    open_ = C.checkpointed(members.join(sizes.select("key", "major"), "key").join(marks, "rep"))
    x, y = (open_.select("key", "major", *(F.col(c).alias(f"{s}_{c}") for c in ("rep", "size", "comp", "band", "bands", *(f"w{i}" for i in range(WORDS))))) for s in "ab")
    differ = sum((F.bit_count(F.col(f"a_w{i}").bitwiseXOR(F.col(f"b_w{i}"))) for i in range(WORDS)), F.lit(0))
    block = lambda c, i: F.substring(F.col(c), i * 8 + 1, F.lit(8))
    before = F.when(F.col("a_band") > 0, F.exists(F.sequence(F.lit(0), F.col("a_band") - 1), lambda i: block("a_bands", i) == block("b_bands", i))).otherwise(False)
    other = (F.col("a_comp") != F.col("b_comp")) & ((F.col("b_comp") == F.col("a_major")) | (F.col("a_rep") < F.col("b_rep")))
    minor = x.where("a_comp <> major").withColumnRenamed("major", "a_major")
    close = (100 + percent) * differ <= (100 - percent) * (F.col("a_size") + F.col("b_size"))
    near = other & _could_link("a_size", "b_size", percent) & close & ~before
    return minor.join(y.drop("major"), (minor["key"] == y["key"]) & near).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct()


def _components(docs: DataFrame, reps: DataFrame, k: int, percent: int, bands: int) -> DataFrame | None:
    """node, comp of the nodes (reps: rep, doc_id, size, print, bands, parity) that have links; None if none has."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.conv(F.hex(F.substring("bands", i * 8 + 1, 8)), 16, -10).cast("long"))
    placed = reps.select("rep", "size", F.posexplode(keys).alias("band", "key"))
    shared = C.checkpointed(placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = C.checkpointed(placed.join(C.few(shared), "key"))
    if members.isEmpty():
        return None
    popular = members.groupBy("rep").agg(F.sum("n").alias("popular"))
    members = C.checkpointed(members.drop("n").join(popular, "rep"))
    linker, links, labels = Linker(docs, members, reps, k, percent), None, None
    now, sizes, left = members.withColumn("comp", F.col("rep")), None, None
    while True:
        last = sizes is not None and left > (1 - GAIN) * before
        found = linker.links(_rest(now, sizes, reps, percent) if last else _star(now, sizes, percent))
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = connected_components(links)
            now = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        if last:
            return labels
        before, sizes = left, C.checkpointed(_sizes(now))
        left = sizes.agg(F.sum(F.col("minor") * F.col("all").cast("double"))).first()[0]
        if left is None:
            return labels
        before = before or 2 * left


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Documents are linked if their shingle sets
    have a Jaccard similarity of percent / 100 or more."""
    own = C.checkpointed(sketches(docs, k, bands, rows).withColumn("row", F.monotonically_increasing_id()))
    linked = F.col("print").isNotNull() & F.col("doc_id").isNotNull()
    first = F.min(F.struct("doc_id", "row", "n_shingles", "bands", "parity"))
    reps = own.where(linked).groupBy("print").agg(first.alias("x"))
    reps = C.checkpointed(reps.select("print", "x.doc_id", F.col("x.row").alias("rep"), F.col("x.n_shingles").alias("size"), "x.bands", "x.parity"))
    labels = _components(docs, reps, k, percent, bands)
    nodes = reps.select("print", "doc_id", "rep")
    if labels is not None:
        nodes = nodes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        least = nodes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        nodes = nodes.join(least, "comp").select("print", "component_id")
    else:
        nodes = nodes.select("print", F.col("doc_id").alias("component_id"))
    some = own.where(linked).select("doc_id", "n_shingles", "print").join(nodes, "print").select("doc_id", "n_shingles", "component_id")
    none = own.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)


#: The same in DuckDB, by comparing all pairs that share a shingle.
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(4, len(w)) - 1], ' ') || CASE WHEN len(w) < 4 THEN ' short' ELSE '' END) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
