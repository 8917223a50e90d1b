"""Helpers that several training-data operators share: word and shingle hashes over Arrow buffers, the
train/held-out rule, and the shared folder.

Texts are read as UTF-8 bytes straight from Arrow buffers and handled in chunks of a few MB, so that a task
needs bounded memory whatever the table's size; only one text of more than a chunk is held whole.
"""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 18
#: Bytes that part words: blank, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: What a broadcast may hold.
BROADCAST_BYTES = 4 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Applications that have the package, and their own folders where spark.checkpoint.dir is unset.
_SHIPPED: set[str] = set()
_OWN: dict[str, str | None] = {}


def ready(spark: SparkSession) -> None:
    """Send this package to the session's executors, once an application, and bound the Arrow batches that pass between the JVM
    and Python workers (two session settings) to 1,000 rows and 4 MB, so that a worker's memory doesn't depend on the rows."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        name = os.path.join(tempfile.mkdtemp(prefix="spark-"), "feedspark")
        context.addPyFile(shutil.make_archive(name, "zip", root, "feedspark"))
    for key, most in (("maxRecordsPerBatch", 1_000), ("maxBytesPerBatch", 4 << 20)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def release() -> None:
    """What this process's memory pools hold unused goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _released(run):
    """run, with a release at a task's end."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return own


def mapped(df: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow for a session that is made ready for it."""
    ready(df.sparkSession)
    return df.mapInArrow(_released(run), schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, one on this machine, which only a local master allows."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault(context.applicationId, None) or tempfile.mkdtemp(prefix="spark-")
        _OWN[context.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder. Unlike an RDD checkpoint it keeps sizes for the
    planner and is read by column."""
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if its rows are measured to hold at most so many bytes, else left to a shuffled join. df: a stored
    table of plain columns."""
    wide = [F.octet_length(c) if kind in ("string", "binary") else F.lit(0) for c, kind in df.dtypes]
    held = df.agg(F.sum(sum((F.coalesce(x, F.lit(0)) for x in wide), F.lit(0)) + 8 * len(wide))).first()[0]
    return F.broadcast(df) if (held or 0) <= most else df


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of x."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x7FB5D329728EA185)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    own: list[np.ndarray] = []
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for i, p in enumerate((_P, _P_INV)):
                step = np.full(max(n, CHUNK_BYTES), p, np.uint64)
                step[0] = 1
                step = np.multiply.accumulate(step)
                if n > 4 * CHUNK_BYTES:  # a very long text: nothing is kept of it
                    own.append(step)
                else:
                    _POWERS[i] = step
    return (own or _POWERS)[0][:n], (own or _POWERS)[1][:n]


def byte_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row; a null row is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if arr.null_count:
        arr = arr.fill_null("")
    _, offsets, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind, len(arr) + 1, arr.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[tuple]:
    """(rows, bytes, offsets) of at most about `most` bytes of text each; a longer text comes alone."""
    for batch in batches:
        data, offs = byte_view(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of spans of bytes, whatever their place; fold: A-Z count as a-z."""
    n = len(data)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER if fold else _BYTE)[data] * up, out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


class Pieces:
    """Runs of bytes (words or lines) of a chunk: start, end, document number, 64-bit hash."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, part: np.ndarray, fold: bool):
        n = len(data)
        inside = ~part[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.ones(n, bool)
        before[1:] = ~inside[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~inside[1:]
        self.start = np.flatnonzero(inside & (before | edge[:n]))
        self.end = np.flatnonzero(inside & (after | edge[1:])) + 1
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        self.inside = inside
        self.hash = spans_hash(data, self.start, self.end, fold)

    def first_of_doc(self, docs: int) -> np.ndarray:
        """Where each document's pieces begin; one entry more than documents."""
        return np.searchsorted(self.doc, np.arange(docs + 1))


def words(data: np.ndarray, offs: np.ndarray, fold: bool) -> Pieces:
    """Words [^\\x20\\x09-\\x0D]+ of every document of a chunk; fold: hashes take A-Z as a-z."""
    return Pieces(data, offs, _SPACE, fold)


_LINE = np.zeros(256, bool)
_LINE[0x0A] = True


def lines(data: np.ndarray, offs: np.ndarray) -> Pieces:
    """Non-empty lines of every document of a chunk."""
    return Pieces(data, offs, _LINE, False)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive pieces; documents' borders are the caller's."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out += hashes[i : i + n] * np.uint64(2 * pow(3, 2 * i + 1, 1 << 61) + 1)
    return mix(out)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each document, A-Z taken as a-z; with fewer than k
    words the whole sequence is one shingle, and with none the set is empty."""
    w = words(data, offs, True)
    at = w.first_of_doc(len(offs) - 1)
    grams = windows(w.hash, k)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(mix(windows(w.hash[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of a byte-wise array over each document."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def group_sizes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element how many elements share its key, and whether it comes first among them."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(keys)))
    sizes, first = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    sizes[order] = np.repeat(size, size)
    first[order] = new
    return sizes, first
