"""Best-fit packing of token sequences by sums of squares.

A piece goes into the open bin, or a new one, for which the sum over residual gaps of the squared number of open
bins with that gap becomes smallest. Placing looks only at counts by gap, so it takes a numpy step of
`capacity` entries a piece. Pieces are placed in batches of `batch` in order of falling length.

Scale: every task packs the rows of its own partition in one pass and without shuffle; a task holds one batch of
pieces and the numbers of its open bins. Bins aren't shared between partitions, so the loss is at most the
few bins that a partition leaves open; partitions of a table of any size are of a fixed size, so the share of this loss
doesn't grow (README has it in figures). Numbers of
sequences are the partition's number and a count, so a task that runs again gives equal numbers for
equal input. Documents with hot sources, many copies or great length need no special case: a longer one is
cut into full pieces, and they make sequences of their own.

Defined results: a null or empty text is the end id alone; repeated rows are packed each on its own; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm import common as C
from feedspark.llm.tokens import encoder

CAPACITY = 1024
SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class SumOfSquares:
    """Open bins by residual gap."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.count = np.zeros(capacity + 1, np.int64)
        self.bins: dict[int, list[int]] = defaultdict(list)

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to capacity units."""
        cap, n = self.capacity, self.count
        gap = cap
        if length < cap:
            # the sum's change for each gap: one bin less there, one more at what remains (none at 0)
            change = 1 - 2 * n[length:cap] + np.where(np.arange(length, cap) == length, 0, 1 + 2 * n[: cap - length])
            change[n[length:cap] == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            if change[best] <= 1 + 2 * n[cap - length]:
                gap = best + length
        if gap == cap:
            where, self.next = self.next, self.next + 1
        else:
            where = self.bins[gap].pop()
            n[gap] -= 1
        if gap > length:
            n[gap - length] += 1
            self.bins[gap - length].append(where)
        return where, cap - gap


def _pieces(total: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length): full pieces; of a longer document the first may be shorter."""
    first = total % capacity or min(total, capacity)
    start, length = 0, first
    while start < total:
        yield start, length
        start, length = start + length, capacity


def _packed(path: str, end_id: int, capacity: int, batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        packer = SumOfSquares(capacity, TaskContext.get().partitionId() << 40)
        held: list[tuple] = []

        def placed() -> pa.RecordBatch:
            rows = sorted(held, key=lambda r: -r[3])  # stable: equal lengths stay in order of reading
            held.clear()
            spots = [packer.place(r[3]) for r in rows]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            columns = [*zip(*rows, strict=True), *zip(*spots, strict=True)]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for part, data, offs in C.chunks(batches, "text"):
            ids, at = coder.encode(data, offs)
            raw = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4", copy=False).tobytes()
            for k, doc in enumerate(part.column("doc_id").to_pylist()):
                base = int(at[k]) + k
                for n, (start, length) in enumerate(_pieces(int(at[k + 1] - at[k]) + 1, capacity)):
                    held.append((doc, n, start, length, raw[4 * (base + start) : 4 * (base + start + length)]))
                    if len(held) >= batch:
                        yield placed()
        if held:
            yield placed()

    return run


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, batch: int = 4096) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.

    path: a tokenizer file; end_id: appended to every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return C.mapped(own, _packed(path, end_id, capacity, batch), SCHEMA)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")))
