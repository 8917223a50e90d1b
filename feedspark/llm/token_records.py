"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A record is: payload length (unsigned 64-bit), masked CRC-32 of those eight bytes, payload, masked CRC-32 of the
payload, all little-endian. The mask turns a checksum by 15 bits and adds a constant, so that checksums of data that
holds checksums stay sound. A payload is doc_id (signed 64-bit), a byte with the width of an id (2 or 4; plus 128
if the document has no id), and the ids. The index is a Parquet table with each record's part, offset, length,
number of ids and ids before it in its part; shuffled reads go through it.

Scale: texts are encoded where they are scanned, and only narrow ids are shuffled, once, to ranges of doc_id that quantiles of
the id column set; rows without an id or with one repeated id fill several ranges if they are many. Each task writes one part
file and its index rows as a stream. Starts need only the sums of ids by part. Reading opens parts by index rows, in order or in any other.

Defined results: a null or empty text is the end id alone; rows without an id come first; repeated rows are records of
their own, ordered by content; an empty table gives an empty index; extra columns are ignored; a very long text is one record.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedspark.llm import common as C
from feedspark.llm.files import Ranges, written
from feedspark.llm.tokens import encoder

INDEX = "part int, record int, doc_id long, offset long, length long, n_tokens long, before long"
MASK = 0xA282EAD8
_HEAD, _CRC, _META = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qB")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = _HEAD.pack(len(payload))
    return b"".join((head, _CRC.pack(masked(head)), payload, _CRC.pack(masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one record; raises ValueError if lengths or checksums don't agree."""
    if len(data) < 16 or masked(data[:8]) != _CRC.unpack_from(data, 8)[0]:
        raise ValueError("a record's length is damaged")
    (n,) = _HEAD.unpack_from(data)
    if len(data) != n + 16 or masked(data[12 : 12 + n]) != _CRC.unpack_from(data, 12 + n)[0]:
        raise ValueError("a record's payload is damaged")
    return data[12 : 12 + n]


def pack_ids(doc_id: int | None, ids: bytes) -> bytes:
    """ids: little-endian unsigned 32-bit; narrowed to 16 bits if all fit."""
    own = np.frombuffer(ids, "<u4")
    wide = bool(len(own)) and int(own.max()) > 0xFFFF
    return _META.pack(doc_id or 0, (4 if wide else 2) + 128 * (doc_id is None)) + (ids if wide else own.astype("<u2").tobytes())


def unpack_ids(payload: bytes) -> tuple[int | None, bytes]:
    doc_id, kind = _META.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{kind & 127}", offset=_META.size)
    return None if kind & 128 else doc_id, ids.astype("<u4").tobytes()


def _part(folder: str, n: int) -> str:
    return f"{folder}/part-{n:06d}.rec"


def _encode(path: str, end_id: int, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = encoder(path), Counter()
        for part, data, offs in C.chunks(batches, "text"):
            ids, at = coder.encode(data, offs)
            raw, docs = np.insert(ids, at[1:], np.uint32(end_id)).tobytes(), part.column("doc_id")
            ends = (4 * (at + np.arange(len(at)))).tolist()
            payloads = [pack_ids(doc, raw[a:b]) for doc, a, b in zip(docs.to_pylist(), ends[:-1], ends[1:], strict=True)]
            keys = docs.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
            for i in np.flatnonzero(high > low).tolist():  # such an id fills ranges of its own; equal rows take turns
                mark = zlib.crc32(payloads[i])
                low[i] += (mark + seen[mark]) % (high[i] - low[i] + 1)
                seen[mark] += 1
            yield pa.RecordBatch.from_arrays([docs, pa.array(np.diff(at) + 1, pa.int64()), pa.array(payloads, pa.binary()), pa.array(low, pa.int32())], ["doc_id", "n_tokens", "payload", "part"])

    return run


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        record = offset = before = 0
        with written(_part(folder, part)) as out:
            for b in batches:
                rows = []
                for doc, n, payload in zip(b.column("doc_id").to_pylist(), b.column("n_tokens").to_pylist(), b.column("payload"), strict=True):
                    data = frame(payload.as_py())
                    out.write(data)
                    rows.append((part, record, doc, offset, len(data), n, before))
                    record, offset, before = record + 1, offset + len(data), before + n
                if rows:
                    kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 5)
                    names = [x.split()[0] for x in INDEX.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def write_records(docs: DataFrame, folder: str, path: str, end_id: int = 1) -> None:
    """Write part files in ascending doc_id order to folder, and the index to folder/index."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_ = F.coalesce("doc_id", F.lit(int(np.iinfo(np.int64).min)))
    cuts = own.agg(F.percentile_approx(id_, [i / parts for i in range(1, parts)], max(10_000, 20 * parts)).alias("cuts")).first()["cuts"] if parts > 1 else None
    encoded = C.mapped(own, _encode(path, end_id, np.array(cuts or [], np.int64)), "doc_id long, n_tokens long, payload binary, part int")
    ordered = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", "payload").drop("part")
    C.mapped(ordered, _write(folder), INDEX).write.parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with `start`, the ids of all records before each one. Only sums by part meet in one place."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    over = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = C.few(C.checkpointed(sums.select("part", (F.sum("n").over(over) - F.col("n")).alias("base"))))
    return index.join(bases, "part").withColumn("start", F.col("base") + F.col("before"))


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                few = b.slice(at, 512)
                rows = [unpack_ids(unframe(files.read(_part(folder, p), o, n))) for p, o, n in zip(*(few.column(c).to_pylist() for c in ("part", "offset", "length")), strict=True)]
                docs, ids = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), few.column("start"), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])
        files.close()

    return run


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, ids of the index's records, in the index's order; every checksum is verified."""
    return C.mapped(index.select("part", "offset", "length", "start"), _read(folder), "doc_id long, start long, ids binary")


def read_shuffled(index: DataFrame, folder: str, seed: int = 0) -> DataFrame:
    """The records in an order that depends on the seed alone: only index rows are shuffled."""
    mixed = index.withColumn("o", F.xxhash64(F.lit(seed), "part", "record")).repartitionByRange("o").sortWithinPartitions("o").drop("o")
    return read_records(mixed, folder)


def op8_token_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = C.shared_folder(spark, "tokens")
    write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    read = read_records(read_index(spark, folder), folder)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
