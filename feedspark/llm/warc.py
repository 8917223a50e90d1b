"""WARC files and a Merkle fixity audit of their replicas.

Pages are written as compressed WARC resource records, one file a partition, with an index of ordered offset ranges.
The audit hashes every record's stored bytes with its range into the leaves of a tree for each file, joins `fanout`
neighbours level by level, and joins the files' roots to one root of the collection. Two replicas with equal roots are
equal; else only the children of mismatching nodes are compared, level by level, down to the damaged ranges. A file's last leaf
is its length, and the collection's root covers the list of files, so that bytes behind the last record and files that
no record names are found as well (`surplus`).

Scale: bytes are read once, where the tasks are; what is shuffled are 32-byte hashes, a sixteenth as many on each
level. A damaged file costs its path of nodes, not a comparison of all records.

Defined results: a null html is an empty block, a null url an empty target; a missing or shorter file has damaged ranges;
repeated rows are records of their own; a very long page is one record; an empty table has no record and a root of its file
list alone; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.llm import common as C
from feedspark.llm.files import Ranges, written

INDEX = "part int, record long, page_id long, offset long, length long"
FANOUT = 16


def _file(folder: str, part: int) -> str:
    return f"{folder}/part-{part:06d}.warc.gz"


def record(page_id: int | None, url: str, html: bytes, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 resource record as a gzip member; equal input gives equal bytes."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
    head = (
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\n"
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\nWARC-Block-Digest: sha256:{hashlib.sha256(html).hexdigest()}\r\n"
        f"Content-Type: text/html\r\nContent-Length: {len(html)}\r\n\r\n"
    )
    return gzip.compress(head.encode() + html + b"\r\n\r\n", 6, mtime=0)


def parse(stored: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = gzip.decompress(stored).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, offset = TaskContext.get().partitionId(), 0, 0
        with written(_file(folder, part)) as out:
            for b in batches:
                rows = []
                for page, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html"), strict=True):
                    data = record(page, url or "", (html.as_py() or "").encode())
                    out.write(data)
                    rows.append((part, n, page, offset, len(data)))
                    n, offset = n + 1, offset + len(data)
                if rows:
                    kinds = (pa.int32(), *[pa.int64()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])

    return run


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write the files and folder/index; return the index."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    C.mapped(own, _write(folder), INDEX).write.parquet(f"{folder}/index")
    return read_index(pages.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _copy(source: str, target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, at, part = Ranges(), None, None, None
        for b in batches:
            for p, o, n, bad in zip(*(b.column(c).to_pylist() for c in ("part", "offset", "length", "bad")), strict=True):
                if p != part:
                    if out:
                        at.__exit__(None, None, None)
                    at = written(_file(target, p))
                    out, part = at.__enter__(), p
                data = bytearray(files.read(_file(source, p), o, n))
                if bad and data:
                    data[len(data) // 2] ^= 0x55
                out.write(bytes(data))
        if out:
            at.__exit__(None, None, None)
        files.close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], ["part"])

    return run


def copy_files(index: DataFrame, source: str, target: str, damaged: Column | None = None) -> None:
    """Copy a collection record by record; where `damaged` holds, one byte of the record is changed (for drills)."""
    bad = F.coalesce(damaged, F.lit(False)) if damaged is not None else F.lit(False)
    rows = index.select("part", "record", "offset", "length", bad.alias("bad")).repartition("part").sortWithinPartitions("part", "record")
    C.mapped(rows, _copy(source, target), "part int").write.format("noop").mode("overwrite").save()


def _hashed(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges()
        for b in batches:
            hashes = []
            for p, o, n in zip(*(b.column(c).to_pylist() for c in ("part", "offset", "length")), strict=True):
                data = files.read(_file(folder, p), o, n)
                hashes.append(hashlib.sha256(b"\0" + o.to_bytes(8, "big") + n.to_bytes(8, "big") + data).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("record"), pa.array(hashes, pa.string())], ["part", "node", "hash"])
        files.close()

    return run


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """file, size of what lies in a collection's folder; contents aren't read."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], kind)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"))


def _ends(index: DataFrame) -> DataFrame:
    """part, file, record (one behind the last), end of every file."""
    name = F.format_string("part-%06d.warc.gz", "part").alias("file")
    return index.groupBy("part").agg((F.max("record") + 1).alias("record"), F.max(F.col("offset") + F.col("length")).alias("end")).select("part", name, "record", "end")


def surplus(index: DataFrame, folder: str) -> DataFrame:
    """file, offset, length of the bytes that no record of the index names: behind a file's last record, or a whole file."""
    both = files_of(index.sparkSession, folder).join(_ends(index), "file", "left")
    return both.select("file", F.coalesce("end", F.lit(0)).alias("offset"), (F.col("size") - F.coalesce("end", F.lit(0))).alias("length")).where("length > 0")


def merkle_tree(index: DataFrame, folder: str, fanout: int = FANOUT) -> DataFrame:
    """part, level (0: records, and behind them the file's length), node, hash: all nodes of every file's tree, as a stored table."""
    records = C.mapped(index.select("part", "record", "offset", "length"), _hashed(folder), "part int, node long, hash string")
    size = F.coalesce(F.col("size").cast("string"), F.lit("none"))
    ends = _ends(index).join(files_of(index.sparkSession, folder), "file", "left").select("part", F.col("record").alias("node"), F.sha2(F.concat(F.lit("3"), size), 256).alias("hash"))
    leaves = C.checkpointed(records.unionByName(ends))
    most = leaves.agg(F.max("node")).first()[0]
    levels, now, n, level = [leaves.withColumn("level", F.lit(0))], leaves, (most or 0) + 1, 0
    while n > 1:
        level, n = level + 1, -(-n // fanout)
        inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"]), "")
        now = C.checkpointed(now.groupBy("part", F.expr(f"node div {fanout}").alias("up")).agg(F.sha2(F.concat(F.lit("1"), inside), 256).alias("hash")).withColumnRenamed("up", "node"))
        levels.append(now.withColumn("level", F.lit(level)))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("part", "level", "node", "hash")


def root(tree: DataFrame, folder: str) -> tuple:
    """The collection's root: files' roots joined in groups, as many levels as it takes, and a digest of the list of files."""
    top = tree.agg(F.max("level")).first()[0]
    now = tree.where(F.col("level") == top).select(F.col("part").cast("long").alias("node"), "hash") if top is not None else None
    while now is not None and now.count() > 1:
        inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"]), "")
        now = C.checkpointed(now.groupBy(F.expr(f"node div {FANOUT}").alias("up")).agg(F.sha2(F.concat(F.lit("2"), inside), 256).alias("hash")).withColumnRenamed("up", "node"))
    found = now.collect() if now is not None else []
    names = files_of(tree.sparkSession, folder).agg(F.count("*"), F.bit_xor(F.xxhash64("file"))).first()
    return (found[0]["hash"] if found else None, *names)


def damaged_records(one: DataFrame, other: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """part, record of the leaves that differ, found by descending only into mismatching nodes."""
    top = one.agg(F.max("level")).first()[0]
    pick = lambda tree, level: tree.where(F.col("level") == level).select("part", "node", "hash")
    odd = None
    for level in range(top if top is not None else 0, -1, -1):
        x = pick(one, level)
        if odd is not None:
            x = x.withColumn("up", F.expr(f"node div {fanout}")).join(odd.select("part", F.col("node").alias("up")), ["part", "up"], "left_semi").select("part", "node", "hash")
        y = pick(other, level).withColumnRenamed("hash", "theirs")
        odd = x.join(y, ["part", "node"], "left").where(~F.col("hash").eqNullSafe(F.col("theirs"))).select("part", "node")
        odd = C.checkpointed(odd)
        if odd.isEmpty():
            break
    return odd.withColumnRenamed("node", "record")


def audit(index: DataFrame, folder: str, replica: str, fanout: int = FANOUT) -> DataFrame:
    """The index with status: ok, or damaged where the replica's bytes differ from the folder's. `surplus` names what else the
    replica holds."""
    one, other = merkle_tree(index, folder, fanout), merkle_tree(index, replica, fanout)
    if root(one, folder) == root(other, replica):
        return index.withColumn("status", F.lit("ok"))
    bad = damaged_records(one, other, fanout).withColumn("bad", F.lit(True))
    return index.join(C.few(bad), ["part", "record"], "left").withColumn("status", F.when(F.col("bad"), "damaged").otherwise("ok")).drop("bad")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                few = b.slice(at, 64)
                found = [parse(files.read(_file(folder, p), o, n)) for p, o, n in zip(*(few.column(c).to_pylist() for c in ("part", "offset", "length")), strict=True)]
                yield pa.RecordBatch.from_arrays([few.column("page_id"), few.column("status"), pa.array([f["warc-target-uri"] for f, _ in found], pa.string()), pa.array([x for _, x in found], pa.binary())], ["page_id", "status", "url", "block"])
        files.close()

    return run


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """page_id, status, url, block of the index's records."""
    return C.mapped(index.select("page_id", "status", "part", "offset", "length"), _read(folder), "page_id long, status string, url string, block binary")


def op10_warc_audit(spark, sf_dir: str) -> DataFrame:
    """Writes all pages and a replica with every 97th page damaged, audits the replica, and reads the good copy."""
    folder, replica = C.shared_folder(spark, "warc"), C.shared_folder(spark, "warc")
    index = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    copy_files(index, folder, replica, F.col("page_id") % 97 == 13)
    read = read_warc(audit(index, folder, replica), folder)
    return read.select("page_id", "url", F.octet_length("block").cast("long").alias("n_bytes"), F.sha2("block", 256).alias("block_sha256"), "status")


OP10_SQL = """
SELECT page_id, coalesce(url, '') AS url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n_bytes, sha256(coalesce(html, '')) AS block_sha256,
       CASE WHEN page_id % 97 = 13 THEN 'damaged' ELSE 'ok' END AS status
FROM pages
"""
