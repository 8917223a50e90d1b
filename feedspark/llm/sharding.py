"""Proportional stratified interleaving: shards that each hold the corpus' mixture of sources.

Rows of a source are ranked in seeded hash order; rank r of n becomes the fraction (2 r - 1) / (2 n). Sorted by that
fraction, the sources interleave in proportion, and cutting the order in equal runs gives shards whose
sources differ from the mixture by at most one row or so each.

Scale: no window spans a source or the table. A source's rows fall in buckets by the leading digits of their hash;
counts per bucket give each bucket's first rank, and rows are numbered inside a bucket. Fractions are spread evenly
over 0 to 1, so the same is done again for the whole order. A bucket has about `per_bucket` rows at any size, also
in a source that holds a third of the table; only counts per bucket (a few thousand rows a source and billion)
meet in one place. Texts never leave the scan, only their size and checksum.

Defined results: a null text has size 16 and checksum 0, as an empty one; a null source is a source of its own;
the hash is of the id, size and checksum, so rows that share an id spread by their texts; its ties go by doc_id, then size and
checksum; repeated rows take a slot each; a very long text is one row; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS = 40


def _first_of_bucket(rows: DataFrame, group: str | None, bucket: str) -> DataFrame:
    """Rows before each bucket (of a group) and rows in all of the group."""
    keys = [group, bucket] if group else [bucket]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    over = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    before = F.sum("n").over(over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return counts.select(*keys, before.alias("before"), F.sum("n").over(over).alias("all"))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = 42, per_bucket: int = 10_000) -> DataFrame:
    """doc_id, source, size, text_crc32, fraction, shard, slot: one row per document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("stratum"),
        F.col("doc_id").cast("string").alias("id"),
    )
    mark = F.concat_ws(":", F.lit(str(seed)), F.coalesce("id", F.lit("")), F.col("size"), F.col("text_crc32"))
    rows = rows.withColumn("h", F.md5(mark)).drop("id")
    total = docs.count()
    buckets = max(1, -(-total // per_bucket))
    part = lambda x: F.floor(x * buckets).cast("long")
    rows = rows.withColumn("bucket", part(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))))
    first = _first_of_bucket(rows, "stratum", "bucket")
    inside = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "size", "text_crc32"))
    ranked = rows.withColumn("inside", inside).join(first, ["stratum", "bucket"])
    fraction = (2 * (F.col("before") + F.col("inside")) - 1).cast("double") / (2 * F.col("all")).cast("double")
    spread = ranked.select("doc_id", "source", "size", "text_crc32", "stratum", "h", fraction.alias("fraction"))
    spread = spread.withColumn("at", F.least(part(F.col("fraction")), F.lit(buckets - 1)))
    starts = _first_of_bucket(spread, None, "at").select("at", "before")
    place = F.row_number().over(Window.partitionBy("at").orderBy("fraction", "stratum", "h", "doc_id", "size", "text_crc32"))
    placed = spread.withColumn("inside", place).join(starts, "at").withColumn("position", F.col("before") + F.col("inside") - 1)
    shard = F.expr(f"cast((position * {shards}) div {max(total, 1)} as int)")
    opens = F.expr(f"((cast({shards} as bigint) - 1) + shard * cast({total} as bigint)) div {shards}")
    return placed.withColumn("shard", shard).select("doc_id", "source", "size", "text_crc32", "fraction", "shard", (F.col("position") - opens).alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    out = interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same in DuckDB, with the checksum computed from its rule.
OP2_SQL = """
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
hexed AS (SELECT *, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
bytes AS (SELECT * EXCLUDE (h), list_transform(range(1, len(h), 2), lambda i: CAST((strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1 AS BIGINT)) AS b FROM hexed),
summed AS (SELECT * EXCLUDE (b), xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS crc, len(b) + 16 AS size FROM bytes, tab),
ranked AS (SELECT *, coalesce('s' || source, 'n') AS stratum, md5('42:' || CAST(doc_id AS VARCHAR) || ':' || CAST(size AS VARCHAR) || ':' || CAST(crc AS VARCHAR)) AS h, count(*) OVER () AS total FROM summed),
r AS (SELECT *, CAST(2 * row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, size, crc) - 1 AS DOUBLE) / CAST(2 * count(*) OVER (PARTITION BY stratum) AS DOUBLE) AS f FROM ranked),
p AS (SELECT *, row_number() OVER (ORDER BY f, stratum, h, doc_id, size, crc) - 1 AS pos FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(pos * 40 // total AS INTEGER) AS shard, pos - (39 + (pos * 40 // total) * total) // 40 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""
