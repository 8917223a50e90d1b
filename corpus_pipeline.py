"""A training corpus in five stages, each written as Parquet and read as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.llm import decontam, near_dup, packing, quality, toxicity
from feedspark.llm.common import checkpointed, few, shared_folder

#: Column of the rows' numbers within the near-duplicate stage.
ROW = "_row"
#: A document's columns as one, carried through an operator, so that what it decides about a row is applied to this row alone.
OWN = "_own"


def _carried(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias(OWN))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned rules reject. Null and empty texts are rejected by the base rule; rows
    are judged one by one, so repeated rows go or stay together, with or without an id; an empty table stays empty."""
    judged = quality.judge(_carried(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=[OWN])
    return judged.where("kept").select(f"{OWN}.*")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold. Rows are scored one by one, with or without an id; null and empty texts
    get the score of no neighbour; an empty table stays empty."""
    scored = toxicity.score_documents(_carried(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=[OWN])
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(f"{OWN}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (one without an id only where none has one),
    and one of repeated rows. Texts without words, null or empty, are alike only if they repeat a row; an empty table stays
    empty."""
    keyed = checkpointed(docs.withColumn(ROW, F.monotonically_increasing_id()))
    own = keyed.select(ROW, F.col("doc_id").alias("id"), F.md5("text").alias("mark"))
    dup = near_dup.near_duplicates(keyed.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id", (F.col("n_shingles") == 0).alias("blank"))
    rows = checkpointed(dup.join(own, ROW))
    group = [F.when(~F.col("blank"), F.col("component_id")).alias("of"), F.when(F.col("blank"), F.col("id")).alias("blank_id"), F.when(F.col("blank"), F.col("mark")).alias("blank_mark"), "blank"]
    kept = rows.groupBy(*group).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", ROW)).alias("x")).select(f"x.{ROW}")
    gone = checkpointed(rows.join(kept, ROW, "left_anti").select(ROW))
    return keyed.join(few(gone), ROW, "left_anti").drop(ROW)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark windows. Rows are decided one by one, with or
    without an id; null and empty texts have no words and stay; an empty table stays empty."""
    found = decontam.phrase_matches(_carried(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=[OWN])
    return decontam.hit_report(found).where("not contaminated").select(f"{OWN}.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens. A null or empty text is the end id alone; repeated rows are packed each on
    its own; an empty table gives an empty result."""
    import public_tokenizers

    return packing.digest(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the learned rules nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = shared_folder(spark, f"stage{i + 1}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
