"""Connected components of a table of links, by smallest-label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, comp: the smallest node that is reachable. Each round takes the smallest label
    of the neighbours and then the label of that label, so rounds grow with the logarithm of a chain's
    length. Minima are combined before the shuffle, and every round is checkpointed."""
    edges = checkpointed(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("node", "other"))
    labels = checkpointed(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")))
    while True:
        spread = edges.join(labels.select(F.col("node").alias("other"), "comp"), "other").select("node", "comp", F.lit(None).cast("long").alias("old"))
        low = spread.unionByName(labels.withColumn("old", F.col("comp"))).groupBy("node").agg(F.min("comp").alias("low"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("next"))
        step = checkpointed(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("next", "low")).alias("comp"), "old"))
        labels = step.select("node", "comp")
        if step.where("comp <> old").isEmpty():
            return labels
