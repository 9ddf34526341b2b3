"""Connected components of a graph that only the cluster holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainflow.llm.common import remove, written


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: long) but the roots; root is the smallest node of the component.

    Large-star and small-star steps alternate until nothing changes: every node's larger neighbours are linked to
    the least neighbour, then its smaller ones. Each round is written to ``folder`` and the one before removed.
    """
    spark, k, last = edges.sparkSession, 0, None
    current = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), f"{folder}/round0")
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        k += 1
        new = written(small.filter("a != b").distinct(), f"{folder}/round{k}")
        remove(spark, f"{folder}/round{k - 1}")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        current, last = new, now
