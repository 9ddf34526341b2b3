"""Exact deduplication by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of bytes. A name is the pair of integers
``(bucket, rank)``: the bucket is the 64-bit hash of the content, the rank is the content's place in the sorted
list of the different contents of that bucket. Contents are compared themselves, so equal names mean equal contents.
Then adjacent pairs of names are named in the same way, again and again, until each document has one name.

Whole contents are shuffled once for each level, after a map-side distinct, so a block that a third of
all documents share is a few rows when it reaches the shuffle. References to blocks carry the bucket only: they need
the content again just in the buckets that hold several contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from grainflow.llm.common import ascii_lower, repeated, text_or_empty, with_totals, workspace, written


def name_contents(refs: DataFrame, content: list[str], hashed=F.xxhash64) -> DataFrame:
    """Adds ``bucket`` and ``rank`` to ``refs`` and drops the content columns.

    ``hashed`` maps columns to a long. The result doesn't depend on it but for the bucket's number: contents that
    meet in a bucket get different ranks, in sorted order.
    """
    refs = refs.withColumn("bucket", hashed(*content))
    different = refs.select("bucket", *content).distinct()
    crowded = different.groupBy("bucket").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("bucket")
    if crowded.isEmpty():
        return refs.drop(*content).withColumn("rank", F.lit(1))
    ranks = different.join(crowded, "bucket", "left_semi").select(
        F.col("bucket").alias("r_bucket"),
        *(F.col(c).alias(f"r_{c}") for c in content),
        F.row_number().over(Window.partitionBy("bucket").orderBy(*content)).alias("r_rank"),
    )
    same = F.col("bucket") == F.col("r_bucket")
    for c in content:
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return refs.join(ranks, same, "left").withColumn("rank", F.coalesce("r_rank", F.lit(1))).drop("r_bucket", "r_rank", *(f"r_{c}" for c in content), *content)


def exact_dedup(docs: DataFrame, block_bytes: int = 8192, hashed=F.xxhash64) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. The largest doc_id of
    equal texts stays; of repeated rows with that doc_id exactly one does. A null doc_id stays only if its group has no other.
    Other columns are ignored. An empty table gives no rows.
    """
    folder = workspace(docs.sparkSession, "exact_dedup")
    text = ascii_lower(text_or_empty())
    rows = docs.select("doc_id", F.sha2(text, 256).alias("sha"), text.cast("binary").alias("bytes"))
    blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / F.lit(block_bytes)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    refs = rows.select("doc_id", "sha", blocks.alias("blocks"), F.posexplode(cut).alias("at", "block"))
    keys = ["doc_id", "sha", "blocks"]
    named = name_contents(refs, ["block"], hashed)
    # Rows that repeat doc_id and text meet in one key; the count of their first blocks says how many there are.
    level = written(_gathered(named, [*keys], F.count_if(F.col("at") == 0)), f"{folder}/level0")
    most = level.agg(F.max("blocks")).first()[0] or 1
    done, depth = level.filter(F.size("names") == 1), 0
    while 2**depth < most:
        depth += 1
        pairs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("names") / F.lit(2)).cast("int") - 1), lambda i: F.struct(F.get("names", i * 2).alias("left"), F.get("names", i * 2 + 1).alias("right")))
        refs = level.filter(F.size("names") > 1).select(*keys, "copies", F.posexplode(pairs).alias("at", "pair"))
        refs = refs.select(*keys, "copies", "at", "pair.left", "pair.right")
        level = written(_gathered(name_contents(refs, ["left", "right"], hashed), keys, F.max("copies")), f"{folder}/level{depth}")
        done = done.unionByName(level.filter(F.size("names") == 1))
    identity = ["blocks", "name.bucket", "name.rank"]
    named_docs = done.select("doc_id", "sha", "copies", "blocks", F.get("names", F.lit(0)).alias("name")).select("doc_id", "sha", "copies", *identity)
    partial = [F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")]
    whole = [F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")]
    out = repeated(with_totals(named_docs, ["blocks", "bucket", "rank"], ["doc_id"], partial, whole), "copies", "copy")
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _gathered(named: DataFrame, keys: list[str], copies: Column) -> DataFrame:
    """The names of each document in order. The list is bounded by the document's own text."""
    ordered = F.array_sort(F.collect_set(F.struct("at", F.struct("bucket", "rank").alias("name"))))
    return named.groupBy(*keys).agg(copies.alias("copies"), ordered.alias("names")).withColumn("names", F.col("names.name"))
