"""Near-duplicate documents by SimHash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainflow.llm.common import one_of_each, text_or_empty, unused, workspace, written
from grainflow.llm.components import components
from grainflow.llm.set_links import cloud_members, if_few, sets_of, similar_groups
from grainflow.llm.simhash_fingerprint import fingerprints, hex16, sketches
from grainflow.llm.trie_join import near_edges

#: Parts that the rows of one fingerprint are dealt out to.
PARTS = 256
#: Bits in which fingerprints of texts that are alike to 0.8 differ at most, all but one in a thousand of them; and the budgets tried before.
SIMILAR_BITS, STEPS = 18, (3, 6, 9, 12, 15)


def simhash_components(docs: DataFrame, budget: int = 4, most: int = 50_000) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id, component_size.

    Fingerprints are linked at ``budget`` or fewer different bits; component_id is the smallest doc_id that links
    reach (null if all are null). Texts without words, null ones too, have fingerprint 0 and are linked like any
    other. Repeated rows count one by one. Other columns are ignored, an empty table gives no rows.
    """
    folder = workspace(docs.sparkSession, "simhash")
    marked = written(fingerprints(docs).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), f"{folder}/fingerprints")
    parts = marked.groupBy("fp", "part").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    different = parts.groupBy("fp").agg(F.min("least").alias("least"), F.sum("copies").alias("copies"), F.collect_set("part").alias("parts"))
    different = written(different, f"{folder}/different")
    stars = components(near_edges(different.select("fp", F.col("fp").alias("node")), budget, most), folder)
    rooted = different.join(stars, different.fp == stars.node, "left").select("fp", "least", "copies", "parts", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("component_size"))
    # A row for each part of a fingerprint's rows, so that no task joins all rows of one.
    named = rooted.join(whole, "root").select("fp", F.explode("parts").alias("part"), "component_id", "component_size")
    return marked.join(named, ["fp", "part"]).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id", "component_size")


def near_distinct(docs: DataFrame, over: int = 4, under: int = 5, budget: int = SIMILAR_BITS, most: int = 50_000) -> DataFrame:
    """The rows of docs (doc_id, text and any other columns) of which each group of near copies keeps one.

    Texts are linked if the intersection of their sets of five-word shingles (words in lower case; a shorter text is one shingle) is ``over / under`` of the union or more;
    a group is what links reach. Texts with the same words are one group, those without words too. Fingerprints of a block meet in a trie within ``budget`` bits; what they
    join is a cloud, in which the whole sets of shingles decide.
    The row with the smallest doc_id stays, null ids last, of equal ids that with the least hash of the text, of equal texts that with the least
    hash of all its columns. An empty table gives no rows.
    """
    folder = workspace(docs.sparkSession, "near_distinct")
    marked = written(sketches(docs), f"{folder}/sketches")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("tie").alias("tie"))
    nodes = marked.groupBy("digest").agg(F.min(row).alias("first"), *(F.min(c).alias(c) for c in ("size", "fp", "blocks")))
    # Numbers are given once, in the written table.
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), f"{folder}/nodes")
    met = nodes.select("node", "fp", F.explode("blocks").alias("block"))
    members = cloud_members(near_edges(met, budget, most, STEPS), f"{folder}/clouds")
    members = written(members.join(nodes.select("node", "size", "first"), "node"), f"{folder}/members")
    sets = written(sets_of(docs, members.select("node", "first.id", "first.tie")), f"{folder}/sets")
    stars = similar_groups(members.select("cloud", "node", "size"), sets, over, under, folder)
    rooted = nodes.join(stars, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    first = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("f_id"), F.col("first.tie").alias("f_tie"))
    rows = marked.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("copies"))
    rows = written(rows.join(first, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("tie") == F.col("f_tie")), "left").select("doc_id", "tie", "copies", F.col("f_tie").isNull().alias("gone")), f"{folder}/rows")
    own, text = (unused(docs, f"gf_{x}") for x in ("id", "text"))
    keyed = docs.select("*", F.col("doc_id").cast("long").alias(own), F.xxhash64(text_or_empty()).alias(text)).alias("all")
    same = lambda keys: F.col(f"all.{own}").eqNullSafe(F.col(f"{keys}.doc_id")) & (F.col(f"all.{text}") == F.col(f"{keys}.tie"))
    gone = if_few(written(rows.filter("gone").select("doc_id", "tie"), f"{folder}/gone")).alias("gone")
    kept = keyed.join(gone, same("gone"), "left_anti")
    if rows.filter("copies > 1 AND NOT gone").isEmpty():
        return kept.drop(own, text)
    many = if_few(written(rows.filter("copies > 1 AND NOT gone").select("doc_id", "tie"), f"{folder}/many")).alias("many")
    once = kept.join(many, same("many"), "left_anti")
    return once.unionByName(one_of_each(kept.join(many, same("many"), "left_semi"), [own, text])).drop(own, text)
