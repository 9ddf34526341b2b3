"""A Merkle tree over a dataset, with a proof for each row, in higher-order SQL functions.

Leaves are ranked within their group and cut into blocks of a fixed number. A block is one row with an array of its nodes; ``aggregate`` goes through the
levels and ``transform`` over a ``sequence`` makes each run of ``fan`` nodes, a ``slice``, into the next level's node. The blocks' roots are the
leaves of the next round, until one is left. Proofs come down the same way: a block's rows get its siblings within the block, and behind them those of the block's root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainflow.functions.prefix import running
from grainflow.llm.common import workspace, written

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(columns: list[Column]) -> Column:
    """The hash of a row's values: each as its number of UTF-8 bytes, a colon and the value; a null as a hyphen."""
    texts = [c.cast("string") for c in columns]
    return hashed(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def _parents(nodes: Column, fan: int) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / F.lit(fan)).cast("int") - 1)
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * fan + 1, fan), ""), 256))


def _numbers(n: Column) -> Column:
    """0 to n - 1, none where n is 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def build(nodes: DataFrame, folder: str, fan: int, depth: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The rounds of blocks of ``fan ** depth`` nodes, and for each round the groups whose tree ends there.

    nodes: group (not null), pos (from 0 without gaps), node and any other columns. A round: group, block, members (structs in order), levels, height.
    """
    rounds, ends, block = [], [], fan**depth
    while True:
        members = F.array_sort(F.collect_list(F.struct("pos", *(c for c in nodes.columns if c not in ("group", "pos")))))
        rows = nodes.groupBy("group", F.floor(F.col("pos") / block).alias("block")).agg(members.alias("members"))
        # A first block that isn't full is its group's only one, and no higher than it must be.
        needed = sum(((F.size("members") > fan**k).cast("int") for k in range(depth)), F.lit(0))
        height = F.when(F.col("block") > 0, F.lit(depth)).otherwise(needed)
        levels = F.aggregate(_numbers(height), F.array(F.col("members.node")), lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1), fan))))
        table = written(rows.select("*", height.alias("height"), levels.alias("levels")), f"{folder}/round{len(rounds)}")
        rounds.append(table)
        tops = table.select("group", F.col("block").alias("pos"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
        second = tops.filter("pos = 1").select("group")
        ends.append(tops.filter("pos = 0").join(second, "group", "left_anti").select("group", "node"))
        nodes = tops.filter("pos > 0").unionByName(tops.filter("pos = 0").join(second, "group", "left_semi"))
        if second.isEmpty():
            return rounds, ends


def _steps(at: Column, height: Column, levels: Column, fan: int) -> Column:
    """The siblings of the block's node ``at`` (from 0) on each level: their text in front of it and behind it."""

    def step(k: Column) -> Column:
        here = F.floor(at / F.pow(F.lit(fan), k)).cast("int")
        run = F.slice(F.get(levels, k), here - here % fan + 1, fan)
        return F.struct(F.array_join(F.slice(run, F.lit(1), here % fan), "").alias("before"), F.array_join(F.slice(run, here % fan + 2, fan), "").alias("after"))

    return F.transform(_numbers(height), step)


def _carried(rounds: list[DataFrame], ends: list[DataFrame], above: DataFrame, fan: int) -> DataFrame:
    """The first round's blocks with ``path``, the steps from their root upwards, and the other columns of above (group, path, ...)."""
    others = [c for c in above.columns if c not in ("group", "path")]
    down = None
    for k in range(len(rounds) - 1, -1, -1):
        tops = ends[k].join(above, "group").select("group", F.lit(0).cast("long").alias("block"), F.col("node").alias("subroot"), "path", *others)
        tops = tops if down is None else tops.unionByName(down)
        table = rounds[k].join(tops, ["group", "block"])
        if k > 0:
            member = F.transform(F.sequence(F.lit(0), F.size("members") - 1), lambda i: F.struct(F.get("members", i)["pos"].alias("child"), F.concat(_steps(i, F.col("height"), F.col("levels"), fan), F.col("path")).alias("path")))
            down = table.select("group", "subroot", *others, F.inline(member)).withColumnRenamed("child", "block").select("group", "block", "subroot", "path", *others)
    return table


def manifest(docs: DataFrame, fields: list[str] = FIELDS, group: str = "lang", order: str = "doc_id", tampered: Column | None = None, changed: dict[str, Column] | None = None, fan: int = 2, depth: int = 10) -> DataFrame:
    """A row for each row of docs: order, leaf, subroot (its group's), root, proof_sha256, folded_root, verified.

    Leaves are hashes of ``fields``; those of a group follow ``order`` (nulls first), then their hash. Each run of ``fan`` nodes makes one of the next level, a last one may
    be shorter, until one remains; the groups' roots, in the order of their names (null first, bytewise), make the root in the same way. folded_root is the root that the
    siblings give with the row's leaf, where ``tampered`` holds with the leaf of the ``changed`` fields instead. Repeated rows count one by one. Other
    columns are ignored, an empty table gives no rows. A block, ``fan ** depth`` leaves, is one row of Spark's.
    """
    spark, folder = docs.sparkSession, workspace(docs.sparkSession, "manifest")
    changed = changed or {}
    other = leaf_of([changed.get(c, F.col(c)) for c in fields])
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaf = leaf_of([F.col(c) for c in fields])
    leaves = docs.select(name.alias("group"), F.col(order).alias("own"), leaf.alias("node"), F.when(F.lit(False) if tampered is None else tampered, other).alias("other"))
    leaves = running(written(leaves, f"{folder}/leaves"), ["group"], ["own", "node"], {"pos": F.lit(1).cast("long")})
    rounds, ends = build(leaves, f"{folder}/leaves_tree", fan, depth)
    subroots = ends[0]
    for end in ends[1:]:
        subroots = subroots.unionByName(end)
    named = written(running(subroots, [], ["group"], {"pos": F.lit(1).cast("long")}), f"{folder}/subroots")
    top_rounds, top_ends = build(named.select(F.lit("").alias("group"), "pos", "node", F.col("group").alias("own")), f"{folder}/groups_tree", fan, depth)
    nothing = spark.createDataFrame([("", [])], "group string, path array<struct<before:string,after:string>>")
    tops = _carried(top_rounds, top_ends, nothing, fan)
    above = tops.select(F.col("subroot").alias("root"), F.inline(_members(fan, ["own"]))).select(F.col("own").alias("group"), "path", "root")
    blocks = _carried(rounds, ends, written(above, f"{folder}/groups"), fan)
    rows = blocks.select("subroot", "root", F.inline(_members(fan, ["own", "node", "other"])))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("other", "node"), lambda node, s: hashed(s["before"], node, s["after"]))
    out = rows.select(F.col("own").alias(order), F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _members(fan: int, columns: list[str]) -> Column:
    """The members of a block, each with its path to the root."""
    at = F.sequence(F.lit(0), F.size("members") - 1)
    return F.transform(at, lambda i: F.struct(*(F.get("members", i)[c].alias(c) for c in columns), F.concat(_steps(i, F.col("height"), F.col("levels"), fan), F.col("path")).alias("path")))
