"""Groups of similar sets, exactly, within clouds of candidates.

A cloud is a set of nodes outside of which none has a link. Each node's set of shingles is shipped to its cloud once, and a task tests the sets against each other until
all are one group or every node outside the largest group has met all others: what is joined already isn't tested again, so copies by the
thousand cost a test each. A cloud that is too large for a task is dealt out to parts. Parts share a few nodes, so that a cloud of copies becomes one
group at once; the nodes that are in other groups then than their cloud's largest meet all its parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainflow.llm.common import text_or_empty, written
from grainflow.llm.components import components
from grainflow.llm.simhash_fingerprint import shingle_sets

#: Nodes and shingles of a part of a cloud, about; and how many of a part's nodes the part before gets as well, about.
MOST, WEIGHT, SHARED = 1_000, 1 << 20, 16
#: Keys of documents that are broadcast at most.
FEW = 1_000_000


def forest(label: np.ndarray, near: Callable[[int], np.ndarray], ask: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs that link the members as all links would. ``near(x)`` says who is linked to x; members of one ``label`` are joined from the start.

    Each of ``ask`` meets all others unless one group has them all; without ``ask`` each member outside the largest group does.
    """
    label = np.unique(label, return_inverse=True)[1]
    left = np.ones(len(label), bool) if ask is None else ask.copy()
    while True:
        sizes = np.bincount(label)
        if sizes.max() == len(label):
            return
        todo = np.flatnonzero(left & (label != sizes.argmax()) if ask is None else left)
        if not len(todo):
            return
        x = todo[0]
        left[x] = False
        found = np.flatnonzero(near(x) & (label != label[x]))
        for other, at in zip(*np.unique(label[found], return_index=True)):
            yield int(x), int(found[at])
            label[label == other] = label[x]


def similar_to(sets: list[np.ndarray], over: int, under: int) -> Callable[[int], np.ndarray]:
    """near(x) of ``forest`` for sets whose intersection is ``over / under`` of their union or more. An empty set is near to none."""
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, int)
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(ids, kind="stable")]
    count = np.bincount(ids)
    start, own = np.cumsum(count) - count, np.concatenate([[0], np.cumsum(size)])

    def near(x: int) -> np.ndarray:
        mine = ids[own[x] : own[x + 1]]
        n = count[mine]
        postings = np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[postings], minlength=len(sets))
        return (both > 0) & (under * both >= over * (size[x] + size - both))

    return near


def in_groups(batches, keys: int, use) -> Iterator[pa.RecordBatch]:
    """Calls ``use`` with the columns, as lists, of each group of rows that agree in the first ``keys`` columns; rows of a group follow each other."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:keys]])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            part = [c.slice(lo, hi - lo).to_pylist() for c in batch.columns]
            if held is not None and [c[0] for c in held[:keys]] == [c[0] for c in part[:keys]]:
                held = [a + b for a, b in zip(held, part)]
            else:
                if held is not None:
                    yield from use(held)
                held = part
    if held is not None:
        yield from use(held)


def _links(rows: DataFrame, keys: list[str], over: int, under: int) -> DataFrame:
    """a, b: a forest of the links within each group of rows (keys, node, label, ask, shingles); ask is null where all members ask."""

    def of_group(columns):
        node, label, ask, packed = columns[-4:]
        if len(node) == 1:
            return
        sets = [np.frombuffer(s, np.uint64) for s in packed]
        asking = None if ask[0] is None else np.array(ask, bool)
        pairs = list(forest(np.array(label), similar_to(sets, over, under), asking))
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([node[k] for k in side], pa.int64()) for side in zip(*pairs)], ["a", "b"])

    met = rows.select(*keys, "node", "label", "ask", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInArrow(lambda batches: in_groups(batches, len(keys), of_group), "a long, b long")


def if_few(keys: DataFrame) -> DataFrame:
    """``keys``, two or three numbers a row, to be broadcast where they are ``FEW`` or fewer; beyond that texts are shuffled to them."""
    return F.broadcast(keys) if keys.count() <= FEW else keys


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles: the shingles of the texts of docs (doc_id, text) that nodes (node, id, tie) name, ``tie`` being the text's xxhash64; one row for each node."""
    texts = docs.select(F.col("doc_id").cast("long").alias("own"), F.xxhash64(text_or_empty()).alias("own_tie"), text_or_empty().alias("text"))
    firsts = if_few(nodes.select("node", "id", "tie"))
    return shingle_sets(texts.join(firsts, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_tie") == F.col("tie")))).dropDuplicates(["node"])


def similar_groups(members: DataFrame, sets: DataFrame, over: int, under: int, folder: str, most: int = MOST, weight: int = WEIGHT) -> DataFrame:
    """(node, root) of the groups of nodes that links reach, but for the roots, which are their smallest nodes.

    members: cloud, node, size (long; read more than once); sets: node, shingles (ascending unsigned 64-bit hashes in bytes). Nodes are linked if they share a cloud and the
    intersection of their sets is ``over / under`` of the union or more.
    """
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("size") / weight)).cast("int").alias("parts")
    large = written(members.groupBy("cloud").agg(parts).filter("parts > 1"), f"{folder}/large")
    split = not large.isEmpty()
    placed = members.withColumn("parts", F.lit(1)).withColumn("part", F.lit(0))
    if split:
        placed = members.join(large, "cloud", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        placed = written(placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), f"{folder}/placed")
        shared = placed.filter((F.col("parts") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.lit(max(1, most // SHARED))) == 0))
        before = shared.withColumn("part", F.pmod(F.col("part") - 1, F.col("parts")))
        placed_twice = placed.unionByName(before)
    else:
        placed_twice = placed
    rows = placed_twice.join(sets, "node").withColumn("label", F.col("node")).withColumn("ask", F.lit(None).cast("boolean"))
    links = written(_links(rows, ["cloud", "part"], over, under), f"{folder}/links")
    stars = components(links, f"{folder}/stars")
    if not split:
        return stars
    named = placed.filter("parts > 1").join(stars, "node", "left").select("cloud", "node", "size", "parts", "part", F.coalesce("root", "node").alias("label"))
    named = written(named, f"{folder}/named")
    largest = named.groupBy("cloud", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("cloud").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    outside = named.join(largest, "cloud").filter("label <> largest").drop("largest")
    shares = F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("size") / weight)).cast("int").alias("shares")
    shares = written(outside.groupBy("cloud").agg(shares), f"{folder}/shares")
    if shares.isEmpty():
        return stars
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = outside.join(shares, "cloud").select("cloud", "node", "label", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"), every("parts").alias("part"), F.lit(True).alias("ask"))
    asked = named.join(shares, "cloud").select("cloud", "node", "label", every("shares").alias("share"), "part", F.lit(False).alias("ask"))
    rows = asking.unionByName(asked).join(sets, "node")
    more = written(_links(rows, ["cloud", "share", "part"], over, under), f"{folder}/more_links")
    return components(links.unionByName(more), f"{folder}/more_stars")


def cloud_members(edges: DataFrame, folder: str) -> DataFrame:
    """cloud, node: the components of edges (a, b), all their nodes."""
    stars = components(edges, folder)
    return stars.select(F.col("root").alias("cloud"), "node").unionByName(stars.select(F.col("root").alias("cloud"), F.col("root").alias("node")).distinct())
