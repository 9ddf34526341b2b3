"""Self-join of 64-bit fingerprints by Hamming distance, on binary tries.

A sorted array of fingerprints is a binary trie: a node is a range of it, and the bit below splits a range in two.
The join follows pairs of nodes from the root down, adds up the bits in which their prefixes differ, and leaves a pair as
soon as that exceeds the budget. All tries of a batch go down together, a level at a time, in numpy.

To spread the work, fingerprints meet only if they agree in one of budget + 1 blocks of bits, which two fingerprints
within the budget always do. A group (block, value) has a trie of its own. Groups of more than ``most`` fingerprints
are split again, by blocks of the bits that are left.

Where the budget is too large for blocks of bits to tell anything, the caller deals fingerprints out by content instead (``block``), and
the budget grows in steps: what few bits join is left alone by the steps that follow. Of such a group each pair of parts is a group of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainflow.llm.common import workspace, written

LEAF, FRONTIER, BATCH = 64, 1 << 17, 1 << 17


def block_masks(mask: int, budget: int) -> list[int]:
    """``mask`` with each of budget + 1 blocks of the other bits added, or none if fewer bits are left."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    if len(free) <= budget:
        return []
    cuts = np.linspace(0, len(free), budget + 2).round().astype(int)
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pairs(a_lo, a_hi, b_lo, b_hi):
    """All (i, j) of each pair of ranges."""
    width = b_hi - b_lo
    sizes = (a_hi - a_lo) * width
    which = np.repeat(np.arange(len(sizes)), sizes)
    k = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return a_lo[which] + k // width[which], b_lo[which] + k % width[which]


def trie_links(group: np.ndarray, fp: np.ndarray, budget: int, joined: np.ndarray | None = None):
    """Yields arrays (i, j), i < j, of all pairs of a group that differ in at most ``budget`` bits.

    group: integers in ascending order; fp: unsigned 64-bit integers, different and ascending within a group.
    joined: labels; pairs of nodes that hold one and the same label are left out.
    """
    changes = None if joined is None else np.concatenate([[0], np.cumsum(joined[1:] != joined[:-1])])
    cut = np.flatnonzero(np.diff(group)) + 1
    lo, hi = np.concatenate([[0], cut]).astype(np.int64), np.concatenate([cut, [len(group)]]).astype(np.int64)
    ones: dict[int, np.ndarray] = {}
    stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        bit, al, ah, bl, bh, used = stack.pop()
        keep = (ah > al) & (bh > bl) & (used <= budget) & ((al != bl) | (ah - al > 1))
        al, ah, bl, bh, used = (x[keep] for x in (al, ah, bl, bh, used))
        if changes is not None and len(al):
            keep = (joined[al] != joined[bl]) | (changes[ah - 1] != changes[al]) | (changes[bh - 1] != changes[bl])
            al, ah, bl, bh, used = (x[keep] for x in (al, ah, bl, bh, used))
        if not len(al):
            continue
        leaf = ((ah - al) * (bh - bl) <= LEAF) | (bit < 0)
        if leaf.any():
            ls = [x[leaf] for x in (al, ah, bl, bh)]
            for at in range(0, len(ls[0]), FRONTIER // LEAF * 4):
                i, j = _pairs(*(x[at : at + FRONTIER // LEAF * 4] for x in ls))
                near = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
                if near.any():
                    yield i[near], j[near]
            al, ah, bl, bh, used = (x[~leaf] for x in (al, ah, bl, bh, used))
            if not len(al):
                continue
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(bit, *(x[:half] for x in (al, ah, bl, bh, used))), (bit, *(x[half:] for x in (al, ah, bl, bh, used)))]
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1))]).astype(np.int32)
        count = ones[bit]
        am, bm = ah - (count[ah] - count[al]), bh - (count[bh] - count[bl])
        two = al != bl  # a node with itself has one pair of different children
        parts = [(al, am, bl, bm, used), (am, ah, bm, bh, used), (al, am, bm, bh, used + 1), tuple(x[two] for x in (am, ah, bl, bm, used + 1))]
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*parts))))


def _roots(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    while True:
        up = parent[i]
        if (up == i).all():
            return i
        i = up


def _united(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Joins the trees of i and j in ``parent``, whose roots are their smallest members. Returns the pairs that did so, fewer than there are members."""
    new = []
    while len(i):
        a, b = _roots(parent, i), _roots(parent, j)
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if len(i):
            high, at = np.unique(np.maximum(a, b), return_index=True)
            parent[high] = np.minimum(a, b)[at]
            new.append((i[at], j[at]))
    return new


def near_edges(rows: DataFrame, budget: int = 4, most: int = 50_000, steps: tuple[int, ...] = ()) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of the links of ``budget`` or fewer different bits.

    rows: fp and node (long), read more than once; with ``block`` (long) only those of a block meet, without it all do.
    Each group yields a spanning forest of such links, fewer edges than it has
    members: copies by the thousand don't become all their pairs. ``steps``: smaller budgets, ascending, that are tried before. A task holds one group, or some small ones, at a time.
    """
    if "block" in rows.columns:
        return _edges_of_groups(in_parts(rows.select("block", "fp", "node"), most), (*steps, budget)).distinct()
    keyed = rows.select(F.lit(0).cast("long").alias("block"), "fp", "node", F.explode(F.array(*(F.lit(_signed(m)) for m in block_masks(0, budget)))).alias("mask"))
    edges, group = None, ["block", "mask", "key"]
    while True:
        keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        large = keyed.groupBy(*group).agg(F.count_distinct("fp").alias("members")).filter(F.col("members") > most).select(*group)
        found = {r.mask: block_masks(r.mask % (1 << 64), budget) for r in large.select("mask").distinct().collect()}  # at most (budget + 1) ** depth
        found = {m: [_signed(x) for x in deeper] for m, deeper in found.items() if deeper}
        if found:
            large = large.filter(F.col("mask").isin(*found))
        here = keyed.join(large, group, "left_anti") if found else keyed
        part = _edges_of_groups(here, (*steps, budget))
        edges = part if edges is None else edges.unionByName(part)
        if not found:
            return edges.distinct()
        deeper = F.create_map(*(x for m, ms in found.items() for x in (F.lit(m), F.array(*(F.lit(v) for v in ms)))))
        keyed = keyed.join(large, group, "left_semi").select("block", "fp", "node", F.explode(F.element_at(deeper, F.col("mask"))).alias("mask"))


def in_parts(rows: DataFrame, most: int) -> DataFrame:
    """block, mask, key, fp, node of rows (block, fp, node): a block of more than ``most`` nodes becomes as many groups as its parts have pairs, which mask and key tell
    apart. Any two of its nodes meet in one of them, and none has many more than ``most``."""
    parts = F.ceil(F.count(F.lit(1)) * 2 / most).cast("int").alias("parts")
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), parts).filter(F.col("n") > most).select("block", "parts")
    large = written(sizes, f"{workspace(rows.sparkSession, 'large_blocks')}/blocks")
    if large.isEmpty():
        return rows.select("block", F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("key"), "fp", "node")
    dealt = rows.join(large, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own, other = F.pmod(F.xxhash64("node"), F.col("parts")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))
    met = dealt.select("block", "fp", "node", own.alias("own"), other.alias("other"))
    return met.select("block", F.least("own", "other").alias("mask"), F.greatest("own", "other").alias("key"), "fp", "node")


def _edges_of_groups(keyed: DataFrame, budgets: tuple[int, ...]) -> DataFrame:
    def edges(group: np.ndarray, fp: np.ndarray, node: np.ndarray):
        # Equal fingerprints of a group follow each other: a chain of edges, and one of them stands for all.
        again = np.concatenate([[False], (group[1:] == group[:-1]) & (fp[1:] == fp[:-1])])
        at = np.flatnonzero(again)
        pairs = [(node[at - 1], node[at])]
        group, fp, node = group[~again], fp[~again], node[~again]
        parent = np.arange(len(fp))
        for budget in budgets:
            joined = _roots(parent, np.arange(len(fp)))
            parent[:] = joined
            for i, j in trie_links(group, fp, budget, joined) if len(fp) else ():
                pairs += [(node[a], node[b]) for a, b in _united(parent, i, j)]
        a, b = (np.concatenate(x) for x in zip(*pairs))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    def scan(batches):
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]))
            rows += batch.num_rows
            if rows >= BATCH:  # the last group may go on in the next batch
                whole = np.concatenate(held, axis=1)
                new = np.flatnonzero((whole[:3, 1:] != whole[:3, :-1]).any(axis=0)) + 1
                if len(new):
                    yield from edges(*_grouped(whole[:, : new[-1]]))
                    whole = whole[:, new[-1] :]
                held, rows = [whole], 0 if len(new) else rows
        if held:
            yield from edges(*_grouped(np.concatenate(held, axis=1)))

    group = ["block", "mask", "key"]
    return keyed.repartition(*group).sortWithinPartitions(*group).select(*group, "fp", "node").mapInArrow(scan, "a long, b long")


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    group = np.concatenate([[0], np.cumsum((rows[:3, 1:] != rows[:3, :-1]).any(axis=0))])
    fp = rows[3].view(np.uint64)
    order = np.lexsort((rows[4], fp, group))
    return group[order], fp[order], rows[4][order]
