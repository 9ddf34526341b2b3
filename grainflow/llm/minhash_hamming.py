"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A signature has ``SLOTS`` minima of ``BITS`` bits. It is split into chunks of ``CHUNK`` slots. Two signatures that differ in no more than ``DISTANCE`` slots differ, by pigeonhole, in
at most one slot of some chunk, so each chunk is indexed with each of its slots left out: the errors that a chunk is allowed, enumerated. Within
a bucket of the index signatures are joined up to that distance, and the clouds that these links form are confirmed on the whole sets of shingles.
Of two texts alike to 0.85 the signatures differ in more slots than that once in 250,000 cases, and the index misses two in 100 million.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainflow.llm.common import in_small_batches, text_or_empty, workspace, written
from grainflow.llm.set_links import cloud_members, forest, sets_of, similar_groups
from grainflow.llm.simhash_fingerprint import shingle_set
from grainflow.llm.trie_join import _pairs, _united

SLOTS, BITS, CHUNK = 32, 16, 4
#: Two errors in each of the eight chunks are one too many.
DISTANCE = 2 * SLOTS // CHUNK - 1
#: Members of a bucket that are compared all at once; rows that a task looks at together; members beyond which a bucket is dealt out.
SMALL, BATCH, MOST = 16, 1 << 17, 20_000
#: Parts that the rows of one node are dealt out to.
PARTS = 256
_PART = 1 << 13
_MIX = np.random.default_rng(13).integers(1, 1 << 63, (2, SLOTS), dtype=np.uint64) | np.uint64(1)
_ONES = np.uint64(0x0101010101010101)
PACKED = ["near0", "near1", "near2", "near3"]


def signature(found: np.ndarray) -> np.ndarray:
    """The lowest ``BITS`` bits, well mixed, of the least of each of ``SLOTS`` hashes of the shingles."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _PART):
        part = found[at : at + _PART, None]
        least = np.minimum(least, ((part ^ part >> np.uint64(29)) * _MIX[0] + _MIX[1]).min(axis=0))
    least ^= least >> np.uint64(32)
    return ((least * _MIX[0, 0]) >> np.uint64(64 - BITS)).astype(np.uint16)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, tie (the text's hash), node (128-bit hash of the set of shingles, null for an empty one), size, signature and near0 to near3 (a byte of each slot) of docs (doc_id, text)."""

    def scan(batches):
        for batch in batches:
            nodes, sizes, signed, near = [], [], [], []
            for text in batch.column(2):
                found = shingle_set(text.as_py())
                sizes.append(len(found))
                nodes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                slots = signature(found)
                signed.append(slots.astype(">u2").tobytes())
                near.append((slots & 255).astype(np.uint8).view(np.int64))
            near = np.array(near).reshape(-1, 4)
            columns = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signed, pa.binary()), *(pa.array(near[:, k]) for k in range(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "tie", "node", "size", "signature", *PACKED])

    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tie"), text_or_empty().alias("text"))
    return rows.mapInArrow(scan, "doc_id long, tie long, node binary, size long, signature binary, " + ", ".join(f"{c} long" for c in PACKED))


def differing(near: np.ndarray, i, j) -> np.ndarray:
    """In how many of the bytes of rows i and j of ``near`` differ; never more than the slots do."""
    x = near[i] ^ near[j]
    x |= x >> np.uint64(4)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & _ONES).sum(axis=-1)


def bucket_links(keys: np.ndarray, node: np.ndarray, near: np.ndarray, distance: int = DISTANCE):
    """Yields (a, b), arrays of nodes: a forest, for each bucket, of the pairs that differ in ``distance`` slots or fewer. ``keys`` are in order."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
    few = (hi - lo > 1) & (hi - lo <= SMALL)
    parent = np.arange(len(keys))
    for at in range(0, int(few.sum()), 4096):
        a, b = lo[few][at : at + 4096], hi[few][at : at + 4096]
        i, j = _pairs(a, b, a, b)
        i, j = i[i < j], j[i < j]
        alike = differing(near, i, j) <= distance
        for a, b in _united(parent, i[alike], j[alike]):
            yield node[a], node[b]
    for a, b in zip(lo[hi - lo > SMALL], hi[hi - lo > SMALL]):
        pairs = list(forest(np.arange(b - a), lambda x, a=a, b=b: differing(near, a + x, slice(a, b)) <= distance))
        if pairs:
            i, j = np.array(pairs).T + a
            yield node[i], node[j]


def hamming_edges(nodes: DataFrame, folder: str, most: int = MOST) -> DataFrame:
    """a, b: edges whose components are those of all pairs of nodes (node, signature, near0 to near3) within ``DISTANCE`` slots.

    A bucket of more than ``most`` nodes is dealt out to parts, and each pair of parts is a bucket of its own.
    """
    width = BITS // 8
    slot = lambda k: F.substring("signature", k * width + 1, width)
    left_out = [(chunk, k) for chunk in range(0, SLOTS, CHUNK) for k in range(chunk, chunk + CHUNK)]
    keys = F.array(*(F.xxhash64(F.lit(k), F.concat(*(slot(j) for j in range(chunk, chunk + CHUNK) if j != k))) for chunk, k in left_out))
    rows = nodes.select("node", *PACKED, F.explode(keys).alias("key"))
    parts = F.ceil(F.count(F.lit(1)) * 2 / most).cast("int").alias("parts")
    large = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), parts).filter(F.col("n") > most).select("key", "parts"), f"{folder}/large_buckets")
    if not large.isEmpty():
        dealt = rows.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own, other = F.pmod(F.xxhash64("node"), F.col("parts")), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        dealt = dealt.select("*", own.alias("own"), other.alias("other"))
        rows = dealt.withColumn("key", F.when(F.col("parts") > 1, F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("key")))

    def scan(batches):
        held, n = [], 0
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            n += batch.num_rows
            if n >= BATCH:  # the last bucket may go on
                whole = np.concatenate(held, axis=1)
                new = np.flatnonzero(whole[0, 1:] != whole[0, :-1]) + 1
                if len(new):
                    yield from found(whole[:, : new[-1]])
                    whole = whole[:, new[-1] :]
                held, n = [whole], 0 if len(new) else n
        if held:
            yield from found(np.concatenate(held, axis=1))

    def found(whole):
        if whole.shape[1]:
            pairs = list(bucket_links(whole[0], whole[1], np.ascontiguousarray(whole[2:].T).view(np.uint64)))
            if pairs:
                a, b = (np.concatenate(side) for side in zip(*pairs))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return rows.select("key", "node", *PACKED).repartition("key").sortWithinPartitions("key").mapInArrow(scan, "a long, b long").distinct()


def minhash_components(docs: DataFrame, over: int = 85, under: int = 100, most: int = MOST) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, component_size.

    Documents are linked if the intersection of their sets of five-word shingles (words in lower case, A-Z only; a shorter text is one shingle) is ``over / under``
    of the union or more; component_id is the smallest doc_id that links reach (null if all are null), kept says whether it is the row's own.
    Texts without words, null ones too, have no shingles and are linked with nothing. Repeated rows are linked, as equal texts are. Other columns are
    ignored, an empty table gives no rows.
    """
    spark, folder = docs.sparkSession, workspace(docs.sparkSession, "minhash")
    marked = written(signatures(docs).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), f"{folder}/signatures")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("tie").alias("tie"))
    some = marked.filter("node IS NOT NULL")
    values = ["size", "signature", *PACKED]
    halves = some.groupBy("node", "part").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("copies"), *(F.min(c).alias(c) for c in values))
    nodes = halves.groupBy("node").agg(F.min("first").alias("first"), F.sum("copies").alias("copies"), F.collect_set("part").alias("parts"), *(F.min(c).alias(c) for c in values))
    # Numbers are given once, in the written table.
    nodes = written(nodes.withColumnRenamed("node", "digest").withColumn("node", F.monotonically_increasing_id()), f"{folder}/nodes")
    members = cloud_members(hamming_edges(nodes, folder, most), f"{folder}/clouds")
    members = written(members.join(nodes.select("node", "size", "first"), "node"), f"{folder}/members")
    sets = written(sets_of(docs, members.select("node", "first.id", "first.tie")), f"{folder}/sets")
    stars = similar_groups(members.select("cloud", "node", "size"), sets, over, under, folder)
    rooted = nodes.join(stars, "node", "left").select("digest", "parts", "first", "copies", F.coalesce("root", "node").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("first").alias("first"), F.sum("copies").alias("component_size"))
    named = rooted.drop("first").join(whole, "root").select("digest", F.explode("parts").alias("part"), F.col("first.id").alias("least"), "component_size")
    joined = marked.join(named, (F.col("node") == F.col("digest")) & (marked.part == named.part), "left")
    alone = F.col("node").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    out = joined.select("doc_id", F.col("size").alias("n_shingles"), component, F.coalesce("component_size", F.lit(1)).cast("long").alias("component_size"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "component_size")
