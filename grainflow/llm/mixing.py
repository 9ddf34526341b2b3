"""Mixing sources to target weights, block by block.

Documents of a source, in a fixed pseudorandom order, are one long row of words that is cut into blocks of ``source_words`` words. An output shard has
a fixed number of slots. How many slots of a shard each source gets is a multinomial draw, given that all shards together
give each source its target. A source's j-th slot takes the block that a pseudorandom permutation of the source's block indices has at j; each
round through all blocks has a permutation of its own. Slots and blocks are then joined by (source, block index).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainflow.llm.common import in_small_batches, one_of_each, repeated, text_or_empty, unused, workspace, written

WORDS = r"[^\x20\x09-\x0D]+"
#: The weights of the sources in order of their names, again and again; the most that a source gives, times its size.
WEIGHTS, MOST = (5, 2, 1), 3
#: Words of a block; a source's own is shorter where its size or target would be too few of them, down to LEAST_WORDS.
BLOCK_WORDS, LEAST_WORDS = 2048, 16
BROADCAST_SOURCES = 10_000
#: Documents of a source that are ordered together, and buckets whose words are added up together.
BUCKET_ROWS, RANGE_BUCKETS = 256, 4096
#: numpy draws from fewer items than this; ``hypergeometric`` serves the others.
DRAWN = 10**9


@dataclass(frozen=True)
class Share:
    source: str | None
    size: int
    target: float
    blocks: int
    slots: int
    length: int
    rows: int = 0


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """The sum of ``sizes`` shared by weight; no share exceeds ``most`` times its size, what exceeds is shared again."""
    total, capped, out = float(sum(sizes)), set(), [0.0] * len(sizes)
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        left, weight = total - sum(most * sizes[i] for i in capped), sum(weights[i] for i in open_)
        out = [float(most * sizes[i]) if i in capped else left * weights[i] / weight for i in range(len(sizes))]
        above = {i for i in open_ if out[i] > most * sizes[i]}
        if not above:
            return out
        capped |= above


def source_words(size: int, target: float, most: int) -> int:
    """Words of a source's block: at most ``most``, and a 64th of what the source has or gives, so that whole blocks miss the target by
    a hundredth or so; 16 words at least, or an eighth of it where that is less."""
    least = min(size, int(target))
    return max(1, min(most, max(min(LEAST_WORDS, least // 8), least // 64)))


def plan_shares(sizes: list[tuple], length: int = BLOCK_WORDS) -> list[Share]:
    """One for each source (name, size and perhaps rows), in code-point order of their names, null last. ``length``: the most words of a block."""
    rows = sorted(sizes, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    want = targets([r[1] for r in rows], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))]) if rows else []
    out = []
    for (source, size, *count), target in zip(rows, want):
        own = source_words(size, target, length)
        blocks = -(-size // own)
        slots = min(MOST * blocks, round(target / size * blocks)) if size else 0
        out.append(Share(source, size, target, blocks, slots, own, *count))
    return out


def _key(seed: int, *parts: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *parts])))


def hypergeometric(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """How many of ``take`` items drawn without replacement are good, for any numbers of items: binomial draws, each accepted with the ratio of the two
    distributions over its maximum. Half of the items at most are drawn, so that two of three draws or more are accepted."""
    total = good + bad
    if 2 * take > total:
        return good - hypergeometric(good, bad, total - take, rng)
    if not (good and bad and take):
        return take if not bad else 0
    log_odds = math.log(good / total), math.log(bad / total)

    def ratio(x: int) -> float:
        return -math.lgamma(good - x + 1) - math.lgamma(bad - take + x + 1) - x * log_odds[0] - (take - x) * log_odds[1]

    lo, hi = max(0, take - bad), min(good, take)
    peak = max(ratio(min(hi, max(lo, good * (take - 1) // total + k))) for k in (0, 1))
    while True:
        x = int(rng.binomial(take, good / total))
        if lo <= x <= hi and math.log(1 - rng.random()) <= ratio(x) - peak:
            return x


def split_quota(quota: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """``take`` of the slots in ``quota``: a draw without replacement, which is what multinomial draws give once the total of each source is known."""
    left = int(quota.sum())
    if left < DRAWN:
        return rng.multivariate_hypergeometric(quota, take, method="marginals")
    out = np.zeros(len(quota), np.int64)
    for k, slots in enumerate(quota.tolist()):
        left -= slots
        out[k] = hypergeometric(slots, left, take, rng)
        take -= int(out[k])
    return out


def shard_counts(quota: np.ndarray, per_shard: int, shard: int, seed: int, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before ``shard``, slots in it). Shards are leaves of a binary tree; a node's slots are
    drawn for its left child from a generator that seed and node name, so any shard can be found alone. ``known`` keeps the draws of large nodes."""
    total = int(quota.sum())
    lo, hi = 0, -(-total // per_shard)
    before, here = np.zeros(len(quota), np.int64), quota.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = known.get((lo, hi)) if known is not None else None
        if left is None:
            left = split_quota(here, (mid - lo) * per_shard, _key(seed, 1, lo, hi))
            if known is not None and hi - lo > 256:
                known[lo, hi] = left
        if shard < mid:
            here, hi = left, mid
        else:
            before, here, lo = before + left, here - left, mid
    return before, here


def permuted(j: np.ndarray, n: int, seed: int, source: int, epoch: int) -> np.ndarray:
    """Where a pseudorandom permutation of range(n) sends each j: a Feistel network on the next power of 4, walked until the value is below n."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    mask = np.uint64((1 << half) - 1)
    keys = _key(seed, 2, source, epoch).integers(0, 2**63, 4, dtype=np.uint64)

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)  # the golden ratio, 64 bits
            mixed ^= mixed >> np.uint64(29)
            left, right = right, left ^ ((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) & mask)
        return left << np.uint64(half) | right

    x = once(j.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def draw_slots(spark, shares: list[Share], per_shard: int, seed: int) -> DataFrame:
    """Every output slot: shard, slot, source_no (in order of names), round, block."""
    quota = np.array([s.slots for s in shares], np.int64)
    blocks = [s.blocks for s in shares]
    shards = -(-int(quota.sum()) // per_shard) if len(quota) else 0
    schema = "shard long, slot long, source_no int, round int, block long"

    def draw(frames):
        known = {}
        for frame in frames:
            for shard in frame["id"].tolist():
                before, here = shard_counts(quota, per_shard, shard, seed, known)
                order = _key(seed, 3, shard).permutation(int(here.sum()))
                at = 0
                for k in np.flatnonzero(here).tolist():
                    j = np.arange(before[k], before[k] + here[k])
                    for epoch in np.unique(j // blocks[k]).tolist():
                        mine = j[j // blocks[k] == epoch] % blocks[k]
                        yield pd.DataFrame({"shard": shard, "slot": order[at : at + len(mine)], "source_no": k, "round": epoch, "block": permuted(mine, blocks[k], seed, k, epoch)})
                        at += len(mine)

    return spark.range(0, shards, 1, max(1, min(shards, 4096))).mapInPandas(draw, schema)


def _count_words(texts: DataFrame) -> DataFrame:
    def count(batches):
        for batch in batches:
            sizes = pa.array([len(t.as_py().encode().split()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, batch.column(2), batch.column(3)], ["doc_id", "size", "source", "tie"])

    return texts.mapInArrow(count, "doc_id long, size long, source string, tie long")


class Mix:
    """A planned mix. docs: doc_id, text, source; other columns are ignored.

    ``spans`` has each row of docs with its place in its source's row of words; ``slots`` the drawn slots; ``pieces`` the words
    of documents that slots take. Null texts have no words, a null source is a source of its own that comes last. Rows
    with the same doc_id, source and size are placed one after the other. The plan depends on the rows and ``seed`` alone.
    """

    def __init__(self, docs: DataFrame, per_shard: int = 4096, seed: int = 17, block_words: int = BLOCK_WORDS):
        self.spark, self.folder = docs.sparkSession, workspace(docs.sparkSession, "mixing")
        texts = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.col("source").cast("string").alias("source"), F.xxhash64(text_or_empty()).alias("tie"))
        self.docs = written(_count_words(texts).groupBy("doc_id", "tie", "source", "size").agg(F.count(F.lit(1)).alias("copies")), f"{self.folder}/sizes")
        words = F.sum(F.col("size") * F.col("copies")).alias("words")
        sizes = [(r.source, r.words, r.n) for r in self.docs.groupBy("source").agg(words, F.count(F.lit(1)).alias("n")).collect()]  # one row a source
        self.shares = plan_shares(sizes, block_words)
        rows = [(k, s.source, s.size, s.target, s.length, -(-s.rows // BUCKET_ROWS)) for k, s in enumerate(self.shares)]
        self.sources = self.spark.createDataFrame(rows, "source_no int, name string, source_size long, target double, length long, buckets long")
        if len(rows) <= BROADCAST_SOURCES:
            self.sources = F.broadcast(self.sources)
        self.spans = written(self._spans(), f"{self.folder}/spans")
        self.slots = draw_slots(self.spark, self.shares, per_shard, seed)

    def _spans(self) -> DataFrame:
        """Places documents by (bucket, tie, doc_id), a pseudorandom order. A bucket has about ``BUCKET_ROWS`` of a source's documents. Words before it are
        added up in two levels, ranges of buckets first, so no task has a whole source."""
        rows = self.docs.join(self.sources, F.col("source").eqNullSafe(F.col("name"))).drop("name")
        rows = rows.withColumn("words", F.col("size") * F.col("copies")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.col("buckets")))
        before = lambda c, by, order: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        of_bucket = rows.groupBy("source_no", "bucket").agg(F.sum("words").alias("words")).withColumn("range", F.floor(F.col("bucket") / RANGE_BUCKETS))
        of_range = of_bucket.groupBy("source_no", "range").agg(F.sum("words").alias("words"))
        of_range = of_range.select("source_no", "range", before("words", ["source_no"], ["range"]).alias("of_range"))
        starts = of_bucket.withColumn("of_bucket", before("words", ["source_no", "range"], ["bucket"])).join(of_range, ["source_no", "range"])
        placed = rows.withColumn("within", before("words", ["source_no", "bucket"], ["tie", "doc_id", "size"])).join(starts.drop("words", "range"), ["source_no", "bucket"])
        start = F.col("of_range") + F.col("of_bucket") + F.col("within") + F.col("copy") * F.col("size")
        return repeated(placed, "copies", "copy").select("doc_id", "tie", "source", "source_no", "source_size", "target", "length", "size", start.alias("start"))

    def pieces(self, *columns: Column | str) -> DataFrame:
        """The words of a document in each block: its ``spans`` row (or ``columns``), block, from_word, n_words."""
        last = F.floor((F.col("start") + F.col("size") - 1) / F.col("length"))
        cut = self.spans.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("length")), last)))
        begin = F.greatest(F.col("start"), F.col("block") * F.col("length"))
        end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("length"))
        return cut.select(*(columns or ["*"]), "source_no", "block", (begin - F.col("start")).alias("from_word"), (end - begin).alias("n_words"))

    def taken(self) -> DataFrame:
        """Each row of docs: doc_id, size, source_size, target (of its source), taken (words in the mix, repeats counted), source."""
        uses = self.slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("uses"))
        keys = ["doc_id", "tie", "start"]
        used = self.pieces(*keys).join(uses, ["source_no", "block"]).groupBy("source_no", *keys).agg(F.sum(F.col("n_words") * F.col("uses")).alias("taken"))
        same = F.lit(True)
        for c in ("source_no", "doc_id", "tie", "start"):
            same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"u.{c}"))
        same = same & (F.col("s.size") > 0)
        joined = self.spans.alias("s").join(used.alias("u"), same, "left")
        return joined.select("s.doc_id", "s.size", "s.source_size", "s.target", F.coalesce("u.taken", F.lit(0)).alias("taken"), "s.source")

    def texts(self, docs: DataFrame) -> DataFrame:
        """The mix itself, from the same docs: a row for each document and round with the columns of docs, text being the words taken.

        The pieces of a document that a round takes follow each other in one text, with the white space between them as it was.
        """
        keys = ["doc_id", "tie", "source", "start"]
        mine = self.pieces(*keys).join(self.slots.select("source_no", "block", "round"), ["source_no", "block"])
        spans = mine.groupBy(*keys, "round").agg(F.array_sort(F.collect_list(F.struct("from_word", "n_words"))).alias("gf_spans"))
        names = [f.name for f in docs.schema.fields]
        own_id, own_tie, own_source = (unused(docs, f"gf_{n}") for n in ("id", "tie", "source"))
        keyed = docs.select("*", F.col("doc_id").cast("long").alias(own_id), F.xxhash64(text_or_empty()).alias(own_tie), F.col("source").cast("string").alias(own_source))
        if not self.docs.filter("copies > 1").isEmpty():
            keyed = one_of_each(keyed, [own_id, own_tie, own_source])  # each repetition has a span of its own
        same = F.lit(True)
        for ours, theirs in ((own_id, "doc_id"), (own_tie, "tie"), (own_source, "source")):
            same = same & F.col(f"k.{ours}").eqNullSafe(F.col(f"p.{theirs}"))
        at = keyed.alias("k").join(spans.alias("p"), same).select(*(F.col(f"k.`{n}`") for n in names), "p.gf_spans")

        def cut(batches):
            for batch in batches:
                texts = [cut_words(t.as_py() or "", s.as_py()) for t, s in zip(batch.column(names.index("text")), batch.column(len(names)))]
                columns = [pa.array(texts, pa.string()) if n == "text" else pa.array(map(len, texts), batch.column(k).type) if n == "n_chars" else batch.column(k) for k, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, names)

        return at.mapInArrow(cut, docs.schema)


def cut_words(text: str, spans: list[dict]) -> str:
    """The words [from_word, from_word + n_words) of each span; spans that touch are cut as one."""
    at = [m.span() for m in re.finditer(WORDS, text)]
    merged: list[list[int]] = []
    for s in spans:
        if merged and merged[-1][1] == s["from_word"]:
            merged[-1][1] += s["n_words"]
        else:
            merged.append([s["from_word"], s["from_word"] + s["n_words"]])
    if merged == [[0, len(at)]]:
        return text
    return " ".join(text[at[a][0] : at[b - 1][1]] for a, b in merged)
