"""Spelling variants: frequent words that are one edit apart, by a positional q-gram inverted index.

Of two words one edit apart, the longer of ``m`` code points, at least ``m - 2 q + 1`` q-grams agree, in front of the edit at the same position from the start, behind it
at the same position from the end. So of each word's q-grams, rarest first, the first q + 1 hold one that agrees (at most q of either word's don't), and
words meet in the shards of the index that such a gram, its position and the word's length name. A shard holds the postings of all
q-grams of its words. All of its words have the gram that the shard is named after, so that one isn't merged; a query's other postings are merged on a heap, but for the
longest ones, in which candidates are looked up. Candidates below the bound fall out, the rest is verified.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainflow.llm.common import in_small_batches, text_or_empty, workspace, written

_RUN = re.compile("[a-zÀ-ÿ]+")
#: Letters that a run may have, once A-Z are lower-cased; q-grams are at most as many as ``ALPHABET ** q``.
ALPHABET = 26 + 64
#: Different words that a task counts before it hands them on.
HELD = 1 << 18
#: What a word does in a shard: it stands in the index and asks; asks only; asks for longer words with the shard's q-gram at its own place, or one later.
STANDS, ASKS, LONGER, LATER = range(4)
AHEAD = (None, None, 0, 1)
#: Pairs of an index's words and others, each with how often it occurs.
PAIRS = "a string, a_n long, b string, b_n long"


def words_with_gaps(doc_id: int | None, text: str | None, every: int = 31) -> Counter:
    """How often each word is in a text. A run (A-Z in lower case) loses one code point where ``every`` divides h, the crc32 of
    ``<doc_id>:<run>``: that at h modulo its length. ``every`` 0 leaves all as they are."""
    # In bytes only A-Z are lower-cased.
    runs = Counter(_RUN.findall((text or "").encode().lower().decode()))
    if not every:
        return runs
    found: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        found[run] += n
    return found


def word_counts(docs: DataFrame, length: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """word, n: the different words of ``length`` code points or more that occur ``least`` times or more in docs (doc_id, text)."""

    def scan(batches):
        held: Counter = Counter()

        def handed_on():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in words_with_gaps(doc_id, text.as_py(), every).items():
                    if len(word) >= length:
                        held[word] += n
                if len(held) >= HELD:
                    yield handed_on()
        if held:
            yield handed_on()

    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(scan, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def one_edit(a: str, b: str, at: int = 0) -> bool:
    """Whether exactly one inserted, deleted or replaced code point leads from ``a`` to ``b``, which is not shorter. The first ``at`` code points are known to be alike."""
    size = len(a)
    while at < size and a[at] == b[at]:
        at += 1
    if size == len(b):
        return at < size and a[at + 1 :] == b[at + 1 :]
    return a[at:] == b[at + 1 :]


def often_enough(lists: list[list[int]], bound: int) -> list[int]:
    """The numbers that are in ``bound`` or more of the ascending lists. A number that is must be in one of all but the bound - 1 longest lists, so only those are merged."""
    lists.sort(key=len)
    cut = len(lists) - bound + 1
    if cut == 1:
        counts = dict.fromkeys(lists[0], 1)
    else:
        counts = {}
        for k in heapq.merge(*lists[:cut]):
            counts[k] = counts.get(k, 0) + 1
    if bound == 1:
        return list(counts)
    longest, out = lists[cut:], []
    for k, missing in counts.items():
        missing, left = bound - missing, bound - 1
        if missing > 0:
            for held in longest:
                at = bisect_left(held, k)
                if at < len(held) and held[at] == k:
                    missing -= 1
                    if not missing:
                        break
                left -= 1
                if left < missing:
                    break
        if missing <= 0:
            out.append(k)
    return out


class Shard:
    """The words of one length that have a certain q-gram at position ``at``, as an inverted index of all their other q-grams by position."""

    def __init__(self, at: int, length: int, q: int):
        self.at, self.q, self.bound, self.members = at, q, length - 2 * q, []
        self.places = [k for k in range(length - q + 1) if k != at]
        self.postings: list[dict[str, list[int]]] = [{} for _ in range(length - q + 1)]

    def add(self, word: str, n: int) -> None:
        for k in self.places:
            self.postings[k].setdefault(word[k : k + self.q], []).append(len(self.members))
        self.members.append((word, n))

    def near(self, word: str, ahead: int | None):
        """The members one edit from ``word``. ahead: None for a word of the members' length; else it is shorter by one, and has the shard's q-gram at the same
        position (0), so that the edit is behind it, or one earlier (1), so that it is in front."""
        if not self.members:
            return
        at, q, postings, lists = self.at, self.q, self.postings, []
        if ahead is None:
            missed = 0
            for k in self.places:
                held = postings[k].get(word[k : k + q])
                if held is not None:
                    lists.append(held)
                elif missed == q:  # one edit changes no more
                    return
                else:
                    missed += 1
        else:
            last = len(word) - q + 1
            # On the side of the gram without the edit each q-gram must be there.
            for k in range(at) if ahead == 0 else range(at, last):
                held = postings[k + ahead].get(word[k : k + q])
                if held is None:
                    return
                lists.append(held)
            for k in range(at + 1, last) if ahead == 0 else range(at - 1):
                gram = word[k : k + q]
                if gram in postings[k]:
                    lists.append(postings[k][gram])
                if gram in postings[k + 1]:
                    lists.append(postings[k + 1][gram])
        if len(lists) < self.bound:
            return
        head, tail, end = word[:at] if ahead != 1 else None, word[at + q - (ahead or 0) :] if ahead != 0 else None, at + q
        for k in often_enough(lists, self.bound):
            other = self.members[k][0]
            if one_edit(word, other, end) if other[:at] == head else other[end:] == tail and one_edit(word, other):
                yield self.members[k]


def near_pairs(words: DataFrame, q: int = 3, most: int = 20_000) -> DataFrame:
    """Pairs a < b of words (word, n; different, of 2 q code points or more) that are one edit apart, each once: a, a_n, b, b_n.

    A shard of more than ``most`` words is dealt out to parts, each with its own share of the index; its queries go to all of them.
    """
    size = F.char_length("word")
    grams = words.select("word", "n", F.posexplode(F.transform(F.sequence(F.lit(1), size - q + 1), lambda i: F.substring(F.col("word"), i, F.lit(q)))).alias("at", "gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    often = F.broadcast(often) if ALPHABET**q <= 1_000_000 else often  # a row for each possible gram at most
    first = F.slice(F.array_sort(F.collect_list(F.struct("often", "gram", "at"))), 1, q + 1)
    signed = grams.join(often, "gram").groupBy("word", "n").agg(F.explode(first).alias("p")).select("word", "n", "p.gram", "p.at")
    # A word stands in the shard of its own length, and asks there and in two shards of words that are longer by one.
    place = lambda ahead, longer: F.struct((F.col("at") + ahead).alias("at"), (size + longer).alias("length"))
    shard = lambda role, ahead, longer: F.struct(F.lit(role).alias("role"), F.xxhash64("gram", place(ahead, longer)).alias("shard"), place(ahead, longer).alias("place"))
    rows = signed.select("word", "n", F.inline(F.array(shard(STANDS, 0, 0), shard(LONGER, 0, 1), shard(LATER, 1, 1))))
    folder = workspace(words.sparkSession, "near_words")
    rows = written(rows, f"{folder}/shards")
    sizes = rows.filter(F.col("role") == STANDS).groupBy("shard").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > most)
    large = written(sizes.select("shard", F.ceil(F.col("size") / F.lit(most)).cast("int").alias("parts")), f"{folder}/large")
    if large.isEmpty():
        rows = rows.withColumn("part", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.when((F.col("role") == STANDS) & (p != own), ASKS).otherwise(F.col("role")).alias("role")))
        dealt = rows.join(large, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        rows = dealt.select("word", "n", "shard", "place", F.inline(parts))

    def scan(batches):
        here, index = None, None
        for batch in batches:
            out = []
            for shard, part, role, at, length, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, part) != here:
                    here, index = (shard, part), Shard(at, length, q)
                for found in index.near(word, AHEAD[role]):
                    out.append((word, n, *found) if word < found[0] else (*found, word, n))
                if role == STANDS:
                    index.add(word, n)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["a", "a_n", "b", "b_n"])

    met = rows.select("shard", "part", "role", "place.at", "place.length", "word", "n").repartition("shard", "part").sortWithinPartitions("shard", "part", "role")
    return met.mapInArrow(scan, PAIRS).dropDuplicates(["a", "b"])


def spelling_variants(docs: DataFrame, length: int = 7, least: int = 2, times: int = 10, every: int = 31, q: int = 3, most: int = 20_000) -> DataFrame:
    """A row for each frequent word of docs (doc_id, text): word, form, root, n, n_near, form_n.

    Words are runs of letters (A-Z in lower case) of ``length`` code points or more that occur ``least`` times or more. A word's form is the most frequent of the words
    one edit away, of equally frequent ones the first by code point, if that is ``times`` as frequent or more; root is the end of the chain of forms.
    Null texts have no words, repeated rows count one by one, a null doc_id counts as an empty one; other columns are ignored; an empty table gives no rows.
    """
    if length < 2 * q:
        raise ValueError("words need two q-grams' length")
    folder = workspace(docs.sparkSession, "spelling")
    words = written(word_counts(docs, length, least, every), f"{folder}/words")
    pairs = near_pairs(words, q, most)
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    near = pairs.select(F.inline(ways)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    best = F.when(-F.col("best.less") >= F.col("n") * times, F.col("best"))
    linked = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), best["other"].alias("form"), (-best["less"]).alias("form_n"))
    linked = written(linked, f"{folder}/linked")
    # Frequencies grow tenfold from form to form, so chains are short; each round doubles the step.
    ups, k = written(linked.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), f"{folder}/roots0"), 0
    while True:
        above = ups.select(F.col("word").alias("root"), F.col("root").alias("above"))
        k += 1
        new = written(ups.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), f"{folder}/roots{k}")
        ups = new.drop("moved")
        if new.filter("moved").isEmpty():
            return linked.join(ups, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
