"""Mixing: shares, permutations and draws against plain versions; the words taken against the texts written."""

from collections import Counter
from math import comb

import numpy as np
from pyspark.sql import functions as F

from grainflow.llm.mixing import DRAWN, Mix, hypergeometric, permuted, plan_shares, shard_counts, split_quota, targets
from grainflow.llm.queries import QUERIES
from tests.llm.helpers import SF, docs_frame, spark_rows


def test_targets():
    assert targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert targets([10, 1000, 100], [5, 2, 1]) == [30.0, 720.0, 360.0] or sum(targets([10, 1000, 100], [5, 2, 1])) == 1110
    capped = targets([10, 1000, 100], [5, 2, 1])
    assert capped[0] == 30 and capped[2] <= 300 and abs(sum(capped) - 1110) < 1e-9


def test_permutation_and_draws():
    for n in (1, 2, 3, 17, 1000, 4096):
        assert sorted(permuted(np.arange(n), n, 3, 1, 0).tolist()) == list(range(n))
    quota, per = np.array([5, 0, 77, 4000]), 100
    shards = -(-int(quota.sum()) // per)
    before = np.zeros(4, np.int64)
    for s in range(shards):
        at, here = shard_counts(quota, per, s, 9)
        assert (at == before).all() and here.sum() == min(per, quota.sum() - s * per)
        before = before + here
    assert (before == quota).all()


def test_small_sources_meet_their_targets_at_long_blocks():
    for n in (2000, 700, 5000):
        for s in plan_shares([(f"s{i:06}", n) for i in range(3000)], 2048):
            assert s.slots and abs(s.slots * s.size / s.blocks - s.target) <= max(8, s.target / 100)
    for s in plan_shares([("a", 10**7), *((f"b{i:04}", 900 + i) for i in range(300))], 2048):
        assert s.slots and abs(s.slots * s.size / s.blocks - s.target) <= max(8, s.target / 100)


def test_words_taken_from_small_sources(spark):
    docs = docs_frame(spark, [(i, f"w{i} " * 250, f"s{i % 30:02}") for i in range(240)])
    taken, target = Counter(), {}
    for r in Mix(docs).taken().collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(target) == 30 and all(abs(taken[s] - t) <= 0.05 * t for s, t in target.items())


def test_query(spark):
    rows = QUERIES["op10_mixing"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    sizes = Counter()
    for d in docs.values():
        sizes[d.source] += len((d.text or "").encode().split())
    want = {s.source: s.target for s in plan_shares(list(sizes.items()))}
    taken = Counter()
    for r in rows:
        d = docs[r.doc_id]
        assert r.size == len((d.text or "").encode().split()) and r.source_size == sizes[d.source] and abs(r.target - want[d.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[d.source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(0.02 * target, 64), source
    assert spark_rows(QUERIES["op10_mixing"](spark, SF))[1] == sorted((tuple(r[c] for c in sorted(r.asDict())) for r in rows), key=repr)


def test_draws_of_any_size():
    rng = np.random.default_rng(5)
    for good, bad, take in ((7, 5, 6), (3, 9, 10), (1, 1, 1), (0, 4, 2), (4, 0, 3), (5, 5, 0)):
        lo, hi, all_ = max(0, take - bad), min(good, take), comb(good + bad, take)
        seen = Counter(hypergeometric(good, bad, take, rng) for _ in range(4000))
        for x in range(lo, hi + 1):
            p = comb(good, x) * comb(bad, take - x) / all_
            assert abs(seen[x] / 4000 - p) < 5 * (p * (1 - p) / 4000) ** 0.5 + 1e-9
    good, bad, take = 10**9, 3 * 10**9, 25 * 10**8
    draws = np.array([hypergeometric(good, bad, take, rng) for _ in range(1500)], float)
    var = take * 0.25 * 0.75 * (good + bad - take) / (good + bad - 1)
    assert abs(draws.mean() - take / 4) < 5 * (var / 1500) ** 0.5 and 0.8 < draws.var() / var < 1.2
    quota = np.array([DRAWN, 5, 0, 2 * DRAWN])
    drawn = split_quota(quota, DRAWN, rng)
    assert drawn.sum() == DRAWN and (drawn <= quota).all() and abs(int(drawn[0]) - DRAWN // 3) < 10**6


def test_taken_by_a_plain_version(spark):
    """Documents laid end to end in the order of their keys, blocks cut from the list of words, and every slot counted word by word."""
    rows = [(i, f"w{i} " * (i * 37 % 400), f"s{i % 3}") for i in range(300)] + [(500, "x y z", "s1")] * 9 + [(None, "n1 n2", None), (None, None, None), (501, "a " * 3000, "s2")]
    docs = docs_frame(spark, rows)
    mix = Mix(docs, per_shard=32, seed=3, block_words=64)
    keyed = [(r.doc_id, r.source, r.tie, r.h, len(r.t.split())) for r in docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).alias("h")).collect()]
    slots = mix.slots.collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots) == sum(s.slots for s in mix.shares)
    want = Counter()
    for k, share in enumerate(mix.shares):
        mine = [r for r in keyed if r[1] == share.source]
        buckets = -(-len({r[:3] for r in mine}) // 256)
        mine.sort(key=lambda r: (r[3] % buckets, r[2], -1 if r[0] is None else r[0]))
        words = [(r[0], r[4]) for r in mine for _ in range(r[4])]
        blocks = [words[at : at + share.length] for at in range(0, len(words), share.length)]
        assert len(blocks) == share.blocks and len(words) == share.size
        uses = Counter((r.round, r.block) for r in slots if r.source_no == k)
        assert all(n == 1 for n in uses.values()) and len(uses) == share.slots
        for _, block in uses:
            want.update((*w, share.source) for w in blocks[block])
    got = Counter()
    for r in mix.taken().collect():
        got[r.doc_id, r.size, r.source] += r.taken
    assert {k: n for k, n in got.items() if n} == dict(want) and sum(got.values()) == sum(want.values())
    assert mix.taken().count() == len(rows)
    again = Mix(docs.repartition(5), per_shard=32, seed=3, block_words=64)
    assert spark_rows(again.taken()) == spark_rows(mix.taken()) and spark_rows(again.texts(docs.repartition(3))) == spark_rows(mix.texts(docs))


def test_texts_hold_the_words_taken(spark):
    docs = docs_frame(spark, [(i, f"w{i} " * (i * 7 % 90), f"s{i % 3}") for i in range(60)] + [(99, None, None), (None, "n1 n2", None), (7, "w7 " * 49, "s1"), (8, "", "s2")]).withColumn("gf_id", F.lit(1))
    mix = Mix(docs, per_shard=16)
    taken = {}
    for r in mix.taken().collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    got = Counter()
    out = mix.texts(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and r.text
    assert dict(got) == {k: v for k, v in taken.items() if v}
    assert Mix(docs.limit(0)).taken().count() == 0 and Mix(docs.limit(0)).texts(docs.limit(0)).count() == 0
