import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from grainflow.llm import queries
from grainflow.llm.components import components
from grainflow.llm.common import workspace
from grainflow.llm.simhash_dedup import near_distinct, simhash_components
from grainflow.llm.simhash_fingerprint import fingerprint
from grainflow.llm.trie_join import block_masks, near_edges, trie_links
from tests.llm.helpers import SF, docs_frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    return brute_of_fingerprints([slow_fingerprint(t or "") for _, t in rows], [i for i, _ in rows])


def brute_of_fingerprints(fps, ids=None):
    rows = list(zip(range(len(fps)) if ids is None else ids, map(int, fps)))
    fps = np.array(sorted({f for _, f in rows}), np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4).tolist():
            root[max(find(i), find(j))] = min(find(i), find(j))
    at = {int(f): find(k) for k, f in enumerate(fps)}
    least = {}
    for i, f in rows:
        if i is not None:
            least[at[f]] = min(i, least.get(at[f], i))
    return sorted(((i, f"{f:016x}", least.get(at[f])) for i, f in rows), key=repr)


def links(fps):
    return {tuple(sorted((int(a), int(b)))) for k, a in enumerate(fps) for b in fps[k + 1 :] if np.bitwise_count(a ^ b) <= 4}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=list("abAB \t\n\x0b\x1c\xa0É"), max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_long_text():
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(150_000))
    assert fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def clustered(n, seed):
    rng = random.Random(seed)
    out = set()
    for _ in range(n // 10):
        base = rng.getrandbits(64)
        for _ in range(10):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            out.add(x)
    return np.array(sorted(out), np.uint64)


def test_trie_finds_all_pairs():
    for seed in range(3):
        fps = np.concatenate([clustered(300, seed), clustered(200, seed + 9)])
        group = np.repeat([0, 1], [len(clustered(300, seed)), len(clustered(200, seed + 9))])
        want = links(fps[group == 0]) | links(fps[group == 1])
        got = {(int(fps[i]), int(fps[j])) for a, b in trie_links(group, fps, 4) for i, j in zip(a, b)}
        assert got == want


def test_masks():
    masks = block_masks(0, 4)
    assert len(masks) == 5 and np.bitwise_or.reduce(np.array(masks, np.uint64)) == np.uint64(2**64 - 1)
    assert all(len(block_masks(m, 4)) == 5 for m in masks) and block_masks(2**61 - 1, 4) == []


def test_edges_with_split_groups(spark):
    fps = clustered(400, 3)
    frame = spark.createDataFrame([(int(x), int(x)) for x in fps.view(np.int64)], "fp long, node long")
    for most in (50_000, 20):
        edges = [(r.a % 2**64, r.b % 2**64) for r in near_edges(frame, 4, most).collect()]
        got = components(spark.createDataFrame([(int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))) for a, b in edges], "a long, b long"), workspace(spark, "test"))
        root = {r.node: r.root for r in got.collect()}
        want = {int(np.uint64(int(f, 16)).view(np.int64)): c for _, f, c in brute_of_fingerprints(fps)}
        of = lambda f: root.get(f, f)
        assert len({(of(f), c) for f, c in want.items()}) == len({of(f) for f in want}) == len(set(want.values()))


def test_long_chain(spark):
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b")
    got = components(chain, workspace(spark, "test")).collect()
    assert len(got) == 300 and {r.root for r in got} == {0}


ROWS = [(1, "a b c d e f g h"), (2, "A b\tc d e f g h"), (3, None), (4, " \n"), (5, "one"), (5, "one"), (None, "one two"), (7, "x " * 9000), (8, "x " * 9001)]


def test_edges_of_tables(spark):
    docs = docs_frame(spark, ROWS).selectExpr("*", "1 as fp", "'x' as root", "2 as node")
    got = simhash_components(docs)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=repr) == brute(ROWS)
    assert simhash_components(docs_frame(spark, [])).count() == 0


def test_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = queries.op2_simhash_trie(spark, SF).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == brute([(d["doc_id"], d["text"]) for d in docs])


def similar_groups(rows, similarity=0.8):
    """Sets of positions: rows whose sets of five-word shingles are alike, by comparing all pairs that share a shingle."""
    root, where, sets = list(range(len(rows))), {}, []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, text in enumerate(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
        shared = {}
        for s in sets[-1]:
            for j in where.setdefault(s, []):
                shared[j] = shared.get(j, 0) + 1
            where[s].append(k)
        for j, n in shared.items():
            if n >= similarity * (len(sets[k]) + len(sets[j]) - n):
                root[max(find(j), find(k))] = min(find(j), find(k))
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), set()).add(k)
    return list(groups.values())


def near_copies(groups, copies, changed, seed, words=(60, 400)):
    """Texts in groups: a base, and copies of it with a share of its words replaced."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(*words))]
        yield " ".join(base)
        for _ in range(copies):
            yield " ".join(word() if rng.random() < changed else w for w in base)


def lost_and_right(spark, texts):
    """(rows kept that comparing all pairs drops, rows that it drops); no row is dropped that it keeps."""
    want = {min(g) for g in similar_groups(texts)}
    kept = {r.doc_id for r in near_distinct(docs_frame(spark, list(enumerate(texts)))).collect()}
    assert kept >= want
    return len(kept - want), len(texts) - len(want)


def test_near_distinct_finds_what_all_pairs_find(spark):
    """Groups of two to five texts whose similarity is about 0.8: of the rows that go, 199 in 200 are found."""
    lost, right = lost_and_right(spark, [*near_copies(200, 3, 0.02, 1), *near_copies(60, 4, 0.005, 2), *near_copies(150, 1, 0.1, 3), *near_copies(100, 2, 0.03, 5, (6, 30))])
    assert right > 600 and lost <= 0.005 * right


@pytest.mark.parametrize("copies,changed,seed,words", [(400, 0.006, 4, (300, 300)), (400, 0.015, 4, (60, 400)), (400, 0.02, 9, (60, 400)), (1500, 0.015, 5, (60, 400))])
def test_near_distinct_in_a_large_group(spark, copies, changed, seed, words):
    """Groups whose pairs mostly, rarely or hardly reach 0.8: of the rows that go 99 in 100 are found."""
    lost, right = lost_and_right(spark, list(near_copies(1, copies, changed, seed, words)))
    assert right > 0.3 * copies and lost <= 0.01 * right, (lost, right)


def test_near_distinct_with_blocks_in_parts(spark):
    """Blocks of more than 20 fingerprints, at 18 bits, lose no more than whole ones."""
    texts = list(near_copies(1, 250, 0.015, 4))
    want = {min(g) for g in similar_groups(texts)}
    kept = {r.doc_id for r in near_distinct(docs_frame(spark, list(enumerate(texts))), most=20).collect()}
    assert kept >= want and len(kept - want) <= 0.01 * (len(texts) - len(want))


def test_near_distinct_edges(spark):
    """Rows without words are one group, null ids come last, one of several equal rows stays, columns keep their names."""
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text), (2, text.upper()), (2, text.upper()), (None, text), (None, "other words are in this text, not the same"), (5, None), (6, ""), (7, "word"), (8, "Word"), (9, "long " * 300_000), (10, "short words")]
    docs = docs_frame(spark, rows).selectExpr("*", "1 AS gone", "2 AS tie", "3 AS node", "4 AS gf_id")
    got = near_distinct(docs)
    assert got.columns == docs.columns and sorted((r.doc_id for r in got.collect()), key=repr) == [10, 2, 5, 7, 9, None]
    assert near_distinct(docs.limit(0)).count() == 0
    differing = docs_frame(spark, [(1, text, "b"), (1, text, "a"), (1, text, "c")])
    assert len({near_distinct(differing.repartition(n)).first().source for n in (1, 2, 3)}) == 1
