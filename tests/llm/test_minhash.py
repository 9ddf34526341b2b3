"""MinHash near duplicates against SQL and against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from grainflow.llm.minhash_hamming import DISTANCE, SLOTS, bucket_links, differing, minhash_components, signature
from grainflow.llm.oracles import MINHASH
from grainflow.llm.queries import op13_minhash_hamming
from grainflow.llm.set_links import forest, similar_groups, similar_to
from tests.llm.helpers import SF, docs_frame, spark_rows, sql_rows


def test_against_sql(spark):
    assert spark_rows(op13_minhash_hamming(spark, SF)) == sql_rows(MINHASH)


def plain_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    return frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain(rows, over=85, under=100):
    """(doc_id, n_shingles, component_id, kept) of rows with ids of their own, by all pairs of different sets."""
    sets = [plain_set(t) for _, t in rows]
    root = {s: s for s in sets}

    def top(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in combinations(list(root), 2):
        both = len(a & b)
        if both and under * both >= over * len(a | b):
            root[top(a)] = top(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s:
            least[top(s)] = min(i, least.get(top(s), i))
    found = [(i, len(s), least[top(s)] if s else i) for (i, _), s in zip(rows, sets)]
    return sorted((i, n, c, i == c) for i, n, c in found)


def copies(rng, n, share, words=160):
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    return [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("most", [20_000, 30])
def test_against_all_pairs(spark, most):
    """Large groups about the threshold, small ones, exact copies; with buckets dealt out and without."""
    rng = random.Random(5)
    texts = copies(rng, 300, 0.012) + copies(rng, 80, 0.006) + [t for k in range(60) for t in copies(rng, 2, 0.01, rng.randint(5, 200))]
    rows = list(enumerate(texts + texts[::7]))
    rng.shuffle(rows)
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_components(docs_frame(spark, rows), most=most).collect()]
    assert sorted(found) == plain(rows)


@pytest.mark.parametrize("share,most", [(0.01, 25), (0.016, 25), (0.03, 10)])
def test_clouds_in_parts(spark, share, most, tmp_path):
    """One cloud in many parts, whether its members are one group, some or none, gives what all pairs give."""
    from grainflow.llm.simhash_fingerprint import shingle_set

    sets = [shingle_set(t) for t in copies(random.Random(3), 150, share)]
    rows = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(sets)], "node long, shingles binary")
    members = spark.createDataFrame([(0, k, len(s)) for k, s in enumerate(sets)], "cloud long, node long, size long")
    stars = {r.node: r.root for r in similar_groups(members, rows, 85, 100, f"file://{tmp_path}", most=most).collect()}
    root = list(range(len(sets)))
    for a, b in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    assert [stars.get(k, k) for k in range(len(sets))] == root


def test_forest_links_as_all_pairs_do():
    rng = np.random.default_rng(2)
    for n, p in [(2, 0.5), (9, 0.2), (40, 0.03), (40, 0.5), (1, 1.0)]:
        adjacent = rng.random((n, n)) < p
        adjacent |= adjacent.T
        label = list(range(n))
        for a, b in forest(np.arange(n), lambda x: adjacent[x].copy()):
            assert adjacent[a, b]
            label = [label[a] if v == label[b] else v for v in label]
        want = list(range(n))
        for a, b in zip(*np.nonzero(adjacent)):
            want = [want[a] if v == want[b] else v for v in want]
        assert len({*zip(label, want)}) == len({*label}) == len({*want})


def test_similar_to():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4], [2, 3, 4, 5], [1, 2, 3, 4], [9], [])]
    near = similar_to(sets, 60, 100)
    assert [near(k).tolist()[:4] for k in range(4)] == [[True, True, True, False]] * 3 + [[False, False, False, True]]
    assert not near(4).any()


def test_signatures_estimate_similarity():
    """Slots differ about as often as shingles do; nothing within the distance is lost in a bucket; bytes never differ more than slots."""
    rng = np.random.default_rng(1)
    differ = []
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
        b = np.unique(np.concatenate([a[32:], rng.integers(0, 1 << 63, 32, dtype=np.uint64)]))
        x, y = signature(a), signature(b)
        differ.append((x != y).sum())
        near = np.stack([(s & 255).astype(np.uint8).view(np.uint64) for s in (x, y)])
        assert differing(near, 0, 1) <= differ[-1]
    assert abs(np.mean(differ) / SLOTS - 64 / 432) < 0.03 and max(differ) <= DISTANCE
    near = rng.integers(0, 1 << 63, (90, 4), dtype=np.uint64)
    near[30:60] = near[:30]
    found = list(bucket_links(np.array([0] * 60 + [1] * 3 + [2] * 27), np.arange(90), near))
    assert sorted((min(a, b), max(a, b)) for x, y in found for a, b in zip(x, y)) == [(k, k + 30) for k in range(30)]


def test_edges(spark):
    """Nulls, no words, short and very long texts, repeated rows and ids, null ids, clashing names, an empty table."""
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, None), (2, " \t"), (3, "A b c"), (4, "a B\tc"), (4, "a B\tc"), (5, long), (6, long + " end"), (None, long), (None, "x y"), (None, "x y"), (7, "ä"), (8, "Ä")]
    docs = docs_frame(spark, rows).withColumnRenamed("lang", "node").withColumnRenamed("source", "part")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_components(docs).collect()), key=repr)
    n = 200_000 - 4
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False), (5, n, 5, True), (6, n + 1, 5, False), (None, n, 5, False), (None, 1, None, True), (None, 1, None, True), (7, 1, 7, True), (8, 1, 8, True)]
    assert found == sorted(want, key=repr)
    assert minhash_components(docs_frame(spark, [])).collect() == []
