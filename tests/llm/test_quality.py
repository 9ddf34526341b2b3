"""The quality classifier: held-out accuracy, features against a plain version, odd rows."""

import random
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from grainflow.llm import quality
from grainflow.llm.quality import DECAY, DIMS, Classifier, Network, features_of, index_vectors, quality_scores, terms_of, word_vectors
from grainflow.llm.queries import QUERIES
from tests.llm.helpers import SF, docs_frame


def test_held_out_accuracy(spark):
    sf = SF.replace("0.01", "0.1")
    rows = QUERIES["op9_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").dropDuplicates(["doc_id"]), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    good, bad = [r for r in held if r.quality == 1], [r for r in held if r.quality == 0]
    assert np.mean([r.predicted for r in good]) > 0.97
    assert np.mean([r.predicted for r in bad]) < 0.1


def test_word_vectors_and_features_against_loops(spark):
    texts = ["Der Hund the the 12 cats!", "", "LOUD NOISE and a cat", "x"]
    index = index_vectors().astype(np.int64)
    want = np.zeros_like(index)
    ids_of = []
    for t in texts:
        flat, sizes = terms_of([t.encode()])
        ids = flat[: sizes[0]].tolist()
        ids_of.append(ids)
        for i, term in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                want[term] += index[ids[j]]
    want = want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    got = word_vectors(docs_frame(spark, list(enumerate(texts))).select("text"))
    assert np.allclose(got, want, atol=1e-5)
    rows = features_of([t.encode() for t in texts], got)
    for ids, row in zip(ids_of, rows):
        assert np.allclose(row[:DIMS], got[ids].mean(axis=0) if ids else 0, atol=1e-4) and np.isclose(row[DIMS], np.log1p(len(ids)), atol=1e-5)


def test_terms_against_a_plain_version(monkeypatch):
    """Terms word by word, on odd texts; each different word is looked up once in a call."""

    class Counting(quality._Terms):
        asked = 0

        def __getitem__(self, word):
            Counting.asked += 1
            return super().__getitem__(word)

    monkeypatch.setattr(quality, "_known", Counting())
    rng = random.Random(5)
    texts = ["".join(rng.choices(list("aB1_.é² \t\n\x0b\x0c\r\x1c\x85\xa0ⒶⅧ中ß٣🙂"), k=rng.randint(0, 12))) for _ in range(2000)] + ["", "  ", " \n ", "a a a", "AB AB ab.", "\xa0 \xa0 x", "x " * 5]
    ids, sizes = terms_of([t.encode() for t in texts])
    hashed = lambda part: quality.FIRST + xxhash.xxh32_intdigest(part.lower()) % (quality.TERMS - quality.FIRST)
    want, different = [], set()
    for t in texts:
        words = [w.decode() for w in t.encode().split()]
        different |= set(words)
        own = []
        for k, w in enumerate(words):
            if k and words[k - 1] == w:
                own.append(quality.SAME)
                continue
            for part in re.findall(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+", w):
                own += [quality.DIGITS] if part.isdigit() else [quality.CAPITALS, hashed(part)] if part.isalpha() and len(part) > 1 and part.isupper() else [hashed(part)]
        want.append(own)
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in [*w, *[quality.PAD] * quality.REACH]]
    assert Counting.asked == len(different | {""})


def test_odd_rows(spark):
    docs = docs_frame(spark, [(1, None), (None, "a"), (2, ""), (2, ""), (3, "word " * 50_000)]).withColumn("score", F.lit("clash")).withColumn("features", F.lit(0))
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (None, 1), (2, None), (2, 7)], "doc_id long, quality int")
    out = quality_scores(docs, labels).collect()
    assert len(out) == 5 and len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    assert [r.held_out for r in out if r.doc_id is None] == [None]
    assert quality_scores(docs, labels.limit(0)).count() == 5
    assert quality_scores(docs.limit(0), labels).count() == 0
    kept = Classifier(docs, labels).kept(docs)
    assert kept.columns == docs.columns
    scores = Classifier(docs, labels).scores().collect()
    assert kept.count() == sum(r.score >= 0.3 for r in scores)


def test_network_and_temperature_against_loops():
    """Scores node by node; the weights are a place where the loss is flat; the temperature is the best of those tried."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 2, (300, DIMS + 1))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(0, 1.5, 300) > 1).astype(np.int64)
    held = np.arange(300) % 4 == 0
    net = Network(x, y, held)
    for row, score in zip(x[:20], net.score(x[:20])):
        z = [(row[j] - net.mean[j]) / net.scale[j] for j in range(DIMS + 1)]
        hidden = [np.tanh(sum(z[j] * net.w[0][j, k] for j in range(DIMS + 1)) + net.w[1][k]) for k in range(len(net.w[1]))]
        out = sum(h * w for h, w in zip(hidden, net.w[2])) + net.w[3][0]
        assert np.isclose(score, 1 / (1 + np.exp(-out / net.temperature)))
    z, t = net.logit(x[held]), y[held]
    loss = lambda g: -np.mean(np.where(t == 1, np.log(1 / (1 + np.exp(-z / g))), np.log(1 - 1 / (1 + np.exp(-z / g)))))
    assert all(loss(net.temperature) <= loss(g) + 1e-9 for g in np.exp(np.linspace(np.log(0.25), np.log(4), 121)))
    fit = ~held

    def cost(w):
        keep, net.w = net.w, w
        out = net.logit(x[fit])
        net.w = keep
        return np.mean(np.logaddexp(0, out) - y[fit] * out) + DECAY / 2 * ((w[0] ** 2).sum() / fit.sum() ** 0.5 + (w[2] ** 2).sum())

    start = Network(x[:0], y[:0], held[:0])
    moved = [w.copy() for w in net.w]
    moved[0] += 0.3 * rng.normal(size=moved[0].shape)
    assert cost(net.w) < cost(moved) and cost(net.w) < 0.7 * cost(start.w)
    assert np.mean((net.score(x[held]) > 0.5) == t) > 0.65
