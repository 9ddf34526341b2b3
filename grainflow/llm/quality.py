"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Terms are runs of letters (lower case), digits and other characters; marks stand for capitals and for a word
repeated at once. Terms are hashed to ``TERMS`` buckets. A bucket's index vector is a fixed sparse random one; its word vector is
the sum of the index vectors of all terms around it (and itself) in the whole corpus, scaled to length 1. A document is the mean of its terms' word vectors
and the logarithm of their number.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainflow.llm.common import in_small_batches, text_or_empty, workspace, written

TERMS, DIMS, ONES, REACH, SEED = 1 << 13, 32, 4, 2, 20
PAD, CAPITALS, DIGITS, SAME, FIRST = 0, 1, 2, 3, 4
HIDDEN, STEPS, RATE, DECAY = 16, 600, 0.02, 1e-3
#: Labelled rows that the network learns from at most: those whose ids' hashes are below a cut.
MOST_LABELLED = 20_000
_PARTS = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
_MARKS = frozenset(string.punctuation)
_WORDS_KEPT = 100_000
#: Counters of a term: two for each dimension, +1 and -1, and one that PAD's codes go to.
_WIDTH = 2 * DIMS + 1


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    out = np.zeros((TERMS, DIMS), np.int16)
    for row in out[1:]:  # PAD has none
        row[rng.choice(DIMS, ONES, replace=False)] = rng.choice([-1, 1], ONES)
    return out


@lru_cache(maxsize=1)
def index_codes() -> np.ndarray:
    """TERMS x ONES: where the index vectors aren't 0, as twice the dimension, one more for -1."""
    index = index_vectors()
    out = np.full((TERMS, ONES), 2 * DIMS)
    term, dim = np.nonzero(index)
    out[1:] = (2 * dim + (index[term, dim] < 0)).reshape(-1, ONES)
    return out


def _packed(term: int) -> bytes:
    return term.to_bytes(4, "little")


def _hashed(part: str) -> bytes:
    return _packed(FIRST + xxhash.xxh32_intdigest(part.lower()) % (TERMS - FIRST))


_mark = lru_cache(maxsize=100)(_hashed)


def _part(part: str) -> bytes:
    return _packed(CAPITALS) + _hashed(part) if part.isupper() and part.isalpha() and len(part) > 1 else _hashed(part)


class _Terms(dict):
    """Word -> its terms, four bytes each (tuples would be the garbage collector's work)."""

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            terms = _part(word)
        elif word[-1:] in _MARKS and word[:-1].isalpha():
            terms = _part(word[:-1]) + _mark(word[-1])
        else:
            terms = b"".join([_packed(DIGITS) if part.isdigit() else _part(part) for part in _PARTS.findall(word)])
        self[word] = terms
        return terms


_known = _Terms()


def terms_of(texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(terms of all texts, each text's followed by REACH times PAD; the number of terms of each text). Each different word is looked up once."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.string())
    if len(_known) > _WORDS_KEPT:
        _known.clear()
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    coded = words.flatten().dictionary_encode()
    terms = [*map(_known.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), _packed(SAME), _packed(PAD) * REACH]
    size, flat = np.fromiter(map(len, terms), np.int64, len(terms)) // 4, np.frombuffer(b"".join(terms), "<i4")
    last = np.cumsum(words.value_lengths().to_numpy() + 1) - 1
    k = np.full(len(coded) + len(texts), len(terms) - 1)
    inner = np.ones(len(k), bool)
    inner[last] = False
    k[inner] = coded.indices.to_numpy()
    k[1:][(k[1:] == k[:-1]) & inner[1:]] = len(terms) - 2
    sizes = size[k]
    stop = np.cumsum(sizes)
    at = np.repeat((np.cumsum(size) - size)[k] - (stop - sizes), sizes)
    return flat[at + np.arange(len(at))], np.diff(stop[last], prepend=0) - REACH


def _parts(texts: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """Slices of about ``most`` bytes."""
    size, at = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
    while at < len(texts):
        stop = int(np.searchsorted(size, (size[at - 1] if at else 0) + most)) + 1
        yield texts.slice(at, stop - at)
        at = stop


def word_vectors(texts: DataFrame) -> np.ndarray:
    """TERMS x DIMS, from every text of ``texts`` (text). Tasks and the shuffle add up whole numbers, so the result
    doesn't depend on their order; what reaches the driver has TERMS rows whatever the corpus."""
    columns = [f"c{k}" for k in range(DIMS)]

    def gather(batches):
        codes, counts = index_codes(), np.zeros(TERMS * _WIDTH, np.int64)
        for batch in batches:
            for part in _parts(batch.column(0)):
                ids, _ = terms_of(part)
                own, n = ids.astype(np.int64)[:, None] * _WIDTH, len(ids)
                for k in range(-REACH, REACH + 1):
                    near = own[max(0, -k) : n - max(0, k)] + codes[ids[max(0, k) : n - max(0, -k)]]
                    counts += np.bincount(near.ravel(), minlength=len(counts))
        signs = counts.reshape(TERMS, _WIDTH)[:, : 2 * DIMS].reshape(TERMS, DIMS, 2)
        total = signs[:, :, 0] - signs[:, :, 1]
        seen = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *(pa.array(total[seen, k]) for k in range(DIMS))], ["term", *columns])

    sums = texts.mapInArrow(gather, "term int, " + ", ".join(f"{c} long" for c in columns)).groupBy("term").agg(*(F.sum(c).alias(c) for c in columns))
    out = np.zeros((TERMS, DIMS))
    for row in sums.collect():
        out[row[0]] = row[1:]
    out[PAD] = 0
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features_of(texts: pa.Array | list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row for each text: the mean of its terms' vectors, and the logarithm of their number."""
    ids, sizes = terms_of(texts)
    stop, wide, sums = np.cumsum(sizes + REACH) - REACH, vectors.astype(np.float64), np.zeros((len(sizes), DIMS))
    for row, a, b in zip(sums, stop - sizes, stop):
        for k in range(a, b, 1 << 16):
            row += wide[ids[k : min(b, k + (1 << 16))]].sum(axis=0)
    return np.column_stack([sums / np.maximum(sizes, 1)[:, None], np.log1p(sizes)]).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and features of each row of docs (doc_id, text)."""

    def pool(batches):
        for batch in batches:
            rows = [features_of(part, vectors) for part in _parts(batch.column(1))]
            if rows:
                features = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(rows).ravel()), DIMS + 1).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), features], ["doc_id", "features"])

    return docs.mapInArrow(pool, "doc_id long, features array<float>")


class Network:
    """Two layers, full-batch Adam, then a temperature that fits held-back rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray):
        x = np.asarray(x, np.float64).reshape(-1, DIMS + 1)
        fit = ~calibrate if (~calibrate).any() else np.ones(len(y), bool)
        self.mean, self.scale = (x[fit].mean(0), x[fit].std(0) + 1e-6) if len(y) else (np.zeros(DIMS + 1), np.ones(DIMS + 1))
        rng, n = np.random.default_rng(SEED), DIMS + 1
        self.w = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        if len(y):
            self._fit((x[fit] - self.mean) / self.scale, y[fit].astype(np.float64))
            held = calibrate if calibrate.any() else fit
            z, t = self.logit(x[held]), y[held]
            grid = np.exp(np.linspace(np.log(0.25), np.log(4), 121))
            loss = [np.mean(np.logaddexp(0, z / g) - t * z / g) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, STEPS + 1):
            h = np.tanh(x @ self.w[0] + self.w[1])
            error = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - y) / len(y)
            back = np.outer(error, self.w[2]) * (1 - h * h)
            grads = [x.T @ back + DECAY * self.w[0] / len(y) ** 0.5, back.sum(0), h.T @ error + DECAY * self.w[2], np.array([error.sum()])]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.w[k] = self.w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


class Classifier:
    """Word vectors and network, fitted from docs (doc_id, text) and labels (doc_id, quality).

    Vectors come from every text. Of labelled rows, those whose crc32 of the id as text is 0 modulo 5 aren't used, remainder 1 fits the
    temperature, the rest the weights. Labels without id or quality are left out, repeated ones count once each. Without
    labels the network scores as it starts.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED):
        rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        self.vectors = word_vectors(rows.select("text"))
        self.features = written(pooled(rows, self.vectors), f"{workspace(docs.sparkSession, 'quality')}/features")
        marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(fold() != 0).distinct()
        learnt = self.features.join(marked, "doc_id").select("doc_id", "features", "quality", fold().alias("fold"))
        # Hashes below a cut keep about most_labelled rows; a sort with a limit would send as many from every task.
        place, n = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), learnt.count()
        near = learnt.withColumn("place", place).filter(F.col("place") < int(min(1.0, most_labelled / max(n, 1)) * (1 << 40)))
        sample = sorted(near.collect(), key=lambda r: (r.place, r.doc_id, r.quality, r.features))[:most_labelled]
        x, y = np.array([r.features for r in sample], np.float64), np.array([r.quality for r in sample], np.int64)
        self.network = Network(x, y, np.array([r.fold == 1 for r in sample], bool))

    def scores(self) -> DataFrame:
        """doc_id and score of each row that the classifier was fitted with."""
        network = self.network

        def score(batches):
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(1).flatten().to_numpy().reshape(-1, DIMS + 1).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.score(x))], ["doc_id", "score"])

        return self.features.mapInArrow(score, "doc_id long, score double")

    def kept(self, docs: DataFrame, threshold: float = 0.3) -> DataFrame:
        """The rows of docs, all columns, whose text scores ``threshold`` or more. Texts are read where they are: nothing is shuffled."""
        network, vectors, names = self.network, self.vectors, docs.columns

        def keep(batches):
            for batch in batches:
                at = 0
                for part in _parts(pc.fill_null(batch.column(names.index("text")), "")):
                    x = features_of(part, vectors)
                    yield batch.slice(at, len(part)).filter(pa.array(network.score(x.astype(np.float64)) >= threshold))
                    at += len(part)

        return docs.mapInArrow(keep, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, held_out (its label isn't used), score, predicted.

    See ``Classifier``. Nulls count as empty texts, which get the score of a document without terms. held_out is null for a null
    doc_id. Other columns are ignored. No documents give no rows.
    """
    scored = Classifier(docs, labels, most_labelled).scores()
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
