"""SimHash fingerprints of whole texts, and what near-duplicate detection needs besides: blocks and sets of shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainflow.llm.common import in_small_batches, text_or_empty

SHINGLE, SEED, PART = 4, 42, 1 << 16
#: Shingles of near-duplicate detection; bands of as many minima, of which two texts that are to meet share one.
SIMILAR_SHINGLE, BANDS, MINIMA = 5, 10, 3
#: BITS[v, b] is bit b of byte v, most significant bit first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_OFFSET = np.arange(8, dtype=np.int64) * 256
_MIX = np.random.default_rng(11).integers(1, 1 << 63, (2, BANDS * MINIMA), dtype=np.uint64) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """In bytes only A-Z are lower-cased, and white space is \\x20 \\x09-\\x0d."""
    return (text or "").encode().lower().split()


def shingle_bytes(words: list[bytes], length: int):
    """Yields the XXH64 digests of the shingles, ``PART`` at a time; fewer words than ``length`` are one shingle."""
    n = max(1, len(words) - length + 1) if words else 0
    for at in range(0, n, PART):
        part = words[at : min(at + PART, n) + length - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(length)))) if len(words) >= length else [b" ".join(words)]
        yield np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)


def _majority(parts, n: int) -> int:
    """A bit is 1 if it is in over half of the ``n`` digests."""
    seen = np.zeros(2048, np.int64)
    for digests in parts:
        seen += np.bincount((digests + _OFFSET).ravel(), minlength=2048)  # how often each byte has each value
    ones = np.einsum("kv,vb->kb", seen.reshape(8, 256), _BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint(text: str) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for a text without words."""
    words = words_of(text)
    return _majority(shingle_bytes(words, SHINGLE), max(1, len(words) - SHINGLE + 1)) if words else 0


def shingle_set(text: str | None) -> np.ndarray:
    """The different shingles of a text, as ascending hashes."""
    parts = [d.view(">u8").ravel() for d in shingle_bytes(words_of(text), SIMILAR_SHINGLE)]
    return np.unique(np.concatenate(parts).astype(np.uint64)) if parts else np.zeros(0, np.uint64)


def sketch(text: str | None) -> tuple[bytes, int, int, list[int]]:
    """(128-bit hash of the words, number of different shingles, their fingerprint, blocks). A text without words has no block."""
    digest = xxhash.xxh3_128_digest(b" ".join(words_of(text)))
    found = shingle_set(text)
    if not len(found):
        return digest, 0, 0, []
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), PART // 8):
        part = found[at : at + PART // 8, None]
        least = np.minimum(least, ((part ^ part >> np.uint64(29)) * _MIX[0] + _MIX[1]).min(axis=0))
    band = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, MINIMA).T:
        band = (band ^ column) * _MIX[0, 0]
        band ^= band >> np.uint64(32)
    return digest, len(found), _fingerprint_of(found), band.view(np.int64).tolist()


def _fingerprint_of(found: np.ndarray) -> int:
    hashes = found ^ found >> np.uint64(32)
    return _majority((hashes[at : at + PART].astype(">u8").view(np.uint8).reshape(-1, 8) for at in range(0, len(hashes), PART)), len(hashes))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (long) for each row of docs (doc_id, text); null texts are empty ones."""

    def scan(batches):
        for batch in batches:
            fp = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(scan, "doc_id long, fp long")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, tie (the text's hash), digest, size, fp and blocks of ``sketch`` for each row of docs (doc_id, text)."""
    names, types = ["doc_id", "tie", "digest", "size", "fp", "blocks"], [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def scan(batches):
        for batch in batches:
            found = zip(*(sketch(t.as_py()) for t in batch.column(2))) if batch.num_rows else [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, t) for x, t in zip(found, types))], names)

    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tie"), text_or_empty().alias("text"))
    return rows.mapInArrow(scan, "doc_id long, tie long, digest binary, size long, fp long, blocks array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node and shingles (ascending hashes, 8 bytes each) for each row of texts (node, text)."""

    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(scan, "node long, shingles binary")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
