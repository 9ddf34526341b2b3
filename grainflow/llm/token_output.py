"""Token-ID output in a binary format of byte or bit planes.

A shard file holds the ids of a range of doc_ids, document after document:

    magic | chunk 0 | chunk 1 | ... | documents | footer | length of the footer (4 bytes) | magic

A chunk is ``chunk_ids`` ids (the last one of a shard may be shorter), transposed into planes: plane k of 4 has byte k of
each id, or plane k of 32 has bit k of each. Planes are compressed one by one with zstandard. ``documents`` is the list of
doc_ids and lengths. The footer (JSON) has the kind of plane, and for each chunk its offset, ids and the planes' sizes.

A task writes its shard under a name of its own and moves it to the final name, so a task that runs again leaves the
same file. The manifest, a Parquet table with a row for each shard, is written by Spark when all shards are there.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainflow.llm.common import in_small_batches, text_or_empty

MAGIC = b"GFPLANE1"
MANIFEST = "shard int, file string, n_docs long, n_ids long, n_bytes long"
NO_ID = -(2**63)  # stands for a null doc_id in a file


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of an array of unsigned 32-bit integers."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class ShardWriter:
    def __init__(self, out, kind: str = "byte", chunk_ids: int = 1 << 16, level: int = 3):
        self.out, self.kind, self.chunk_bytes = out, kind, chunk_ids * 4
        self.packer = zstandard.ZstdCompressor(level=level)
        self.held, self.at, self.chunks, self.docs, self.n_ids = bytearray(), len(MAGIC), [], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((NO_ID if doc_id is None else doc_id, len(ids) // 4))
        self.n_ids += len(ids) // 4
        self.held += ids
        at = 0
        while len(self.held) - at >= self.chunk_bytes:
            self._chunk(bytes(self.held[at : at + self.chunk_bytes]))
            at += self.chunk_bytes
        del self.held[:at]

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _chunk(self, ids: bytes) -> None:
        start = self.at
        sizes = [self._put(self.packer.compress(p)) for p in to_planes(np.frombuffer(ids, "<u4"), self.kind)]
        self.chunks.append([start, len(ids) // 4, sizes])

    def close(self) -> int:
        if self.held:
            self._chunk(bytes(self.held))
        docs = [self.at, self._put(self.packer.compress(np.array(self.docs, "<i8").tobytes())), len(self.docs)]
        footer = json.dumps({"kind": self.kind, "n_ids": self.n_ids, "chunks": self.chunks, "docs": docs}).encode()
        self._put(footer + struct.pack("<I", len(footer)) + MAGIC)
        return self.at


class ShardReader:
    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 12)
        length, magic = struct.unpack("<I8s", file.read(12))
        if magic != MAGIC:
            raise ValueError("not a shard file, or one that ends early")
        file.seek(size - 12 - length)
        self.footer = json.loads(file.read(length))
        self.unpacker = zstandard.ZstdDecompressor()

    def docs(self) -> np.ndarray:
        """Rows of doc_id and number of ids."""
        start, size, n = self.footer["docs"]
        self.file.seek(start)
        return np.frombuffer(self.unpacker.decompress(self.file.read(size)), "<i8").reshape(n, 2)

    def chunk(self, k: int) -> np.ndarray:
        """Any chunk, found through the chunk index."""
        start, n, sizes = self.footer["chunks"][k]
        self.file.seek(start)
        return from_planes([self.unpacker.decompress(self.file.read(s)) for s in sizes], n, self.footer["kind"])

    def documents(self):
        """(doc_id, the document's ids in one or more arrays) in order; one chunk is in memory at a time."""
        k, held = -1, np.zeros(0, "<u4")
        for doc_id, n in self.docs().tolist():
            parts = []
            while n:
                if not len(held):
                    k += 1
                    held = self.chunk(k)
                parts.append(held[:n])
                n -= len(parts[-1])
                held = held[len(parts[-1]) :]
            yield None if doc_id == NO_ID else doc_id, parts


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, kind: str = "byte", chunk_ids: int = 1 << 16, shards: int | None = None) -> DataFrame:
    """Encodes each whole text and writes shard files and the manifest under ``folder``, in ascending doc_id order.

    docs: doc_id, text; a null text is an empty one, other columns are ignored. Null doc_ids come first; rows with the same
    doc_id follow each other in the order of their texts' hashes. An empty table gives a manifest without rows. ``shards``: how many files at most (else as many
    as Spark has shuffle partitions after it coalesced them). Returns the manifest.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches):
        from grainflow.llm.encoding import encoder

        encode, writer, shard = encoder(tokenizer).encode, None, TaskContext.get().partitionId()
        store, root = pafs.FileSystem.from_uri(folder)
        name = f"shard-{shard:06d}.planes"
        for batch in batches:
            if batch.num_rows and writer is None:
                store.create_dir(root, recursive=True)
                own = f"{root}/.{name}.{uuid.uuid4().hex}"
                out = store.open_output_stream(own)
                writer = ShardWriter(out, kind, chunk_ids)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer.add(doc_id, encode(text.as_py()) + end)
        if writer is not None:
            n_bytes = writer.close()
            out.close()
            store.move(own, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids], "n_bytes": [n_bytes]})

    rows.sortWithinPartitions(*order).mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Each document of a folder's shard files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and,
    if asked for, ids as an array. A task reads one file, chunk by chunk."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("shard", "file", F.coalesce(before, F.lit(0)).alias("start"))
    spread = placed.repartitionByRange(max(1, manifest.count()), "shard").select("file", "start")

    def digest(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{file}") as source:
                    rows = []
                    for doc_id, parts in ShardReader(source).documents():
                        n, crc = 0, 0
                        for p in parts:
                            n, crc = n + len(p), zlib.crc32(np.ascontiguousarray(p), crc)
                        rows.append((doc_id, start, n, crc, np.concatenate(parts).astype("i8") if with_ids and parts else []))
                        start += n
                        if len(rows) >= (256 if with_ids else 8192):
                            yield _batch(rows, with_ids)
                            rows = []
                    if rows:
                        yield _batch(rows, with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return spread.mapInArrow(digest, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    doc_id, start, n, crc, ids = zip(*rows)
    columns = {"doc_id": pa.array(doc_id, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
    return pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(ids, pa.list_(pa.int64()))} if with_ids else {}))
