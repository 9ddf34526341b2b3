"""The flat field of images of any size: a truncated SVD by a randomised range finder.

Images are rows with an array of d pixels. The range of the centred matrix is found by subspace iteration from random vectors: a pass over the images multiplies
each by the k vectors at hand and adds up, per block of pixels, the products with the result; only blocks of d x k numbers are shuffled, summed by
their number. No d x d matrix exists, the driver sees k x k numbers, and the vectors lie in Parquet rows, a block each, which tasks read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.functions.storage import new_folder

#: Pixels of a block, and numbers of a set of vectors that a task keeps or adds up at once; larger ones are read block by block and summed in several passes.
BLOCK, HELD = 4096, 1 << 25
BLOCKS = "block int, mean array<double>, vectors array<double>"


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """Arrays as an Arrow list column, without a Python number each."""
    ends = np.concatenate([[0], np.cumsum([r.size for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r.ravel() for r in rows]) if rows else np.zeros(0)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def _read(path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    store, root = pafs.FileSystem.from_uri(path)
    for batch in pads.dataset(root, filesystem=store, format="parquet").to_batches(batch_size=16):
        for k, block in enumerate(batch.column("block").to_pylist()):
            mean = batch.column("mean").slice(k, 1).flatten().to_numpy(zero_copy_only=False)
            yield block, mean, batch.column("vectors").slice(k, 1).flatten().to_numpy(zero_copy_only=False).reshape(len(mean), -1)


@functools.lru_cache(maxsize=2)
def _kept(path: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return sorted(_read(path), key=lambda row: row[0])


def _blocks(path: str, small: bool):
    return _kept(path) if small else _read(path)


def _summed(parts: DataFrame, path: str) -> None:
    """Writes the sum of each block's rows (block, values), one row at a time in a task's hands."""

    def add(batches):
        block, total = None, None
        for batch in batches:
            for k, b in enumerate(batch.column(0).to_pylist()):
                values = batch.column(1).slice(k, 1).flatten().to_numpy(zero_copy_only=False)
                if b == block:
                    total = total + values
                    continue
                if block is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), _lists([total])], ["block", "values"])
                block, total = b, values
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), _lists([total])], ["block", "values"])

    parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, values array<double>").write.mode("overwrite").parquet(path)


class FlatField:
    """A rank-r model of the illumination of images of one size: their mean and the r strongest modes.

    ``centre`` says what is taken off before: ``pixel``, each pixel's mean over the images, or ``all``, the mean of all pixels of all images. ``extra`` vectors more than
    ``rank`` are iterated ``rounds`` times; a matrix of no higher rank than both is found exactly. The model is in ``folder``, as Parquet, and can be read from there again.
    """

    def __init__(self, df: DataFrame, pixels: str, rank: int, centre: str = "pixel", extra: int = 10, rounds: int = 3, block: int = BLOCK, held: int = HELD, seed: int = 0, folder: str | None = None):
        if centre not in ("pixel", "all"):
            raise ValueError(f"centre must be pixel or all, not {centre}")
        spark = df.sparkSession
        images = df.select(F.transform(F.col(pixels), lambda v: v.cast("double")).alias("x"))
        sums = images.agg(F.count("x"), F.min(F.size("x")), F.max(F.size("x")), F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v))).first()
        self.images, self.pixels, most, total = sums
        if not self.images:
            raise ValueError("no images")
        if self.pixels != most:
            raise ValueError(f"images of {self.pixels} to {most} pixels: they must be of one size")
        self.spark, self.block, self.held, self.folder = spark, block, held, folder or new_folder(spark, "flat_field")
        n, d = self.images, self.pixels
        k = min(rank + extra, d, n)
        spans = {b: (b * block, min(d, (b + 1) * block)) for b in range(-(-d // block))}
        work = new_folder(spark, "flat_field_rounds")
        numbers = spark.range(len(spans)).select(F.col("id").cast("int").alias("block"))
        if centre == "pixel":
            _summed(images.mapInArrow(_column_sums(spans), "block int, values array<double>"), f"{work}/means")
            means = spark.read.schema("block int, values array<double>").parquet(f"{work}/means").select("block", F.transform("values", lambda v: v / n).alias("mean"))
        else:
            sizes = F.least(F.lit(block), F.lit(d) - F.col("block") * block)
            means = numbers.select("block", F.array_repeat(F.lit(total / n / d), sizes).alias("mean"))

        def random(batches):
            for batch in batches:
                means_ = [batch.column(1).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for i in range(batch.num_rows)]
                found = [np.random.default_rng([seed, b]).standard_normal((len(m), k)) for b, m in zip(batch.column(0).to_pylist(), means_)]
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(means_), _lists(found)], ["block", "mean", "vectors"])

        at = f"{work}/start"
        means.select("block", "mean").mapInArrow(random, BLOCKS).write.mode("overwrite").parquet(at)
        for i in range(rounds):
            path = f"{work}/products{i}"
            self._products(images, at, k, spans, path)
            products = means.join(spark.read.schema("block int, values array<double>").parquet(path), "block").select("block", "mean", F.col("values").alias("vectors"))
            at, k = self._orthogonal(products, k, f"{work}/vectors{i}")
        # Among the vectors' combinations the modes are those along which the images' coefficients are uncorrelated.
        strong, turn = np.linalg.eigh(self._inner(images, at, k))
        order = np.argsort(strong)[::-1][:rank]
        self.rank, self.strength = len(order), np.sqrt(np.maximum(strong[order], 0))
        spark.read.schema(BLOCKS).parquet(at).mapInArrow(_turned(turn[:, order]), BLOCKS).write.mode("overwrite").parquet(f"{self.folder}/modes")
        meta = [(self.rank, self.pixels, self.images, block, held, self.strength.tolist())]
        spark.createDataFrame(meta, "rank int, pixels int, images long, block int, held long, strength array<double>").write.mode("overwrite").parquet(f"{self.folder}/model")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> FlatField:
        """A model that was saved: one row and the modes' blocks."""
        model = cls.__new__(cls)
        row = spark.read.parquet(f"{folder}/model").first()
        model.spark, model.folder, model.rank, model.pixels, model.images, model.block, model.held, model.strength = spark, folder, row.rank, row.pixels, row.images, row.block, row.held, np.array(row.strength)
        return model

    def save(self, folder: str) -> None:
        for part in ("modes", "model"):
            self.spark.read.parquet(f"{self.folder}/{part}").write.mode("errorifexists").parquet(f"{folder}/{part}")

    def modes(self) -> DataFrame:
        """block, mean, vectors (the modes' values of each of the block's pixels, one pixel after the other)."""
        return self.spark.read.schema(BLOCKS).parquet(f"{self.folder}/modes")

    def _products(self, images: DataFrame, at: str, k: int, spans: dict, path: str) -> None:
        """Block by block the products of the centred images with their coefficients on the vectors at ``at``."""
        small, per_pass = self.pixels * k <= self.held, max(1, self.held // (self.block * k))
        parts = None
        for first in range(0, len(spans), per_pass):
            chosen = range(first, min(first + per_pass, len(spans)))

            def scan(batches, chosen=chosen):
                out = {b: 0.0 for b in chosen}
                for batch in batches:
                    if batch.num_rows:
                        x = _matrix(batch.column(0))
                        y = sum((x[:, slice(*spans[b])] - mean) @ v for b, mean, v in _blocks(at, small))
                        for b, mean, _ in _blocks(at, small):
                            if b in out:
                                out[b] = out[b] + (x[:, slice(*spans[b])] - mean).T @ y
                for b, total in out.items():
                    if np.ndim(total):
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), _lists([total])], ["block", "values"])

            part = images.mapInArrow(scan, "block int, values array<double>")
            parts = part if parts is None else parts.unionByName(part)
        _summed(parts, path)

    def _inner(self, images: DataFrame, at: str, k: int) -> np.ndarray:
        """The k x k inner products of the images' coefficients on the vectors at ``at``."""
        small, block = self.pixels * k <= self.held, self.block

        def scan(batches):
            total = np.zeros((k, k))
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(0))
                    y = sum((x[:, b * block : b * block + len(mean)] - mean) @ v for b, mean, v in _blocks(at, small))
                    total += y.T @ y
            yield pa.RecordBatch.from_arrays([_lists([total])], ["values"])

        return self._added(images.mapInArrow(scan, "values array<double>"), k)

    @staticmethod
    def _added(parts: DataFrame, k: int) -> np.ndarray:
        """The sum of k x k matrices, a row each; the driver gets the sum."""
        sums = parts.select(F.posexplode("values").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(k * k)
        for r in sums:
            out[r.at] = r.v
        return out.reshape(k, k)

    def _orthogonal(self, products: DataFrame, k: int, path: str) -> tuple[str, int]:
        """Writes an orthonormal basis of the products' range; vectors that add nothing to it go. Twice, for the sake of rounding."""
        for turn in ("a", "b"):

            def inner(batches, k=k):
                total = np.zeros((k, k))
                for batch in batches:
                    for i in range(batch.num_rows):
                        v = batch.column(2).slice(i, 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                        total += v.T @ v
                yield pa.RecordBatch.from_arrays([_lists([total])], ["values"])

            values, vectors = np.linalg.eigh(self._added(products.mapInArrow(inner, "values array<double>"), k))
            kept = values > max(values.max(), 1e-300) * 1e-13
            change = vectors[:, kept] / np.sqrt(values[kept]) if kept.any() else np.zeros((k, 1))
            products.mapInArrow(_turned(change), BLOCKS).write.mode("overwrite").parquet(f"{path}{turn}")
            products, k = self.spark.read.schema(BLOCKS).parquet(f"{path}{turn}"), change.shape[1]
        return f"{path}{turn}", k

    def flattened(self, df: DataFrame, pixels: str, rank: int | None = None) -> DataFrame:
        """df with each image's flat field in ``flat`` (the mean plus the image's projection on the first ``rank`` modes; the image isn't centred before) and the image
        divided by it in ``normalised`` (0 where it is 0)."""
        path, names, block, d = f"{self.folder}/modes", df.columns, self.block, self.pixels
        r, small = self.rank if rank is None else min(rank, self.rank), self.pixels * self.rank <= self.held

        def apply(batches):
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(names.index(pixels)))
                    if x.shape[1] != d:
                        raise ValueError(f"images of {x.shape[1]} pixels, a model of {d}")
                    y = sum(x[:, b * block : b * block + len(mean)] @ v[:, :r] for b, mean, v in _blocks(path, small))
                    flat = np.empty_like(x)
                    for b, mean, v in _blocks(path, small):
                        flat[:, b * block : b * block + len(mean)] = mean + y @ v[:, :r].T
                    out = np.divide(x, flat, out=np.zeros_like(x), where=flat != 0)
                    yield pa.RecordBatch.from_arrays([*batch.columns, _lists(list(flat)), _lists(list(out))], [*names, "flat", "normalised"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInArrow(apply, f"{schema}, flat array<double>, normalised array<double>")


def _column_sums(spans: dict):
    def scan(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0)).sum(axis=0)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(spans), pa.int32()), _lists([total[lo:hi] for lo, hi in spans.values()])], ["block", "values"])

    return scan


def _turned(change: np.ndarray):
    """Each block's vectors combined by the columns of ``change``."""

    def scan(batches):
        for batch in batches:
            found = [batch.column(2).slice(i, 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(change)) @ change for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _lists(found)], ["block", "mean", "vectors"])

    return scan
