"""Images in and out: files decoded by Spark's own image source, grey values, flips, cuts, stitched stacks, PNG files written by tasks."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.operators.arrays import percentile_range, scaled_to
from grainflow.sources.shapes import frame_keys, stem

#: The share of red, green and blue in a grey value.
GREY = (0.2125, 0.7154, 0.0721)


def read_images(spark: SparkSession, *paths: str) -> DataFrame:
    """frame, run, train, frame_idx, path, height, width and pixels (grey, 0 to 1, row-major) of image files with 8 bits a channel. Files that aren't images are left out."""
    files = spark.read.format("image").option("dropInvalid", True).load(list(paths))

    def grey(batches):
        for batch in batches:
            rows = []
            for channels, data in zip(batch.column(3).to_pylist(), batch.column(4)):
                x = np.frombuffer(data.as_py(), np.uint8).reshape(-1, channels) / 255.0
                rows.append(x[:, 0] if channels == 1 else x[:, 2] * GREY[0] + x[:, 1] * GREY[1] + x[:, 0] * GREY[2])  # stored as blue, green, red
            ends = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32))
            pixels = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows) if rows else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pixels], ["path", "height", "width", "pixels"])

    parts = files.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    out = parts.mapInArrow(grey, "path string, height int, width int, pixels array<double>").withColumn("frame", stem(F.col("path")))
    return out.withColumns(frame_keys(F.col("frame"))).select("frame", "run", "train", "frame_idx", "path", "height", "width", "pixels")


def flipped(pixels: Column, height: int, width: int, rows: bool = False, columns: bool = False) -> Column:
    """An image with its rows, its columns, or both in reverse."""
    lines = F.sequence(F.lit(0), F.lit(height - 1))
    if rows and columns:
        return F.reverse(pixels)
    if rows:
        return F.flatten(F.transform(lines, lambda y: F.slice(pixels, (height - 1 - y) * width + 1, width)))
    return F.flatten(F.transform(lines, lambda y: F.reverse(F.slice(pixels, y * width + 1, width)))) if columns else pixels


def cut_out(pixels: Column, width: int, top: int, bottom: int, left: int, right: int) -> Column:
    """Rows top to bottom and columns left to right of an image, far ends exclusive."""
    return F.flatten(F.transform(F.sequence(F.lit(top), F.lit(bottom - 1)), lambda y: F.slice(pixels, y * width + left + 1, right - left)))


def stitched(stacks: list[DataFrame], by: list[str], index: str, cuts: list[tuple[int, int]]) -> DataFrame:
    """The frames of several cameras one after the other: of each stack's frames, numbered by ``index`` within ``by``, those from the cut's first number up to its last one
    (exclusive; negative: from the stack's end), numbered on from the stack before."""
    out, offset = None, 0
    for stack, (first, last) in zip(stacks, cuts):
        if last <= 0:
            last = stack.agg(F.max(index)).first()[0] + 1 + last
        part = stack.filter(F.col(index).between(first, last - 1)).withColumn(index, (F.col(index) - first + offset).cast("int"))
        offset += max(0, last - first)
        out = part if out is None else out.unionByName(part)
    return out


def png_bytes(pixels: np.ndarray) -> bytes:
    """A grey image of unsigned 8 or 16 bits."""
    height, width = pixels.shape
    lines = np.zeros((height, 1 + width * pixels.itemsize), np.uint8)
    lines[:, 1:] = pixels.astype(pixels.dtype.newbyteorder(">")).view(np.uint8).reshape(height, -1)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8 * pixels.itemsize, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def write_images(
    images: DataFrame, folder: str, name: str, pixels: str, height: int, width: int, lo: float | None = None, hi: float | None = None, bits: int = 8, overwrite: bool = False, shares: tuple[float, float] = (0.005, 0.995)
) -> DataFrame:
    """Writes a grey PNG file for each row, values from lo to hi on the whole range of ``bits`` and cut off beyond; nulls and NaN are 0. Without lo and hi one range serves all
    images, that between the ``shares`` of all their pixels. Returns name and written: false where the file was there before. A file appears whole or not at all. Run by an
    action on what is returned."""
    if bits not in (8, 16):
        raise ValueError("8 or 16 bits")
    if lo is None or hi is None:
        ends = percentile_range(images, pixels, *shares).first()
        lo, hi = (ends[0] if lo is None else lo), (ends[1] if hi is None else hi)

    def write(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            done = []
            for n, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                path = f"{root}/{n}.png"
                done.append(overwrite or store.get_file_info(path).type == pafs.FileType.NotFound)
                if done[-1]:
                    x = np.array(values.as_py(), np.uint8 if bits == 8 else np.uint16)
                    store.create_dir(root, recursive=True)
                    draft = f"{root}/.{n}.{uuid.uuid4().hex}"
                    with store.open_output_stream(draft) as out:
                        out.write(png_bytes(x.reshape(height, width)))
                    store.move(draft, path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.bool_())], ["name", "written"])

    whole = scaled_to(F.col(pixels), lo, hi, 2**bits - 1).alias("pixels")
    return images.select(F.col(name).cast("string").alias("name"), whole).mapInArrow(write, "name string, written boolean")
