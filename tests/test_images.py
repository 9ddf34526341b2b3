"""Images written as PNG and read again by Spark's decoder; flips, cuts and stitched stacks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainflow.sources.images import cut_out, flipped, png_bytes, read_images, stitched, write_images

H, W = 4, 5


def stack(spark, n, start=0.0):
    return spark.createDataFrame([(0, k, [start + k / 10 + v / 100 for v in range(H * W)]) for k in range(n)], "train int, frame_idx int, pixels array<double>")


def test_written_images_come_back(spark, tmp_path):
    """Scaled to 8 bits, cut off beyond the range; what exists is left alone; names give keys; other files are left out."""
    folder = f"file://{tmp_path}/png"
    df = stack(spark, 3).withColumn("name", F.format_string("r7_tid0_%03d", "frame_idx"))
    df = df.withColumn("pixels", F.transform("pixels", lambda v, i: F.when(i == 0, F.lit(None)).when(i == 1, F.lit(float("nan"))).when(i == 2, 9.0).otherwise(v)))
    assert [r.written for r in write_images(df, folder, "name", "pixels", H, W, 0.0, 0.5).collect()] == [True] * 3
    assert [r.written for r in write_images(df.withColumn("pixels", F.transform("pixels", lambda v: v * 0)), folder, "name", "pixels", H, W, 0.0, 0.5).collect()] == [False] * 3
    (tmp_path / "png" / "notes.png").write_bytes(b"no image")
    rows = {r.frame: r for r in read_images(spark, folder).collect()}
    assert set(rows) == {f"r7_tid0_{k:03d}" for k in range(3)}
    r = rows["r7_tid0_002"]
    assert (r.run, r.train, r.frame_idx, r.height, r.width) == ("r007", 0, 2, H, W)
    want = np.floor(np.clip([0, 0, 18] + [(0.2 + v / 100) / 0.5 for v in range(3, H * W)], 0, 1) * 255 + 0.5) / 255
    assert np.allclose(r.pixels, want)
    wide = stack(spark, 2).withColumn("name", F.format_string("w_tid0_%03d", "frame_idx"))
    assert write_images(wide, f"file://{tmp_path}/wide", "name", "pixels", H, W, bits=16, shares=(0.0, 1.0)).count() == 2
    assert (tmp_path / "wide" / "w_tid0_001.png").read_bytes()[24] == 16
    with pytest.raises(ValueError):
        write_images(df, folder, "name", "pixels", H, W, 0, 1, bits=12)


def test_colours_become_grey(spark, tmp_path):
    import struct
    import zlib

    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"\x00" + bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 255, 255, 255])
    (tmp_path / "c.png").write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 4, 1, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b""))
    assert read_images(spark, f"file://{tmp_path}").first().pixels == pytest.approx([0.2125, 0.7154, 0.0721, 1.0])
    assert png_bytes(np.array([[1, 2]], np.uint16))[24] == 16


def test_flips_and_cuts(spark):
    x = np.arange(H * W, dtype=float).reshape(H, W)
    p = F.col("p")
    row = spark.createDataFrame([(x.ravel().tolist(),)], "p array<double>").select(
        flipped(p, H, W, rows=True).alias("r"), flipped(p, H, W, columns=True).alias("c"), flipped(p, H, W, True, True).alias("b"), flipped(p, H, W).alias("n"), cut_out(p, W, 1, 3, 2, 5).alias("k")
    ).first()
    assert [row.r, row.c, row.b, row.n, row.k] == [a.ravel().tolist() for a in (x[::-1], x[:, ::-1], x[::-1, ::-1], x, x[1:3, 2:5])]


def test_stitched_cameras(spark):
    """The second camera's frames go on behind the first one's; noisy ones at both ends are left out."""
    out = stitched([stack(spark, 6), stack(spark, 5, 10.0)], ["train"], "frame_idx", [(2, -1), (1, 0)])
    rows = {r.frame_idx: r.pixels[0] for r in out.collect()}
    assert rows == pytest.approx({0: 0.2, 1: 0.3, 2: 0.4, 3: 10.1, 4: 10.2, 5: 10.3, 6: 10.4})
