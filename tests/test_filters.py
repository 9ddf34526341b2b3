"""Image filters on tiles against the same on whole images in numpy, tile borders included."""

import math

import numpy as np
import pytest

from grainflow.operators import filters
from grainflow.operators.filters import BINS, Preparation, background, channels, clipped_map, equalised, gaussian, images_of, prepared, ridges, tiles_of, valid_pixels, with_halo

H, W = 70, 93


def picture(seed):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:H, :W]
    return 0.4 + 0.2 * np.sin(y / 20) + 0.1 * np.cos(x / 15) - 0.3 * (np.abs(np.hypot(y - 35, x - 40) - 18) < 1.5) + rng.normal(0, 0.02, (H, W))


def frame(spark, n=2):
    ok = np.ones((H, W))
    ok[5:20, 60:80] = 0
    return spark.createDataFrame([(k, picture(k).ravel().tolist(), ok.ravel().tolist()) for k in range(n)], "k int, px array<double>, ok array<double>"), ok > 0


def plain(x, ok, how):
    below = background(x, ok, how.background)
    flat = x / np.maximum(below, 1e-6) if how.mode == "divide" else x - below + np.median(x[ok])
    flat = np.where(ok, flat, np.median(flat[ok]))
    den = gaussian(flat, how.denoise) if how.denoise else flat
    lo, hi = np.percentile(den[ok], [100 * q for q in how.stretch])
    norm = np.clip((den - lo) / (hi - lo + 1e-12), 0, 1)
    ridge = ridges(norm, how.ridges)
    middle = np.median(ridge[ok])
    z = np.maximum(0, (ridge - middle) / (1.4826 * np.median(np.abs(ridge[ok] - middle)) + 1e-12)) * ok
    side, maps = how.equalise, {}
    for r in range(math.ceil(H / side)):
        for c in range(math.ceil(W / side)):
            part = norm[r * side : (r + 1) * side, c * side : (c + 1) * side]
            maps[r, c] = clipped_map(np.bincount(np.minimum((part * BINS).astype(int), BINS - 1).ravel(), minlength=BINS).astype(float), how.clip)
    return {"flat": flat, "norm": norm, "ridge_z": z, "clahe": equalised(norm, 0, 0, maps, side)}


@pytest.mark.parametrize("how", [Preparation(background=6.0, tile=32, equalise=25), Preparation(background=9.0, mode="subtract", denoise=0.0, tile=20, equalise=40)])
def test_tiles_give_what_whole_images_give(spark, how):
    """Halos reach over one tile and, in the second case, over two; regions of the equalisation don't fit the tiles."""
    df, ok = frame(spark)
    names = ["flat", "norm", "ridge_z", "clahe"]
    tiles = prepared(df, ["k"], "px", "ok", H, W, how)
    assert tiles.count() == 2 * math.ceil(H / how.tile) * math.ceil(W / how.tile)
    for row in images_of(tiles, ["k"], names, W, how.tile).collect():
        want = plain(picture(row.k), ok, how)
        for n in names:
            assert np.abs(np.array(row[n]).reshape(H, W) - want[n]).max() < 1e-8, n


def test_tiles_and_images(spark):
    df, _ = frame(spark)
    tiles = tiles_of(df, ["k"], {"px": "px"}, H, W, 32)
    assert sorted((r.ty, r.tx, len(r.px)) for r in tiles.filter("k = 0").collect())[-1] == (2, 2, 6 * 29)
    assert {r.k: r.px for r in images_of(tiles, ["k"], ["px"], W, 32).collect()} == {k: picture(k).ravel().tolist() for k in range(2)}
    moved = with_halo(tiles, ["k"], ["px"], H, W, 32, 1, lambda a: [np.roll(a[0], 1, axis=1)], ["left"])
    left = {r.k: np.array(r.left).reshape(H, W) for r in images_of(moved, ["k"], ["left"], W, 32).collect()}
    assert all(np.array_equal(left[k][:, 1:], picture(k)[:, :-1]) and np.array_equal(left[k][:, 0], picture(k)[:, 0]) for k in range(2))
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "ty" in plan.split("hashpartitioning(k", 1)[1][:40]


def test_gaussians():
    """A constant stays, a slope's derivative is its slope, a parabola's second derivative 2; a masked mean doesn't see what is masked."""
    assert np.allclose(gaussian(np.full((9, 12), 3.0), 2.0), 3)
    y, x = np.mgrid[:60, :60].astype(float)
    inner = (slice(20, 40), slice(20, 40))
    assert np.allclose(gaussian(3 * x + y, 2.0, (0, 1))[inner], 3) and np.allclose(gaussian(y * y, 2.0, (2, 0))[inner], 2) and np.allclose(gaussian(x * y, 2.0, (1, 1))[inner], 1)
    valid = np.ones((30, 30), bool)
    valid[:, 15:] = False
    assert np.allclose(background(np.where(valid, 5.0, 900.0), valid, 2.0)[:, :15], 5)
    line = np.ones((40, 40))
    line[:, 20] = 0
    found = ridges(line, (1.0, 2.0))
    assert found[20].argmax() == 20 and found[20, 20] > 0.3 and found[20, 5] < 1e-6


def test_equalisation():
    """Without a limit the map is the cumulative share; with a tight one nearly the identity."""
    counts = np.zeros(BINS)
    counts[[3, 200]] = 50
    assert clipped_map(counts, 1.0)[[2, 3, 199, 200, 255]].tolist() == [0, 0.5, 0.5, 1, 1]
    assert np.abs(clipped_map(counts, 0.0) - np.arange(1, BINS + 1) / BINS).max() < 0.02


def test_valid_pixels(spark):
    boxes = [(0, 0.5, 0, 0.25)]
    row = spark.range(1).select(valid_pixels(4, 8, boxes).alias("v")).first()
    want = np.ones((4, 8))
    want[:2, :2] = 0
    assert row.v == want.ravel().tolist()
    polygons = spark.createDataFrame([([[1.5, 3.5], [1.5, 6.5], [3.5, 6.5], [3.5, 3.5]],), ([[0.5, 4.5], [0.5, 5.5], [2.5, 5.5], [2.5, 4.5]],)], "points array<array<double>>")
    want[2:4, 4:7] = 0
    want[1:3, 5] = 0
    assert valid_pixels(4, 8, boxes, polygons).first().valid == want.ravel().tolist()
    assert valid_pixels(4, 8, [], polygons.limit(0)).count() == 1


def test_channels(spark):
    tiles = spark.createDataFrame([(0, 0, 0, [0.5, 1.0], [25.0, 4.0])], "k int, ty int, tx int, norm array<double>, ridge_z array<double>")
    assert [(r.channel, r.name, r.pixels) for r in channels(tiles, ["k"], ["norm", "ridge"]).orderBy("channel").collect()] == [(0, "norm", [0.5, 1.0]), (1, "ridge", [1.0, 0.4])]
    with pytest.raises(ValueError):
        prepared(tiles, ["k"], "norm", "norm", 1, 2, Preparation(mode="multiply"))
    assert filters.reach(1.0) == 4
