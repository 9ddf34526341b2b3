"""Image filters on tiles: background, denoising, stretch, local equalisation and ridges.

An image is cut into square tiles, rows of their own. A filter needs pixels around its tile (a halo), so each tile sends strips of itself to its neighbours, which meet there by a
shuffle on (image, tile); no task has a whole image. What is of a whole image, medians and percentiles, comes from counted values, and local
equalisation from histograms of regions, which tiles get by a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainflow.functions.storage import settled
from grainflow.operators.distribution import percentiles

BINS = 256
#: Pixels, halos included, of the tiles that a function gets at once; larger tiles come one by one.
TOGETHER = 1 << 16


@dataclass(frozen=True)
class Preparation:
    """How images are prepared; lengths in pixels."""

    background: float = 12.0
    mode: str = "divide"  # or subtract
    denoise: float = 0.7  # 0: not at all
    stretch: tuple[float, float] = (0.005, 0.995)
    equalise: int = 51  # side of a region; 0: not at all
    clip: float = 0.01
    ridges: tuple[float, ...] = (0.8, 1.2, 1.6)
    tile: int = 128


def reach(sigma: float) -> int:
    """Pixels on either side that a Gaussian takes in."""
    return int(4 * sigma + 0.5)


def gaussian(x: np.ndarray, sigma: float, order: tuple[int, int] = (0, 0)) -> np.ndarray:
    """``x`` (an image or a stack of them) convolved with a Gaussian, or its derivative of ``order`` along rows and columns; beyond the edge the edge's pixels go on."""
    r = reach(sigma)
    at = np.arange(-r, r + 1)
    bell = np.exp(-0.5 * (at / sigma) ** 2)
    bell /= bell.sum()
    slope, bend = -at * bell, (at * at / sigma**2 - 1) * bell
    bend -= bell * bend.sum()
    # Cut off kernels are scaled so that a slope's derivative is right, and a parabola's second one.
    kernels = [bell, slope / (slope @ -at), bend / (bend @ (at * at)) * 2]
    for axis, k in zip((x.ndim - 2, x.ndim - 1), order):
        wide = np.pad(x, [(r, r) if a == axis else (0, 0) for a in range(x.ndim)], mode="edge")
        windows = np.lib.stride_tricks.sliding_window_view(wide, 2 * r + 1, axis=axis)
        x = windows @ kernels[k][::-1]
    return x


def background(x: np.ndarray, valid: np.ndarray, sigma: float) -> np.ndarray:
    """The Gaussian mean of the valid pixels around each."""
    return gaussian(np.where(valid, x, 0.0), sigma) / np.maximum(gaussian(valid.astype(float), sigma), 1e-3)


def ridges(x: np.ndarray, sigmas: tuple[float, ...]) -> np.ndarray:
    """How dark a line each pixel lies on: the larger eigenvalue of the second derivatives, times sigma squared, at the best of the sigmas; 0 where it is negative."""
    best = np.zeros_like(x)
    for s in sigmas:
        rr, cc, rc = gaussian(x, s, (2, 0)), gaussian(x, s, (0, 2)), gaussian(x, s, (1, 1))
        best = np.maximum(best, s * s * ((rr + cc) / 2 + np.hypot((rr - cc) / 2, rc)))
    return best


def equalised(x: np.ndarray, row: int, col: int, maps: dict[tuple[int, int], np.ndarray], side: int) -> np.ndarray:
    """Pixels (0 to 1) of a part of an image that begins at (row, col) by the maps of the four regions whose centres are around, weighted by nearness."""
    rows, cols = 1 + max(r for r, _ in maps), 1 + max(c for _, c in maps)
    y, x_ = (row + np.arange(x.shape[0]) + 0.5) / side - 0.5, (col + np.arange(x.shape[1]) + 0.5) / side - 0.5
    bins, out = np.minimum((x * BINS).astype(int), BINS - 1), np.zeros_like(x)
    low = [np.floor(v).astype(int) for v in (y, x_)]
    share = [v - lo for v, lo in zip((y, x_), low)]
    for dy in (0, 1):
        for dx in (0, 1):
            r, c = np.clip(low[0] + dy, 0, rows - 1), np.clip(low[1] + dx, 0, cols - 1)
            weight = np.outer(share[0] if dy else 1 - share[0], share[1] if dx else 1 - share[1])
            for a in np.unique(r):
                for b in np.unique(c):
                    part = np.ix_(r == a, c == b)
                    out[part] += weight[part] * maps[a, b][bins[part]]
    return out


def clipped_map(counts: np.ndarray, clip: float) -> np.ndarray:
    """The cumulative share of each bin, of counts cut off at ``clip`` of the pixels (one at least), what was cut off dealt out evenly."""
    most = max(1.0, clip * counts.sum())
    cut = np.minimum(counts, most)
    cut = cut + (counts.sum() - cut.sum()) / BINS
    return np.cumsum(cut) / counts.sum()


def tiles_of(images: DataFrame, keys: list[str], pixels: dict[str, str], height: int, width: int, tile: int) -> DataFrame:
    """keys, ty, tx and arrays: each image's tiles, row-major, those at the far edges smaller. pixels: name of the array in a tile and in ``images``."""
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit((n - 1) // tile)))
    cut = images.select(*keys, *pixels.values(), grid(height).alias("ty")).select("*", grid(width).alias("tx"))
    y0, x0 = F.col("ty") * tile, F.col("tx") * tile
    rows = F.sequence(y0, F.least(y0 + tile, F.lit(height)) - 1)
    w = F.least(x0 + tile, F.lit(width)) - x0
    part = lambda c: F.flatten(F.transform(rows, lambda y: F.slice(c, y * width + x0 + 1, w)))
    return cut.select(*keys, "ty", "tx", *(part(c).alias(name) for name, c in pixels.items()))


def images_of(tiles: DataFrame, keys: list[str], names: list[str], width: int, tile: int) -> DataFrame:
    """keys and the whole arrays of tiles."""
    w = F.least(F.lit(tile), F.lit(width) - F.col("tx") * tile)
    lines = F.sequence(F.lit(0), (F.size(names[0]) / w).cast("int") - 1)
    parts = F.transform(lines, lambda i: F.struct((F.col("ty") * tile + i).alias("y"), F.col("tx").alias("tx"), *(F.slice(n, i * w + 1, w).alias(n) for n in names)))
    ordered = tiles.select(*keys, F.explode(parts).alias("p")).groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("p"))
    whole = lambda n: F.flatten(F.transform("p", lambda p: p[n])).alias(n)
    return ordered.select(*keys, *map(whole, names))


def with_halo(tiles: DataFrame, keys: list[str], names: list[str], height: int, width: int, tile: int, halo: int, use: Callable[[list[np.ndarray]], list[np.ndarray]], out: list[str], stacks: bool = False) -> DataFrame:
    """keys, ty, tx and ``out``: what ``use`` makes of each tile's arrays ``names`` with ``halo`` pixels around them (beyond the image its edge's pixels), without the halo.

    With ``stacks`` small tiles go to tasks' functions many at once, as many as have ``TOGETHER`` pixels, and ``use`` gets those at the same place of their images as one array."""
    far = -(-halo // tile)
    steps = F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(-far, far + 1) for b in range(-far, far + 1)))
    sent = tiles.withColumn("to", F.explode(steps)).select(*keys, "ty", "tx", *names, (F.col("ty") + F.col("to.dy")).alias("oy"), (F.col("tx") + F.col("to.dx")).alias("ox"))
    sent = sent.filter(F.col("oy").between(0, (height - 1) // tile) & F.col("ox").between(0, (width - 1) // tile))
    first = lambda own, other: F.greatest(F.col(own) * tile, F.col(other) * tile - halo)
    last = lambda own, other, n: F.least(F.col(own) * tile + tile, F.col(other) * tile + tile + halo, F.lit(n))
    sent = sent.withColumns({"y0": first("ty", "oy"), "y1": last("ty", "oy", height), "x0": first("tx", "ox"), "x1": last("tx", "ox", width)}).filter("y0 < y1 AND x0 < x1")
    w = F.least(F.lit(tile), F.lit(width) - F.col("tx") * tile)
    begin = lambda y: (y - F.col("ty") * tile) * w + F.col("x0") - F.col("tx") * tile + 1
    strip = lambda c: F.flatten(F.transform(F.sequence(F.col("y0"), F.col("y1") - 1), lambda y: F.slice(c, begin(y), F.col("x1") - F.col("x0"))))
    strips = sent.select(*keys, "oy", "ox", "y0", "y1", "x0", "x1", *(strip(c).alias(f"_{c}") for c in names))
    strips = strips.withColumnsRenamed({"oy": "ty", "ox": "tx"} | {f"_{c}": c for c in names})

    def assembled(frame: pd.DataFrame) -> pd.DataFrame:
        made = []
        for (ty, tx), tiles_ in frame.groupby(["ty", "tx"]):
            y0, x0 = ty * tile - halo, tx * tile - halo
            h, w = min(tile, height - ty * tile), min(tile, width - tx * tile)
            image = tiles_.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            whose = tiles_[[*keys, "ty", "tx"]].iloc[np.unique(image, return_index=True)[1]]
            wide = {c: np.full((len(whose), h + 2 * halo, w + 2 * halo), np.nan) for c in names}
            for (a, b, d, e), at in tiles_.reset_index(drop=True).groupby(["y0", "y1", "x0", "x1"]).indices.items():
                for c in names:
                    wide[c][image[at], a - y0 : b - y0, d - x0 : e - x0] = np.stack(tiles_[c].to_numpy()[at]).astype(float).reshape(-1, b - a, e - d)
            around = [(0, 0), (max(0, -y0), max(0, y0 + h + 2 * halo - height)), (max(0, -x0), max(0, x0 + w + 2 * halo - width))]
            arrays = [np.pad(v[:, max(0, -y0) : height - y0, max(0, -x0) : width - x0], around, mode="edge") for v in wide.values()]
            used = use(arrays) if stacks else [np.stack(v) for v in zip(*(use([a[k] for a in arrays]) for k in range(len(whose))))]
            found = (a[:, halo : halo + h, halo : halo + w].reshape(len(whose), -1) for a in used)
            made.append(whose.assign(**{c: list(v) for c, v in zip(out, found)}))
        return pd.concat(made)[[*keys, "ty", "tx", *out]]

    kinds = ", ".join(f"`{k}` {tiles.schema[k].dataType.simpleString()}" for k in (*keys, "ty", "tx"))
    schema, together = f"{kinds}, " + ", ".join(f"{c} array<double>" for c in out), TOGETHER // (tile + 2 * halo) ** 2
    if together < 2 or not stacks:
        return strips.groupBy(*keys, "ty", "tx").applyInPandas(assembled, schema)
    groups = F.pmod(F.xxhash64(*keys, "ty", "tx"), F.lit(-(-tiles.count() // together) or 1))
    return strips.withColumn("_group", groups).groupBy("_group").applyInPandas(assembled, schema)


def _of_valid(tiles: DataFrame, keys: list[str], name: str, points: dict[str, float]) -> DataFrame:
    """Percentiles of the valid pixels of each image."""
    pairs = tiles.select(*keys, F.explode(F.arrays_zip(F.col(name).alias("v"), F.col("valid").alias("ok"))).alias("p"))
    return percentiles(pairs.filter("p.ok > 0").select(*keys, F.col("p.v").alias("v")), keys, "v", points).drop("n")


def valid_pixels(height: int, width: int, boxes: list[tuple[float, float, float, float]] = [], polygons: DataFrame | None = None) -> Column | DataFrame:
    """1 for each pixel that may be used, 0 in the boxes (top, bottom, left, right as fractions of the image, ends exclusive), row-major; with ``polygons`` (points: [row, column] in
    pixels), a table of one row with ``valid``, 0 in these too."""
    cuts = [(round(a * height), round(b * height), round(c * width), round(d * width)) for a, b, c, d in boxes]

    def one(i: Column) -> Column:
        y, x, out = F.floor(i / width), i % width, F.lit(False)
        for a, b, c, d in cuts:
            out = out | ((y >= a) & (y < b) & (x >= c) & (x < d))
        return F.when(out, 0.0).otherwise(1.0)

    all_ = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), one)
    if polygons is None:
        return all_
    from grainflow.operators.outlines import pixels_of, polygon_rows

    held = pixels_of(polygon_rows(polygons.withColumn("_all", F.lit(1)).withColumn("_n", F.monotonically_increasing_id()), ["_all", "_n"], "points", height, width), ["_all", "_n"], width)
    gone = held.select(F.explode("pixels").alias("p")).distinct().agg(F.map_from_entries(F.collect_list(F.struct("p", F.lit(0.0)))).alias("gone"))
    return gone.select(F.transform(all_, lambda v, i: F.coalesce(F.try_element_at("gone", i.cast("long")), v)).alias("valid"))


def prepared(images: DataFrame, keys: list[str], pixels: str, valid: str, height: int, width: int, how: Preparation = Preparation()) -> DataFrame:
    """keys, ty, tx and arrays of each image's tiles: work (the pixels), valid, flat (the background divided or subtracted), norm (denoised and stretched), clahe (equalised by
    regions), ridge_z (dark lines, as robust z; 0 where not valid). ``valid``: 1 or 0 for each pixel. ``images_of`` makes whole images of it."""
    if how.mode not in ("divide", "subtract"):
        raise ValueError(f"mode must be divide or subtract, not {how.mode}")
    size = (height, width, how.tile)
    tiles = tiles_of(images, keys, {"work": pixels, "valid": valid}, *size)
    divide = how.mode == "divide"

    def flat(arrays):
        x, ok = arrays
        below = background(x, ok > 0, how.background)
        return [x, ok, x / np.maximum(below, 1e-6) if divide else x - below]

    t = settled(with_halo(tiles, keys, ["work", "valid"], *size, reach(how.background), flat, ["work", "valid", "flat"], stacks=True), "flat")
    if not divide:
        t = t.join(_of_valid(t, keys, "work", {"level": 0.5}), keys).withColumn("flat", F.transform("flat", lambda v: v + F.col("level"))).drop("level")
    t = t.join(_of_valid(t, keys, "flat", {"level": 0.5}), keys)
    t = t.withColumn("flat", F.zip_with("flat", "valid", lambda v, ok: F.when(ok > 0, v).otherwise(F.col("level")))).drop("level")
    if how.denoise > 0:
        smooth = lambda arrays: [*arrays, gaussian(arrays[2], how.denoise)]
        t = with_halo(t, keys, ["work", "valid", "flat"], *size, reach(how.denoise), smooth, ["work", "valid", "flat", "norm"], stacks=True)
    else:
        t = t.withColumn("norm", F.col("flat"))
    t = settled(t, "denoised")
    ends = _of_valid(t, keys, "norm", {"lo": how.stretch[0], "hi": how.stretch[1]})
    t = t.join(ends, keys).withColumn("norm", F.transform("norm", lambda v: F.least(F.greatest((v - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-12), F.lit(0.0)), F.lit(1.0)))).drop("lo", "hi")
    names = ["work", "valid", "flat", "norm"]
    dark = lambda arrays: [*arrays, ridges(arrays[3], how.ridges)]
    t = settled(with_halo(t, keys, names, *size, max(reach(s) for s in how.ridges), dark, [*names, "ridge"], stacks=True), "ridges")
    middle = _of_valid(t, keys, "ridge", {"middle": 0.5})
    away = t.join(middle, keys).withColumn("away", F.transform("ridge", lambda v: F.abs(v - F.col("middle"))))
    spread = middle.join(_of_valid(away, keys, "away", {"spread": 0.5}), keys)
    z = F.zip_with("ridge", "valid", lambda v, ok: F.greatest(F.lit(0.0), (v - F.col("middle")) / (F.col("spread") * 1.4826 + 1e-12)) * ok)
    t = t.join(spread, keys).withColumn("ridge_z", z).drop("middle", "spread", "ridge")
    return _equalise(t, keys, height, width, how) if how.equalise else t.withColumn("clahe", F.col("norm"))


def _equalise(tiles: DataFrame, keys: list[str], height: int, width: int, how: Preparation) -> DataFrame:
    side, tile = how.equalise, how.tile
    rows, cols = math.ceil(height / side), math.ceil(width / side)
    w = F.least(F.lit(tile), F.lit(width) - F.col("tx") * tile)
    px = tiles.select(*keys, "ty", "tx", w.alias("w"), F.posexplode("norm").alias("i", "v"))
    region = [F.floor((F.col("ty") * tile + F.floor(F.col("i") / F.col("w"))) / side).cast("int").alias("ry"), F.floor((F.col("tx") * tile + F.col("i") % F.col("w")) / side).cast("int").alias("rx")]
    counts = px.select(*keys, *region, F.least(F.floor(F.col("v") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).groupBy(*keys, "ry", "rx", "bin").agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy(*keys, "ry", "rx").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"))
    hist = held.select(*keys, "ry", "rx", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at("held", b), F.lit(0)).cast("double")).alias("counts"))
    around = lambda t, n: F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col(t) * tile / side - 0.5)).cast("int"), F.least(F.lit(n - 1), F.floor((F.col(t) * tile + tile) / side + 0.5)).cast("int")))
    wanted = tiles.select(*keys, "ty", "tx", around("ty", rows).alias("ry")).select("*", around("tx", cols).alias("rx"))
    maps = wanted.join(hist, [*keys, "ry", "rx"]).groupBy(*keys, "ty", "tx").agg(F.collect_list(F.struct("ry", "rx", "counts")).alias("maps"))
    joined = tiles.join(maps, [*keys, "ty", "tx"])

    def apply(frames):
        for frame in frames:
            out = []
            for ty, tx, norm, maps_ in zip(frame["ty"], frame["tx"], frame["norm"], frame["maps"]):
                found = {(m["ry"], m["rx"]): clipped_map(np.asarray(m["counts"], float), how.clip) for m in maps_}
                # Numbered from the image's first region: those beyond the tile's surroundings are never asked for.
                found.setdefault((rows - 1, cols - 1), np.zeros(BINS))
                x = np.asarray(norm, float).reshape(-1, min(tile, width - tx * tile))
                out.append(equalised(x, ty * tile, tx * tile, found, side).ravel().tolist())
            yield frame.drop(columns="maps").assign(clahe=out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.schema.fields)
    return joined.select(*tiles.columns, "maps").mapInPandas(apply, f"{kinds}, clahe array<double>")


def channels(tiles: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, ty, tx, channel, pixels: the input of a model, a row for each channel of each tile, in [0, 1]. ridge is ridge_z over 10, cut off at 1."""
    of = lambda n: F.transform("ridge_z", lambda v: F.least(F.greatest(v / 10, F.lit(0.0)), F.lit(1.0))) if n == "ridge" else F.col(n)
    rows = F.array(*(F.struct(F.lit(k).alias("channel"), F.lit(n).alias("name"), of(n).alias("pixels")) for k, n in enumerate(names)))
    return tiles.select(*keys, "ty", "tx", F.inline(rows))
