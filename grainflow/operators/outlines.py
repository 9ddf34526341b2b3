"""From masks to shapes: contours, fits to what is seen of an object at the image's edge, the shape that overlaps a mask best, and polygons as pixels.

Masks are sorted arrays of pixel numbers, as in ``masks``. Overlaps are counted on intervals of grid rows, which meet by row in a join; no pixel is
compared with another. Contours and fits are numerical and look at one mask at a time, in tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainflow.operators.geometry import seen_points, with_visibility
from grainflow.operators.masks import MOMENTS, circles_along, ellipse_spans, ellipses_along, equal_area_radius, lists, measures, moments, to_model, types


@dataclass(frozen=True)
class EdgeRules:
    """What decides between a circle, an ellipse and a sliver where the image cuts an object."""

    # Fixed values.
    least_arc: float = 45.0  # degrees of the outline in the image, below which it is a sliver
    ellipse_arc: float = 100.0  # from which an ellipse is tried
    gain: float = 1.6  # how many times nearer to the outline than the circle the ellipse must be
    most_ratio: float = 2.5  # of its axes
    reliable_arc: float = 140.0
    round_ratio: float = 0.93  # of the axes, from which a shape is a circle


def contours(pixels: np.ndarray, width: int) -> list[np.ndarray]:
    """The closed outlines of a mask, longest first: middles (row, column) of the pixel edges that have the mask on one side, in order. Pixels that touch at a corner only
    aren't joined."""
    i, j = pixels // width, pixels % width
    top, left = i.min() - 1, j.min() - 1
    held = np.zeros((i.max() - top + 2, j.max() - left + 2), bool)
    held[i - top, j - left] = True
    span = held.shape[1] + 1
    # Each edge goes from a corner to the next with the mask on its right: along the upper, right, lower and left side of a pixel.
    sides = [((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 1)), ((1, 0), (1, 1), (1, 0)), ((0, -1), (1, 0), (0, 0))]
    start, stop, owner, middle = [], [], [], []
    y, x = np.nonzero(held)
    for (dy, dx), (ay, ax), (by, bx) in sides:
        free = ~held[y + dy, x + dx]
        p, q = y[free], x[free]
        start.append((p + ay) * span + q + ax)
        stop.append((p + by) * span + q + bx)
        owner.append(p * span + q)
        middle.append(np.column_stack([p + top + dy / 2, q + left + dx / 2]))
    start, stop, owner, middle = (np.concatenate(v) for v in (start, stop, owner, middle))
    order = np.lexsort((owner, start))
    first = np.searchsorted(start[order], stop, "left")
    # Where two edges leave a corner, the outline stays with its pixel.
    two = np.flatnonzero(np.searchsorted(start[order], stop, "right") - first == 2)
    first[two] += owner[order[first[two]]] != owner[two]
    follows, left_over, out = order[first], np.ones(len(start), bool), []
    for k in range(len(start)):
        if left_over[k]:
            chain = []
            while left_over[k]:
                left_over[k] = False
                chain.append(k)
                k = follows[k]
            out.append(middle[chain])
    return sorted(out, key=len, reverse=True)


def hull_pixels(points: np.ndarray) -> int:
    """How many pixel centres the convex hull of points (row, column) holds, its edge included."""
    points = np.unique(points, axis=0)

    def chain(points, sign):
        kept: list[np.ndarray] = []
        for p in points:
            while len(kept) > 1 and sign * ((kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) - (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0])) >= 0:
                kept.pop()
            kept.append(p)
        return np.array(kept)

    low, high = chain(points, 1), chain(points, -1)
    rows = np.arange(math.ceil(points[0, 0]), math.floor(points[-1, 0]) + 1)
    ends = np.sort([np.interp(rows, c[:, 0], c[:, 1]) for c in (low, high)], axis=0)
    return int((np.floor(ends[1] + 1e-9) - np.ceil(ends[0] - 1e-9) + 1).sum())


def _on_ellipse(r: np.ndarray, c: np.ndarray, fit: tuple) -> np.ndarray:
    """Distances of points to an ellipse (row, col, semi_major, semi_minor, angle_deg; or one for each point): Newton steps on the angle of the nearest point."""
    row, col, a, b, angle = fit
    t = np.radians(angle)
    u = (c - col) * np.cos(t) + (r - row) * np.sin(t)
    v = (r - row) * np.cos(t) - (c - col) * np.sin(t)
    at = np.arctan2(v * a, u * b)
    for _ in range(20):
        x, y, dx, dy = a * np.cos(at), b * np.sin(at), -a * np.sin(at), b * np.cos(at)
        slope = (x - u) * dx + (y - v) * dy
        bend = dx * dx + dy * dy - (x - u) * x - (y - v) * y
        change = np.where(bend > 0, slope / np.where(bend > 0, bend, 1.0), 0.0)
        at = at - change
        if np.abs(change).max(initial=0.0) < 1e-13:
            break
    return np.hypot(a * np.cos(at) - u, b * np.sin(at) - v)


#: What ``outline_fits`` says of a mask.
FIT = {
    "outline_points": "long", "border_points": "long", "convex_pixels": "long", "edge_truncated": "boolean", "fit_kind": "string", "arc_deg": "double", "outline_visible_frac": "double",
    "y": "double", "x": "double", "semi_major": "double", "semi_minor": "double", "angle_deg": "double", "circle_y": "double", "circle_x": "double", "radius": "double",
}


#: Cells of the boxes around masks that are looked at together.
CELLS = 1 << 20


def _hulls(top: np.ndarray, rows: np.ndarray, mask: np.ndarray, i: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """``hull_pixels`` of many masks: ``rows`` rows from ``top`` on, and of each row with pixels its mask, number, first and last column.

    The outline's points lie on rows and between them. Its left side is the lower convex chain of the least columns, its right side that of the negative largest ones;
    chains are built for all masks at once, a half row at a time."""
    out = np.zeros(len(top), np.int64)
    high = np.ceil(np.log2(rows)).astype(int)
    for h in np.unique(high):
        at = np.flatnonzero(high == h)
        place = np.full(len(top), -1)
        place[at] = np.arange(len(at))
        own = np.flatnonzero(place[mask] >= 0)
        k, wide = i[own] - top[mask[own]], 2 * int(rows[at].max()) + 1
        f = np.full((2 * len(at), wide), np.inf)
        for side, end in ((0, first[own].astype(float)), (len(at), -last[own].astype(float))):
            m = place[mask[own]] + side
            f[m, 2 * k] = end
            f[m, 2 * k + 2] = np.minimum(f[m, 2 * k + 2], end)  # the row before may end farther out
            f[m, 2 * k + 1] = end - 0.5
        held, spot = np.zeros(f.shape, np.int64), np.zeros(len(f), np.int64)  # the chain so far, and its length
        for j in range(wide):
            new = np.flatnonzero(np.isfinite(f[:, j]))
            try_ = new[spot[new] > 1]
            while len(try_):
                p, q = held[try_, spot[try_] - 2], held[try_, spot[try_] - 1]
                fp, fq = f[try_, p], f[try_, q]
                try_ = try_[(fq - fp) * (j - p) >= (f[try_, j] - fp) * (q - p)]
                spot[try_] -= 1
                try_ = try_[spot[try_] > 1]
            held[new, spot[new]] = j
            spot[new] += 1
        chain = np.repeat(np.arange(len(f)), spot)
        j = held[chain, np.arange(len(chain)) - np.repeat(np.cumsum(spot) - spot, spot)]
        count = rows[at]
        line = np.repeat(np.arange(len(at)), count)
        y = 2 * (np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)) + 1
        left, right = (np.interp((line + side) * wide + y, chain * wide + j, f[chain, j]) for side in (0, len(at)))
        out[at] = np.bincount(line, np.floor(-right + 1e-9) - np.ceil(left - 1e-9) + 1, len(at)).astype(np.int64)
    return out


def _edges(sizes: np.ndarray, pixels: np.ndarray, height: int, width: int, hulls: bool, cut_only: bool) -> tuple:
    """Of masks that follow each other the number of edges, those at the border and ``hull_pixels`` (or zeros); and the edges, with ``cut_only`` of masks that may be cut:
    mask, middle (row, column) and the edge that goes on from it."""
    n, start, (i, j) = len(sizes), np.cumsum(sizes) - sizes, np.divmod(pixels, width)
    top, left = np.minimum.reduceat(i, start) - 1, np.minimum.reduceat(j, start) - 1
    high, wide = np.maximum.reduceat(i, start) - top + 2, np.maximum.reduceat(j, start) - left + 2
    base = np.cumsum(high * wide) - high * wide
    held = np.zeros(int((high * wide).sum()), bool)
    held[np.repeat(base - top * wide - left, sizes) + i * np.repeat(wide, sizes) + j] = True
    cell = np.flatnonzero(held)
    of = np.repeat(np.arange(n), np.add.reduceat(held, base, dtype=np.int64))
    w = wide[of]
    i, j = np.divmod(cell - base[of], w)
    i, j = i + top[of], j + left[of]
    hull = np.zeros(n, np.int64)
    if hulls:
        runs = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (i[1:] != i[:-1])))
        hull = _hulls(top + 1, high - 2, of[runs], i[runs], j[runs], j[np.append(runs[1:], len(cell)) - 1])
    free = np.stack([~held[cell + d] for d in (-w, 1, w, -1)])
    every = np.bincount(of, free.sum(axis=0), n).astype(np.int64)
    # A middle is at the border where its pixel is in the first or last row or column and the edge is not the inner one.
    first_i, last_i, first_j, last_j = i == 0, i == height - 1, j == 0, j == width - 1
    beside, above = first_j | last_j, first_i | last_i
    border = np.stack([beside | first_i | (i - 0.5 >= height - 1), above | last_j | (j + 0.5 <= 0), beside | last_i | (i + 0.5 <= 0), above | first_j | (j - 0.5 >= width - 1)]) & free
    at_border = np.bincount(of, border.sum(axis=0), n).astype(np.int64)
    if cut_only:
        asked = (at_border >= 3)[of]
        cell, of, w, i, j, free, border = cell[asked], of[asked], w[asked], i[asked], j[asked], free[:, asked], border[:, asked]
    count = np.append(0, np.cumsum(free.sum(axis=1)))
    number = np.empty((4, len(held)), np.int32)
    for s in range(4):
        number[s, cell[free[s]]] = np.arange(count[s], count[s + 1])
    follows, mask, y, x = [], [], [], []
    for s, (dy, dx) in enumerate(((-0.5, 0), (0, 0.5), (0.5, 0), (0, -0.5))):
        f = free[s]
        p, step = cell[f], w[f]
        side = (-step, 1, step, -1)
        turn = p + side[(s + 1) % 4]
        ahead = turn + side[s]
        # An outline stays with its pixel at a corner: it turns, goes straight on along the next pixel, or turns the other way.
        follows.append(np.where(free[(s + 1) % 4][f], number[(s + 1) % 4, p], np.where(held[ahead], number[(s - 1) % 4, ahead], number[s, turn])))
        mask.append(of[f])
        y.append(i[f] + dy)
        x.append(j[f] + dx)
    return every, at_border, hull, *map(np.concatenate, (mask, y, x, follows, [border[s][free[s]] for s in range(4)]))


def _longest(mask: np.ndarray, follows: np.ndarray, masks: int) -> np.ndarray:
    """Which edges are of the longest outline of their mask; of equals that which begins first. An outline is known by its least edge, found by doubling steps."""
    least, ahead = np.arange(len(mask)), follows
    while True:
        new = np.minimum(least, least[ahead])
        if (new == least).all():
            break
        least, ahead = new, ahead[ahead]
    size = np.bincount(least, minlength=len(mask))
    heads = np.flatnonzero(size)
    order = heads[np.lexsort((heads, -size[heads], mask[heads]))]
    best = np.full(masks, -1)
    best[mask[order][::-1]] = order[::-1]
    return least == best[mask]


def _fits(sizes: np.ndarray, pixels: np.ndarray, height: int, width: int, scale: float, rules: EdgeRules, cut_only: bool, hulls: bool = True) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """``FIT`` of masks with pixels that follow each other, unknown numbers as NaN. fit_kind is a place in ``KINDS``, or -1."""
    n = len(sizes)
    every, at_border, hull, mask, y, x, follows, border = _edges(sizes, pixels, height, width, hulls, cut_only)
    line = _longest(mask, follows, n)
    mask, y, x, border = mask[line], y[line], x[line], border[line]
    cut = np.bincount(mask, border, n) >= 3
    seen = (cut[mask] & ~border) | (~cut[mask] & (not cut_only))
    mask, y, x = mask[seen], y[seen], x[seen]
    order = np.argsort(mask, kind="stable")
    order = order[(np.bincount(mask, minlength=n) >= 6)[mask[order]]]
    mask, r, c = mask[order], (y[order] + 0.5) / scale - 0.5, (x[order] + 0.5) / scale - 0.5
    who, size = np.unique(mask, return_counts=True)
    of = np.repeat(np.arange(len(who)), size)
    circle = circles_along(r, c, size)
    cy, cx, radius = circle.T
    known = ~np.isnan(radius)
    with np.errstate(invalid="ignore"):
        step = np.floor(np.degrees(np.arctan2(r - cy[of], c - cx[of]) + math.pi) / 10)
    hit = np.zeros((len(who), 38), bool)
    ok = known[of]
    hit[of[ok], step[ok].astype(int)] = True
    arc = 10.0 * hit.sum(axis=1)
    cut_ = cut[who]
    sliver = known & cut_ & (arc < rules.least_arc)
    shape = np.column_stack([cy, cx, radius, radius, np.zeros(len(who))])
    tried = np.flatnonzero(known & ~sliver & (~cut_ | (arc >= rules.ellipse_arc)))
    points = np.isin(of, tried)
    ellipse = np.full((len(who), 5), np.nan)
    ellipse[tried] = ellipses_along(r[points], c[points], size[tried])
    with np.errstate(invalid="ignore"):
        good, a, b = ~np.isnan(ellipse[:, 0]), ellipse[:, 2], ellipse[:, 3]
        likely = good & cut_ & (a <= rules.most_ratio * b) & (a < 3 * radius) & (np.hypot(ellipse[:, 1] - cx, ellipse[:, 0] - cy) < radius)
    some = likely[of]
    if some.any():
        rms = lambda d: np.sqrt(np.bincount(of[some], d * d, len(who)) / size)
        round_ = rms(np.hypot(r[some] - cy[of[some]], c[some] - cx[of[some]]) - radius[of[some]])
        oval = rms(_on_ellipse(r[some], c[some], tuple(v[of[some]] for v in ellipse.T)))
        likely &= round_ > rules.gain * np.maximum(oval, 1e-6)
    oval = good & (~cut_ | likely)
    shape[oval] = ellipse[oval]
    kind = np.where(~known, -1, np.where(sliver, KINDS.index("visible"), np.where(oval, KINDS.index("ellipse"), KINDS.index("circle"))))
    t, whole = np.radians(shape[:, 4]), known & ~sliver
    visible = np.full(len(who), np.nan)
    visible[whole] = seen_points(*shape[whole, :4].T, np.cos(t[whole]), np.sin(t[whole]), height / scale, width / scale) / 360
    shape[sliver | ~known], arc[~known] = np.nan, np.nan
    wide = lambda v: _placed(v, who, n)
    columns = [every, at_border, hull, cut, None, wide(np.minimum(arc, 360.0)), wide(visible), *map(wide, shape.T), *map(wide, circle.T)]
    kinds = np.full(n, -1)
    kinds[who] = kind
    return dict(zip(FIT, columns)), kinds


KINDS = ("circle", "ellipse", "visible")


def _placed(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.nan)
    out[at] = values
    return out


def _fitted(masks: DataFrame, keys: list[str], height: int, width: int, scale: float, rules: EdgeRules, cut_only: bool, more: list[str], hulls: bool = True) -> DataFrame:
    """keys, ``FIT`` and of ``more`` the mask's ``MOMENTS`` or pixels, in one pass; masks without pixels have no row. Without ``hulls`` convex_pixels is 0."""

    def fit(batches):
        for batch in batches:
            sizes, pixels = lists(batch, "pixels")
            ends, at = np.cumsum(sizes), 0
            columns = {c: batch.column(c) for c in (*keys, "pixels")}
            if "n" in more:
                columns |= {k: pa.array(v) for k, v in moments(sizes, pixels, width).items()}
            i, j = np.divmod(pixels, width)
            start = ends - sizes
            box = lambda v: np.maximum.reduceat(v, start) - np.minimum.reduceat(v, start) + 3 if len(v) else v
            cells, parts, kinds = np.cumsum(box(i) * box(j)), [], []
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + CELLS, "right")))
                found, kind = _fits(sizes[at:to], pixels[start[at] : ends[to - 1]], height, width, scale, rules, cut_only, hulls)
                parts.append(found)
                kinds.append(kind)
                at = to
            if parts:
                names = pa.array([*KINDS, None], pa.string())
                columns |= {c: pa.array(np.concatenate([p[c] for p in parts]), from_pandas=True) for c in FIT if c != "fit_kind"}
                columns["fit_kind"] = names.take(pa.array(np.concatenate(kinds) % len(names)))
                yield pa.RecordBatch.from_arrays([columns[c] for c in (*keys, *FIT, *more)], [*keys, *FIT, *more])

    kinds = {"pixels": masks.schema["pixels"].dataType.simpleString(), "n": "long"}
    schema = types(masks, keys) + ", ".join(f"{c} {t}" for c, t in (FIT | {c: kinds.get(c, "double") for c in more}).items())
    return masks.select(*keys, "pixels").filter(F.size("pixels") > 0).mapInArrow(fit, schema)


def outline_fits(masks: DataFrame, keys: list[str], height: int, width: int, scale: float = 1.0, rules: EdgeRules = EdgeRules(), cut_only: bool = False) -> DataFrame:
    """keys and ``FIT``: the outline of each mask with pixels (a grid of ``height`` x ``width``), fitted in image pixels.

    The longest contour counts. Where three of its points or more are at the grid's border the mask is cut: those points are left out, and a circle, or an ellipse that is
    clearly nearer to a long enough arc, is fitted to what is seen, so the centre may lie outside the image; a short arc is a sliver (``visible``), which has its circle only. Else
    it is the ellipse, or the circle if there is none. outline_points, border_points and convex_pixels (of the convex hull) are of all contours. Contours of fewer than six
    points, or in a line, have no fit, nor have with ``cut_only`` masks that aren't cut. Masks without pixels have no row.
    """
    return _fitted(masks, keys, height, width, scale, rules, cut_only, [])


def measure_with_edges(masks: DataFrame, keys: list[str], height: int, width: int, scale: float = 1.0, rules: EdgeRules = EdgeRules()) -> DataFrame:
    """A row for each mask with pixels: x, y, area_px2, r_eq, major_axis, minor_axis, orientation_deg, eccentricity, solidity, area_visible_px2, edge_truncated, fit_kind,
    arc_deg, outline_visible_frac, fit_reliable.

    Masks inside the image are measured by their pixels (fit_kind ``mask``); those that the image cuts by the outline fitted to what is seen, so that size and centre are those
    of the whole object. Slivers keep the measures of their pixels and aren't reliable. area_visible_px2 and solidity are always those of the pixels.
    """
    f = _fitted(masks, keys, height, width, scale, rules, True, [*MOMENTS]).withColumnsRenamed({"y": "_y", "x": "_x", "fit_kind": "_kind", "arc_deg": "_arc", "outline_visible_frac": "_seen", "edge_truncated": "_cut"})
    j = f.withColumns(measures(scale))
    cut = F.col("_cut") & F.col("_kind").isNotNull()
    sliver, fitted = cut & (F.col("_kind") == "visible"), cut & (F.col("_kind") != "visible")
    a, b = F.col("semi_major"), F.col("semi_minor")
    pick = lambda there, here: F.when(fitted, there).otherwise(here)
    turned = F.when(F.col("_kind") == "ellipse", F.pmod(180 - F.col("angle_deg"), F.lit(180.0)) - 90)
    return j.select(
        *keys,
        pick(F.col("_x"), F.col("x")).alias("x"),
        pick(F.col("_y"), F.col("y")).alias("y"),
        pick(a * b * math.pi, F.col("area_px2")).alias("area_px2"),
        pick(equal_area_radius(a, b), F.col("r_eq")).alias("r_eq"),
        pick(a * 2, F.col("major_axis")).alias("major_axis"),
        pick(b * 2, F.col("minor_axis")).alias("minor_axis"),
        pick(turned, F.col("orientation_deg")).alias("orientation_deg"),
        pick(F.sqrt(F.greatest(F.lit(0.0), 1 - (b / a) * (b / a))), F.col("eccentricity")).alias("eccentricity"),
        (F.col("area_px2") * scale**2 / F.col("convex_pixels")).alias("solidity"),
        F.col("area_px2").alias("area_visible_px2"),
        cut.alias("edge_truncated"),
        F.when(cut, F.col("_kind")).otherwise("mask").alias("fit_kind"),
        F.when(cut, F.col("_arc")).otherwise(360.0).alias("arc_deg"),
        F.when(~sliver, pick(F.col("_seen"), F.lit(1.0))).alias("outline_visible_frac"),
        (~sliver & (~cut | (F.col("_arc") >= rules.reliable_arc))).alias("fit_reliable"),
    )


def mask_rows(masks: DataFrame, keep: list[str], width: int) -> DataFrame:
    """keep, y, first, last: the intervals of each grid row that a mask's pixels fill."""
    p = F.col("pixels")
    begins = F.filter(p, lambda v, i: (i == 0) | (F.get(p, i - 1) != v - 1) | (v % width == 0))
    ends = F.filter(p, lambda v, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != v + 1) | (v % width == width - 1))
    runs = masks.select(*keep, F.explode(F.arrays_zip(begins.alias("b"), ends.alias("e"))).alias("run"))
    return runs.select(*keep, F.floor(F.col("run.b") / width).alias("y"), (F.col("run.b") % width).alias("first"), (F.col("run.e") % width).alias("last"))


def row_overlaps(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, name, iou of each of ``right``'s shapes (keys, name, y, first, last) with the mask of its keys in ``left`` (keys, y, first, last). Intervals meet by grid row; those of one
    side don't overlap. Shapes without an interval, or without a mask, have no row."""
    size = F.sum(F.col("last") - F.col("first") + 1)
    both = right.join(left.select(*keys, "y", F.col("first").alias("_first"), F.col("last").alias("_last")), [*keys, "y"])
    shared = F.greatest(F.lit(0), F.least("last", "_last") - F.greatest("first", "_first") + 1)
    inter = both.groupBy(*keys, name).agg(F.sum(shared).alias("_both"))
    sizes = right.groupBy(*keys, name).agg(size.alias("_n")).join(left.groupBy(*keys).agg(size.alias("_m")), keys)
    joined = sizes.join(inter, [*keys, name], "left").withColumn("_both", F.coalesce("_both", F.lit(0)))
    return joined.select(*keys, name, (F.col("_both") / (F.col("_n") + F.col("_m") - F.col("_both"))).alias("iou"))


def shape_overlaps(masks: DataFrame, keys: list[str], shapes: dict[str, tuple], height: int, width: int, scale: float = 1.0) -> DataFrame:
    """keys and for each of ``shapes`` (name: columns row, col, a, b, angle_deg, in image pixels) the iou of a row's mask (``pixels``, sorted) and ellipse; null where the shape is
    unknown or has no pixel, or the mask has none. Both are in one row, so nothing is shuffled."""
    names = list(shapes)

    def rate(batches):
        for batch in batches:
            sizes, pixels = lists(batch, "pixels")
            place, out = np.repeat(np.arange(len(sizes)), sizes) * (height * width) + pixels, []
            for k in range(len(names)):
                first = len(keys) + 1 + 5 * k
                own, y, lo, hi = ellipse_spans(*(batch.column(c).to_numpy(zero_copy_only=False) for c in range(first, first + 5)), height, width, scale)
                row = own * (height * width) + y * width
                both = np.bincount(own, np.searchsorted(place, row + hi, "right") - np.searchsorted(place, row + lo, "left"), len(sizes))
                all_ = np.bincount(own, hi - lo + 1, len(sizes))
                with np.errstate(invalid="ignore"):
                    out.append(pa.array(np.where((all_ > 0) & (sizes > 0), both / (all_ + sizes - both), np.nan), from_pandas=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *out], [*keys, *names])

    one = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    columns = (one(c).alias(f"_{name}_{k}") for name, shape in shapes.items() for k, c in enumerate(shape))
    return masks.select(*keys, "pixels", *columns).mapInArrow(rate, types(masks, keys) + ", ".join(f"`{name}` double" for name in names))


def shapes_of_masks(masks: DataFrame, keys: list[str], height: int, width: int, scale: float = 1.0, kind: str = "auto", rules: EdgeRules = EdgeRules()) -> DataFrame:
    """keys, y, x, semi_major, semi_minor, angle_deg, fit_kind (circle, ellipse, sliver), iou: the shape for each mask, in image pixels.

    Inside the image it is that of the circle and the ellipse fitted to the outline and the ellipse with the mask's area, centre and moments which overlaps the mask best. Of
    a mask that the image cuts it is the fit to what is seen, if that overlaps the mask by half, else the ellipse of the moments; of a sliver the circle of its arc, whose iou is
    null. ``kind`` auto: shapes rounder than ``rules.round_ratio`` become circles of their area; ellipse: none; circle: all. Masks of fewer than three pixels without a fit, and slivers whose circle is larger
    than the image, have no row.
    """
    if kind not in ("auto", "ellipse", "circle"):
        raise ValueError(f"kind must be auto, ellipse or circle, not {kind}")
    # A pixel's own extent is part of the moments; the area stays the mask's.
    of = measures(scale)
    half = lambda c: F.sqrt(of[c] * of[c] / 16 + 1 / (12 * scale**2)) * 2
    found = _fitted(masks, keys, height, width, scale, rules, False, [*MOMENTS, "pixels"], hulls=False).withColumns({"area_px2": of["area_px2"], "my": of["y"], "mx": of["x"], "_a": half("major_axis"), "_b": half("minor_axis"), "mt": 90 - of["orientation_deg"]})
    same = F.sqrt(F.col("area_px2") / (F.col("_a") * F.col("_b") * math.pi))
    found = found.withColumns({"ma": F.col("_a") * same, "mb": F.col("_b") * same})
    cut, sliver = F.coalesce(F.col("edge_truncated") & F.col("fit_kind").isNotNull(), F.lit(False)), F.coalesce(F.col("fit_kind") == "visible", F.lit(False))
    names = ("y", "x", "semi_major", "semi_minor", "angle_deg")
    shape = lambda *cols: F.struct(*((F.col(c) if isinstance(c, str) else c).cast("double").alias(n) for n, c in zip(names, cols)))
    circle = shape("circle_y", "circle_x", "radius", "radius", F.lit(0.0))
    mean = equal_area_radius(F.col("ma"), F.col("mb"))
    own = shape("my", "mx", mean, mean, F.lit(0.0)) if kind == "circle" else shape("my", "mx", "ma", "mb", "mt")
    fitted = circle if kind == "circle" else F.when(F.col("fit_kind") == "ellipse", shape(*names)).otherwise(circle)
    small = F.col("radius") <= max(height, width) / scale
    usable = F.when(cut & F.lit(kind == "circle"), small).otherwise((F.col("radius") > 0) & (cut | (F.col("fit_kind") != "ellipse") | (F.col("semi_major") < F.col("radius") * 3)))
    options = {"_own": F.when(F.col("area_px2") * scale**2 >= 3, own), "_round": F.when(~cut & (F.col("radius") > 0), circle), "_fit": F.when(~sliver & usable, fitted)}
    j = found.select(*keys, "pixels", cut.alias("_cut"), sliver.alias("_sliver"), small.alias("_small"), circle.alias("_circle"), *(v.alias(k) for k, v in options.items()))
    slivers = F.col("_sliver") & F.col("_small")
    j = j.filter(~F.col("_sliver") | slivers)
    carried = [*keys, "_cut", "_sliver", "_circle", *options]
    tried = shape_overlaps(j, carried, {f"{k}_iou": tuple(f"{k}.{n}" for n in names) for k in options}, height, width, scale)
    # The fit to what is seen comes first where it is good enough, and not at all where it isn't.
    iou = {k: F.coalesce(f"{k}_iou", F.lit(0.0)) for k in options}
    rank = {k: iou[k] if k == "_own" else F.when(F.col("_cut"), F.when(iou[k] >= 0.5, F.lit(2.0)).otherwise(F.lit(-1.0))).otherwise(iou[k]) for k in options}
    rated = (F.when(F.col(k).isNotNull(), F.struct(rank[k].alias("rank"), F.lit(-at).alias("at"), F.col(k).alias("s"), iou[k].alias("iou"))) for at, k in enumerate(options))
    best = F.when(F.col("_sliver"), F.struct(F.lit(0.0).alias("rank"), F.lit(0).alias("at"), F.col("_circle").alias("s"), F.lit(None).cast("double").alias("iou"))).otherwise(F.greatest(*rated))
    out = tried.select(*keys, "_sliver", best.alias("_best")).filter("_best IS NOT NULL").select(*keys, "_sliver", "_best.s.*", "_best.iou")
    short, long = F.least("semi_major", "semi_minor"), F.greatest("semi_major", "semi_minor")
    is_round = F.lit(True) if kind == "circle" else (short / long >= rules.round_ratio) if kind == "auto" else F.lit(False)
    r = equal_area_radius(F.col("semi_major"), F.col("semi_minor"))
    is_round = is_round & ~F.col("_sliver")
    whole = F.when(F.col("_sliver"), "sliver").when(is_round | (short == long), "circle").otherwise("ellipse")
    return out.select(*keys, "y", "x", F.when(is_round, r).otherwise(long).alias("semi_major"), F.when(is_round, r).otherwise(short).alias("semi_minor"), F.when(is_round, 0.0).otherwise(F.col("angle_deg")).alias("angle_deg"), whole.alias("fit_kind"), "iou")


def polygon_spans(sizes: np.ndarray, r: np.ndarray, c: np.ndarray, rows: int, cols: int):
    """polygon (its number), y, first, last: the pixels of each grid row of polygons whose corners follow each other, by the even-odd rule; polygons of as many corners together."""
    start = np.cumsum(sizes) - sizes
    for n in np.unique(sizes[sizes >= 3]):
        same, most = np.flatnonzero(sizes == n), max(1, (1 << 18) // (n * max(1, rows)))
        for at in (same[k : k + most] for k in range(0, len(same), most)):
            corner = start[at][:, None] + np.arange(n)
            pr, pc = r[corner], c[corner]
            fine = np.isfinite(pr).all(1) & np.isfinite(pc).all(1)
            with np.errstate(invalid="ignore"):
                low, high = np.maximum(0, np.ceil(pr.min(1))), np.minimum(rows - 1, np.floor(pr.max(1)))
            lines = np.where(fine & (low <= high), high - low + 1, 0).astype(np.int64)
            own = np.repeat(np.arange(len(at)), lines)
            y = np.arange(len(own)) - np.repeat(np.cumsum(lines) - lines, lines) + low[own].astype(np.int64)
            qr, qc = np.roll(pr, -1, axis=1), np.roll(pc, -1, axis=1)
            with np.errstate(all="ignore"):
                line = y[:, None]
                met = (pr[own] <= line) != (qr[own] <= line)
                cuts = np.where(met, pc[own] + (line - pr[own]) / (qr - pr)[own] * (qc - pc)[own], np.inf)
            cuts.sort(axis=1)
            ends = np.ceil(cuts[:, : n // 2 * 2])
            first, last = np.maximum(0, ends[:, 0::2]), np.minimum(cols - 1, ends[:, 1::2] - 1)
            k, m = np.nonzero((ends[:, 1::2] < np.inf) & (first <= last))
            yield at[own[k]], y[k], first[k, m].astype(np.int64), last[k, m].astype(np.int64)


def _with_polygons(df: DataFrame, keep: list[str], points: str, height: int, width: int, scale: float, use, schema: str) -> DataFrame:
    """``use`` of a batch's columns ``keep`` and the spans of its polygons, on the grid."""
    rows, cols = round(height * scale), round(width * scale)

    def fill(batches):
        for batch in batches:
            (sizes, r), (_, c) = lists(batch, "_r"), lists(batch, "_c")
            parts = list(polygon_spans(sizes, r, c, rows, cols))
            yield use(batch.select(keep), *(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(4)))

    grid = lambda k: F.transform(points, lambda q: to_model(F.get(q, F.lit(k)).cast("double"), scale))
    return df.filter(F.size(points) >= 3).select(*keep, grid(0).alias("_r"), grid(1).alias("_c")).mapInArrow(fill, types(df, keep) + schema)


def polygon_rows(df: DataFrame, keep: list[str], points: str, height: int, width: int, scale: float = 1.0) -> DataFrame:
    """keep, y, first, last: the pixels of each grid row whose centres a polygon ([row, column] points in image pixels, of any shape) holds, by the even-odd rule, inside the
    image. The intervals of a row don't overlap. A polygon of fewer than three points has no rows."""
    rows = lambda kept, own, *span: pa.RecordBatch.from_arrays([*kept.take(pa.array(own)).columns, *map(pa.array, span)], [*keep, "y", "first", "last"])
    return _with_polygons(df, keep, points, height, width, scale, rows, "y long, first long, last long")


def polygon_areas(df: DataFrame, keys: list[str], points: str, height: int, width: int, scale: float = 1.0) -> DataFrame:
    """keys, area_visible_px2: ``rows_area`` of the ``polygon_rows`` of each polygon, added up where it is filled; those without a pixel have no row."""

    def area(kept, own, _, first, last):
        pixels = np.bincount(own, last - first + 1, kept.num_rows)
        held = np.flatnonzero(pixels)
        return pa.RecordBatch.from_arrays([*kept.take(pa.array(held)).columns, pa.array(pixels[held] / scale**2)], [*keys, "area_visible_px2"])

    return _with_polygons(df, keys, points, height, width, scale, area, "area_visible_px2 double")


def rows_area(rows: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """keys, area_visible_px2: the pixels of intervals that don't overlap, in image pixels."""
    return rows.groupBy(*keys).agg((F.sum(F.col("last") - F.col("first") + 1) / scale**2).alias("area_visible_px2"))


def pixels_of(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, pixels: the mask of intervals (y, first, last) that don't overlap."""
    run = F.sequence(F.col("y") * width + F.col("first"), F.col("y") * width + F.col("last"))
    return rows.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list(run))).alias("pixels"))


def _with_area(df: DataFrame, rows: int, cols: int, scale: float) -> DataFrame:
    """df with area_visible_px2, the pixels of each ellipse; those without a pixel go."""
    names = df.columns

    def area(batches):
        for batch in batches:
            own, _, first, last = ellipse_spans(*(v.to_numpy(zero_copy_only=False) for v in batch.columns[-5:]), rows, cols, scale)
            pixels = np.bincount(own, last - first + 1, batch.num_rows)
            held = np.flatnonzero(pixels)
            yield pa.RecordBatch.from_arrays([*batch.select(names).take(pa.array(held)).columns, pa.array(pixels[held] / scale**2)], [*names, "area_visible_px2"])

    shape = (F.col(c).cast("double").alias(f"_{c}") for c in ("y", "x", "semi_major", "semi_minor", "angle_deg"))
    return df.select(*names, *shape).mapInArrow(area, types(df, names) + "area_visible_px2 double")


def measure_shapes(df: DataFrame, keys: list[str], height: int, width: int, scale: float = 1.0, least_arc: float = EdgeRules.reliable_arc) -> DataFrame:
    """Measures of circles and ellipses (keys, y, x, semi_major, semi_minor, angle_deg, fit_kind) that have a pixel in the image: the whole shape's x, y, area_px2, r_eq, axes,
    orientation_deg (null for circles), eccentricity and solidity, what is seen of it (area_visible_px2, outline_visible_frac, arc_deg), shape_type, edge_truncated, fit_kind, fit_reliable."""
    seen = _with_area(with_visibility(df, height, width, least_arc), round(height * scale), round(width * scale), scale)
    a, b = F.col("semi_major"), F.col("semi_minor")
    circle = F.col("shape_type") == "circle"
    kind = F.when(F.col("fit_kind").isin("sliver", "from_polygon"), F.col("fit_kind")).otherwise(F.col("shape_type"))
    return seen.select(
        *keys, "shape_type", "x", "y", (a * b * math.pi).alias("area_px2"), equal_area_radius(a, b).alias("r_eq"), (a * 2).alias("major_axis"), (b * 2).alias("minor_axis"),
        F.when(~circle, F.pmod(180 - F.col("angle_deg"), F.lit(180.0)) - 90).alias("orientation_deg"), "eccentricity", F.lit(1.0).alias("solidity"), "area_visible_px2", "edge_truncated", kind.alias("fit_kind"),
        "arc_deg", "outline_visible_frac", "fit_reliable",
    )
