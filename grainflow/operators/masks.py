"""Shapes as pixels: rasterised ellipses, what they cover together, measures and overlaps of masks, outlines fitted by circles and ellipses.

A mask is a sorted array of pixel numbers, row * width + column. Pixels are counted from their centres: the pixel of row i and column j of a grid ``scale``
times as fine lies at ((i + 0.5) / scale - 0.5, (j + 0.5) / scale - 0.5) of the image.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainflow.operators.geometry import box_overlaps


def to_model(v: Column, scale: float) -> Column:
    """An image coordinate on a grid ``scale`` times as fine."""
    return (v + 0.5) * scale - 0.5


def to_image(v: Column, scale: float) -> Column:
    return (v + 0.5) / scale - 0.5


def too_small(a: Column, b: Column, least: float = 0.5) -> Column:
    """Whether an ellipse has a semi-axis below ``least`` pixels; unknown axes are too small."""
    return ~F.coalesce((a >= least) & (b >= least), F.lit(False))


def equal_area_radius(a: Column, b: Column) -> Column:
    """The radius of the circle with an ellipse's area."""
    return F.sqrt(a * b)


def arc_degrees(angles: Column, step: int = 10) -> Column:
    """How much of a full turn directions (degrees) reach, in steps: the different steps they fall in."""
    return F.size(F.array_distinct(F.transform(angles, lambda a: F.pmod(F.floor(a / step), F.lit(360 // step))))) * step


def ellipse_rows(df: DataFrame, keep: list[str], row: str, col: str, a: str, b: str, angle_deg: str, height: int, width: int, scale: float = 1.0) -> DataFrame:
    """keep, y, first, last: the pixels of each grid row whose centres an ellipse holds, inside the image. An ellipse of no size, or one that holds no centre, has no rows.

    On a row the ellipse's equation is quadratic in the column, so its ends are a closed form and nothing is tested pixel by pixel.
    """
    rows, cols, t = round(height * scale), round(width * scale), F.radians(angle_deg)
    inv = lambda c: 1 / (F.col(c) * F.col(c))
    cc, ss, sc = F.cos(t) * F.cos(t), F.sin(t) * F.sin(t), F.sin(t) * F.cos(t)
    e = df.filter((F.col(a) > 0) & (F.col(b) > 0)).select(
        *keep, F.col(row).alias("_r"), F.col(col).alias("_c"), (cc * inv(a) + ss * inv(b)).alias("_qa"), (sc * (inv(a) - inv(b))).alias("_qb"), (ss * inv(a) + cc * inv(b)).alias("_qc"), F.sqrt(F.col(a) * F.col(a) * ss + F.col(b) * F.col(b) * cc).alias("_reach")
    )
    low = F.greatest(F.lit(0), F.ceil(to_model(F.col("_r") - F.col("_reach"), scale)))
    high = F.least(F.lit(rows - 1), F.floor(to_model(F.col("_r") + F.col("_reach"), scale)))
    e = e.withColumns({"_lo": low, "_hi": high}).filter("_lo <= _hi").withColumn("y", F.explode(F.sequence("_lo", "_hi")))
    d = to_image(F.col("y"), scale) - F.col("_r")
    e = e.withColumn("_d", d).withColumn("_q", F.pow(F.col("_qb") * F.col("_d"), 2) - F.col("_qa") * (F.col("_qc") * F.col("_d") * F.col("_d") - 1)).filter("_q >= 0")
    edge = lambda sign: to_model(F.col("_c") + (-F.col("_qb") * F.col("_d") + sign * F.sqrt("_q")) / F.col("_qa"), scale)
    e = e.select(*keep, "y", F.greatest(F.lit(0), F.ceil(edge(-1))).alias("first"), F.least(F.lit(cols - 1), F.floor(edge(1))).alias("last"))
    return e.filter("first <= last")


def ellipse_coverage(df: DataFrame, frame: list[str], row: str, col: str, a: str, b: str, angle_deg: str, height: int, width: int, scale: float = 2.0) -> DataFrame:
    """frame, coverage: the share of a frame's pixels that its ellipses cover together. A grid row's intervals are united in order, so a task sees one row's ellipses."""
    spans = ellipse_rows(df, frame, row, col, a, b, angle_deg, height, width, scale)
    before = F.max("last").over(Window.partitionBy(*frame, "y").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(before, F.lit(-1))))
    covered = spans.withColumn("_new", new).groupBy(*frame).agg(F.sum("_new").alias("_pixels"))
    all_ = round(height * scale) * round(width * scale)
    return df.select(*frame).distinct().join(covered, frame, "left").select(*frame, (F.coalesce("_pixels", F.lit(0)) / all_).alias("coverage"))


def lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The lengths and the numbers of an array column, one after the other."""
    column = batch.column(name)
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def types(df: DataFrame, columns: list[str]) -> str:
    """Columns of ``df`` as the beginning of a schema."""
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def ellipse_spans(r: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray, angle_deg: np.ndarray, rows: int, cols: int, scale: float) -> tuple[np.ndarray, ...]:
    """ellipse (its number), y, first, last: ``ellipse_rows`` of a batch. A pixel so near to an end that rounding decides is tried by the ellipse's equation itself."""
    with np.errstate(all="ignore"):
        cos, sin = np.cos(np.radians(angle_deg)), np.sin(np.radians(angle_deg))
        near = np.minimum(0.25, 1e-6 * (1 + np.maximum(a, b) * scale))
        reach = np.sqrt(a * a * sin * sin + b * b * cos * cos)
        low, high = np.maximum(0, np.ceil((r - reach + 0.5) * scale - 0.5 - near)), np.minimum(rows - 1, np.floor((r + reach + 0.5) * scale - 0.5 + near))
        n = np.where((a > 0) & (b > 0) & np.isfinite(c) & (low <= high), high - low + 1, 0).astype(np.int64)
        own = np.repeat(np.arange(len(n)), n)
        y = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + low[own].astype(np.int64)
        d = (y + 0.5) / scale - 0.5 - r[own]
        qa, qb, ab = cos * cos / (a * a) + sin * sin / (b * b), sin * cos * (1 / (a * a) - 1 / (b * b)), (a * b) ** 2
        middle, half = c[own] - (qb / qa)[own] * d, np.sqrt(np.maximum(qa[own] - d * d / ab[own], 0.0)) / qa[own]
        ends = ((middle - half + 0.5) * scale - 0.5, (middle + half + 0.5) * scale - 0.5)
        first, last = np.ceil(ends[0] - near[own]), np.floor(ends[1] + near[own])
        for place, end, step in ((first, ends[0], 1), (last, ends[1], -1)):
            at = np.flatnonzero(np.abs(place - end) <= near[own])
            k, dx, dy = own[at], (place[at] + 0.5) / scale - 0.5 - c[own[at]], d[at]
            u, v = (dx * cos[k] + dy * sin[k]) / a[k], (dy * cos[k] - dx * sin[k]) / b[k]
            place[at[~(u * u + v * v <= 1)]] += step
    first, last = np.maximum(first, 0), np.minimum(last, cols - 1)
    kept = first <= last
    return own[kept], y[kept], first[kept].astype(np.int64), last[kept].astype(np.int64)


def rasterised(df: DataFrame, keys: list[str], row: str, col: str, a: str, b: str, angle_deg: str, height: int, width: int, scale: float = 1.0) -> DataFrame:
    """keys, pixels: the mask of each ellipse; those without a pixel have no row. Ellipses are drawn in tasks, a batch at once, where they are."""
    rows, cols = round(height * scale), round(width * scale)

    def draw(batches):
        for batch in batches:
            shape = [v.to_numpy(zero_copy_only=False) for v in batch.columns[-5:]]
            own, y, first, last = ellipse_spans(*shape, rows, cols, scale)
            long = last - first + 1
            pixels = np.repeat(y * cols + first - (np.cumsum(long) - long), long) + np.arange(long.sum())
            size = np.bincount(own, long, batch.num_rows).astype(np.int64)
            held = np.flatnonzero(size)
            drawn = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size[held])).astype(np.int32)), pa.array(pixels))
            yield pa.RecordBatch.from_arrays([*batch.select(keys).take(pa.array(held)).columns, drawn], [*keys, "pixels"])

    shape = (F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate((row, col, a, b, angle_deg)))
    return df.select(*keys, *shape).mapInArrow(draw, types(df, keys) + "pixels array<long>")


#: What is summed up of a mask's pixels: their number, mean row and column, variances and covariance.
MOMENTS = ("n", "mi", "mj", "vi", "vj", "cij")


def moments(sizes: np.ndarray, pixels: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """``MOMENTS`` of masks with pixels, which follow each other."""
    start, (i, j) = np.cumsum(sizes) - sizes, np.divmod(pixels, width)
    mean = lambda v: np.add.reduceat(v, start) / sizes if len(sizes) else np.zeros(0)
    mi, mj = mean(i.astype(float)), mean(j.astype(float))
    di, dj = i - np.repeat(mi, sizes), j - np.repeat(mj, sizes)
    return dict(zip(MOMENTS, (sizes.astype(np.int64), mi, mj, mean(di * di), mean(dj * dj), mean(di * dj))))


def measures(scale: float) -> dict[str, Column]:
    """What ``measure_masks`` says of a mask, from its ``MOMENTS``."""
    half, root = (F.col("vi") + F.col("vj")) / 2, F.sqrt(F.pow((F.col("vi") - F.col("vj")) / 2, 2) + F.col("cij") * F.col("cij"))
    long, short = half + root, F.greatest(F.lit(0.0), half - root)
    return {
        "area_px2": F.col("n") / scale**2, "x": to_image(F.col("mj"), scale), "y": to_image(F.col("mi"), scale), "r_eq": F.sqrt(F.col("n") / math.pi / scale**2), "major_axis": F.sqrt(long) * 4 / scale, "minor_axis": F.sqrt(short) * 4 / scale,
        "orientation_deg": F.degrees(F.atan2(F.col("cij") * 2, F.col("vi") - F.col("vj")) / 2), "eccentricity": F.when(long > 0, F.sqrt(1 - short / long)).otherwise(0.0),
    }


def measure_masks(masks: DataFrame, keys: list[str], width: int, scale: float = 1.0) -> DataFrame:
    """Area, centre, axes, direction and eccentricity of each mask from the second moments of its pixels, in image pixels; one row for each mask with pixels.

    orientation_deg is the angle of the long axis from the row axis. axis lengths are four standard deviations along the axes.
    """

    def summed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, moments(*lists(batch, "pixels"), width).values())], [*keys, *MOMENTS])

    m = masks.select(*keys, "pixels").filter(F.size("pixels") > 0).mapInArrow(summed, types(masks, keys) + "n long, mi double, mj double, vi double, vj double, cij double")
    return m.select(*keys, *(v.alias(c) for c, v in measures(scale).items()))


def mask_overlaps(masks: DataFrame, by: list[str], key: str, width: int, cell: float = 32.0) -> DataFrame:
    """by, a, b, iou of pairs of a group's masks that share pixels. Masks whose boxes overlap are compared, others never meet."""
    r, c = F.transform("pixels", lambda p: F.floor(p / width)), F.transform("pixels", lambda p: F.pmod(p, F.lit(width)))
    boxes = masks.select(*by, key, F.array_min(r).alias("r0"), F.array_min(c).alias("c0"), (F.array_max(r) + 1).alias("r1"), (F.array_max(c) + 1).alias("c1"))
    near = box_overlaps(boxes, by, key, ("r0", "c0", "r1", "c1"), cell).select(*by, "a", "b")
    side = lambda name: masks.select(*by, F.col(key).alias(name), F.col("pixels").alias(f"_{name}"))
    met = near.join(side("a"), [*by, "a"]).join(side("b"), [*by, "b"]).withColumn("_n", F.size(F.array_intersect("_a", "_b"))).filter("_n > 0")
    return met.select(*by, "a", "b", (F.col("_n") / (F.size("_a") + F.size("_b") - F.col("_n"))).alias("iou"))


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The shortest least-squares solution of each a x = b of a stack."""
    q, upper = np.linalg.qr(a)
    return (np.linalg.pinv(upper, rcond=a.shape[1] * np.finfo(float).eps) @ (q.transpose(0, 2, 1) @ b[:, :, None]))[:, :, 0]


def circles_of(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``circle_of`` for each row of a stack, all at once; NaN where there is none, also where points aren't finite."""
    out = np.full((len(r), 3), np.nan)
    live = np.flatnonzero(np.isfinite(r).all(1) & np.isfinite(c).all(1))
    if r.shape[1] < 3 or not len(live):
        return out
    u, v = r - r.mean(1, keepdims=True), c - c.mean(1, keepdims=True)
    design = np.stack([2 * u[live], 2 * v[live], np.ones_like(u[live])], axis=2)
    full = np.linalg.matrix_rank(design) == 3
    done, live = live[full], live[full]
    x, y, k = _solved(design[full], u[live] ** 2 + v[live] ** 2).T
    out[live] = np.column_stack([x, y, np.sqrt(np.maximum(k + x * x + y * y, 1e-12))])
    for _ in range(50):
        if not len(live):
            break
        du, dv, rad = u[live] - out[live, :1], v[live] - out[live, 1:2], out[live, 2:]
        far = np.hypot(du, dv)
        safe = np.maximum(far, 1e-12)
        step = _solved(np.stack([-du / safe, -dv / safe, -np.ones_like(safe)], axis=2), rad - far)
        out[live] += step
        live = live[np.abs(step).max(1) >= 1e-10 * np.maximum(1.0, out[live, 2])]
    out[done, :2] += np.column_stack([r[done].mean(1), c[done].mean(1)])
    return out


def circle_of(r: np.ndarray, c: np.ndarray) -> tuple[float, float, float] | None:
    """Centre and radius of the circle nearest to points: the algebraic one, then Gauss-Newton on distances. None for fewer than three points or points in a line."""
    if len(r) < 3:
        return None
    mr, mc = r.mean(), c.mean()
    u, v = r - mr, c - mc
    design = np.column_stack([2 * u, 2 * v, np.ones_like(u)])
    if np.linalg.matrix_rank(design) < 3:
        return None
    x, y, k = np.linalg.lstsq(design, u * u + v * v, rcond=None)[0]
    rad = math.sqrt(max(k + x * x + y * y, 1e-12))
    for _ in range(50):
        far = np.hypot(u - x, v - y)
        safe = np.maximum(far, 1e-12)
        step = np.linalg.lstsq(np.column_stack([-(u - x) / safe, -(v - y) / safe, -np.ones_like(u)]), rad - far, rcond=None)[0]
        x, y, rad = x + step[0], y + step[1], rad + step[2]
        if np.abs(step).max() < 1e-10 * max(1.0, rad):
            break
    return float(mr + x), float(mc + y), float(rad)


def ellipses_through(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``ellipse_through`` for each row of a stack, all at once; NaN where there is none."""
    out = np.full((len(r), 5), np.nan)
    if r.shape[1] < 6 or not len(r):
        return out
    try:
        with np.errstate(all="ignore"):
            _ellipses(r, c, out)
    except np.linalg.LinAlgError:  # of one of them, which is found by halves
        half = len(r) // 2
        out[:] = np.nan
        if half:
            out[:half], out[half:] = ellipses_through(r[:half], c[:half]), ellipses_through(r[half:], c[half:])
    return out


def _ellipses(r: np.ndarray, c: np.ndarray, out: np.ndarray) -> None:
    turned = lambda m: m.transpose(0, 2, 1)
    size = np.maximum(np.maximum(np.std(r, axis=1), np.std(c, axis=1)), 1e-9)[:, None]
    y, x = (r - r.mean(1, keepdims=True)) / size, (c - c.mean(1, keepdims=True)) / size
    square, line = np.stack([x * x, x * y, y * y], axis=2), np.stack([x, y, np.ones_like(x)], axis=2)
    drop = -np.linalg.solve(turned(line) @ line, turned(line) @ square)
    reduced = turned(square) @ square + turned(square) @ line @ drop
    values, vectors = np.linalg.eig(np.stack([reduced[:, 2] / 2, -reduced[:, 1], reduced[:, 0] / 2], axis=1))
    vectors = np.real(vectors)
    held = 4 * vectors[:, 0] * vectors[:, 2] - vectors[:, 1] ** 2 > 0
    at = np.flatnonzero(held.any(1))
    best = np.argmin(np.where(held, np.abs(np.real(values)), np.inf), axis=1)[at]
    conic = vectors[at, :, best]
    (a, b, d), (p, q, k) = conic.T, (drop[at] @ conic[:, :, None])[:, :, 0].T
    form = np.stack([np.stack([a, b / 2], axis=1), np.stack([b / 2, d], axis=1)], axis=1)
    x0, y0 = np.linalg.solve(2 * form, -np.stack([p, q], axis=1)[:, :, None])[:, :, 0].T
    level = -(a * x0 * x0 + b * x0 * y0 + d * y0 * y0 + p * x0 + q * y0 + k)
    lengths, axes = np.linalg.eigh(form / level[:, None, None])
    real = (lengths > 0).all(1)
    at, size = at[real], size[at[real], 0]
    long, short = (1 / np.sqrt(lengths[real])).T
    angle = np.degrees(np.arctan2(axes[real, 1, 0], axes[real, 0, 0]))
    out[at] = np.column_stack([r[at].mean(1) + y0[real] * size, c[at].mean(1) + x0[real] * size, long * size, short * size, (angle + 90) % 180 - 90])


def _conics(ll: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> np.ndarray:
    """Centre (x, y), semi-axes and angle of the ellipse of each stack of moment matrices (line by line, line by square, square by square); NaN where there is none."""
    out, turned = np.full((len(ll), 5), np.nan), lambda m: m.transpose(0, 2, 1)
    drop = -np.linalg.solve(ll, ls)
    reduced = ss + turned(ls) @ drop
    values, vectors = np.linalg.eig(np.stack([reduced[:, 2] / 2, -reduced[:, 1], reduced[:, 0] / 2], axis=1))
    vectors = np.real(vectors)
    held = 4 * vectors[:, 0] * vectors[:, 2] - vectors[:, 1] ** 2 > 0
    at = np.flatnonzero(held.any(1))
    best = np.argmin(np.where(held, np.abs(np.real(values)), np.inf), axis=1)[at]
    conic = vectors[at, :, best]
    (a, b, d), (p, q, k) = conic.T, (drop[at] @ conic[:, :, None])[:, :, 0].T
    form = np.stack([np.stack([a, b / 2], axis=1), np.stack([b / 2, d], axis=1)], axis=1)
    x0, y0 = np.linalg.solve(2 * form, -np.stack([p, q], axis=1)[:, :, None])[:, :, 0].T
    level = -(a * x0 * x0 + b * x0 * y0 + d * y0 * y0 + p * x0 + q * y0 + k)
    lengths, axes = np.linalg.eigh(form / level[:, None, None])
    real = (lengths > 0).all(1)
    long, short = (1 / np.sqrt(lengths[real])).T
    angle = np.degrees(np.arctan2(axes[real, 1, 0], axes[real, 0, 0]))
    out[at[real]] = np.column_stack([x0[real], y0[real], long, short, (angle + 90) % 180 - 90])
    return out


def _halved(f, *stacks: np.ndarray) -> np.ndarray:
    """f of stacks; where one of them has no solution it is found by halves and has NaN."""
    try:
        with np.errstate(all="ignore"):
            return f(*stacks)
    except np.linalg.LinAlgError:
        half = len(stacks[0]) // 2
        if not half:
            return np.full((1, 5), np.nan)
        return np.vstack([_halved(f, *(v[:half] for v in stacks)), _halved(f, *(v[half:] for v in stacks))])


def circles_along(r: np.ndarray, c: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``circle_of`` for outlines of three points or more that follow each other: row, col, radius from sums over each outline; NaN for points in a line."""
    out, n = np.full((len(sizes), 3), np.nan), sizes.astype(float)
    if not len(sizes):
        return out
    total = lambda v, size: np.add.reduceat(v, np.cumsum(size) - size)
    mr, mc = total(r, sizes) / n, total(c, sizes) / n
    u, v = r - np.repeat(mr, sizes), c - np.repeat(mc, sizes)
    z, uu, vv, uv = u * u + v * v, total(u * u, sizes), total(v * v, sizes), total(u * v, sizes)
    det, uz, vz = uu * vv - uv * uv, total(u * z, sizes) / 2, total(v * z, sizes) / 2
    live = np.flatnonzero(det > 1e-12 * uu * vv)
    done, in_ = live, np.zeros(len(sizes), bool)
    with np.errstate(all="ignore"):
        x, y = (vv * uz - uv * vz) / det, (uu * vz - uv * uz) / det
    rad = np.sqrt(np.maximum((uu + vv) / n + x * x + y * y, 1e-12))
    in_[live] = True
    keep = np.repeat(in_, sizes)
    u, v = u[keep], v[keep]
    for _ in range(50):
        if not len(live):
            break
        size = sizes[live]
        wide = lambda w: np.repeat(w[live], size)  # noqa: B023, E731
        du, dv = u - wide(x), v - wide(y)
        far = np.hypot(du, dv)
        safe = np.maximum(far, 1e-12)
        e, f, off, m = du / safe, dv / safe, far - wide(rad), size.astype(float)
        # Steps of the centre from sums around the means; that of the radius from the means.
        me, mf, mo = total(e, size) / m, total(f, size) / m, total(off, size) / m
        e, f, off = e - np.repeat(me, size), f - np.repeat(mf, size), off - np.repeat(mo, size)
        ee, ff, ef, eo, fo = (total(w, size) for w in (e * e, f * f, e * f, e * off, f * off))
        d = ee * ff - ef * ef
        d = np.where(d > 0, d, np.inf)
        sx, sy = (ff * eo - ef * fo) / d, (ee * fo - ef * eo) / d
        sr = mo - me * sx - mf * sy
        x[live], y[live], rad[live] = x[live] + sx, y[live] + sy, rad[live] + sr
        go = np.maximum(np.maximum(np.abs(sx), np.abs(sy)), np.abs(sr)) >= 1e-10 * np.maximum(1.0, rad[live])
        keep = np.repeat(go, size)
        u, v, live = u[keep], v[keep], live[go]
    out[done] = np.column_stack([mr + x, mc + y, rad])[done]
    return out


def ellipses_along(r: np.ndarray, c: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``ellipse_through`` for outlines of six points or more that follow each other; NaN where there is none."""
    if not len(sizes):
        return np.zeros((0, 5))
    n = sizes.astype(float)
    total = lambda v: np.add.reduceat(v, np.cumsum(sizes) - sizes)
    mr, mc = total(r) / n, total(c) / n
    y, x = r - np.repeat(mr, sizes), c - np.repeat(mc, sizes)
    size = np.maximum(np.sqrt(np.maximum(total(y * y), total(x * x)) / n), 1e-9)
    y, x = y / np.repeat(size, sizes), x / np.repeat(size, sizes)
    s, li = (x * x, x * y, y * y), (x, y, None)
    times = lambda p, q: n if p is None and q is None else total(p if q is None else q if p is None else p * q)
    matrix = lambda left, right: np.stack([np.stack([times(p, q) for q in right], axis=1) for p in left], axis=1)
    found = _halved(_conics, matrix(li, li), matrix(li, s), matrix(s, s))
    return np.column_stack([mr + found[:, 1] * size, mc + found[:, 0] * size, found[:, 2] * size, found[:, 3] * size, found[:, 4]])


def ellipse_through(r: np.ndarray, c: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """Centre, semi-axes and angle (degrees, of the long axis from the column axis) of the least-squares ellipse of points: the conic whose discriminant is held
    negative, its quadratic part an eigenvector of a 3 x 3 problem (Halir and Flusser). None for fewer than six points or where there is no ellipse."""
    if len(r) < 6:
        return None
    size = max(float(np.std(r)), float(np.std(c)), 1e-9)
    y, x = (r - r.mean()) / size, (c - c.mean()) / size
    square, line = np.column_stack([x * x, x * y, y * y]), np.column_stack([x, y, np.ones_like(x)])
    try:
        drop = -np.linalg.solve(line.T @ line, line.T @ square)
        reduced = square.T @ square + square.T @ line @ drop
        values, vectors = np.linalg.eig(np.array([reduced[2] / 2, -reduced[1], reduced[0] / 2]))
    except np.linalg.LinAlgError:
        return None
    vectors = np.real(vectors)
    held = np.flatnonzero(4 * vectors[0] * vectors[2] - vectors[1] ** 2 > 0)
    if not len(held):
        return None
    a, b, d = vectors[:, held[np.argmin(np.abs(np.real(values[held])))]]
    p, q, k = drop @ (a, b, d)
    x0, y0 = np.linalg.solve([[2 * a, b], [b, 2 * d]], [-p, -q])
    level = -(a * x0 * x0 + b * x0 * y0 + d * y0 * y0 + p * x0 + q * y0 + k)
    lengths, axes = np.linalg.eigh(np.array([[a, b / 2], [b / 2, d]]) / level)
    if not (lengths > 0).all():
        return None
    long, short = 1 / np.sqrt(lengths)
    angle = math.degrees(math.atan2(axes[1, 0], axes[0, 0]))
    return float(r.mean() + y0 * size), float(c.mean() + x0 * size), float(long * size), float(short * size), (angle + 90) % 180 - 90


def fitted_outlines(points: DataFrame, by: list[str], row: str, col: str) -> DataFrame:
    """by, n_points, circle and ellipse of each outline: row, col, radius; row, col, semi_major, semi_minor, angle_deg; null where points don't determine one.
    An outline is a group; its points are some hundreds. Outlines of as many points are fitted together."""
    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by)
    shapes = ("circle_row", "circle_col", "radius", "row", "col", "semi_major", "semi_minor", "angle_deg")

    def fit(batches):
        for batch in batches:
            sizes = batch.column("_r").value_lengths().to_numpy(zero_copy_only=False)
            start, r, c = np.cumsum(sizes) - sizes, *(batch.column(k).flatten().to_numpy() for k in ("_r", "_c"))
            found = np.full((len(sizes), len(shapes)), np.nan)
            for n in np.unique(sizes):
                same, most = np.flatnonzero(sizes == n), max(1, (1 << 16) // n)
                for at in (same[k : k + most] for k in range(0, len(same), most)):
                    own = start[at][:, None] + np.arange(n)
                    found[at] = np.hstack([circles_of(r[own], c[own]), ellipses_through(r[own], c[own])])
            columns = [*(batch.column(k) for k in by), pa.array(sizes, pa.int64()), *(pa.array(v, from_pandas=True) for v in found.T)]
            yield pa.RecordBatch.from_arrays(columns, [*by, "n_points", *shapes])

    rows = points.select(*by, F.col(row).cast("double").alias("_r"), F.col(col).cast("double").alias("_c")).filter("_r IS NOT NULL AND _c IS NOT NULL")
    outlines = rows.groupBy(*by).agg(F.collect_list("_r").alias("_r"), F.collect_list("_c").alias("_c"))
    return outlines.mapInArrow(fit, f"{kinds}, n_points long, " + ", ".join(f"{c} double" for c in shapes))
