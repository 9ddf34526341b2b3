"""Geometry of shapes as column expressions, and joins, suppression and matching of boxes within a frame."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainflow.functions.storage import settled


def ellipse_of(e1r: Column, e1c: Column, e2r: Column, e2c: Column) -> dict[str, Column]:
    """Area, equal-area radius, axes and angle of the ellipse with half-side vectors e1 and e2 (row, column), in closed form."""
    k = F.abs(e1r * e2c - e1c * e2r)
    q = e1r * e1r + e1c * e1c + e2r * e2r + e2c * e2c
    plus, minus = F.sqrt(q + 2 * k), F.sqrt(F.greatest(F.lit(0.0), q - 2 * k))
    rr, cc, rc = e1r * e1r + e2r * e2r, e1c * e1c + e2c * e2c, e1r * e1c + e2r * e2c
    return {"area": k * math.pi, "r_eq": F.sqrt(k), "semi_major": (plus + minus) / 2, "semi_minor": (plus - minus) / 2, "angle_deg": F.degrees(0.5 * F.atan2(2 * rc, cc - rr))}


def box_halves(corners: Column) -> tuple[Column, ...]:
    """The half-side vectors of four corners (array of [row, column]) of an ellipse's box."""
    p = lambda i, j: F.get(F.get(corners, F.lit(i)), F.lit(j))
    return ((p(1, 0) - p(0, 0)) / 2, (p(1, 1) - p(0, 1)) / 2, (p(3, 0) - p(0, 0)) / 2, (p(3, 1) - p(0, 1)) / 2)


def box_centre(corners: Column) -> tuple[Column, Column]:
    mean = lambda j: F.aggregate(corners, F.lit(0.0), lambda a, c: a + F.get(c, F.lit(j))) / F.size(corners)
    return mean(0), mean(1)


def polygon_moments(points: Column) -> dict[str, Column]:
    """Signed area, centroid and area of a polygon of [row, column] points, by the shoelace sums."""
    turned = F.concat(F.slice(points, F.lit(2), F.size(points) - 1), F.slice(points, F.lit(1), F.lit(1)))
    pair = F.arrays_zip(points.alias("p"), turned.alias("q"))
    r0, c0, r1, c1 = (lambda z: F.get(z["p"], F.lit(0))), (lambda z: F.get(z["p"], F.lit(1))), (lambda z: F.get(z["q"], F.lit(0))), (lambda z: F.get(z["q"], F.lit(1)))
    cross = lambda z: c0(z) * r1(z) - c1(z) * r0(z)
    total = lambda f: F.aggregate(pair, F.lit(0.0), lambda a, z: a + f(z))
    signed = total(cross) / 2
    return {"area": F.abs(signed), "row": F.try_divide(total(lambda z: (r0(z) + r1(z)) * cross(z)), signed * 6), "col": F.try_divide(total(lambda z: (c0(z) + c1(z)) * cross(z)), signed * 6)}


def polygon_ellipse(points: Column) -> Column:
    """The ellipse with a polygon's area, centroid and direction of second moments, as a struct: row, col, semi_major, semi_minor, angle_deg. Null for a polygon without area."""
    m = polygon_moments(points)
    turned = F.concat(F.slice(points, F.lit(2), F.size(points) - 1), F.slice(points, F.lit(1), F.lit(1)))
    pair = F.arrays_zip(points.alias("p"), turned.alias("q"))
    p, q = (lambda z, j: F.get(z["p"], F.lit(j))), (lambda z, j: F.get(z["q"], F.lit(j)))
    cross = lambda z: p(z, 1) * q(z, 0) - q(z, 1) * p(z, 0)
    total = lambda f: F.aggregate(pair, F.lit(0.0), lambda a, z: a + f(z) * cross(z))
    twice = total(lambda z: F.lit(1.0))
    second = lambda j: F.try_divide(total(lambda z: p(z, j) * p(z, j) + p(z, j) * q(z, j) + q(z, j) * q(z, j)), twice * 6)
    mixed = F.try_divide(total(lambda z: p(z, 1) * q(z, 0) + 2 * p(z, 1) * p(z, 0) + 2 * q(z, 1) * q(z, 0) + q(z, 1) * p(z, 0)), twice * 12)
    sums = F.struct(m["area"].alias("area"), m["row"].alias("row"), m["col"].alias("col"), second(0).alias("rr"), second(1).alias("cc"), mixed.alias("rc"))

    def ellipse(m: Column) -> Column:
        rr, cc, rc = m["rr"] - m["row"] * m["row"], m["cc"] - m["col"] * m["col"], m["rc"] - m["row"] * m["col"]
        half, spread = (cc + rr) / 2, F.hypot((cc - rr) / 2, rc)
        # A filled ellipse's variances are a quarter of its squared half axes; the area fixes the scale.
        ratio = F.sqrt(F.try_divide(half + spread, half - spread))
        whole = (F.size(points) >= 3) & (m["area"] >= 1e-6) & (half > spread)
        out = {"row": m["row"], "col": m["col"], "semi_major": F.sqrt(m["area"] / math.pi * ratio), "semi_minor": F.sqrt(m["area"] / math.pi / ratio), "angle_deg": F.degrees(0.5 * F.atan2(2 * rc, cc - rr))}
        return F.when(whole, F.struct(*(v.alias(k) for k, v in out.items())))

    return F.get(F.transform(F.array(sums), ellipse), F.lit(0))  # the sums are found once


def ellipse_corners(row: Column, col: Column, a: Column, b: Column, angle_deg: Column) -> Column:
    """The four corners [row, column] of an ellipse's box, in the order that ``box_halves`` expects."""
    t = F.radians(angle_deg)
    corner = lambda i, j: F.array(row + i * a * F.sin(t) + j * b * F.cos(t), col + i * a * F.cos(t) - j * b * F.sin(t))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def seen_points(y: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, cos_t: np.ndarray, sin_t: np.ndarray, height: float, width: float, points: int = 360) -> np.ndarray:
    """How many of ``points`` on each ellipse's outline lie in the image. Ellipses that are clearly inside or outside by their extent aren't walked; unknown ones have none."""
    reach_y, reach_x, near = np.hypot(a * sin_t, b * cos_t), np.hypot(a * cos_t, b * sin_t), 1e-6
    within = (y - reach_y > near - 0.5) & (y + reach_y < height - 0.5 - near) & (x - reach_x > near - 0.5) & (x + reach_x < width - 0.5 - near)
    beyond = (y + reach_y < -0.5 - near) | (y - reach_y > height - 0.5 + near) | (x + reach_x < -0.5 - near) | (x - reach_x > width - 0.5 + near)
    out = np.where(within, points, 0)
    around = [(i * 2 * math.pi) / points for i in range(points)]
    c, s = np.array([math.cos(i) for i in around]), np.array([math.sin(i) for i in around])
    left, most = np.flatnonzero(~(within | beyond)), max(1, (1 << 16) // points)
    for at in (left[k : k + most] for k in range(0, len(left), most)):
        of = lambda v: v[at][:, None]  # noqa: B023, E731
        ac, bs = of(a) * c, of(b) * s
        py, px = of(y) + ac * of(sin_t) + bs * of(cos_t), of(x) + ac * of(cos_t) - bs * of(sin_t)
        out[at] = ((py >= -0.5) & (py <= height - 0.5) & (px >= -0.5) & (px <= width - 0.5)).sum(axis=1)
    return out


def with_visibility(df: DataFrame, height: float, width: float, least_arc: float, points: int = 360) -> DataFrame:
    """Ellipses (y, x, semi_major, semi_minor, angle_deg, fit_kind) that are in the image at least in part, with what is seen of them.

    Adds shape_type, eccentricity, outline_visible_frac, arc_deg, edge_truncated, fit_reliable. Ellipses outside the image go: no point of the outline is in it, nor does
    the ellipse cover its centre. Drafts of slivers are truncated and never reliable. Outlines are walked in tasks, a batch of ellipses at once.
    """
    a, b, t, names = F.col("semi_major"), F.col("semi_minor"), F.radians("angle_deg"), df.columns

    def walked(batches):
        for batch in batches:
            shape = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns - 6, batch.num_columns)]
            seen = seen_points(*shape, height, width, points)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-6], pa.array(seen / points)], [*names, "outline_visible_frac"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)
    shape = (*(F.col(c).cast("double").alias(f"_{c}") for c in ("y", "x", "semi_major", "semi_minor")), F.cos(t).alias("_cos"), F.sin(t).alias("_sin"))
    drawn = df.filter(b > 0).select(*names, *shape).mapInArrow(walked, f"{kinds}outline_visible_frac double")
    dy, dx = (height - 1) / 2 - F.col("y"), (width - 1) / 2 - F.col("x")
    covers = F.pow((dx * F.cos(t) + dy * F.sin(t)) / a, F.lit(2.0)) + F.pow((dy * F.cos(t) - dx * F.sin(t)) / b, F.lit(2.0)) <= 1
    kept = drawn.filter((F.col("outline_visible_frac") > 0) | covers)
    sliver, whole = F.coalesce(F.col("fit_kind") == "sliver", F.lit(False)), F.col("outline_visible_frac") == 1
    return kept.withColumns(
        {
            "shape_type": F.when(b >= a * 0.999, "circle").otherwise("ellipse"),
            "eccentricity": F.sqrt(F.greatest(F.lit(0.0), 1 - (b / a) * (b / a))),
            "arc_deg": F.col("outline_visible_frac") * 360,
            "edge_truncated": ~whole | sliver,
            "fit_reliable": ~sliver & (whole | (F.col("outline_visible_frac") * 360 >= least_arc)),
        }
    )


def outline(row: Column, col: Column, a: Column, b: Column, angle_deg: Column, n: int = 128) -> Column:
    """n points of an ellipse's outline as an array of [row, column]."""
    t = F.radians(angle_deg)
    at = lambda i: i * (2 * math.pi / n)
    point = lambda i: F.array(row + a * F.cos(at(i)) * F.sin(t) + b * F.sin(at(i)) * F.cos(t), col + a * F.cos(at(i)) * F.cos(t) - b * F.sin(at(i)) * F.sin(t))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def outline_points(row: Column, col: Column, a: Column, b: Column, angle_deg: Column, n: int) -> list[Column]:
    """The points of ``outline`` as a column each, for small n."""
    t = F.radians(angle_deg)
    around = [(i * 2 * math.pi) / n for i in range(n)]
    return [F.array(row + a * math.cos(i) * F.sin(t) + b * math.sin(i) * F.cos(t), col + a * math.cos(i) * F.cos(t) - b * math.sin(i) * F.sin(t)) for i in around]


#: Different places that a cell of the finest grid holds at most, if no grid down to ``4 ** -FINEST`` of the mean size is finer; and the number of these grids.
CROWDED, FINEST = 64, 10
#: Cells along a block's side, and rows of group keys or places that are broadcast at most.
BLOCK, FEW = 8, 500_000


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def nearest_neighbours(df: DataFrame, by: list[str], key: str, x: str, y: str, cell: float | None = None) -> DataFrame:
    """Each point's distance to the nearest other point of its group (nn); a point alone in its group has no row.

    Points at the same place are at distance 0 and done. The other places meet in blocks of square cells, which also hold the places in the cells around: an equi-join, so a
    frame of any size is dealt out, and only places at a block's edge are shuffled more than once. A group's cells have a size of ``cell``, or one at which they hold two points
    on average; where points lie in clusters the grid begins so fine that no cell is crowded. Points without a neighbour in reach go to a grid four times as coarse, until none
    is left or a grid has one cell; what is left is written after each round, and if it is little only the blocks concerned are shuffled again.
    """
    points = df.select(*by, F.col(key).alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    width, height = F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y")
    spans = points.groupBy(*by).agg(F.greatest(width, height).alias("_span"), F.greatest(F.sqrt(width * height * 2 / F.count(F.lit(1))), F.greatest(width, height) / F.count(F.lit(1)), F.lit(1e-9)).alias("_own"))
    size = F.lit(float(cell)) if cell else F.col("_own")
    spans = settled(spans.select(*by, "_span", size.alias("_size")), "neighbours")
    places = points.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_k"))
    places = settled(places.join(_few(spans, spans.count()), by), "neighbours")
    at = lambda c, scale: F.floor(F.col(c) / (F.col("_size") * scale))
    scale = 1.0
    for k in range(FINEST + 1):
        scale = 4.0**-k
        most = places.select(*by, at("_x", scale).alias("_i"), at("_y", scale).alias("_j")).groupBy(*by, "_i", "_j").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if (most or 0) <= CROWDED:
            break
    same = places.filter("_n > 1").select(*by, "_x", "_y")
    out = points.join(_few(same, same.count()), [*by, "_x", "_y"], "left_semi").select(*by, F.col("_k").alias(key), F.lit(0.0).alias("nn"))
    left = places.filter("_n = 1").drop("_n")
    carried = [c for c in left.columns if c not in by and c != "_k"]
    block, blocks = lambda c: F.floor(c / BLOCK), [*by, "_bi", "_bj"]
    first = True
    while True:
        asked = left.withColumns({"_bi": block(at("_x", scale)), "_bj": block(at("_y", scale))})
        around = lambda c: F.explode(F.sequence(block(at(c, scale) - 1), block(at(c, scale) + 1)))  # noqa: B023, E731
        others = places.withColumn("_bi", around("_x")).withColumn("_bj", around("_y")).select(*blocks, F.col("_x").alias("_ox"), F.col("_y").alias("_oy"))
        if not first:
            concerned = asked.select(*blocks).distinct()
            n = concerned.count()
            others = others.join(F.broadcast(concerned), blocks, "left_semi") if n <= FEW else others
        far = F.when((F.col("_x") != F.col("_ox")) | (F.col("_y") != F.col("_oy")), F.hypot(F.col("_x") - F.col("_ox"), F.col("_y") - F.col("_oy")))
        near = asked.join(others, blocks, "left").groupBy(*blocks, "_k").agg(F.min(far).alias("nn"), *(F.first(c).alias(c) for c in carried))
        here = F.col("_size") * scale
        done = F.coalesce(F.col("nn") <= here, F.lit(False))
        near = settled(near.select(*by, "_k", F.when(done, F.col("nn")).alias("nn"), *(F.when(~done, F.col(c)).alias(c) for c in carried)), "neighbours")
        out = out.unionByName(near.filter("nn IS NOT NULL").select(*by, F.col("_k").alias(key), "nn"))
        left = near.filter(F.col("nn").isNull() & (here <= F.col("_span"))).drop("nn")
        if left.isEmpty():
            return out
        scale, first = scale * 4, False


def nearest_on_curve(points: DataFrame, curves: DataFrame, by: list[str], x: str, y: str, curve: str) -> DataFrame:
    """points with the place (index), x, y and distance of the nearest vertex of their group's curve. curves: by, an array of [x, y]; of equals the first counts."""
    joined = points.join(curves.select(*by, F.col(curve).alias("_c")), by)
    rated = F.transform("_c", lambda p, i: F.struct(F.hypot(p[0] - F.col(x), p[1] - F.col(y)).alias("distance"), i.alias("place"), p[0].alias("near_x"), p[1].alias("near_y")))
    return joined.select(*points.columns, F.array_min(rated).alias("_n")).select(*points.columns, "_n.place", "_n.near_x", "_n.near_y", "_n.distance")


def clark_evans(nn: DataFrame, df: DataFrame, by: list[str], width: float, height: float) -> DataFrame:
    """n, mean nearest distance and the Clark-Evans ratio with the edge correction, for groups of three points or more."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    means = nn.groupBy(*by).agg(F.avg("nn").alias("nn_mean"))
    area, edge = width * height, 2 * (width + height)
    expected = 0.5 * F.sqrt(F.lit(area) / F.col("n")) + (0.0514 + 0.041 / F.sqrt("n")) * (F.lit(edge) / F.col("n"))
    return n.join(means, by, "left").select(*by, "n", "nn_mean", F.when(F.col("n") >= 3, F.col("nn_mean") / expected).alias("clark_evans"))


def box_overlaps(boxes: DataFrame, by: list[str], key: str, box: tuple[str, str, str, str], cell: float) -> DataFrame:
    """Pairs (a, b), a < b, of boxes of a group that overlap, and their IoU. Boxes meet in the grid cells that they cover."""
    r0, c0, r1, c1 = box
    covered = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    cells = boxes.select(*by, key, *box, F.explode(covered(r0, r1)).alias("_i"), covered(c0, c1).alias("_js")).withColumn("_j", F.explode("_js")).drop("_js")
    b = cells.select(*by, "_i", "_j", F.col(key).alias("b"), *(F.col(c).alias(f"b_{c}") for c in box))
    met = cells.withColumnRenamed(key, "a").join(b, [*by, "_i", "_j"]).filter("a < b")
    low = lambda p, q: F.greatest(F.col(p), F.col(f"b_{q}"))
    high = lambda p, q: F.least(F.col(p), F.col(f"b_{q}"))
    met = met.withColumns({"h": high(r1, r1) - low(r0, r0), "w": high(c1, c1) - low(c0, c0)}).filter("h > 0 AND w > 0")
    mine = (F.col(r1) - F.col(r0)) * (F.col(c1) - F.col(c0))
    theirs = (F.col(f"b_{r1}") - F.col(f"b_{r0}")) * (F.col(f"b_{c1}") - F.col(f"b_{c0}"))
    common = F.col("h") * F.col("w")
    return met.select(*by, "a", "b", (common / (mine + theirs - common)).alias("iou")).distinct()


def suppress(detections: DataFrame, overlaps: DataFrame, by: list[str], key: str, score: str, most: float) -> DataFrame:
    """Greedy non-maximum suppression within each group: by score, then key; kept if its IoU with all kept ones is at most ``most``.

    A greedy choice is sequential, so it is a fold over a frame's detections in order; only those that overlap another above ``most`` are in it.
    """
    bad = overlaps.filter(F.col("iou") > most)
    both = bad.select(*by, F.col("a").alias("k"), F.col("b").alias("o")).unionByName(bad.select(*by, F.col("b").alias("k"), F.col("a").alias("o")))
    foes = both.groupBy(*by, "k").agg(F.collect_set("o").alias("foes")).withColumnRenamed("k", key)
    rows = detections.select(*by, key, score).join(foes, [*by, key], "left")
    clear = rows.filter("foes IS NULL").select(*by, key)
    kind = detections.schema[key].dataType.simpleString()
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), "foes")))
    chosen = rows.filter("foes IS NOT NULL").groupBy(*by).agg(ordered.alias("d")).select(*by, F.explode(_fold_kept(kind)).alias(key))
    return clear.unionByName(chosen)


def _fold_kept(kind: str) -> Column:
    """The keys that stay of a column d of (score, key, foes) in order."""
    free = lambda kept, d: ~F.arrays_overlap(kept, d["foes"])
    return F.aggregate("d", F.array().cast(f"array<{kind}>"), lambda kept, d: F.when(free(kept, d), F.concat(kept, F.array(d["k"]))).otherwise(kept))


def match_greedy(pairs: DataFrame, by: list[str], prediction: str, truth: str, score: str, iou: str, least: float = 0.5) -> DataFrame:
    """One-to-one matches in each group: predictions by score take the free truth with the highest IoU of ``least`` or more. A fold over a frame's pairs in order."""
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in (prediction, truth, iou)}
    pair = F.struct((-F.col(score)).alias("s"), F.col(prediction).alias("p"), (-F.col(iou)).alias("i"), F.col(truth).alias("t"))
    grouped = pairs.filter(F.col(iou) >= least).groupBy(*by).agg(F.array_sort(F.collect_list(pair)).alias("d"))
    zero = F.array().cast(f"array<struct<p:{kinds[prediction]},t:{kinds[truth]},iou:{kinds[iou]}>>")

    def step(out: Column, d: Column) -> Column:
        used = F.exists(out, lambda m: (m["p"] == d["p"]) | (m["t"] == d["t"]))
        return F.when(used, out).otherwise(F.concat(out, F.array(F.struct(d["p"].alias("p"), d["t"].alias("t"), (-d["i"]).alias("iou")))))

    matched = grouped.select(*by, F.explode(F.aggregate("d", zero, step)).alias("m"))
    return matched.select(*by, F.col("m.p").alias(prediction), F.col("m.t").alias(truth), F.col("m.iou").alias(iou))


def match_scores(matches: DataFrame, predictions: DataFrame, truths: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 per group."""
    tp, p, t = (d.groupBy(*by).agg(F.count(F.lit(1)).alias(n)) for d, n in ((matches, "tp"), (predictions, "p"), (truths, "t")))
    out = p.join(t, by, "full").join(tp, by, "left").na.fill(0, ["tp", "p", "t"])
    return out.select(*by, "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"), F.try_divide("tp", "p").alias("precision"), F.try_divide("tp", "t").alias("recall"), F.try_divide(2 * F.col("tp"), F.col("p") + F.col("t")).alias("f1"))
