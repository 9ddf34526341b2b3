"""Contours, fits at the image's edge, shapes of masks and polygons, against pixels drawn one by one."""

import math

import numpy as np
import pytest

from grainflow.operators import outlines
from grainflow.operators.outlines import EdgeRules, contours, hull_pixels, mask_rows, measure_shapes, measure_with_edges, outline_fits, pixels_of, polygon_rows, row_overlaps, rows_area, shapes_of_masks

H, W = 60, 80
Y, X = np.mgrid[:H, :W]


def drawn(cy, cx, a, b=None, angle=0.0, scale=1):
    y, x = (np.mgrid[: H * scale, : W * scale] + 0.5) / scale - 0.5
    t, b = math.radians(angle), b or a
    u, v = (x - cx) * math.cos(t) + (y - cy) * math.sin(t), (y - cy) * math.cos(t) - (x - cx) * math.sin(t)
    return np.flatnonzero(((u / a) ** 2 + (v / b) ** 2 <= 1).ravel())


def frame(spark, masks):
    return spark.createDataFrame([(k, p.tolist()) for k, p in masks.items()], "k string, pixels array<long>")


def test_contours():
    """A pixel has four edges; pixels that touch at a corner are two outlines; a hole has an outline of its own; points follow each other."""
    assert [c.tolist() for c in contours(np.array([W * 5 + 7]), W)] == [[[4.5, 7], [5, 7.5], [5.5, 7], [5, 6.5]]]
    assert [len(c) for c in contours(np.array([W * 5 + 5, W * 6 + 6, W * 6 + 7]), W)] == [6, 4]
    ring = np.setdiff1d(drawn(30, 40, 12), drawn(30, 40, 5))
    outer, inner = contours(ring, W)
    assert len(outer) > len(inner) and np.hypot(*(outer - (30, 40)).T).min() > 11 and np.hypot(*(inner - (30, 40)).T).max() < 6
    for c in (outer, inner):
        assert np.hypot(*np.diff(np.vstack([c, c[:1]]), axis=0).T).max() <= 1.0
    assert len(contours(np.array([0, 1, W, W + 1]), W)[0]) == 8  # in the image's corner


def test_hull():
    square = contours(np.array([W * y + x for y in range(3, 8) for x in range(10, 14)]), W)
    assert hull_pixels(square[0]) == 20
    cross = np.array([W * (10 + k) + 20 for k in range(-4, 5)] + [W * 10 + 20 + k for k in range(-4, 5) if k])
    assert hull_pixels(np.concatenate(contours(cross, W))) == 41  # a diamond of half diagonal 4.5
    assert hull_pixels(contours(np.array([W * 3 + 3]), W)[0]) == 1


@pytest.mark.parametrize("name,args,kind", [
    ("left", (30, -4, 15), "circle"), ("top", (3, 40, 16), "circle"), ("corner", (2, 3, 14), "circle"), ("far out", (30, 90, 24), "circle"),
    ("right ellipse", (30, 74, 22, 12, 80), "ellipse"), ("bottom ellipse", (54, 40, 12, 22, 20), "ellipse"), ("sliver", (-28, 40, 30), "visible"),
])
def test_edge_fits_find_the_whole_shape(spark, name, args, kind):
    cy, cx, a, b = args[0], args[1], args[2], args[3] if len(args) > 3 else args[2]
    fit = outline_fits(frame(spark, {"m": drawn(*args)}), ["k"], H, W).first()
    assert fit.edge_truncated and fit.fit_kind == kind and fit.border_points >= 3
    if kind == "visible":
        assert fit.semi_major is None and fit.outline_visible_frac is None and fit.arc_deg < 45
        return
    assert abs(fit.y - cy) < 1 and abs(fit.x - cx) < 1 and abs(fit.semi_major - max(a, b)) < 1 and abs(fit.semi_minor - min(a, b)) < 1
    around = np.arange(3600) * (2 * math.pi / 3600)
    t = math.radians(args[4] if len(args) > 4 else 0)
    oy, ox = cy + a * np.cos(around) * math.sin(t) + b * np.sin(around) * math.cos(t), cx + a * np.cos(around) * math.cos(t) - b * np.sin(around) * math.sin(t)
    seen = np.mean((oy >= -0.5) & (oy <= H - 0.5) & (ox >= -0.5) & (ox <= W - 0.5))
    assert abs(fit.outline_visible_frac - seen) < 0.04


def test_measures_of_masks(spark):
    """Inside the image the pixels' own, at its edge the whole object's; slivers and short arcs aren't reliable; solidity is of the pixels."""
    cross = np.array([W * (10 + k) + 20 for k in range(-4, 5)] + [W * 10 + 20 + k for k in range(-4, 5) if k])
    masks = {"in": drawn(30, 40, 12, 7, 30), "cut": drawn(30, -8, 15), "sliver": drawn(-28, 40, 30), "half": drawn(0, 40, 12), "dot": np.array([W * 50 + 50]), "cross": cross}
    rows = {r.k: r for r in measure_with_edges(frame(spark, masks), ["k"], H, W).collect()}
    m = rows["in"]
    assert (m.fit_kind, m.edge_truncated, m.arc_deg, m.outline_visible_frac, m.fit_reliable, m.area_px2) == ("mask", False, 360.0, 1.0, True, len(masks["in"]))
    assert abs(m.orientation_deg - 60) < 1 and abs(m.major_axis - 24) < 0.5
    c = rows["cut"]
    assert c.fit_kind == "circle" and abs(c.r_eq - 15) < 1.5 and c.area_visible_px2 == len(masks["cut"]) and c.orientation_deg is None and not c.fit_reliable
    assert rows["half"].fit_reliable and abs(rows["half"].r_eq - 12) < 0.5
    s = rows["sliver"]
    assert (s.fit_kind, s.fit_reliable, s.outline_visible_frac, s.area_px2) == ("visible", False, None, len(masks["sliver"]))
    assert rows["dot"].solidity == 1 and rows["cross"].solidity == pytest.approx(17 / 41)


def test_shapes_of_masks(spark):
    """Round masks become circles, others ellipses of their size and direction; those that the image cuts keep their whole size; a streak across the image doesn't."""
    streak = np.array([W * y + x for y in (20, 21, 22) for x in range(W)])
    masks = {"round": drawn(30, 40, 12, 11.5, 10), "long": drawn(30, 40, 16, 9, 30), "cut": drawn(30, -4, 15), "cut ellipse": drawn(30, 74, 22, 12, 80), "sliver": drawn(-28, 40, 30), "streak": streak, "dot": np.array([W * 50 + 50]), "two": np.array([0, 1])}
    df = frame(spark, masks)
    rows = {r.k: r for r in shapes_of_masks(df, ["k"], H, W).collect()}
    assert {k: r.fit_kind for k, r in rows.items()} == {"round": "circle", "long": "ellipse", "cut": "circle", "cut ellipse": "ellipse", "sliver": "sliver", "streak": "ellipse"}
    r = rows["long"]
    assert abs(r.semi_major - 16) < 0.4 and abs(r.semi_minor - 9) < 0.4 and abs(r.angle_deg - 30) < 1.5 and r.iou > 0.95
    assert rows["round"].semi_major == rows["round"].semi_minor and abs(rows["round"].semi_major - math.sqrt(12 * 11.5)) < 0.3
    assert abs(rows["cut"].x + 4) < 1 and abs(rows["cut"].semi_major - 15) < 1 and rows["sliver"].iou is None
    assert rows["streak"].semi_major > 30 and abs(rows["streak"].y - 21) < 0.01
    for k, r in rows.items():
        if r.iou is not None:
            shape = drawn(r.y, r.x, r.semi_major, r.semi_minor, r.angle_deg)
            both = len(np.intersect1d(shape, masks[k]))
            assert r.fit_kind == "circle" or r.iou == pytest.approx(both / (len(shape) + len(masks[k]) - both))
    assert {r.fit_kind for r in shapes_of_masks(df.filter("k IN ('long', 'cut ellipse')"), ["k"], H, W, kind="circle").collect()} == {"circle"}
    assert shapes_of_masks(df.filter("k = 'round'"), ["k"], H, W, kind="ellipse").first().fit_kind == "ellipse"
    with pytest.raises(ValueError):
        shapes_of_masks(df, ["k"], H, W, kind="square")
    assert shapes_of_masks(df.limit(0), ["k"], H, W).collect() == []


def test_rows_of_masks(spark):
    rng = np.random.default_rng(1)
    masks = {str(k): np.unique(rng.integers(0, H * W, 900)) for k in range(4)} | {"all": np.arange(H * W)}
    rows = mask_rows(frame(spark, masks), ["k"], W)
    assert {r.k: r.pixels for r in pixels_of(rows, ["k"], W).collect()} == {k: p.tolist() for k, p in masks.items()}
    other = rows.withColumnRenamed("k", "o").crossJoin(spark.createDataFrame([(k,) for k in masks], "k string")).select("k", "o", "y", "first", "last")
    for r in row_overlaps(rows, other, ["k"], "o").collect():
        both = len(np.intersect1d(masks[r.k], masks[r.o]))
        assert r.iou == pytest.approx(both / (len(masks[r.k]) + len(masks[r.o]) - both))


@pytest.mark.parametrize("scale", [1, 2])
def test_polygons(spark, scale):
    """Even-odd filling of crossing, concave and partly outside polygons; the intervals of a row don't overlap."""
    rng = np.random.default_rng(scale)
    polygons = {str(k): (rng.random((n, 2)) * (H + 30, W + 30) - 15).tolist() for k, n in enumerate([3, 4, 7, 12, 30])} | {"line": [[1.0, 1.0], [5.0, 5.0]], "grid": [[9.5, 9.5], [9.5, 19.5], [19.5, 19.5], [19.5, 9.5]]}
    df = spark.createDataFrame(list(polygons.items()), "k string, points array<array<double>>")
    rows = polygon_rows(df, ["k"], "points", H, W, scale)
    found = {r.k: r.pixels for r in pixels_of(rows, ["k"], W * scale).collect()}
    y, x = np.mgrid[: H * scale, : W * scale]
    for k, points in polygons.items():
        p = (np.array(points) + 0.5) * scale - 0.5
        inside = np.zeros(y.shape, bool)
        for (r0, c0), (r1, c1) in zip(p, np.roll(p, -1, axis=0)):
            crossed = (r0 <= y) != (r1 <= y)
            with np.errstate(divide="ignore", invalid="ignore"):
                inside ^= crossed & (c0 + (y - r0) / (r1 - r0) * (c1 - c0) <= x)
        want = np.flatnonzero(inside.ravel()).tolist() if len(points) > 2 else []
        assert found.get(k, []) == want
    areas = {r.k: r.area_visible_px2 for r in rows_area(rows, ["k"], scale).collect()}
    assert areas["grid"] == 100 and areas == {k: len(p) / scale**2 for k, p in found.items()}


def test_measured_shapes(spark):
    """What is seen of a shape is its pixels in the image; shapes outside it have no row."""
    rows = [("in", 30.0, 40.0, 12.0, 7.0, 30.0, None), ("cut", 30.0, 0.0, 10.0, 10.0, 0.0, None), ("out", -40.0, 40.0, 10.0, 10.0, 0.0, None), ("draft", 30.0, 40.0, 9.0, 9.0, 0.0, "sliver")]
    df = spark.createDataFrame(rows, "k string, y double, x double, semi_major double, semi_minor double, angle_deg double, fit_kind string")
    got = {r.k: r for r in measure_shapes(df, ["k"], H, W, 2.0).collect()}
    assert set(got) == {"in", "cut", "draft"}
    assert got["in"].area_visible_px2 == len(drawn(30, 40, 12, 7, 30, 2)) / 4 and got["cut"].area_visible_px2 == len(drawn(30, 0, 10, scale=2)) / 4
    assert got["in"].orientation_deg == pytest.approx(60) and got["cut"].orientation_deg is None and got["cut"].edge_truncated and not got["in"].edge_truncated
    assert (got["draft"].fit_kind, got["draft"].fit_reliable, got["in"].fit_kind, got["in"].solidity) == ("sliver", False, "ellipse", 1.0)


def test_distance_to_an_ellipse():
    fit, around = (30.0, 40.0, 12.0, 7.0, 25.0), np.arange(36000) * (2 * math.pi / 36000)
    t = math.radians(25)
    oy, ox = 30 + 12 * np.cos(around) * math.sin(t) + 7 * np.sin(around) * math.cos(t), 40 + 12 * np.cos(around) * math.cos(t) - 7 * np.sin(around) * math.sin(t)
    rng = np.random.default_rng(2)
    k = rng.integers(0, 36000, 200)
    r, c = oy[k] + rng.normal(0, 0.5, 200), ox[k] + rng.normal(0, 0.5, 200)
    want = np.hypot(r[:, None] - oy, c[:, None] - ox).min(axis=1)
    assert np.abs(outlines._on_ellipse(r, c, fit) - want).max() < 1e-3
    assert EdgeRules().round_ratio == 0.93
