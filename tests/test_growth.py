"""What larger tables brought to light: values found once, no buffers that grow with a group, plain versions of what runs on whole batches."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from grainflow.functions.storage import settled
from grainflow.operators import filters, geometry, masks, metrics, outlines, regression as reg


def test_trends_use_each_value_once(spark):
    """Values that another evaluation would change have their ranks all the same: nothing is found twice and joined back."""
    noise = F.udf(lambda v: v + random.random(), "double").asNondeterministic()
    df = spark.createDataFrame([(run, k, float(k)) for run in "ab" for k in range(8)], "run string, train int, v double").withColumn("v", noise("v"))
    got = {(r.run, r.pooled): r for r in reg.trends(df, "run", "train", ["v"]).collect()}
    assert {k: r.n for k, r in got.items()} == {("a", False): 8, ("b", False): 8, (None, True): 16}
    assert got["a", False].spearman_rho == 1 and got["b", False].spearman_rho == 1 and got[None, True].spearman_rho > 0.9


def test_described_without_a_groups_values_in_one_buffer(spark):
    """Percentiles of counted values; a group without values, and the group null, have rows too; no exact percentile holds a group's values."""
    rows = [("a", float(k), 1.0) for k in range(11)] + [(None, 3.0, None), (None, 4.0, None), ("e", None, 2.0)]
    df = metrics.described(spark.createDataFrame(rows, "g string, v double, w double"), ["g"], ["v", "w"])
    got = {(r.g, r.column): tuple(r)[2:] for r in df.collect()}
    assert got["a", "v"][0] == 11 and got["a", "v"][3:] == (0.0, 2.5, 5.0, 7.5, 10.0) and got[None, "v"][3:] == (3.0, 3.25, 3.5, 3.75, 4.0)
    assert got[None, "w"] == (0, *[None] * 7) and got["e", "v"] == (0, *[None] * 7) and got["e", "w"][0] == 1 and len(got) == 6
    assert "percentile(" not in df._jdf.queryExecution().toString()


def test_outlines_are_walked_in_batches(spark):
    """Counts of points as one by one, for ellipses inside, across and outside the image and unknown ones; the plan has no array of points for each row."""
    rng = np.random.default_rng(4)
    y, x, a, t = rng.uniform(-20, 80, 400), rng.uniform(-20, 130, 400), rng.uniform(0.5, 40, 400), rng.uniform(0, math.pi, 400)
    y[0], b = np.nan, a * rng.uniform(0.2, 1, 400)
    i = np.arange(360) * 2 * math.pi / 360
    py, px = y[:, None] + np.outer(a, np.cos(i)) * np.sin(t)[:, None] + np.outer(b, np.sin(i)) * np.cos(t)[:, None], x[:, None] + np.outer(a, np.cos(i)) * np.cos(t)[:, None] - np.outer(b, np.sin(i)) * np.sin(t)[:, None]
    want = ((py >= -0.5) & (py <= 59.5) & (px >= -0.5) & (px <= 109.5)).sum(1)
    assert 0 < (want == 360).sum() < 400 and (want == 0).sum() > 1
    assert geometry.seen_points(y, x, a, b, np.cos(t), np.sin(t), 60, 110).tolist() == want.tolist()
    rows = [(k, 30.0, 5.0, 10.0, 5.0, 0.0, None) for k in range(3)]
    df = geometry.with_visibility(spark.createDataFrame(rows, "k int, y double, x double, semi_major double, semi_minor double, angle_deg double, fit_kind string"), 60, 110, 120)
    assert [r.edge_truncated for r in df.collect()] == [True] * 3 and "lambda" not in df._jdf.queryExecution().toString()


def _inside(cy, cx, a, b, t, height=60, width=110):
    y, x = np.mgrid[:height, :width]
    dy, dx = y - cy, x - cx
    return np.flatnonzero((((dx * np.cos(t) + dy * np.sin(t)) / a) ** 2 + ((dy * np.cos(t) - dx * np.sin(t)) / b) ** 2 <= 1).ravel()).tolist()


def test_pixels_on_an_ellipses_edge(spark):
    """Where an ellipse ends at a pixel's centre its equation decides, whatever the place of the pixel."""
    discs = [(angle, k, n, float(20 + n), (k * 1000 + n * 1000 + 900) / 1000, n + 0.9, (n + 0.3) / 2) for angle in (0, 90) for k in range(90) for n in range(1, 8)]
    df = spark.createDataFrame(discs, "angle int, k int, n int, row double, col double, a double, b double")
    got = {(r.angle, r.k, r.n): r.pixels for r in masks.rasterised(df, ["angle", "k", "n"], "row", "col", "a", "b", "angle", 60, 110).collect()}
    wrong = [d for d in discs if got.get(d[:3], []) != _inside(*d[3:7], math.radians(d[0]))]
    assert not wrong, (len(wrong), wrong[:2])


def test_batches_of_masks_against_one_by_one(spark):
    """Numbers of edges, border and hull of many masks at once, with holes, gaps and corners that touch, are those of the contours of each; no shuffle is needed."""
    rng = np.random.default_rng(7)
    shapes = [_inside(*rng.uniform((-5, -5, 0.6, 0.6, 0), (65, 115, 16, 9, 3.1))) for _ in range(200)]
    shapes = [np.array(p)[rng.random(len(p)) < (0.7 if k % 3 == 0 else 1.1)] for k, p in enumerate(shapes)] + [np.array([7]), np.array([0, 109, 59 * 110]), np.array([115, 226, 337])]
    shapes = {k: p for k, p in enumerate(shapes) if len(p)}
    df = spark.createDataFrame([(k, p.tolist()) for k, p in shapes.items()], "k int, pixels array<long>")
    fits = outlines.outline_fits(df, ["k"], 60, 110)
    for r in fits.collect():
        found = outlines.contours(shapes[r.k], 110)
        every = np.concatenate(found)
        border = lambda p: ((p[:, 0] <= 0) | (p[:, 0] >= 59) | (p[:, 1] <= 0) | (p[:, 1] >= 109)).sum()
        assert (r.outline_points, r.border_points, r.convex_pixels, r.edge_truncated) == (len(every), border(every), outlines.hull_pixels(every), border(found[0]) >= 3)
        seen = found[0] if not r.edge_truncated else found[0][~((found[0][:, 0] <= 0) | (found[0][:, 0] >= 59) | (found[0][:, 1] <= 0) | (found[0][:, 1] >= 109))]
        circle = masks.circle_of(*seen.T) if len(seen) >= 6 else None
        assert (circle is None) == (r.radius is None) and (circle is None or circle[2] > 1e3 or np.allclose(circle, (r.circle_y, r.circle_x, r.radius), atol=1e-6))
    for out in (fits, outlines.measure_with_edges(df, ["k"], 60, 110), outlines.shapes_of_masks(df, ["k"], 60, 110), outlines.shape_overlaps(df, ["k"], {"iou": tuple(map(F.lit, (30.0, 50.0, 9.0, 5.0, 10.0)))}, 60, 110)):
        assert out.count() > 0 and "Exchange" not in out._jdf.queryExecution().toString()


def test_areas_without_a_shuffle(spark):
    """Polygons and ellipses are added up where they are filled."""
    stars = spark.createDataFrame([(1, [[9.5, 9.5], [9.5, 19.5], [19.5, 19.5], [19.5, 9.5]]), (2, [[-9.0, -9.0], [-8.0, -5.0], [-5.0, -5.0]])], "k int, points array<array<double>>")
    areas = outlines.polygon_areas(stars, ["k"], "points", 60, 110, 2.0)
    ellipses = spark.createDataFrame([(1, 30.0, 50.0, 9.0, 5.0, 10.0, None), (2, 300.0, 50.0, 9.0, 5.0, 10.0, None)], "k int, y double, x double, semi_major double, semi_minor double, angle_deg double, fit_kind string")
    shapes = outlines.measure_shapes(ellipses, ["k"], 60, 110)
    assert [(r.k, r.area_visible_px2) for r in areas.collect()] == [(1, 100.0)]
    assert [(r.k, r.area_visible_px2) for r in shapes.collect()] == [(1, len(_inside(30, 50, 9, 5, math.radians(10))))]
    assert all("Exchange" not in out._jdf.queryExecution().toString() for out in (areas, shapes))


def test_neighbours_shuffle_few_copies(spark, monkeypatch):
    """A place is asked for once and offered to the blocks that it is near to, not to nine cells; distances are those of all pairs, also across blocks and after coarser grids."""
    rng, plans = np.random.default_rng(5), []
    monkeypatch.setattr(geometry, "settled", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or settled(df, name))
    points = [(g, k, *map(float, p)) for g, n in (("a", 1500), ("b", 3), ("c", 1)) for k, p in enumerate(rng.uniform(0, 100, (n, 2)))] + [("a", 5000, 900.0, -900.0), ("d", 1, 2.0, 2.0), ("d", 2, 2.0, 2.0), ("d", 3, 2.0, 3.0)]
    got = {(r.g, r.k): r.nn for r in geometry.nearest_neighbours(spark.createDataFrame(points, "g string, k int, x double, y double"), ["g"], "k", "x", "y").collect()}
    for g in "abd":
        own = np.array([p[2:] for p in points if p[0] == g])
        d = np.hypot(*(own[:, None] - own[None]).transpose(2, 0, 1)) + np.diag(np.full(len(own), np.inf))
        assert np.allclose([got[g, p[1]] for p in points if p[0] == g], d.min(axis=1))
    assert len(got) == len(points) - 1 and not any("explode(array(" in p for p in plans)


def test_small_tiles_go_to_tasks_together(spark):
    """Tiles of many images in one call, each with its own halo, images alike in nothing but size; null is a key too."""
    rng = np.random.default_rng(3)
    images = {k: rng.random((8, 8)) for k in [*range(60), None]}
    df = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in images.items()], "k int, px array<double>")
    seen = spark.sparkContext.accumulator(0)

    def smooth(arrays):
        seen.add(1)
        return [filters.gaussian(arrays[0], 0.6)]

    tiles = filters.with_halo(filters.tiles_of(df, ["k"], {"px": "px"}, 8, 8, 4), ["k"], ["px"], 8, 8, 4, 2, smooth, ["px"], stacks=True)
    got = {(r.k, r.ty, r.tx): np.reshape(r.px, (4, 4)) for r in tiles.collect()}
    assert len(got) == 4 * len(images) and 4 <= seen.value < len(got)
    for (k, ty, tx), v in got.items():
        assert np.allclose(v, filters.gaussian(images[k], 0.6)[4 * ty : 4 * ty + 4, 4 * tx : 4 * tx + 4])
