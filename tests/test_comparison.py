"""Comparison, drafting, image and source operators on small tables, with nulls, ties and empty tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainflow.operators import arrays, comparison, geometry, maintenance, population, size_models
from grainflow.sources import shapes


def test_fit_distance_against_numpy(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.lognormal(2.0, 0.4, 500), 1)
    v = v[v >= 5]
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("a", None), ("a", 1.0)], "run string, r double")
    fits = spark.createDataFrame([("a", 2.0, 0.4)], "run string, mu double, sigma double")
    x = np.sort(v)
    sf = lambda t: 0.5 * math.erfc((math.log(t) - 2.0) / 0.4 / math.sqrt(2))
    cdf = np.array([1 - sf(t) / sf(5.0) for t in x])
    after, before = np.searchsorted(x, x, "right") / len(x), np.searchsorted(x, x, "left") / len(x)
    want = max(np.abs(after - cdf).max(), np.abs(before - cdf).max())
    assert comparison.fit_distance(df, ["run"], "r", 5.0, fits).first().d == pytest.approx(want, abs=1e-9)


def test_spearman_with_ties_nulls_and_no_variation(spark):
    rows = [("a", 1.0, 2.0), ("a", 1.0, 2.0), ("a", 2.0, 1.0), ("a", 3.0, None), ("b", 1.0, 1.0), ("b", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    found = {r.g: (r.n, r.rho) for r in comparison.spearman(df, ["g"], "x", "y").collect()}
    assert found["a"] == (3, pytest.approx(-1.0)) and found["b"] == (2, None)
    whole = comparison.spearman(df, [], "x", "y").first()
    assert whole.n == 5
    assert comparison.spearman(df.limit(0), ["g"], "x", "y").count() == 0


def test_base_of_null_groups_and_groups_without_base(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 4.0), ("b", 1, 3.0)], "g string, t int, v double")
    found = {(r.g, r.t): r.v_rel for r in comparison.relative_to_base(df, ["g"], F.col("g").isNotNull(), ["v"]).collect()}
    assert found == {(None, 1): pytest.approx(2 / 3), (None, 2): pytest.approx(4 / 3), ("b", 1): None}


def test_empty_bins_are_zero(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 2.0), ("a", None), ("b", 9.0)], "g string, v double")
    found = [(r.g, r.bin, r.density) for r in comparison.filled_histogram(df, ["g"], "v", 0.0, 2.0, 2).orderBy("g", "bin").collect()]
    assert found == [("a", 0, 0.5), ("a", 1, 0.5)]
    band = comparison.density_band(df, "g", "v", 0.0, 4.0, 2, least=2).orderBy("bin").collect()
    assert [(r.bin, r.n_runs, r.p50) for r in band] == [(0, 1, 0.25), (1, 1, 0.25)]


def test_stage_never_overwrites(spark):
    stage = spark.createDataFrame([("a",)], "frame string")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "frame string, v int")
    assert [r.frame for r in maintenance.to_stage(new, stage, "frame").collect()] == ["b"]


def test_stretch_and_boxes(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0, 4.0],), ([5.0, 5.0],), ([],), (None,)], "p array<double>")
    found = [r.s for r in df.select(arrays.stretched(F.col("p"), 0.25, 0.75).alias("s")).collect()]
    assert found[0] == [0.0, 0.0, 0.5, 1.0, 1.0] and found[2] == [] and found[3] is None
    image = spark.createDataFrame([([float(i) for i in range(12)],)], "p array<double>")
    cut = image.select(arrays.without_boxes(F.col("p"), 3, 4, [(0, 1 / 3, 0.5, 1), (2 / 3, 1, 0, 0.25)]).alias("p")).first().p
    assert [i for i, v in enumerate(cut) if v is None] == [2, 3, 8]


def test_run_order_and_sets(spark):
    df = spark.createDataFrame([("s", "r1000"), ("s", "r99"), ("s", "r99"), ("s", "x"), ("t", "r2")], "set string, run string")
    assert [r.run for r in df.select("run").distinct().orderBy(*shapes.run_order(F.col("run"))).collect()] == ["x", "r2", "r99", "r1000"]
    assert {r.set: r.runs for r in shapes.ordered_runs(df).collect()} == {"s": ["x", "r99", "r1000"], "t": ["r2"]}


def test_images_are_found_in_order(spark):
    frames = spark.createDataFrame([("a", "r001", "/own/a.png"), ("b", "r001", "/own/b.png"), ("c", "r001", None), ("d", "r001", "/gone")], "frame string, run string, frame_path string")
    files = spark.createDataFrame([("/x/shapes/a.tif",), ("/own/a.png",), ("/own/b.png",), ("/raw/jpg_r001/c.jpg",)], "path string")
    found = {r.frame: r.image for r in shapes.resolve_images(frames, files).collect()}
    assert found == {"a": "/x/shapes/a.tif", "b": "/own/b.png", "c": "/raw/jpg_r001/c.jpg", "d": None}


def test_numbered_frames_and_run_log(spark):
    index = spark.createDataFrame([("r010", 1, 5), ("r002", 1, 5), ("r002", 2, 6)], "run string, train int, frame_idx int")
    assert [r.run for r in shapes.frames_numbered(index, 5).collect()] == ["r002", "r010"]
    assert [r.run for r in shapes.frames_numbered(index, 5, ["r010"]).collect()] == ["r010"]
    log = spark.createDataFrame([("r1", 2, "new", "b"), ("r1", 1, "old", "a")], "run string, at int, info string, selection string")
    assert tuple(shapes.latest_run_info(log, ["run"]).first()) == ("r1", 2, "new", ["a", "b"])


def test_exact_signed_ranks_against_all_patterns(spark):
    v = [1.5, -2.5, 3.5, 4.5, -0.5, 5.5, 6.5]
    df = spark.createDataFrame([("a", x) for x in v] + [("a", 0.0), ("a", None)] + [("b", 1.0)] * 7, "g string, v double")
    found = {r.g: r for r in population.wilcoxon(df, ["g"], F.col("v")).collect()}
    ranks = np.argsort(np.argsort(np.abs(v))) + 1
    low = min(ranks[np.array(v) > 0].sum(), ranks[np.array(v) < 0].sum())
    sums = [sum(r for r, up in zip(ranks, p) if up) for p in itertools.product((0, 1), repeat=len(v))]
    assert found["a"].n == 7 and found["a"].p == pytest.approx(2 * np.mean([s <= low for s in sums]))
    assert found["b"].n == 7 and 0 < found["b"].p < 0.05  # ties: the normal form


def test_wider_families(spark):
    rng = np.random.default_rng(5)
    both = np.round(np.concatenate([rng.lognormal(1.0, 0.25, 1500), rng.lognormal(2.5, 0.3, 1500)]), 1)
    table = {r.model: r for r in size_models.model_table(spark.createDataFrame([(float(x),) for x in both], "v double").withColumn("g", F.lit(1)), ["g"], "v", 1.0).collect()}
    best = table["mixture"]
    assert best["rank"] == 1 and best.daic == 0 and sorted((best.params[1], best.params[3])) == pytest.approx([1.0, 2.5], abs=0.06)
    assert best.mean == pytest.approx(both.mean(), rel=0.03)
    assert table["generalised_gamma"].nll <= min(table["gamma"].nll, table["weibull"].nll) + 0.5
    assert len(table["generalised_gamma"].params) == 3 and table["lognormal"].aic == pytest.approx(2 * table["lognormal"].nll + 4)


def test_polygons_become_ellipses_in_their_places(spark):
    t = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    a, b, angle = 12.0, 5.0, 0.4
    ring = np.column_stack([30 + a * np.cos(t) * np.sin(angle) + b * np.sin(t) * np.cos(angle), 50 + a * np.cos(t) * np.cos(angle) - b * np.sin(t) * np.sin(angle)])
    box = [[0.0, 0.0], [0.0, 8.0], [4.0, 8.0], [4.0, 0.0]]
    bubbles = [("ellipse", box, "ellipse"), ("polygon", ring.tolist(), None), ("polygon", [[1.0, 1.0], [2.0, 2.0], [3.0, 3.0]], None), ("path", [[0.0, *p] for p in ring[::-1].tolist()], "x"), (None, None, None)]
    schema = "frame string, run string, train int, frame_idx int, reviewed boolean, bubbles array<struct<type:string,data:array<array<double>>,fit_kind:string>>"
    docs = spark.createDataFrame([("f", "r1", 1, 1, None, bubbles), ("g", "r1", 1, 2, None, []), ("h", "r1", 1, 3, None, None)], schema)
    assert {r.frame: r.n_polygons for r in shapes.as_ellipses(docs).collect()} == {"f": 3, "g": 0, "h": 0}
    rows = {r.bubble_id: r for r in shapes.bubbles_of(shapes.as_ellipses(docs)).collect()}
    assert sorted(rows) == [0, 1, 3] and rows[1].fit_kind == "from_polygon" and rows[0].fit_kind == "ellipse"
    for k in (1, 3):
        r = rows[k]
        assert (r.y, r.x, r.semi_major, r.semi_minor, r.angle_deg) == pytest.approx((30, 50, a, b, np.degrees(angle)), rel=2e-3)
    seen = {r.bubble_id: r for r in geometry.with_visibility(shapes.bubbles_of(shapes.as_ellipses(docs)), 250, 400, 120).collect()}
    assert not seen[1].edge_truncated and seen[1].fit_reliable and seen[1].shape_type == "ellipse" and seen[1].arc_deg == 360


def test_visibility_outside_covering_and_slivers(spark):
    rows = [(1, -50.0, -50.0, 5.0, 5.0, None), (2, 5.0, 5.0, 100.0, 90.0, None), (3, 5.0, 5.0, 2.0, 2.0, "sliver"), (4, 0.0, 5.0, 3.0, 3.0, None), (5, 5.0, 5.0, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "k int, y double, x double, semi_major double, semi_minor double, fit_kind string").withColumn("angle_deg", F.lit(0.0))
    found = {r.k: r for r in geometry.with_visibility(df, 10, 10, 120).collect()}
    assert sorted(found) == [2, 3, 4]
    assert found[2].arc_deg == 0 and not found[2].fit_reliable and found[3].edge_truncated and not found[3].fit_reliable
    assert found[4].edge_truncated and found[4].fit_reliable and found[4].shape_type == "circle" and 180 < found[4].arc_deg < 220
