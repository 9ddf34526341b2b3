"""Operators against known values and plain versions, with the edge cases that the queries' tables don't have."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainflow.functions import names
from grainflow.operators import arrays, distribution as dist, geometry, maintenance, metrics, regression as reg, selection, sequence as seq


def test_tails(spark):
    row = spark.range(1).select(
        dist.normal_sf(F.lit(1.959963985)).alias("z"), dist.chi2_sf(F.lit(18.7), F.lit(2)).alias("c"), dist.t_two_sided(F.lit(2.0), F.lit(10)).alias("t"), dist.t_two_sided(F.lit(2.0), F.lit(0)).alias("none")
    ).first()
    assert row.z == pytest.approx(0.025, abs=1e-8) and row.c == pytest.approx(8.697e-5, rel=1e-3)
    assert row.t == pytest.approx(0.07338803, abs=1e-7) and row.none is None


def test_step_kinds(spark):
    rows = [(1.2, 0.9, 1.0, "new bubbles"), (0.8, 1.1, 1.1, "coalescence"), (1.0, 1.2, 1.5, "growth"), (1.0, 0.8, 0.5, "dissolution"), (1.05, 1.0, 1.1, "little change"), (1.05, 1.2, 1.1, "mixed"), (1.0, 0.95, 1.25, "little change"), (1.3, 1.2, 1.1, "mixed"), (None, 1.0, 1.0, "mixed")]
    out = spark.createDataFrame(rows, "c double, s double, v double, want string").select("want", seq.step_kind(F.col("c"), F.col("s"), F.col("v")).alias("got")).collect()
    assert all(r.want == r.got for r in out)


def test_robust_z_without_spread(spark):
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "k int, v double")
    assert sorted((r.z_v for r in seq.robust_z(flat, ["v"]).collect()), key=lambda z: (z is None, z)) == [0.0, 0.0, None]
    mad0 = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0), (4, 9.0)], "k int, v double")
    assert max(r.z_v for r in seq.robust_z(mad0, ["v"]).collect()) == pytest.approx(4 / np.std([5, 5, 5, 9]))


def test_event_override_and_ties(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 1, 20), ("a", 2, 40), ("b", 0, 5), ("b", 1, 5), ("c", 0, 1)], "run string, train int, n int")
    found = {r.run: r.event for r in seq.event_train(df, "run", "train", "n").collect()}
    assert found == {"a": 1, "b": None, "c": None}
    override = spark.createDataFrame([("a", None), ("b", 1)], "run string, event int")
    assert {r.run: r.event for r in seq.event_train(df, "run", "train", "n", override=override).collect()} == {"a": None, "b": 1, "c": None}


def test_decay_and_lognormal():
    t = np.arange(0, 120, 5.0)
    found = reg.decay_curve(t, 80 * np.exp(-t / 30) + 12, True)
    assert found["tau"] == pytest.approx(30, rel=1e-5) and found["n_inf"] == pytest.approx(12, rel=1e-4) and found["n0"] == pytest.approx(92, rel=1e-4) and found["r2"] == pytest.approx(1)
    rng = np.random.default_rng(2)
    y = 50 * np.exp(-t / 40) + rng.normal(0, 1, len(t))
    found = reg.decay_curve(t, y, False)
    cost = lambda n0, tau: ((y - n0 * np.exp(-t / tau)) ** 2).sum()
    assert all(cost(found["n0"], found["tau"]) <= cost(found["n0"] + a, found["tau"] + b) + 1e-9 for a in (-0.05, 0, 0.05) for b in (-0.05, 0, 0.05))
    assert found["tau_se"] == pytest.approx(1.2, rel=0.5) and found["n_inf"] == 0 and found["n_inf_se"] is None
    rising = reg.decay_curve(t, t + 1, True)
    assert rising["n0"] >= 0 and rising["n_inf"] >= 0
    assert reg.decay_curve(t[:3], t[:3] + 1, True)["tau"] is None
    rng = np.random.default_rng(1)
    r = rng.lognormal(2.5, 0.5, 20_000)
    r = r[r >= 8]
    mu, sigma, nll = reg.truncated_lognormal(r, np.ones_like(r), 8.0)
    assert mu == pytest.approx(2.5, abs=0.05) and sigma == pytest.approx(0.5, abs=0.03)
    assert reg.truncated_lognormal(np.array([9.0]), np.array([5.0]), 8.0) == (None, None, None)


def test_kruskal_and_mann_whitney(spark):
    rows = [("a", v) for v in (1, 2, 3, 4, 5)] + [("b", v) for v in (6, 7, 8, 9, 10)] + [("c", 3)]
    df = spark.createDataFrame(rows, "g string, v int")
    k = dist.kruskal(df, [], "g", "v").first()
    assert (k.groups, k.n) == (2, 10) and k.h == pytest.approx(6.8181818) and k.p == pytest.approx(0.009023, rel=1e-3)
    m = dist.mann_whitney(df.filter("g <> 'c'").withColumn("f", F.col("g") == "b"), [], "f", "v").first()
    # Two of the 252 ways to choose five ranks of ten are as extreme; the normal form, which serves where values are tied, says 0.0122.
    assert m.u == 25 and m.p == pytest.approx(2 / 252)
    tied = df.filter("g <> 'c'").withColumn("f", F.col("g") == "b").withColumn("v", F.when(F.col("v") == 2, 1).otherwise(F.col("v")))
    assert dist.mann_whitney(tied, [], "f", "v").first().p == pytest.approx(0.0119, rel=2e-2)


def test_selection_language(spark):
    manifest = spark.createDataFrame([(f"r{r}", t, f) for r in (571, 572) for t in range(5) for f in (10, 11)], "run string, train long, frame_idx long")
    count = lambda items: selection.select_frames(manifest, selection.selection(spark, items)).count()
    assert count("all") == 20 and count("r571") == 10 and count("r571_tid3") == 2 and count("r571_tid3_010") == 1 and count("tid3_010") == 2 and count("train3frame010") == 2
    assert count([("571", "0-2", 10), (range(0, 2), [11])]) == 7
    assert count(["r571_tid3", "r571_tid3"]) == 2
    for bad in ("571", "frame10", "x", ""):
        with pytest.raises(ValueError):
            selection.parse_item(bad)
    assert selection.number_ranges("1-3, 7") == [(1, 3), (7, 7)] and selection.run_id("/a/r563_svd_tid3_010") == "r563" and selection.run_id(7) == "r007"


def test_geometry(spark):
    box = spark.createDataFrame([([[0.0, 0.0], [0.0, 8.0], [4.0, 8.0], [4.0, 0.0]],)], "data array<array<double>>")
    e = geometry.ellipse_of(*geometry.box_halves(F.col("data")))
    row = box.select(*(v.alias(k) for k, v in e.items()), *(v.alias(f"p_{k}") for k, v in geometry.polygon_moments(F.col("data")).items())).first()
    assert row.area == pytest.approx(8 * math.pi) and (row.semi_major, row.semi_minor) == (4, 2) and row.angle_deg == pytest.approx(0)
    assert (row.p_area, row.p_row, row.p_col) == (32, 2, 4)
    ring = spark.range(1).select(geometry.outline(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(3.0), F.lit(25.0), 16).alias("o")).first().o
    assert all(math.hypot(r - 1, c - 2) == pytest.approx(3) for r, c in ring)


def test_suppression_is_greedy_by_score(spark):
    d = spark.createDataFrame([(1, k, s) for k, s in ((1, 0.9), (2, 0.8), (3, 0.7), (4, 0.1))], "f int, k int, s double")
    pairs = spark.createDataFrame([(1, 1, 2, 0.6), (1, 2, 3, 0.6)], "f int, a int, b int, iou double")
    assert sorted(r.k for r in geometry.suppress(d, pairs, ["f"], "k", "s", 0.5).collect()) == [1, 3, 4]


def test_hold_out_guards(spark):
    df = spark.range(5).withColumnRenamed("id", "k")
    count = lambda d, share, frame=None: maintenance.hold_out(d, "k", share, frame=frame).filter("held_out").count()
    assert (count(df, 0.0), count(df, -1.0), count(df, 1e-9), count(df, 2.0)) == (0, 0, 1, 4)
    assert count(df.filter("k < 2"), 0.9) == 0 and count(df.limit(0), 0.5) == 0
    framed = df.withColumn("f", F.col("k") % 3)
    assert maintenance.hold_out(framed, "k", 1e-9, frame="f").filter("held_out").select("f").distinct().count() == 1
    assert count(framed, 2.0, "f") in (3, 4)  # all but a frame's rows
    two = df.withColumn("f", F.col("k") % 2)
    assert count(two, 1e-9, "f") == 1  # two frames: regions are held out by themselves


def test_flat_field_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.random((40, 3)) @ rng.random((3, 30)) + 1
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id int, px array<double>")
    field = arrays.FlatField(df, "px", 3)
    mean = x.mean(0)
    _, _, vt = np.linalg.svd(x - mean, full_matrices=False)
    want = mean + x @ vt[:3].T @ vt[:3]
    got = {r.id: r.flat for r in field.flattened(df, "px").collect()}
    assert np.allclose([got[i] for i in range(40)], want, atol=1e-6)


def test_labels_and_bins(spark):
    row = spark.range(1).select(
        names.range_label(F.lit("r562"), F.lit(5), F.lit("r563"), F.lit(3)).alias("a"), names.train_label(F.lit("r1"), F.lit(2)).alias("b"), names.p_text(F.lit(0.00002)).alias("p"), names.log_edges(1.0, 100.0, 2).alias("e"), names.bin_centres(names.log_edges(1.0, 100.0, 2)).alias("m"),
        names.angle_in_half_turn(F.lit(90.0)).alias("g"),
    ).first()
    assert (row.a, row.b, row.p, row.g) == ("r562 t5 to r563 t3", "r1 train 2", "2.0e-05", -90)
    assert row.e == pytest.approx([1, 10, 100]) and row.m == pytest.approx([10**0.5, 10**1.5])


def test_greedy_matching(spark):
    pairs = spark.createDataFrame([(1, 1, 7, 0.9, 0.6), (1, 1, 8, 0.9, 0.8), (1, 2, 8, 0.8, 0.9), (1, 2, 7, 0.8, 0.55), (1, 3, 7, 0.7, 0.99), (1, 3, 9, 0.7, 0.2)], "f int, p int, t int, s double, iou double")
    got = {(r.p, r.t) for r in geometry.match_greedy(pairs, ["f"], "p", "t", "s", "iou").collect()}
    assert got == {(1, 8), (2, 7)}


def test_decay_notes(spark):
    rows = [("short", k, 5.0 - k) for k in range(2)] + [("flat", k, 7.0) for k in range(6)] + [("good", 10 * k, 80 * math.exp(-k / 3)) for k in range(8)]
    got = {r.g: r for r in reg.decay_fits(spark.createDataFrame([(g, float(t), float(y)) for g, t, y in rows], "g string, t double, y double"), ["g"], "t", "y", offset=False).collect()}
    assert got["short"].note == "only 2 points (need 3)" and got["short"].tau is None
    assert got["flat"].note.startswith("no decay") and got["good"].note == "" and got["good"].tau == pytest.approx(30, rel=1e-4)
    assert got["good"].rate_per_min == pytest.approx(2, rel=1e-4) and got["good"].half_life == pytest.approx(30 * math.log(2), rel=1e-4)


def test_variance_partition_against_dummies(spark):
    """Least squares on indicator columns of all rows; runs with different trains."""
    rng = np.random.default_rng(5)
    rows = [(f"r{i}", t, float(i + 0.3 * t + rng.normal()), None if t == 3 else 1.0) for i in range(4) for t in range(i, 9) for _ in range(2)]
    got = {r.metric: r for r in dist.variance_partition(spark.createDataFrame(rows, "run string, train int, v double, flat double"), "run", "train", ["v", "flat"]).collect()}
    assert set(got) == {"v"}  # a metric that doesn't vary has no shares
    y, runs, trains = np.array([r[2] for r in rows]), np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    dummies = lambda c: (c[:, None] == np.unique(c)[None, 1:]).astype(float)

    def r2(*parts):
        x = np.hstack([np.ones((len(y), 1)), *parts])
        left = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        return 1 - (left**2).sum() / ((y - y.mean()) ** 2).sum()

    full, run, train = r2(dummies(runs), dummies(trains)), r2(dummies(runs)), r2(dummies(trains))
    want = (full - train, full - run, run + train - full, 1 - full)
    assert (got["v"].run_only, got["v"].train_only, got["v"].shared, got["v"].interaction_noise) == pytest.approx(want, abs=1e-9)


def test_ks_p():
    """Against counting all arrangements, and against Kolmogorov's limit where samples are large."""
    from itertools import combinations

    for m, n in ((3, 4), (5, 5), (2, 7)):
        far = []
        for first in combinations(range(m + n), m):
            walk = np.cumsum([1 / m if k in first else -1 / n for k in range(m + n)])
            far.append(np.abs(walk).max())
        far = np.array(far)
        for d in np.unique(np.round(far, 9)):
            want = (far >= d - 1e-9).mean()
            assert dist.ks_p(np.array([d]), np.array([m]), np.array([n]))[0] == pytest.approx(want, abs=1e-9)
    exact, limit = dist.ks_p(np.array([0.03, 0.03]), np.array([9_000, 10_001]), np.array([9_000, 10_001]))
    assert exact == pytest.approx(0.00063, rel=0.1) and limit == pytest.approx(0.00024, rel=0.1)
    assert dist.ks_p(np.array([0.0]), np.array([5]), np.array([9]))[0] == 1


def test_consecutive_ks(spark):
    rows = [("a", t, float(v + 3 * (t == 2))) for t in (0, 2, 5) for v in range(6)] + [("a", 7, 1.0), ("b", 1, 2.0)]
    got = [tuple(r) for r in dist.consecutive_ks(spark.createDataFrame(rows, "run string, train int, v double"), "run", "train", "v").orderBy("train_from").collect()]
    assert [r[:3] for r in got] == [("a", 0, 2), ("a", 2, 5)] and all(r[3] == pytest.approx(0.5) and r[4] == pytest.approx(0.4740, abs=1e-4) for r in got)


def test_trend_p_and_exclusion(spark):
    rows = [("a", k, float(k)) for k in range(6)] + [("b", k, float((k * 7) % 5)) for k in range(6)] + [("c", 0, 1.0)]
    df = spark.createDataFrame(rows, "run string, train int, v double")
    got = {(r.run, r.pooled): r for r in reg.trends(df, "run", "train", ["v"]).collect()}
    assert set(got) == {("a", False), ("b", False), (None, True)} and got["a", False].spearman_p == 0 and got["a", False].slope_p == pytest.approx(0, abs=1e-12)
    b = got["b", False]
    t = b.spearman_rho * math.sqrt(4 / (1 - b.spearman_rho**2))
    row = spark.range(1).select(dist.t_two_sided(F.lit(t), F.lit(4)).alias("p")).first()
    assert b.spearman_p == pytest.approx(row.p)
    left = reg.trends(df, "run", "train", ["v"], exclude=spark.createDataFrame([("a", 0), ("a", 0), ("b", 9)], "run string, train int"))
    assert {(r.run, r.pooled): r.n for r in left.collect()} == {("a", False): 5, ("b", False): 6, (None, True): 12}


def test_merge_rules(spark):
    """Rows as they stand in the stage (content key, shapes, regions, draft, reviewed, key imported) and what a merge does with them."""
    cases = [
        ("new", None, "copied"), ("out", ("k", 3, 0, False, False, None), "skipped (excluded)"), ("empty", ("k", 0, 0, False, False, None), "updated (replaces an empty row)"),
        ("regions", ("k", 0, 2, False, False, None), "skipped (own)"), ("draft", ("k", 3, 0, True, False, None), "updated (replaces an uncorrected draft)"), ("draft with regions", ("k", 3, 1, True, False, None), "skipped (own)"),
        ("reviewed draft", ("k", 3, 0, True, True, None), "skipped (own)"), ("own", ("k", 3, 0, None, None, None), "skipped (own)"), ("edited", ("k", 3, 0, False, False, "old"), "skipped (edited since)"),
        ("emptied by hand", ("k", 0, 0, False, False, "old"), "skipped (edited since)"), ("same", ("src", 3, 0, False, False, "src"), "up to date"), ("older", ("old", 3, 0, False, False, "old"), "updated"),
    ]
    incoming = spark.createDataFrame([(k, "src") for k, _, _ in cases], "key string, digest string")
    stage = spark.createDataFrame([(k, *row) for k, row, _ in cases if row], "key string, digest string, n_shapes int, n_rois int, draft boolean, reviewed boolean, imported_key string")
    got = maintenance.merge_actions(incoming, stage, spark.createDataFrame([("out",)], "key string"), "key", "digest")
    assert {r.key: r.action for r in got.collect()} == {k: want for k, _, want in cases}


def test_frame_metrics_of_empty_frames(spark):
    from grainflow.operators import metrics

    frames = spark.createDataFrame([("a", 250, 400), ("b", 250, 400)], "frame string, image_height_px int, image_width_px int")
    b = spark.createDataFrame([("a", 2.0, 12.0, 10.0, 20.0, 4.0, 4.0, None), ("a", 4.0, 36.0, 20.0, 20.0, 8.0, 4.0, True), ("lost", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, True)], "frame string, r_eq_um double, area_um2 double, x double, y double, major_axis double, minor_axis double, edge_truncated boolean")
    got = {r.frame: r for r in metrics.frame_metrics(b, frames, ["frame"]).collect()}
    assert set(got) == {"a", "b"} and (got["b"].n, got["b"].area_total, got["b"].packing, got["b"].r_mean, got["b"].cx_um) == (0, 0, 0, None, None)
    a = got["a"]
    assert (a.n, a.r_mean, a.n_edge, a.aspect_median, a.frac_noncircular) == (2, 3, 1, 0.75, 0.5) and a.cx_um == pytest.approx(17.5 * 3.2) and a.density_per_mm2 == pytest.approx(2 / 1.024)


def test_prediction_as_draft(spark):
    saved = spark.createDataFrame([("f1", "old", "m0", "t0", True, "t1", 5)], "frame string, bubbles string, model string, drafted_at string, reviewed boolean, edited_at string, extra int").withColumn("draft", F.lit(False))
    new = spark.createDataFrame([("f1", "new", "m1", "t2"), ("f2", "n2", "m1", "t2")], "frame string, bubbles string, model string, drafted_at string")
    got = {r.frame: r for r in maintenance.as_draft(saved, new, ["frame"]).collect()}
    assert (got["f1"].bubbles, got["f1"].model, got["f1"].reviewed, got["f1"].edited_at, got["f1"].extra, got["f1"].draft) == ("new", "m1", None, None, 5, True)
    assert got["f2"].bubbles == "n2" and got["f2"].draft and got["f2"].extra is None


def test_nearest_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    points = [("a", k, *map(float, p)) for k, p in enumerate(np.vstack([rng.normal(0, 0.1, (200, 2)), rng.uniform(-500, 500, (40, 2))]))] + [("b", 0, 1.0, 1.0), ("c", 0, 2.0, 2.0), ("c", 1, 2.0, 2.0), ("d", 0, None, 1.0), ("e", 0, 0.0, 0.0), ("e", 1, 0.0, 9.0)]
    got = {(r.g, r.k): r.nn for r in geometry.nearest_neighbours(spark.createDataFrame(points, "g string, k int, x double, y double"), ["g"], "k", "x", "y").collect()}
    want = {}
    for g, k, x, y in points:
        far = [math.hypot(x - u, y - v) for h, j, u, v in points if h == g and j != k and u is not None] if x is not None else []
        if far:
            want[g, k] = min(far)
    assert got == pytest.approx(want)


def test_gamma_tail():
    from grainflow.operators.size_models import gamma_tail

    for a, x, want in ((1.0, 2.0, math.exp(-2)), (2.0, 3.0, 4 * math.exp(-3)), (0.5, 1.0, math.erfc(1.0)), (0.5, 9.0, math.erfc(3.0)), (3.0, 0.5, 1.625 * math.exp(-0.5)), (5.0, 0.0, 1.0), (2.0, math.inf, 0.0)):
        assert gamma_tail(a, x) == pytest.approx(want, rel=1e-10)


def test_truncated_fits_find_the_family(spark):
    from grainflow.operators import size_models

    rng = np.random.default_rng(4)
    x = np.sort(rng.gamma(3.0, 4.0, 8_000))
    x = x[x >= 5]
    p, _ = size_models.fit_model("gamma", x, np.ones_like(x), 5.0)
    assert np.exp(p) == pytest.approx([3.0, 4.0], rel=0.15) and size_models.weighted_ks("gamma", p, x, np.ones_like(x), 5.0) < 0.02
    far = size_models.weighted_ks("weibull", np.log([1.0, 3.0]), x, np.ones_like(x), 5.0)
    assert far > 0.1
    few, twice = x[::50], np.array([1.0, 3.0] * 100)[: len(x[::50])]
    want = max(max(abs((twice[: i + 1].sum()) / twice.sum() - f), abs(twice[:i].sum() / twice.sum() - f)) for i, v in enumerate(few) for f in [1 - size_models.tail("gamma", v, p) / size_models.tail("gamma", 5.0, p)])
    assert size_models.weighted_ks("gamma", p, few, twice, 5.0) == pytest.approx(want)


def test_bootstrap_weights(spark):
    from grainflow.operators import size_models

    df = spark.createDataFrame([("a", v, 2.0) for v in range(6, 30)] + [("b", v, 0.5) for v in range(6, 20)], "run string, v int, w double").withColumn("v", F.col("v").cast("double"))
    got = size_models.bootstrap_runs(df, "run", "v", 5.0, resamples=4, weight="w").collect()
    assert len(got) == 4 and all(r.mean > 5 and r.mode > 0 and r.skewness is not None for r in got)
    doubled = size_models.bootstrap_runs(df.withColumn("w", F.col("w") * 2), "run", "v", 5.0, resamples=4, weight="w").collect()
    assert [r.mean for r in sorted(got)] == pytest.approx([r.mean for r in sorted(doubled)], rel=1e-2)


def test_nearest_neighbours_in_clusters(spark):
    """Two tight clusters far apart, points all in one place, repeated places and a lone outlier: as all pairs give them, and no cell of the first grid is crowded."""
    rng = np.random.default_rng(9)
    xy = [("clusters", k, *(rng.normal(0, 1e-3, 2) + (k % 2) * 500)) for k in range(600)] + [("clusters", 600, 250.0, 250.0)]
    xy += [("place", k, 3.0, 4.0) for k in range(50)] + [("mixed", k, float(k // 2), 0.0) for k in range(6)] + [("mixed", 6, 9.0, 0.0), ("alone", 0, 1.0, 1.0)]
    rows = [(g, k, float(a), float(b)) for g, k, a, b in xy]
    got = {(r.g, r.k): r.nn for r in geometry.nearest_neighbours(spark.createDataFrame(rows, "g string, k int, x double, y double"), ["g"], "k", "x", "y").collect()}
    want = {}
    for g in ("clusters", "place", "mixed"):
        own = [r for r in rows if r[0] == g]
        p = np.array([r[2:] for r in own])
        d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
        np.fill_diagonal(d, np.inf)
        want |= {(g, r[1]): v for r, v in zip(own, d.min(axis=1))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_frame_description(spark):
    """Coverage, nearest distance and Clark-Evans beside the sizes; a frame without bubbles has them too."""
    bubbles = [("f", k, 10.0 + 20 * k, 30.0, 5.0, 4.0, 3.0, 0.0) for k in range(3)]
    names = "frame string, bubble_id int, x double, y double, r_eq_um double, semi_major double, semi_minor double, angle_deg double"
    df = spark.createDataFrame(bubbles, names).withColumns({"area_um2": F.lit(50.0), "major_axis": F.col("semi_major") * 2, "minor_axis": F.col("semi_minor") * 2, "edge_truncated": F.lit(False)})
    frames = spark.createDataFrame([("f", 60, 80), ("none", 60, 80)], "frame string, image_height_px int, image_width_px int")
    rows = {r.frame: r for r in metrics.frame_description(df, frames, ["frame"], 60, 80).collect()}
    r = rows["f"]
    assert r.n == 3 and r.nn_um == pytest.approx(20 * 3.2) and r.coverage == pytest.approx(3 * math.pi * 12 / 4800, rel=0.03)
    expected = 0.5 * math.sqrt(4800 / 3) + (0.0514 + 0.041 / math.sqrt(3)) * 280 / 3
    assert r.clark_evans == pytest.approx(20 / expected)
    assert (rows["none"].n, rows["none"].coverage, rows["none"].nn_um, rows["none"].clark_evans) == (0, 0.0, None, None)


def test_bootstrap_of_equal_groups(spark):
    """A run drawn twice counts once, unlike without ``equal``; frames of a run weigh alike however many rows they have."""
    from grainflow.operators import size_models

    rows = [("a", 1, v) for v in range(6, 30)] * 9 + [("a", 2, v) for v in range(20, 30)] + [("b", 1, v) for v in range(6, 14)]
    df = spark.createDataFrame(rows, "run string, frame int, v int").withColumn("v", F.col("v").cast("double"))
    for equal in (["run"], ["run", "frame"]):
        got = {r.resample: r.params for r in size_models.bootstrap_runs(df, "run", "v", 5.0, resamples=6, equal=equal).collect()}
        rng = np.random.default_rng(0)
        for k in range(6):
            drawn = {"ab"[i] for i in rng.integers(0, 2, 2)}
            own = [r for r in rows if r[0] in drawn]
            group = lambda r: r[: len(equal)]
            count = {g: sum(group(r) == g for r in own) for g in map(group, own)}
            w = {}
            for r in own:
                w[r[2]] = w.get(r[2], 0) + 1 / count[group(r)]
            x = np.array(sorted(w), float)
            want = size_models.fit_model("lognormal", x, np.array([w[v] for v in x]), 5.0)[0]
            assert got[k] == pytest.approx(want, abs=2e-3)
    with pytest.raises(ValueError):
        size_models.bootstrap_runs(df, "run", "v", 5.0, weight="v", equal=["run"])


def test_outlines_and_masks(spark):
    from grainflow.operators import masks

    t = np.linspace(0, 2 * np.pi, 30, endpoint=False)
    rows = [("circle", 5 + 3 * math.sin(a), 7 + 3 * math.cos(a)) for a in t] + [("arc", 5 + 3 * math.sin(a), 7 + 3 * math.cos(a)) for a in t[:9]] + [("line", float(k), float(k)) for k in range(6)] + [("two", 1.0, 2.0), ("two", 2.0, 2.0), ("none", None, 1.0)]
    got = {r.g: r for r in masks.fitted_outlines(spark.createDataFrame(rows, "g string, r double, c double"), ["g"], "r", "c").collect()}
    for g in ("circle", "arc"):
        assert (got[g].circle_row, got[g].circle_col, got[g].radius) == pytest.approx((5, 7, 3), abs=1e-6)
    assert (got["circle"].semi_major, got["circle"].semi_minor) == pytest.approx((3, 3), abs=1e-6)
    assert got["line"].radius is None and got["line"].semi_major is None and got["two"].radius is None and "none" not in got
    shapes = spark.createDataFrame([(1, 1, [0, 1, 2, 10, 11, 12]), (1, 2, [11, 12, 13]), (1, 3, [95]), (2, 1, [0])], "f int, k int, pixels array<int>")
    assert [tuple(r) for r in masks.mask_overlaps(shapes, ["f"], "k", 10).collect()] == [(1, 1, 2, pytest.approx(2 / 7))]
    one = masks.measure_masks(shapes.filter("f = 2 OR k = 2"), ["f", "k"], 10).orderBy("f").collect()
    assert (one[0].area_px2, one[0].x, one[0].y, one[0].minor_axis) == (3, 2, 1, 0) and (one[1].area_px2, one[1].eccentricity) == (1, 0)
    row = spark.range(1).select(masks.arc_degrees(F.array(F.lit(1.0), F.lit(9.0), F.lit(12.0), F.lit(-5.0))).alias("arc"), masks.too_small(F.lit(3.0), F.lit(0.4)).alias("small"), masks.too_small(F.lit(None).cast("double"), F.lit(4.0)).alias("null"), masks.equal_area_radius(F.lit(8.0), F.lit(2.0)).alias("r"), masks.to_image(masks.to_model(F.lit(2.25), 3.0), 3.0).alias("back")).first()
    assert (row.arc, row.small, row.null, row.r, row.back) == (30, True, True, 4, 2.25)


def test_each_outline_is_fitted(spark, tmp_path):
    """The query fits an ellipse for each supplier, frame and number, also those of one size and direction; outlines of different lengths are fitted together."""
    from grainflow.operators import geometry, masks
    from grainflow.plans.catalog import QUERIES

    rows = [(order, 100 * supplier + order, supplier, line, 10.0 * supplier + line) for order in (1, 181, 361) for supplier in (1, 2) for line in (1, 2, 7)] + [(1, 1, None, 1, 4.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").selectExpr("*", "l_quantity * 1000 AS l_extendedprice", "'A' AS l_returnflag", "date'1992-01-02' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.supplier, r.frame, r.bubble): (r.row, r.col, r.semi_major, r.semi_minor) for r in QUERIES["fitted_outlines"](spark, str(tmp_path)).collect()}
    assert got == {(s, o, k): (r, r, round(k + 0.9, 6), round((k + 0.3) / 2, 6)) for o, _, s, k, r in rows}
    kinds = spark.createDataFrame([("a", 12), ("b", 12), (None, 30), ("d", 5)], "g string, n int").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    points = kinds.withColumn("p", F.get(geometry.outline(F.lit(2.0), F.lit(3.0), F.lit(4.0), F.lit(1.0), F.lit(20.0), 30), F.col("at") * (30 / F.col("n")).cast("int"))).select("g", F.col("p")[0].alias("r"), F.col("p")[1].alias("c"))
    points = points.unionByName(spark.createDataFrame([("line", float(k), 2.0 * k) for k in range(12)] + [("nan", float("nan") if k else 0.0, 2.0 * k) for k in range(12)], points.schema))
    fits = {r.g: r for r in masks.fitted_outlines(points, ["g"], "r", "c").collect()}
    assert {g: r.n_points for g, r in fits.items()} == {"a": 12, "b": 12, None: 30, "d": 5, "line": 12, "nan": 12}
    for g in ("a", "b", None):
        assert tuple(fits[g][k] for k in ("row", "col", "semi_major", "semi_minor", "angle_deg")) == pytest.approx((2, 3, 4, 1, 20)) and fits[g].radius > 0
    assert fits["d"].radius > 0 and fits["d"].semi_major is None and all(fits[g][k] is None for g in ("line", "nan") for k in ("radius", "row", "semi_major"))
    at, rng = np.linspace(0, 5, 20), np.random.default_rng(4)
    r, c = (rng.uniform(2, 9, (15, 1)) * f(at + rng.uniform(0, 6, (15, 1))) + rng.normal(0, 0.05, (15, 20)) for f in (np.sin, np.cos))
    assert np.allclose(masks.circles_of(r, c), [masks.circle_of(*o) for o in zip(r, c)], atol=1e-6) and np.allclose(masks.ellipses_through(r, c), [masks.ellipse_through(*o) for o in zip(r, c)], atol=1e-6)


def test_scaling_and_percentiles(spark):
    df = spark.createDataFrame([(0, [0.0, 5.0, 10.0, None]), (1, [20.0, -3.0])], "k int, px array<double>")
    scaled = {r.k: r.s for r in df.select("k", arrays.scaled_to(F.col("px"), 0.0, 10.0, 100).alias("s")).collect()}
    assert scaled[0][:3] == [0, 50, 100] and scaled[1] == [100, 0]
    lo, hi = arrays.percentile_range(df, "px", 0.0, 1.0).first()[:2]
    assert (lo, hi) == (-3, 20)
