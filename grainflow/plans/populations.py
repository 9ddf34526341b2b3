"""Queries of the population operators and size models."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainflow.operators import geometry, masks
from grainflow.operators import population as pop
from grainflow.operators import size_models
from grainflow.plans.base import SQL, bubbles, read, rounded, trains


def drop_sparse(spark, sf_dir):
    kept, dropped = pop.drop_sparse(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame")), bubbles(spark, sf_dir).select("frame"), ["frame"], 4)
    return kept.withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False)))


def weighted_sizes(spark, sf_dir):
    w = pop.weights(bubbles(spark, sf_dir), ["frame"])
    return rounded(w.groupBy("run").agg((F.sum(F.col("weight") * F.col("r")) / F.sum("weight")).alias("r_mean"), F.sum("weight").alias("weight")), 4)


def scaled_curves(spark, sf_dir):
    return rounded(pop.scaled_curves(bubbles(spark, sf_dir), ["run", "train"], "r", 0.0, 2.5, 10))


def collapse(spark, sf_dir):
    return rounded(pop.collapse(pop.scaled_curves(bubbles(spark, sf_dir), ["run", "train"], "r", 0.0, 2.5, 10), ["run", "train"], 1, 7))


def coverage(spark, sf_dir):
    b = bubbles(spark, sf_dir).select("supplier", (F.col("r") * 5).alias("row"), (F.col("area") / 250).alias("col"), (F.col("r") / 5).alias("rad"))
    return rounded(pop.coverage(b, ["supplier"], "row", "col", "rad", 250, 400))


def _discs(spark, sf_dir):
    """Ellipses on frames of 60 x 110 pixels, a supplier a frame."""
    b = bubbles(spark, sf_dir).groupBy("supplier", "frame", "bubble").agg(F.min("r").alias("row"), (F.min("area") / 1000).alias("col"))
    return b.withColumns({"a": F.col("bubble") + 0.9, "b": (F.col("bubble") + 0.3) / 2, "angle": (F.col("frame") % 180).cast("double")})


def ellipse_coverage(spark, sf_dir):
    return rounded(masks.ellipse_coverage(_discs(spark, sf_dir), ["supplier"], "row", "col", "a", "b", "angle", 60, 110, 2.0))


def measured_masks(spark, sf_dir):
    shapes = masks.rasterised(_discs(spark, sf_dir), ["supplier", "frame", "bubble"], "row", "col", "a", "b", "angle", 60, 110)
    m = masks.measure_masks(shapes, ["supplier", "frame", "bubble"], 110)
    return rounded(m.groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in ("area_px2", "x", "y", "r_eq", "major_axis", "minor_axis", "eccentricity"))), 5)


def mask_overlaps(spark, sf_dir):
    discs = _discs(spark, sf_dir).groupBy("frame", "bubble").agg(*(F.min(c).alias(c) for c in ("row", "col", "a", "b", "angle")))
    shapes = masks.rasterised(discs, ["frame", "bubble"], "row", "col", "a", "b", "angle", 60, 110)
    return rounded(masks.mask_overlaps(shapes, ["frame"], "bubble", 110))


def fitted_outlines(spark, sf_dir):
    """Circles and ellipses through the outlines of all ellipses, a row each: the ellipses come back."""
    keys = ["supplier", "frame", "bubble"]
    points = _discs(spark, sf_dir).select(*keys, F.explode(geometry.outline(F.col("row"), F.col("col"), F.col("a"), F.col("b"), F.col("angle"), 24)).alias("p"))
    out = masks.fitted_outlines(points.select(*keys, F.col("p")[0].alias("i"), F.col("p")[1].alias("j")), keys, "i", "j")
    return rounded(out.select(*keys, "n_points", "row", "col", "semi_major", "semi_minor"), 6)


def snapshots(spark, sf_dir):
    return pop.snapshots(trains(spark, sf_dir).select("run", "train", "n"), ["run"], "train", 7)


def every_kth(spark, sf_dir):
    return pop.every_kth(trains(spark, sf_dir).select("run", "train", "n"), ["run"], "train", 5)


def interpolated(spark, sf_dir):
    t = trains(spark, sf_dir)
    asked = t.select("run").distinct().withColumn("place", F.explode(F.array(*(F.lit(float(v)) for v in (1.0, 40.5, 55.25, 70.0, 200.0)))))
    return rounded(pop.interpolated(t.withColumn("x", F.col("train").cast("double")), ["run"], "x", "r_mean", asked, "place"))


def signed_ranks(spark, sf_dir):
    return rounded(pop.wilcoxon(bubbles(spark, sf_dir), ["run"], F.col("r") - 25).drop("p"), 4)


def size_model_table(spark, sf_dir):
    return rounded(size_models.model_table(bubbles(spark, sf_dir), ["run"], "r", 5.0).drop("params", "skewness"), 2)


def bootstrap(spark, sf_dir):
    fits = size_models.bootstrap_runs(bubbles(spark, sf_dir), "run", "r", 5.0)
    return rounded(fits.select("resample", F.get("params", F.lit(0)).alias("mu"), F.get("params", F.lit(1)).alias("log_sigma"), "mode", "mean", "skewness"), 4)


QUERIES = {
    "drop_sparse": drop_sparse, "weighted_sizes": weighted_sizes, "scaled_curves": scaled_curves, "collapse": collapse, "coverage": coverage, "snapshots": snapshots, "every_kth": every_kth, "interpolated": interpolated,
    "ellipse_coverage": ellipse_coverage, "measured_masks": measured_masks, "mask_overlaps": mask_overlaps, "fitted_outlines": fitted_outlines, "signed_ranks": signed_ranks, "size_model_table": size_model_table, "bootstrap": bootstrap,
}

_CURVES = """m AS (SELECT run, train, avg(r) AS m FROM bubbles GROUP BY ALL HAVING count(*) >= 10), x AS (SELECT b.run, b.train, r / m AS x FROM bubbles b JOIN m ON b.run = m.run AND b.train = m.train),
h AS (SELECT run, train, CAST(least(floor(x / 0.25), 9) AS INT) AS bin, count(*) AS c FROM x WHERE x BETWEEN 0 AND 2.5 GROUP BY ALL), curves AS (SELECT run, train, bin, c / sum(c) OVER (PARTITION BY run, train) / 0.25 AS density FROM h)"""

# Pixels are tried one by one in each ellipse's box.
_DISCS = """discs AS (SELECT supplier, frame, bubble, min(r) AS y0, min(area) / 1000 AS x0, bubble + 0.9::DOUBLE AS a, (bubble + 0.3::DOUBLE) / 2 AS b, radians(frame % 180) AS t FROM bubbles GROUP BY supplier, frame, bubble)"""
_PIXELS = """rows_ AS (SELECT *, unnest(range(greatest(0, floor((y0 - a) * {s}))::BIGINT, least({h} - 1, ceil((y0 + a + 1) * {s}))::BIGINT + 1)) AS y FROM {d}),
cells AS (SELECT *, unnest(range(greatest(0, floor((x0 - a) * {s}))::BIGINT, least({w} - 1, ceil((x0 + a + 1) * {s}))::BIGINT + 1)) AS x FROM rows_),
px AS (SELECT * FROM (SELECT *, (y + 0.5::DOUBLE) / {s} - 0.5 - y0 AS dy, (x + 0.5::DOUBLE) / {s} - 0.5 - x0 AS dx FROM cells) WHERE pow((dx * cos(t) + dy * sin(t)) / a, 2) + pow((dy * cos(t) - dx * sin(t)) / b, 2) <= 1)"""

ORACLE_SQL = {
    "drop_sparse": f"WITH {SQL}, c AS (SELECT frame, count(*) AS n FROM bubbles GROUP BY frame) SELECT o_orderkey AS frame, coalesce(n, 0) AS n, coalesce(n, 0) >= 4 AS kept FROM orders LEFT JOIN c ON o_orderkey = frame",
    "weighted_sizes": f"""WITH {SQL}, w AS (SELECT run, r, (SELECT count(*) FROM bubbles) / (SELECT count(DISTINCT frame) FROM bubbles) / count(*) OVER (PARTITION BY frame) AS w FROM bubbles)
SELECT run, round(sum(w * r) / sum(w), 4) AS r_mean, round(sum(w), 4) AS weight FROM w GROUP BY run""",
    "scaled_curves": f"WITH {SQL}, {_CURVES} SELECT run, train, bin, round(density, 6) AS density FROM curves",
    "collapse": f"""WITH {SQL}, {_CURVES}, k AS (SELECT count(*) AS k FROM (SELECT DISTINCT run, train FROM curves)), s AS (SELECT bin, sum(density) / max(k) AS m, sum(density * density) / max(k) AS q, max(k) AS k FROM curves, k WHERE bin BETWEEN 1 AND 7 GROUP BY bin)
SELECT max(k) AS frames, count(*) AS bins, round(avg(sqrt(greatest(0, q - m * m)) / m), 6) AS score FROM s""",
    "snapshots": f"""WITH {SQL}, p AS (SELECT run, train, n, row_number() OVER (PARTITION BY run ORDER BY train) - 1 AS i, count(*) OVER (PARTITION BY run) AS k FROM trains)
SELECT run, train, n FROM p WHERE i IN (SELECT round_even(j * (k - 1) / 6, 0) FROM range(0, 7) AS t(j))""",
    "every_kth": f"WITH {SQL} SELECT run, train, n FROM trains QUALIFY (row_number() OVER (PARTITION BY run ORDER BY train) - 1) % 5 = 0",
    "interpolated": f"""WITH {SQL}, q AS (SELECT DISTINCT run, unnest([1.0, 40.5, 55.25, 70.0, 200.0])::DOUBLE AS place FROM trains),
lo AS (SELECT q.run, place, arg_max(train, train) AS x, arg_max(r_mean, train) AS y FROM q JOIN trains t ON t.run = q.run AND t.train <= place GROUP BY ALL),
hi AS (SELECT q.run, place, arg_min(train, train) AS x, arg_min(r_mean, train) AS y FROM q JOIN trains t ON t.run = q.run AND t.train > place GROUP BY ALL)
SELECT q.run, q.place, round(CASE WHEN lo.x IS NULL THEN hi.y WHEN hi.x IS NULL THEN lo.y ELSE lo.y + (hi.y - lo.y) * (q.place - lo.x) / (hi.x - lo.x) END, 6) AS r_mean
FROM q LEFT JOIN lo ON lo.run = q.run AND lo.place = q.place LEFT JOIN hi ON hi.run = q.run AND hi.place = q.place""",
    "signed_ranks": f"""WITH {SQL}, k AS (SELECT run, r - 25 AS v, rank() OVER (PARTITION BY run ORDER BY abs(r - 25)) + (count(*) OVER (PARTITION BY run, abs(r - 25)) - 1) / 2 AS rk FROM bubbles WHERE r <> 25)
SELECT run, count(*) AS n, round(sum(rk) FILTER (WHERE v > 0), 4) AS w_plus, round(sum(rk) FILTER (WHERE v < 0), 4) AS w_minus FROM k GROUP BY run HAVING count(*) >= 6""",
    "coverage": f"""WITH {SQL}, d AS (SELECT supplier, r * 5 AS y0, area / 250 AS x0, r / 5 AS rad FROM bubbles),
p AS (SELECT supplier, x0, rad, y0, unnest(range(greatest(0, ceil(y0 - rad))::BIGINT, least(249, floor(y0 + rad))::BIGINT + 1)) AS y FROM d),
s AS (SELECT supplier, y, greatest(0, ceil(x0 - sqrt(greatest(0, rad * rad - pow(y - y0, 2)))))::BIGINT AS a, least(399, floor(x0 + sqrt(greatest(0, rad * rad - pow(y - y0, 2)))))::BIGINT AS b FROM p),
c AS (SELECT DISTINCT supplier, y, unnest(range(a, b + 1)) AS x FROM s WHERE a <= b)
SELECT u.supplier, round(count(x) / 100000, 6) AS coverage FROM (SELECT DISTINCT supplier FROM bubbles) u LEFT JOIN c ON c.supplier = u.supplier GROUP BY u.supplier""",
    "ellipse_coverage": f"""WITH {SQL}, {_DISCS}, {_PIXELS.format(s=2, h=120, w=220, d="discs")}, c AS (SELECT supplier, count(*) AS n FROM (SELECT DISTINCT supplier, y, x FROM px) GROUP BY supplier)
SELECT s.supplier, round(coalesce(n, 0) / 26400, 6) AS coverage FROM (SELECT DISTINCT supplier FROM bubbles) s LEFT JOIN c ON c.supplier = s.supplier""",
    "measured_masks": f"""WITH {SQL}, {_DISCS}, {_PIXELS.format(s=1, h=60, w=110, d="discs")},
m AS (SELECT supplier, frame, bubble, count(*) AS n, avg(y) AS y, avg(x) AS x, var_pop(y) AS vi, var_pop(x) AS vj, covar_pop(y, x) AS c FROM px GROUP BY supplier, frame, bubble),
e AS (SELECT *, (vi + vj) / 2 + sqrt(pow((vi - vj) / 2, 2) + c * c) AS l, greatest(0, (vi + vj) / 2 - sqrt(pow((vi - vj) / 2, 2) + c * c)) AS s FROM m)
SELECT supplier, count(*) AS n, round(avg(n), 5) AS area_px2, round(avg(x), 5) AS x, round(avg(y), 5) AS y, round(avg(sqrt(n / pi())), 5) AS r_eq, round(avg(4 * sqrt(l)), 5) AS major_axis, round(avg(4 * sqrt(s)), 5) AS minor_axis,
       round(avg(CASE WHEN l > 0 THEN sqrt(1 - s / l) ELSE 0 END), 5) AS eccentricity FROM e GROUP BY supplier""",
    "mask_overlaps": f"""WITH {SQL}, {_DISCS}, one AS (SELECT frame, bubble, min(y0) AS y0, min(x0) AS x0, min(a) AS a, min(b) AS b, min(t) AS t FROM discs GROUP BY frame, bubble), {_PIXELS.format(s=1, h=60, w=110, d="one")},
n AS (SELECT frame, bubble, count(*) AS n FROM px GROUP BY ALL), k AS (SELECT p.frame, p.bubble AS a, q.bubble AS b, count(*) AS k FROM px p JOIN px q ON p.frame = q.frame AND p.y = q.y AND p.x = q.x AND p.bubble < q.bubble GROUP BY ALL)
SELECT k.frame, k.a, k.b, round(k / (u.n + v.n - k), 6) AS iou FROM k JOIN n u ON u.frame = k.frame AND u.bubble = k.a JOIN n v ON v.frame = k.frame AND v.bubble = k.b""",
    "fitted_outlines": f"""WITH {SQL}, {_DISCS} SELECT supplier, frame, bubble, 24 AS n_points, round(y0, 6) AS "row", round(x0, 6) AS col, round(a, 6) AS semi_major, round(b, 6) AS semi_minor FROM discs""",
}
