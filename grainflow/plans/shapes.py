"""Queries of contours, fits at the image's edge, shapes of masks and polygons, over the ellipses of ``populations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainflow.operators import geometry, masks, outlines
from grainflow.plans.base import SQL, rounded
from grainflow.plans.populations import _DISCS, _PIXELS, _discs

KEYS, HEIGHT, WIDTH = ["supplier", "frame", "bubble"], 60, 110


def _masks(spark, sf_dir):
    return masks.rasterised(_discs(spark, sf_dir), KEYS, "row", "col", "a", "b", "angle", HEIGHT, WIDTH)


def _shapes(spark, sf_dir):
    names = {"row": "y", "col": "x", "a": "semi_major", "b": "semi_minor", "angle": "angle_deg"}
    return _discs(spark, sf_dir).withColumnsRenamed(names).withColumn("fit_kind", F.when(F.col("frame") % 5 == 0, "sliver"))


def outline_points(spark, sf_dir):
    fits = outlines.outline_fits(_masks(spark, sf_dir), KEYS, HEIGHT, WIDTH, cut_only=True)
    return fits.groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), F.sum("outline_points").alias("outline_points"), F.sum("border_points").alias("border_points"))


def measured_edges(spark, sf_dir):
    return rounded(outlines.measure_with_edges(_masks(spark, sf_dir), KEYS, HEIGHT, WIDTH), 5)


def mask_shapes(spark, sf_dir):
    return rounded(outlines.shapes_of_masks(_masks(spark, sf_dir), KEYS, HEIGHT, WIDTH), 5)


def row_overlaps(spark, sf_dir):
    """How far each mask and the circle of its ellipse's area overlap."""
    d = _discs(spark, sf_dir).withColumn("r", masks.equal_area_radius(F.col("a"), F.col("b")))
    drawn = masks.rasterised(d, [*KEYS, "row", "col", "r"], "row", "col", "a", "b", "angle", HEIGHT, WIDTH)
    found = outlines.shape_overlaps(drawn, KEYS, {"iou": ("row", "col", "r", "r", F.lit(0.0))}, HEIGHT, WIDTH).filter("iou IS NOT NULL")
    return rounded(found.groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), F.avg("iou").alias("iou"), F.min("iou").alias("least")))


def polygon_fill(spark, sf_dir):
    """Stars of five points, whose middle the even-odd rule leaves out, on a grid twice as fine."""
    corners = geometry.outline_points(F.col("row"), F.col("col"), F.col("a") * 2, F.col("b") * 3, F.col("angle"), 5)
    stars = _discs(spark, sf_dir).select(*KEYS, F.array(*(corners[k] for k in (0, 2, 4, 1, 3))).alias("points"))
    area = outlines.polygon_areas(stars, KEYS, "points", HEIGHT, WIDTH, 2.0)
    return rounded(area.groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), F.sum("area_visible_px2").alias("area")))


def measured_shapes(spark, sf_dir):
    m = outlines.measure_shapes(_shapes(spark, sf_dir), KEYS, HEIGHT, WIDTH, 2.0)
    sums = {"area_px2": "area_px2", "area_visible_px2": "area_visible_px2", "outline_visible_frac": "outline_visible_frac"}
    flags = [F.count_if(c).alias(c) for c in ("edge_truncated", "fit_reliable")]
    return rounded(m.groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(n) for c, n in sums.items()), *flags), 4)


QUERIES = {"outline_points": outline_points, "measured_edges": measured_edges, "mask_shapes": mask_shapes, "row_overlaps": row_overlaps, "polygon_fill": polygon_fill, "measured_shapes": measured_shapes}

_ONE = _PIXELS.format(s=1, h=HEIGHT, w=WIDTH, d="discs")
_STARS = "stars AS (SELECT supplier, frame, bubble, y0, x0, 2 * a AS a, 3 * b AS b, t, greatest(2 * a, 3 * b) AS reach FROM discs)"

ORACLE_SQL = {
    "outline_points": f"""WITH {SQL}, {_DISCS}, {_ONE}, p AS (SELECT supplier, frame, bubble, y, x FROM px),
e AS (SELECT p.*, dy, dx FROM p, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS s(dy, dx)),
o AS (SELECT e.*, y + dy / 2 AS my, x + dx / 2 AS mx FROM e ANTI JOIN p q ON q.supplier = e.supplier AND q.frame = e.frame AND q.bubble = e.bubble AND q.y = e.y + dy AND q.x = e.x + dx)
SELECT supplier, count(DISTINCT (frame, bubble)) AS n, count(*) AS outline_points, count(*) FILTER (WHERE my <= 0 OR my >= {HEIGHT - 1} OR mx <= 0 OR mx >= {WIDTH - 1}) AS border_points FROM o GROUP BY supplier""",
    "row_overlaps": f"""WITH {SQL}, {_DISCS}, {_ONE}, m AS (SELECT supplier, frame, bubble, y, x FROM px),
wide AS (SELECT supplier, frame, bubble, y0, x0, sqrt(a * b) AS r, unnest(range(greatest(0, floor(y0 - a))::BIGINT, least({HEIGHT - 1}, ceil(y0 + a))::BIGINT + 1)) AS y FROM discs),
c AS (SELECT * FROM (SELECT *, unnest(range(greatest(0, floor(x0 - r))::BIGINT, least({WIDTH - 1}, ceil(x0 + r))::BIGINT + 1)) AS x FROM wide) WHERE pow((y - y0) / r, 2) + pow((x - x0) / r, 2) <= 1),
nm AS (SELECT supplier, frame, bubble, count(*) AS n FROM m GROUP BY ALL), nc AS (SELECT supplier, frame, bubble, count(*) AS n FROM c GROUP BY ALL),
k AS (SELECT supplier, frame, bubble, count(*) AS k FROM m JOIN c USING (supplier, frame, bubble, y, x) GROUP BY ALL),
i AS (SELECT supplier, coalesce(k, 0) / (nm.n + nc.n - coalesce(k, 0)) AS iou FROM nm JOIN nc USING (supplier, frame, bubble) LEFT JOIN k USING (supplier, frame, bubble))
SELECT supplier, count(*) AS n, round(avg(iou), 6) AS iou, round(min(iou), 6) AS least FROM i GROUP BY supplier""",
    "polygon_fill": f"""WITH {SQL}, {_DISCS}, {_STARS}, v AS (SELECT *, list_transform([0, 2, 4, 1, 3, 0], lambda i: i * 2 * pi() / 5) AS u FROM stars),
q AS (SELECT *, list_transform(u, lambda i: (y0 + a * cos(i) * sin(t) + b * sin(i) * cos(t) + 0.5) * 2 - 0.5) AS qr, list_transform(u, lambda i: (x0 + a * cos(i) * cos(t) - b * sin(i) * sin(t) + 0.5) * 2 - 0.5) AS qc FROM v),
r AS (SELECT *, unnest(range(greatest(0, floor((y0 - reach) * 2))::BIGINT, least({2 * HEIGHT - 1}, ceil((y0 + reach + 1) * 2))::BIGINT + 1)) AS y FROM q),
k AS (SELECT *, list_transform(list_filter(range(1, 6), lambda i: (qr[i] <= y) <> (qr[i + 1] <= y)), lambda i: qc[i] + (y - qr[i]) / (qr[i + 1] - qr[i]) * (qc[i + 1] - qc[i])) AS cut FROM r),
x AS (SELECT supplier, frame, bubble, y, cut, unnest(range(greatest(0, floor((x0 - reach) * 2))::BIGINT, least({2 * WIDTH - 1}, ceil((x0 + reach + 1) * 2))::BIGINT + 1)) AS x FROM k WHERE len(cut) > 0),
i AS (SELECT supplier, frame, bubble FROM x WHERE len(list_filter(cut, lambda c: c <= x)) % 2 = 1)
SELECT supplier, count(DISTINCT (frame, bubble)) AS n, round(count(*) / 4, 6) AS area FROM i GROUP BY supplier""",
    "measured_shapes": f"""WITH {SQL}, {_DISCS}, {_PIXELS.format(s=2, h=2 * HEIGHT, w=2 * WIDTH, d="discs")}, n AS (SELECT supplier, frame, bubble, count(*) / 4 AS n FROM px GROUP BY ALL),
p AS (SELECT *, unnest(range(0, 360)) * pi() / 180 AS i FROM discs),
s AS (SELECT supplier, frame, bubble, count(*) FILTER (WHERE y0 + a * cos(i) * sin(t) + b * sin(i) * cos(t) BETWEEN -0.5 AND {HEIGHT - 0.5} AND x0 + a * cos(i) * cos(t) - b * sin(i) * sin(t) BETWEEN -0.5 AND {WIDTH - 0.5}) / 360 AS f, any_value(a * b * pi()) AS w FROM p GROUP BY ALL)
SELECT supplier, count(*) AS n, round(sum(w), 4) AS area_px2, round(sum(n), 4) AS area_visible_px2, round(sum(f), 4) AS outline_visible_frac, count(*) FILTER (WHERE f < 1 OR frame % 5 = 0) AS edge_truncated,
       count(*) FILTER (WHERE frame % 5 <> 0 AND (f = 1 OR f * 360 >= 140)) AS fit_reliable FROM s JOIN n USING (supplier, frame, bubble) GROUP BY supplier""",
}
