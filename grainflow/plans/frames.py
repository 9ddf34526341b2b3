"""Queries of selection, maintenance, geometry and arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainflow.operators import arrays, geometry, maintenance, selection
from grainflow.plans.base import SQL, bubbles, read, rounded

ITEMS = ["r001_tid3", ("2", "10-20,30", [1, 2]), (range(5, 8), 4)]
RANGES = [("r001", 3, 3, 0, 2**31 - 1), ("r002", 10, 20, 1, 1), ("r002", 10, 20, 2, 2), ("r002", 30, 30, 1, 1), ("r002", 30, 30, 2, 2), (None, 5, 7, 4, 4)]


def _manifest(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    run = F.concat(F.lit("r"), F.lpad((F.col("user_id") % 7).cast("string"), 3, "0"))
    return e.select(run.alias("run"), (F.floor(F.col("event_id") / 7) % 40).alias("train"), (F.floor(F.col("event_id") / 280) % 6).alias("frame_idx"), "event_id", "ts")


def select_frames(spark, sf_dir):
    return selection.select_frames(_manifest(spark, sf_dir), selection.selection(spark, ITEMS)).select("run", "train", "frame_idx", "event_id")


def compact_ranges(spark, sf_dir):
    return selection.compact_ranges(read(spark, sf_dir, "events"), ["user_id"], "event_id")


def missing_frames(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    wanted = m.select("run").distinct().withColumn("train", F.explode(F.sequence(F.lit(0), F.lit(44)))).withColumn("train", F.col("train").cast("long"))
    return selection.missing(wanted, m, ["run", "train"])


def newest_version(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return maintenance.newest(o, ["o_custkey"], "o_orderdate", ["o_orderkey"])


def first_wins(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_extendedprice")
    return maintenance.first_wins(li, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity"])


def stale_exports(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    exports = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("exported"), F.count(F.lit(1)).alias("n_bytes")).select(F.col("o_custkey").alias("key"), F.col("exported").cast("timestamp").alias("exported"), "n_bytes")
    li = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).join(o.select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("changed")), "key", "left")
    return maintenance.stale(exports, li, ["key"], "exported", "changed", least_bytes=3)


def merge_actions(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    incoming = o.groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderstatus").alias("digest"))
    c = read(spark, sf_dir, "customer")
    stage = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.lit("O").alias("digest"), (F.col("c_nationkey") % 3).alias("n_shapes"), (F.col("c_nationkey") > 12).alias("draft"), (F.col("c_mktsegment") == "BUILDING").alias("reviewed"), (F.col("c_custkey") % 4).alias("n_rois"), F.when(F.col("c_nationkey") < 6, "O").when(F.col("c_nationkey") < 9, "F").alias("imported_key"))
    excluded = c.filter("c_acctbal > 8000").select(F.col("c_custkey").alias("key"))
    return maintenance.merge_actions(incoming, stage, excluded, "key", "digest")


def hold_out(spark, sf_dir):
    return maintenance.hold_out(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 0.2, seed=3)


def hold_out_frames(spark, sf_dir):
    return maintenance.hold_out(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", 0.2, seed=3, frame="c_nationkey")


def _points(spark, sf_dir):
    return bubbles(spark, sf_dir).select("supplier", F.concat_ws("-", "frame", "bubble").alias("id"), (F.col("r") * 8.0).alias("x"), (F.col("area") / 400.0).alias("y"))


def nearest_neighbours(spark, sf_dir):
    p = _points(spark, sf_dir).groupBy("supplier", "id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    nn = geometry.nearest_neighbours(p, ["supplier"], "id", "x", "y")
    return rounded(geometry.clark_evans(nn, p, ["supplier"], 400.0, 250.0))


def _boxes(spark, sf_dir):
    b = bubbles(spark, sf_dir).groupBy("frame", "bubble").agg(F.min("r").alias("r0"), F.min("area").alias("a"))
    return b.select("frame", "bubble", "r0", (F.col("r0") + 20).alias("r1"), (F.col("a") / 1000).alias("c0"), (F.col("a") / 1000 + 30).alias("c1"), F.col("a").alias("score"))


def box_overlaps(spark, sf_dir):
    return rounded(geometry.box_overlaps(_boxes(spark, sf_dir), ["frame"], "bubble", ("r0", "c0", "r1", "c1"), 32.0))


def suppressed(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    pairs = geometry.box_overlaps(boxes, ["frame"], "bubble", ("r0", "c0", "r1", "c1"), 32.0)
    return geometry.suppress(boxes, pairs, ["frame"], "bubble", "score", 0.3)


def matched(spark, sf_dir):
    """Lines of an order with odd numbers as predictions of those with even numbers."""
    boxes = _boxes(spark, sf_dir)
    pairs = geometry.box_overlaps(boxes, ["frame"], "bubble", ("r0", "c0", "r1", "c1"), 32.0)
    odd = F.col("bubble") % 2 == 1
    kept = pairs.filter((F.col("a") + F.col("b")) % 2 == 1).select("frame", F.when(F.col("a") % 2 == 1, F.col("a")).otherwise(F.col("b")).alias("prediction"), F.when(F.col("a") % 2 == 1, F.col("b")).otherwise(F.col("a")).alias("truth"), "iou")
    kept = kept.join(boxes.select("frame", F.col("bubble").alias("prediction"), "score"), ["frame", "prediction"])
    m = geometry.match_greedy(kept, ["frame"], "prediction", "truth", "score", "iou", 0.2)
    return rounded(geometry.match_scores(m, boxes.filter(odd), boxes.filter(~odd), ["frame"]))


def ellipses(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount")
    e = geometry.ellipse_of(F.col("l_quantity"), F.col("l_tax") * 10, F.col("l_discount") * 20, F.col("l_quantity") / 2)
    return rounded(li.select("l_orderkey", *(v.alias(k) for k, v in e.items())).groupBy("l_orderkey").agg(F.sum("area").alias("area"), F.max("r_eq").alias("r_eq"), F.max("semi_major").alias("semi_major"), F.min("semi_minor").alias("semi_minor"), F.max("angle_deg").alias("angle_deg")), 5)


def image_stats(spark, sf_dir):
    return rounded(arrays.image_stats(read(spark, sf_dir, "embeddings"), ["vec_id"], "embedding"), 4)


def flat_field(spark, sf_dir):
    images = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") + 2).alias("pixels"))
    out = arrays.FlatField(images, "pixels", rank=3).flattened(images, "pixels")
    n = F.size("flat")
    return rounded(out.select("vec_id", (F.aggregate("flat", F.lit(0.0), lambda a, v: a + v) / n).alias("flat_mean"), (F.aggregate("normalised", F.lit(0.0), lambda a, v: a + v) / n).alias("normalised_mean")), 5)


QUERIES = {
    "select_frames": select_frames, "compact_ranges": compact_ranges, "missing_frames": missing_frames, "newest_version": newest_version, "first_wins": first_wins, "stale_exports": stale_exports, "merge_actions": merge_actions,
    "hold_out": hold_out, "hold_out_frames": hold_out_frames, "nearest_neighbours": nearest_neighbours, "box_overlaps": box_overlaps, "suppressed": suppressed, "matched": matched, "ellipses": ellipses, "image_stats": image_stats, "flat_field": flat_field,
}

_MANIFEST = "manifest AS (SELECT 'r' || lpad(CAST(user_id % 7 AS VARCHAR), 3, '0') AS run, event_id // 7 % 40 AS train, event_id // 280 % 6 AS frame_idx, event_id FROM events)"
_FITS = " OR ".join(f"(train BETWEEN {a} AND {b} AND frame_idx BETWEEN {c} AND {d}" + (f" AND run = '{run}')" if run else ")") for run, a, b, c, d in RANGES)
_BOXES = f"{SQL}, boxes AS (SELECT frame, bubble, min(r) AS r0, min(r) + 20 AS r1, min(area) / 1000 AS c0, min(area) / 1000 + 30 AS c1 FROM bubbles GROUP BY frame, bubble)"

_OVERLAPS = f"""{_BOXES}, met AS (SELECT x.frame, x.bubble AS a, y.bubble AS b, least(x.r1, y.r1) - greatest(x.r0, y.r0) AS h, least(x.c1, y.c1) - greatest(x.c0, y.c0) AS w FROM boxes x JOIN boxes y ON x.frame = y.frame AND x.bubble < y.bubble),
pairs AS (SELECT frame, a, b, h * w / (1200 - h * w) AS iou FROM met WHERE h > 0 AND w > 0), scored AS (SELECT frame, bubble, min(area) AS score FROM bubbles GROUP BY frame, bubble)"""

ORACLE_SQL = {
    # Boxes of a frame are taken one by one in order; the list of those that stay goes along.
    "suppressed": f"""WITH RECURSIVE {_OVERLAPS}, foes AS (SELECT frame, k, list(o) AS o FROM (SELECT frame, a AS k, b AS o FROM pairs WHERE iou > 0.3 UNION ALL SELECT frame, b, a FROM pairs WHERE iou > 0.3) GROUP BY frame, k),
d AS (SELECT s.frame, bubble, coalesce(o, []) AS o, row_number() OVER (PARTITION BY s.frame ORDER BY score DESC, bubble) AS n FROM scored s LEFT JOIN foes ON foes.frame = s.frame AND k = bubble),
f AS (SELECT DISTINCT frame, 0::BIGINT AS n, []::BIGINT[] AS kept FROM d
  UNION ALL SELECT f.frame, d.n, CASE WHEN list_has_any(kept, o) THEN kept ELSE list_append(kept, bubble) END FROM f JOIN d ON d.frame = f.frame AND d.n = f.n + 1)
SELECT frame, unnest(kept) AS bubble FROM f WHERE n = (SELECT max(n) FROM d WHERE d.frame = f.frame)""",
    "matched": f"""WITH RECURSIVE {_OVERLAPS}, c AS (SELECT frame, CASE WHEN a % 2 = 1 THEN a ELSE b END AS p, CASE WHEN a % 2 = 1 THEN b ELSE a END AS t, iou FROM pairs WHERE (a + b) % 2 = 1 AND iou >= 0.2),
d AS (SELECT c.*, row_number() OVER (PARTITION BY c.frame ORDER BY score DESC, p, iou DESC, t) AS n FROM c JOIN scored s ON s.frame = c.frame AND s.bubble = p),
f AS (SELECT DISTINCT frame, 0::BIGINT AS n, []::BIGINT[] AS p, []::BIGINT[] AS t FROM d
  UNION ALL SELECT f.frame, d.n, CASE WHEN list_contains(f.p, d.p) OR list_contains(f.t, d.t) THEN f.p ELSE list_append(f.p, d.p) END, CASE WHEN list_contains(f.p, d.p) OR list_contains(f.t, d.t) THEN f.t ELSE list_append(f.t, d.t) END
  FROM f JOIN d ON d.frame = f.frame AND d.n = f.n + 1),
m AS (SELECT frame, max(len(p)) AS tp FROM f GROUP BY frame), n AS (SELECT frame, count(*) FILTER (WHERE bubble % 2 = 1) AS p, count(*) FILTER (WHERE bubble % 2 = 0) AS t FROM boxes GROUP BY frame)
SELECT frame, coalesce(tp, 0) AS tp, p - coalesce(tp, 0) AS fp, t - coalesce(tp, 0) AS fn, round(CASE WHEN p > 0 THEN coalesce(tp, 0) / p END, 6) AS precision, round(CASE WHEN t > 0 THEN coalesce(tp, 0) / t END, 6) AS recall,
       round(2 * coalesce(tp, 0) / (p + t), 6) AS f1 FROM n LEFT JOIN m USING (frame)""",
    "select_frames": f"WITH {_MANIFEST} SELECT run, train, frame_idx, event_id FROM manifest WHERE {_FITS}",
    "compact_ranges": """WITH d AS (SELECT DISTINCT user_id, event_id AS n FROM events), i AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS isle FROM d),
r AS (SELECT user_id, min(n) AS lo, max(n) AS hi FROM i GROUP BY user_id, isle)
SELECT user_id, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ranges FROM r GROUP BY user_id""",
    "missing_frames": f"WITH {_MANIFEST} SELECT run, train FROM (SELECT DISTINCT run FROM manifest) r, (SELECT unnest(range(0, 45)) AS train) t WHERE (run, train) NOT IN (SELECT (run, train) FROM manifest)",
    "newest_version": "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
    "first_wins": "SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) = 1",
    "stale_exports": """WITH o AS (SELECT o_custkey AS key, min(o_orderdate) AS exported, max(o_orderdate) AS changed, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey AS key, CASE WHEN exported IS NULL THEN 'missing' WHEN n < 3 THEN 'empty' WHEN epoch(changed) > epoch(exported) + 1 THEN 'changed' ELSE 'fresh' END AS status
FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN o ON c_custkey = key""",
    "merge_actions": """WITH i AS (SELECT o_custkey AS key, max(o_orderstatus) AS digest FROM orders GROUP BY 1)
SELECT key, digest, CASE WHEN c_acctbal > 8000 THEN 'skipped (excluded)' WHEN c_acctbal IS NULL OR c_acctbal <= 0 THEN 'copied'
       WHEN c_nationkey >= 9 AND c_nationkey % 3 = 0 AND c_custkey % 4 = 0 THEN 'updated (replaces an empty row)'
       WHEN c_nationkey >= 9 AND c_nationkey > 12 AND c_mktsegment <> 'BUILDING' AND c_custkey % 4 = 0 THEN 'updated (replaces an uncorrected draft)'
       WHEN c_nationkey >= 9 THEN 'skipped (own)' WHEN c_nationkey >= 6 THEN 'skipped (edited since)' WHEN digest = 'O' THEN 'up to date' ELSE 'updated' END AS action
FROM i LEFT JOIN customer ON key = c_custkey""",
    "hold_out": "SELECT c_custkey, CAST('0x' || md5('3:' || c_custkey)[1:8] AS BIGINT) / 4294967295 < 0.2 AS held_out FROM customer",
    "hold_out_frames": """WITH u AS (SELECT c_custkey, c_nationkey, CAST('0x' || md5('3:' || c_nationkey)[1:8] AS BIGINT) / 4294967295 AS u FROM customer)
SELECT c_custkey, c_nationkey, CASE WHEN (SELECT min(u) FROM u) >= 0.2 THEN u = (SELECT min(u) FROM u) ELSE u < 0.2 END AS held_out FROM u""",
    "nearest_neighbours": f"""WITH {SQL}, p AS (SELECT supplier, frame || '-' || bubble AS id, min(r * 8) AS x, min(area / 400) AS y FROM bubbles GROUP BY ALL),
m AS (SELECT a.supplier, a.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS nn FROM p a JOIN p b ON a.supplier = b.supplier AND a.id <> b.id GROUP BY ALL),
c AS (SELECT supplier, count(*) AS n FROM p GROUP BY supplier), d AS (SELECT supplier, avg(nn) AS nn_mean FROM m GROUP BY supplier)
SELECT c.supplier, n, round(nn_mean, 6) AS nn_mean, round(CASE WHEN n >= 3 THEN nn_mean / (0.5 * sqrt(100000.0::DOUBLE / n) + (0.0514 + 0.041 / sqrt(n)) * 1300.0::DOUBLE / n) END, 6) AS clark_evans FROM c LEFT JOIN d USING (supplier)""",
    "box_overlaps": f"""WITH {_BOXES}, m AS (SELECT x.frame, x.bubble AS a, y.bubble AS b, least(x.r1, y.r1) - greatest(x.r0, y.r0) AS h, least(x.c1, y.c1) - greatest(x.c0, y.c0) AS w FROM boxes x JOIN boxes y ON x.frame = y.frame AND x.bubble < y.bubble)
SELECT frame, a, b, round(h * w / (1200 - h * w), 6) AS iou FROM m WHERE h > 0 AND w > 0""",
    "ellipses": """WITH v AS (SELECT l_orderkey, l_quantity AS a, l_tax * 10 AS b, l_discount * 20 AS c, l_quantity / 2 AS d FROM lineitem),
k AS (SELECT l_orderkey, abs(a * d - b * c) AS k, a * a + b * b + c * c + d * d AS q, a * a + c * c AS rr, b * b + d * d AS cc, a * b + c * d AS rc FROM v)
SELECT l_orderkey, round(sum(k * pi()), 5) AS area, round(max(sqrt(k)), 5) AS r_eq, round(max((sqrt(q + 2 * k) + sqrt(greatest(0, q - 2 * k))) / 2), 5) AS semi_major,
       round(min((sqrt(q + 2 * k) - sqrt(greatest(0, q - 2 * k))) / 2), 5) AS semi_minor, round(max(degrees(0.5 * atan2(2 * rc, cc - rr))), 5) + 0.0 AS angle_deg FROM k GROUP BY l_orderkey""",
    "image_stats": """SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) / len(embedding), 4) + 0.0 AS mean, round(len(list_filter(embedding, lambda v: v < 0.01 OR v > 0.99)) / len(embedding), 4) AS clipped FROM embeddings""",
}
