"""Queries of frame metrics, descriptions, flags and document rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainflow.operators import geometry, maintenance, metrics
from grainflow.operators import sequence as seq
from grainflow.plans.base import SQL, bubbles, read, rounded, trains


def _shapes(spark, sf_dir):
    b = bubbles(spark, sf_dir)
    k = F.col("bubble")
    return b.select(
        "run", "train", "frame", "bubble", F.col("r").alias("r_eq_um"), F.col("area").alias("area_um2"), (F.col("supplier") % 400).cast("double").alias("x"), (k * 30.0).alias("y"),
        (F.col("r") + 1).alias("major_axis"), ((F.col("r") + 1) * (k + 3.5) / 10).alias("minor_axis"), (F.col("run") == "A").alias("edge_truncated"), (F.col("supplier") % 5 > 0).alias("fit_reliable"),
        F.lit(250).alias("image_height_px"), F.lit(400).alias("image_width_px"), (F.col("train") % 2 == 0).alias("reviewed"),
    )


def frame_metrics(spark, sf_dir):
    """Orders are frames with bubbles; customers, under numbers of their own, are frames without."""
    keys = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame")).unionByName(read(spark, sf_dir, "customer").select((-F.col("c_custkey")).alias("frame")))
    frames = keys.select("frame", F.lit(250).alias("image_height_px"), F.lit(400).alias("image_width_px"))
    b = _shapes(spark, sf_dir).drop("image_height_px", "image_width_px")
    found = metrics.frame_metrics(b, frames, ["frame"], um_per_px=3.1)
    return rounded(found.withColumn("r32", F.round("r32", 4)), 5)


def described(spark, sf_dir):
    return rounded(metrics.described(bubbles(spark, sf_dir), ["run"], ["r", "area"]))


def value_counts(spark, sf_dir):
    s = seq.steps(trains(spark, sf_dir), "run", "train")
    kinds = s.select("run", seq.step_kind(F.col("count_ratio"), F.col("r_mean_ratio"), F.col("volume_ratio")).alias("kind"))
    return rounded(metrics.value_counts(kinds, ["kind"], ["run"]))


def share_change_by_kind(spark, sf_dir):
    s = seq.steps(trains(spark, sf_dir), "run", "train")
    kinds = s.select("run", "train_to", seq.step_kind(F.col("count_ratio"), F.col("r_mean_ratio"), F.col("volume_ratio")).alias("kind"))
    return rounded(metrics.share_change_by_kind(s.select("run", "train_to", "frac_small_change"), kinds, ["run", "train_to"], "kind", "frac_small_change"))


def analysis_flags(spark, sf_dir):
    flagged = metrics.analysis_flags(_shapes(spark, sf_dir), True, True, 45.0)
    return flagged.groupBy("run", "train").agg(F.count_if("in_analysis").alias("n_in_analysis"), F.count(F.lit(1)).alias("n"))


def chosen(spark, sf_dir):
    flagged = metrics.analysis_flags(_shapes(spark, sf_dir), False, True)
    kept = metrics.chosen(flagged, True, True, spark.createDataFrame([("A", 4), ("N", 50)], "run string, train long"))
    return rounded(kept.groupBy("run", "train").agg(F.count(F.lit(1)).alias("n"), F.avg("r_eq_um").alias("r_mean")))


def top_detections(spark, sf_dir):
    d = bubbles(spark, sf_dir).select("supplier", F.format_string("%d-%d", "frame", "bubble").alias("id"), F.col("area").alias("score"))
    return metrics.top_detections(d, ["supplier"], "id", "score", 30000.0, 20)


def nearest_on_curve(spark, sf_dir):
    curve = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.array(i * 4.0, 30.0 + 20.0 * F.sin(i / 3)))
    curves = spark.createDataFrame([("A",), ("N",), ("R",)], "run string").withColumn("curve", curve)
    p = bubbles(spark, sf_dir).select("run", "frame", "bubble", "r", (F.col("area") / 1000).alias("y"))
    return rounded(geometry.nearest_on_curve(p, curves, ["run"], "r", "y", "curve").groupBy("run", "place").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("distance")))


def _documents(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    flag = lambda c, v: F.col(c) == v
    return li.select("l_orderkey", "l_linenumber", flag("l_linestatus", "F").alias("reviewed"), flag("l_returnflag", "A").alias("draft"), (F.col("l_linenumber") - 1).alias("n_bubbles"), (F.col("l_suppkey") % 2).alias("n_rois"))


def trainable(spark, sf_dir):
    return maintenance.trainable(_documents(spark, sf_dir)).groupBy("draft", "reviewed", "n_rois", "eligible").agg(F.count(F.lit(1)).alias("n"))


def changed_since(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    exported = o.filter("o_orderkey % 3 > 0").select("o_orderkey", F.col("o_orderstatus").alias("digest"))
    current = o.filter("o_orderkey % 5 > 0").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "O").otherwise(F.col("o_orderstatus")).alias("digest"))
    return maintenance.changed_since(exported, current, ["o_orderkey"], "digest")


def edited_payload(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", F.lit("2026-01-01").alias("edited_at"))
    edits = c.filter("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_nationkey") < 12, "MACHINERY").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.lit("2026-02-02").alias("at"))
    return maintenance.edited_payload(c, edits, ["c_custkey"], ["c_mktsegment"], "at")


QUERIES = {
    "frame_metrics": frame_metrics, "described": described, "value_counts": value_counts, "share_change_by_kind": share_change_by_kind, "analysis_flags": analysis_flags, "chosen": chosen, "top_detections": top_detections,
    "nearest_on_curve": nearest_on_curve, "trainable": trainable, "changed_since": changed_since, "edited_payload": edited_payload,
}

_KINDS = """s AS (SELECT run, train AS train_to, n / greatest(lag(n) OVER w, 1) AS c, r_mean / lag(r_mean) OVER w AS m, volume / nullif(lag(volume) OVER w, 0) AS v, frac_small - lag(frac_small) OVER w AS ds, lag(train) OVER w AS p FROM trains WINDOW w AS (PARTITION BY run ORDER BY train)),
kinds AS (SELECT run, train_to, ds, CASE WHEN c > 1.1 AND m < 1 THEN 'new bubbles' WHEN c < 0.9 AND m > 1 AND abs(v - 1) <= 0.25 THEN 'coalescence' WHEN v > 1.25 AND c <= 1.1 THEN 'growth'
  WHEN v < 0.75 AND c <= 1.1 THEN 'dissolution' WHEN c BETWEEN 0.9 AND 1.1 AND abs(m - 1) <= 0.1 THEN 'little change' ELSE 'mixed' END AS kind FROM s WHERE p IS NOT NULL)"""
_FOV = "250 * 400 * 0.0031::DOUBLE * 0.0031"

ORACLE_SQL = {
    "frame_metrics": f"""WITH {SQL}, f AS (SELECT o_orderkey AS frame FROM orders UNION ALL SELECT -c_custkey FROM customer),
b AS (SELECT frame, r, area, supplier % 400 AS x, bubble * 30 AS y, (bubble + 3.5) / 10 AS aspect, run = 'A' AS edge FROM bubbles),
m AS (SELECT frame, count(*) AS n, avg(r) AS r_mean, stddev_samp(r) / sqrt(count(*)) AS r_sem, quantile_cont(r, 0.5) AS r_median, stddev_samp(r) AS r_std, max(r) AS r_max, quantile_cont(r, 0.9) AS r_p90, sum(r * r * r) / sum(r * r) AS r32,
  stddev_samp(r) / avg(r) AS polydispersity, sum(area) AS area_total, sum(4.0::DOUBLE / 3 * pi() * r * r * r) AS volume, avg((r < 10)::DOUBLE) AS frac_small, stddev_samp(ln(r)) AS log_width, quantile_cont(aspect, 0.5) AS aspect_median,
  avg((aspect < 0.8)::DOUBLE) AS frac_noncircular, sum(x * area) / sum(area) * 3.1 AS cx_um, sum(y * area) / sum(area) * 3.1 AS cy_um, count(*) FILTER (WHERE edge) AS n_edge FROM b GROUP BY frame)
SELECT frame, 250 AS image_height_px, 400 AS image_width_px, coalesce(n, 0) AS n, """
    + ", ".join(f"round({c}, {4 if c == 'r32' else 5}) AS {c}" for c in "r_mean r_sem r_median r_std r_max r_p90 r32 polydispersity frac_small log_width aspect_median frac_noncircular cx_um cy_um".split())
    + f""", round(coalesce(area_total, 0), 5) AS area_total, round(coalesce(volume, 0), 5) AS volume, coalesce(n_edge, 0) AS n_edge, round({_FOV}, 5) AS fov_mm2, round(coalesce(n, 0) / ({_FOV}), 5) AS density_per_mm2,
round(coalesce(area_total, 0) / ({_FOV} * 1000000), 5) AS packing FROM f LEFT JOIN m USING (frame)""",
    "described": f"""WITH {SQL}, l AS (SELECT run, 'r' AS "column", r AS v FROM bubbles UNION ALL SELECT run, 'area', area FROM bubbles)
SELECT run, "column", count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS max FROM l GROUP BY ALL""",
    "value_counts": f"WITH {SQL}, {_KINDS} SELECT run, kind, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY run), 6) AS share FROM kinds GROUP BY run, kind",
    "share_change_by_kind": f"WITH {SQL}, {_KINDS} SELECT kind, count(ds) AS n, round(avg(ds), 6) + 0.0 AS mean, round(stddev_samp(ds) / sqrt(count(ds)), 6) AS sem FROM kinds GROUP BY kind",
    "analysis_flags": f"""WITH {SQL} SELECT run, train, count(*) FILTER (WHERE run <> 'A' AND supplier % 5 > 0 AND supplier % 400 BETWEEN 44.5 AND 354.5 AND bubble * 30 BETWEEN 44.5 AND 204.5) AS n_in_analysis, count(*) AS n FROM bubbles GROUP BY run, train""",
    "chosen": f"WITH {SQL} SELECT run, train, count(*) AS n, round(avg(r), 6) AS r_mean FROM bubbles WHERE train % 2 = 0 AND supplier % 5 > 0 AND (run, train) NOT IN (('A', 4), ('N', 50)) GROUP BY run, train",
    "top_detections": f"WITH {SQL} SELECT supplier, frame || '-' || bubble AS id, area AS score FROM bubbles WHERE area >= 30000 QUALIFY row_number() OVER (PARTITION BY supplier ORDER BY area DESC, frame || '-' || bubble) <= 20",
    "nearest_on_curve": f"""WITH {SQL}, c AS (SELECT i AS place, i * 4.0::DOUBLE AS x, 30 + 20 * sin(i / 3) AS y FROM range(0, 16) t(i)),
d AS (SELECT run, frame, bubble, r, area, place, sqrt(pow(x - r, 2) + pow(y - area / 1000, 2)) AS d FROM bubbles, c), m AS (SELECT run, frame, bubble, r, area, arg_min(place, (d, place)) AS place, min(d) AS d FROM d GROUP BY ALL),
k AS (SELECT run, frame, bubble, r, area, count(*) AS k FROM bubbles GROUP BY ALL)
SELECT run, place::INT AS place, sum(k)::BIGINT AS n, round(sum(d * k) / sum(k), 6) AS distance FROM m JOIN k USING (run, frame, bubble, r, area) GROUP BY run, place""",
    "trainable": """WITH d AS (SELECT l_returnflag = 'A' AS draft, l_linestatus = 'F' AS reviewed, l_suppkey % 2 AS n_rois, l_linenumber > 1 AS filled FROM lineitem)
SELECT draft, reviewed, n_rois, (NOT draft OR reviewed OR n_rois > 0) AND filled AS eligible, count(*) AS n FROM d GROUP BY ALL""",
    "changed_since": "SELECT o_orderkey, o_orderstatus AS exported, 'O' AS current FROM orders WHERE o_orderkey % 15 NOT IN (0, 3, 5, 6, 9, 10, 12) AND o_custkey % 2 = 0 AND o_orderstatus <> 'O'",
    "edited_payload": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_nationkey < 12 THEN 'MACHINERY' ELSE c_mktsegment END AS c_mktsegment, c_nationkey,
CASE WHEN c_custkey % 3 = 0 AND c_nationkey < 12 AND c_mktsegment IS DISTINCT FROM 'MACHINERY' THEN '2026-02-02' ELSE '2026-01-01' END AS edited_at FROM customer""",
}
