"""Queries of the comparison operators and of the drafting rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainflow.operators import arrays, comparison, geometry, maintenance
from grainflow.operators import regression as reg
from grainflow.plans.base import SQL, bubbles, read, rounded, trains


def train_means(spark, sf_dir):
    frames = bubbles(spark, sf_dir).groupBy("run", "train", "frame").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("r").alias("r_mean"))
    return rounded(comparison.train_means(frames, ["run", "train"], ["n", "r_mean"]))


def relative_to_base(spark, sf_dir):
    t = trains(spark, sf_dir).select("run", "train", "r_mean", "volume")
    return rounded(comparison.relative_to_base(t, ["run"], F.col("train") % 5 == 0, ["r_mean", "volume"]).drop("r_mean", "volume"))


def density_band(spark, sf_dir):
    return rounded(comparison.density_band(bubbles(spark, sf_dir), "supplier", "r", 0.0, 50.0, 10))


def baseline_difference(spark, sf_dir):
    return rounded(comparison.baseline_difference(bubbles(spark, sf_dir), ["run"], "train", "r", 0.0, 50.0, 10))


def rank_correlation(spark, sf_dir):
    return rounded(comparison.spearman(bubbles(spark, sf_dir), ["run"], "r", "area"))


def distance_summary(spark, sf_dir):
    """Mean Wasserstein distances of ln r between all frames (run and month), without pairs."""
    b = bubbles(spark, sf_dir).filter("r > 0").select("run", "train", F.ln("r").alias("v"))
    return rounded(comparison.mean_distances(b, "run", "train", "v"))


def fit_distances(spark, sf_dir):
    b = bubbles(spark, sf_dir)
    fits = reg.lognormal_fits(b, ["run"], "r", 5.0).select("run", "mu", "sigma")
    return rounded(comparison.fit_distance(b, ["run"], "r", 5.0, fits), 4)


def spacing(spark, sf_dir):
    return rounded(comparison.spacing(read(spark, sf_dir, "events"), ["event_type"], "event_id"))


def draft_status(spark, sf_dir):
    wanted = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    documents = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderstatus") == "P").alias("reviewed"), (F.col("o_totalprice") > 300000).alias("edited"))
    elsewhere = read(spark, sf_dir, "customer").filter("c_nationkey < 8").select(F.col("c_custkey").alias("key"))
    return maintenance.draft_status(wanted, documents, elsewhere, "key", overwrite=True)


def next_work(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    documents = li.select(
        F.col("l_suppkey").alias("folder"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("name"),
        (F.col("l_linestatus") == "F").alias("reviewed"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_shipdate")).alias("drafted_at"),
        (F.col("l_linenumber") - 1).alias("n_bubbles"),
        (F.col("l_returnflag") == "A").alias("draft"),
        (F.col("l_quantity") > 25).cast("int").alias("n_rois"),
    )
    return maintenance.next_work(documents, "folder", "name")


def stretched(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", arrays.stretched(F.col("embedding"), 0.1, 0.9).alias("p"))
    mean = F.aggregate("p", F.lit(0.0), lambda a, v: a + v) / F.size("p")
    return rounded(e.select("vec_id", mean.alias("mean"), F.size(F.filter("p", lambda v: v == 0)).cast("long").alias("at_zero")), 5)


def visibility(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") % 300 - 25).cast("double").alias("y"),
        (F.col("o_orderkey") % 460 - 30).cast("double").alias("x"),
        (F.col("o_totalprice") / 10000).alias("semi_major"),
        (F.col("o_totalprice") / 20000).alias("semi_minor"),
        (F.col("o_orderkey") % 180).cast("double").alias("angle_deg"),
        F.when(F.col("o_orderstatus") == "P", "sliver").alias("fit_kind"),
    )
    return rounded(geometry.with_visibility(o, 250.0, 400.0, 120.0).select("o_orderkey", "outline_visible_frac", "edge_truncated", "fit_reliable"))


QUERIES = {
    "train_means": train_means, "relative_to_base": relative_to_base, "density_band": density_band, "baseline_difference": baseline_difference, "rank_correlation": rank_correlation, "distance_summary": distance_summary,
    "fit_distances": fit_distances, "spacing": spacing, "draft_status": draft_status, "next_work": next_work, "stretched": stretched, "visibility": visibility,
}

_FILLED = """h AS (SELECT {g}, CAST(least(floor(r / 5), 9) AS INT) AS bin, count(*) AS c FROM bubbles WHERE r BETWEEN 0 AND 50 GROUP BY ALL),
e AS (SELECT DISTINCT {g}, unnest(range(0, 10)) AS bin FROM (SELECT {g} FROM bubbles GROUP BY ALL HAVING count(*) >= {least})),
d AS (SELECT {g}, CAST(bin AS INT) AS bin, coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY {g}) / 5 AS d FROM e LEFT JOIN h USING ({g}, bin))"""

ORACLE_SQL = {
    "train_means": f"""WITH {SQL}, f AS (SELECT run, train, frame, count(*) AS n, avg(r) AS m FROM bubbles GROUP BY ALL)
SELECT run, train, round(avg(n), 6) AS n, round(stddev_samp(n) / sqrt(count(*)), 6) AS n_sem, round(avg(m), 6) AS r_mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS r_mean_sem, count(*) AS n_frames FROM f GROUP BY run, train""",
    "relative_to_base": f"""WITH {SQL}, b AS (SELECT run, quantile_cont(r_mean, 0.5) AS m, quantile_cont(volume, 0.5) AS v FROM trains WHERE train % 5 <> 0 GROUP BY run)
SELECT run, train, round(r_mean / m, 6) AS r_mean_rel, round(volume / v, 6) AS volume_rel FROM trains LEFT JOIN b USING (run)""",
    "density_band": f"""WITH {SQL}, {_FILLED.format(g="supplier", least=50)}
SELECT bin, count(*) AS n_runs, round(quantile_cont(d, 0.16), 6) AS p16, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.84), 6) AS p84 FROM d GROUP BY bin""",
    "baseline_difference": f"""WITH {SQL}, {_FILLED.format(g="run, train", least=1)}
SELECT run, train, bin, round(d, 6) AS density, round(d - first_value(d) OVER (PARTITION BY run, bin ORDER BY train), 6) + 0.0 AS difference FROM d""",
    "rank_correlation": f"""WITH {SQL}, k AS (SELECT run, rank() OVER (PARTITION BY run ORDER BY r) + (count(*) OVER (PARTITION BY run, r) - 1) / 2 AS x, rank() OVER (PARTITION BY run ORDER BY area) + (count(*) OVER (PARTITION BY run, area) - 1) / 2 AS y FROM bubbles)
SELECT run, count(*) AS n, round(corr(x, y), 6) AS rho FROM k GROUP BY run""",
    "distance_summary": f"""WITH {SQL}, g AS (SELECT row_number() OVER (ORDER BY run, train) AS id, run, train, n FROM trains), c AS (SELECT id, ln(r) AS v, count(*) / any_value(g.n) AS c FROM bubbles JOIN g USING (run, train) GROUP BY ALL),
o AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.id < b.id),
s AS (SELECT a, b, v, sum(d) AS d FROM (SELECT a, b, v, c AS d FROM o JOIN c ON c.id = a UNION ALL SELECT a, b, v, -c FROM o JOIN c ON c.id = b) GROUP BY ALL),
p AS (SELECT a, b, abs(sum(d) OVER w) * (lead(v) OVER w - v) AS x FROM s WINDOW w AS (PARTITION BY a, b ORDER BY v)), m AS (SELECT a, b, sum(x) AS d FROM p GROUP BY ALL),
q AS (SELECT x.run = y.run AS r, x.train = y.train AS t, d FROM m JOIN g x ON x.id = a JOIN g y ON y.id = b)
SELECT round(avg(d) FILTER (WHERE r AND NOT t), 6) AS same_run, round(avg(d) FILTER (WHERE NOT r AND t), 6) AS same_train, round(avg(d) FILTER (WHERE NOT r AND NOT t), 6) AS both_different FROM q""",
    "spacing": """WITH d AS (SELECT event_type, lead(event_id) OVER (PARTITION BY event_type ORDER BY event_id) - event_id AS d FROM events)
SELECT event_type, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS spacing FROM d GROUP BY event_type""",
    "draft_status": """WITH d AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'P') AS r, bool_or(o_totalprice > 300000) AS e FROM orders GROUP BY 1)
SELECT c_custkey AS key, CASE WHEN r THEN 'skipped (exists, reviewed)' WHEN e THEN 'skipped (exists, corrected)' WHEN c_nationkey < 8 THEN 'copied (reviewed elsewhere)' ELSE 'predict' END AS status FROM customer LEFT JOIN d ON k = c_custkey""",
    "next_work": """WITH d AS (SELECT l_suppkey AS folder, l_orderkey || '-' || l_linenumber AS name, l_suppkey % 2 = 0 AS results, CASE WHEN l_suppkey % 2 = 0 THEN l_linestatus <> 'F' ELSE l_linenumber = 1 OR (l_returnflag = 'A' AND l_linestatus <> 'F' AND l_quantity <= 25) END AS open FROM lineitem)
SELECT folder, CASE WHEN bool_or(results) THEN 'results' ELSE 'training' END AS mode, coalesce(min(name) FILTER (WHERE open), min(name)) AS next, count(*) FILTER (WHERE open) AS n_open FROM d GROUP BY folder""",
    "stretched": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS p FROM embeddings), q AS (SELECT *, list_aggregate(p, 'quantile_cont', 0.1) AS lo, list_aggregate(p, 'quantile_cont', 0.9) AS hi FROM e),
s AS (SELECT vec_id, list_transform(p, lambda v: greatest(0, least(1, (v - lo) / (hi - lo)))) AS p FROM q)
SELECT vec_id, round(list_sum(p) / len(p), 5) + 0.0 AS mean, len(list_filter(p, lambda v: v = 0)) AS at_zero FROM s""",    "visibility": """WITH o AS (SELECT o_orderkey, o_orderstatus = 'P' AS sliver, o_custkey % 300 - 25 AS y, o_orderkey % 460 - 30 AS x, o_totalprice / 10000 AS a, o_totalprice / 20000 AS b, radians(o_orderkey % 180) AS t FROM orders),
p AS (SELECT *, unnest(range(0, 360)) * pi() / 180 AS i FROM o), s AS (SELECT o_orderkey, any_value(sliver) AS sliver, any_value(pow(((199.5 - x) * cos(t) + (124.5 - y) * sin(t)) / a, 2) + pow(((124.5 - y) * cos(t) - (199.5 - x) * sin(t)) / b, 2) <= 1) AS covers,
  count(*) FILTER (WHERE y + a * cos(i) * sin(t) + b * sin(i) * cos(t) BETWEEN -0.5 AND 249.5 AND x + a * cos(i) * cos(t) - b * sin(i) * sin(t) BETWEEN -0.5 AND 399.5) / 360 AS f FROM p GROUP BY o_orderkey)
SELECT o_orderkey, round(f, 6) AS outline_visible_frac, f < 1 OR sliver AS edge_truncated, NOT sliver AND f * 360 >= 120 AS fit_reliable FROM s WHERE f > 0 OR covers""",
}
