"""Queries of the distribution and regression operators. p-values have no SQL here; tests hold them against known values."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainflow.operators import distribution as dist
from grainflow.operators import regression as reg
from grainflow.operators import sequence as seq
from grainflow.plans.base import SQL, bubbles, read, rounded, trains


def histogram(spark, sf_dir):
    return rounded(dist.histogram(bubbles(spark, sf_dir), ["run"], "r", 0.0, 50.0, 20))


def histogram_2d(spark, sf_dir):
    b = bubbles(spark, sf_dir).withColumn("y", F.col("area") / 1000)
    return dist.histogram_2d(b, ["run"], "r", "y", 7.0, 49.0, 60.0)


def weighted_histogram(spark, sf_dir):
    return rounded(dist.weighted_histogram(bubbles(spark, sf_dir), ["run"], "r", "area", 0.0, 50.0, 20), 4)


def weighted_ecdf(spark, sf_dir):
    return rounded(dist.weighted_ecdf(bubbles(spark, sf_dir), ["run"], "r", "area"))


def consecutive_ks(spark, sf_dir):
    return rounded(dist.consecutive_ks(bubbles(spark, sf_dir), "run", "train", "r").drop("p"))


def steps_with_ks(spark, sf_dir):
    """Steps with the distance of the size distributions beside them; a step without one has null."""
    ks = dist.consecutive_ks(bubbles(spark, sf_dir), "run", "train", "r", 200).drop("p")
    steps = seq.steps(trains(spark, sf_dir), "run", "train").select("run", "train_from", "train_to", "count_ratio")
    return rounded(steps.join(ks, ["run", "train_from", "train_to"], "left"))


def ecdf(spark, sf_dir):
    return rounded(dist.ecdf(bubbles(spark, sf_dir), ["run"], "r"))


def _pairs(spark, sf_dir):
    kinds = read(spark, sf_dir, "events").select("event_type").distinct()
    return kinds.withColumnRenamed("event_type", "a").join(kinds.withColumnRenamed("event_type", "b"), F.col("a") < F.col("b"))


def ks_distance(spark, sf_dir):
    return rounded(dist.ks_distance(read(spark, sf_dir, "events"), "event_type", "value", _pairs(spark, sf_dir)))


def wasserstein(spark, sf_dir):
    return rounded(dist.wasserstein(read(spark, sf_dir, "events"), "event_type", "value", _pairs(spark, sf_dir)), 4)


def kruskal(spark, sf_dir):
    return rounded(dist.kruskal(bubbles(spark, sf_dir), [], "run", "r"), 4)


def mann_whitney(spark, sf_dir):
    b = bubbles(spark, sf_dir).withColumn("large", F.col("area") > 40000)
    return rounded(dist.mann_whitney(b, ["run"], "large", "r").drop("p"), 4)


def variance_partition(spark, sf_dir):
    return rounded(dist.variance_partition(trains(spark, sf_dir), "run", "train", ["r_mean", "frac_small"]))


def line_fits(spark, sf_dir):
    return rounded(reg.line_fit(trains(spark, sf_dir), ["run"], "train", "r_mean").drop("p"))


def pooled_trends(spark, sf_dir):
    exclude = spark.createDataFrame([("A", 5), ("N", 50)], "run string, train long")
    return rounded(reg.trends(trains(spark, sf_dir), "run", "train", ["n", "r_mean", "frac_small"], ["n"], exclude).drop("slope_p", "spearman_p"))


def whole_set_trend(spark, sf_dir):
    return rounded(reg.whole_set_trend(trains(spark, sf_dir), "run", "train", "n").drop("p", "slope_p"))


def _ranges(spark, sf_dir):
    line = seq.timeline(trains(spark, sf_dir), "run", "train", 15.0, 60.0).withColumn("set", F.lit("all"))
    ranges = spark.createDataFrame([(1, "A", 40, "N", 60), (2, "R", 90, "N", 80), (3, "N", 70, "N", 71)], "range_id int, start_run string, start_train long, end_run string, end_train long")
    return seq.range_members(line, ranges, "run", "train", "set")


def range_lines(spark, sf_dir):
    return rounded(reg.range_lines(_ranges(spark, sf_dir), ["range_id"], "t_s", "r_mean").drop("p"), 8)


def range_decays(spark, sf_dir):
    return rounded(reg.decay_fits(_ranges(spark, sf_dir), ["range_id"], "t_s", "n", offset=False), 4)


def power_law(spark, sf_dir):
    return rounded(reg.power_law(bubbles(spark, sf_dir), ["run"], "r", "area"))


def equal_means(spark, sf_dir):
    t = bubbles(spark, sf_dir).groupBy("run", "train").agg(F.avg("r").alias("v"), (F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("se"))
    return rounded(reg.equal_means(t, ["run"], "v", "se").drop("p"), 5)


def decay_fits(spark, sf_dir):
    return rounded(reg.decay_fits(trains(spark, sf_dir), ["run"], "train", "n"), 4)


def lognormal_fits(spark, sf_dir):
    return rounded(reg.lognormal_fits(bubbles(spark, sf_dir), ["run"], "r", 5.0), 4)


def size_classes(spark, sf_dir):
    edges = [0, 10, 20, 30, 40, 51]
    b = bubbles(spark, sf_dir)
    counts = [F.count_if((F.col("r") >= lo) & (F.col("r") < hi)).alias(f"c{lo}_{hi}") for lo, hi in zip(edges, edges[1:])]
    return b.groupBy("run", "train").agg(*counts)


def run_pivot(spark, sf_dir):
    p = bubbles(spark, sf_dir).groupBy("train").pivot("run", ["A", "N", "R"]).agg(F.sum("r"))
    return rounded(p.na.fill(0.0))


def mean_pivot(spark, sf_dir):
    """Mean size of each run (rows) in the trains 1 to 12; null where a run has none."""
    return rounded(bubbles(spark, sf_dir).groupBy("run").pivot("train", list(range(1, 13))).agg(F.avg("r")))


def ranked_runs(spark, sf_dir):
    t = trains(spark, sf_dir)
    return rounded(t.groupBy("run").agg(F.avg("r_mean").alias("r_mean"), (F.stddev_samp("r_mean") / F.sqrt(F.count(F.lit(1)))).alias("r_sem"), F.count(F.lit(1)).alias("n_trains"), F.max(F.struct("n", (-F.col("train")).alias("m"))).alias("top")).select("run", "r_mean", "r_sem", "n_trains", F.col("top.n").alias("top_n"), (-F.col("top.m")).alias("top_train")))


def event_props(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return rounded(e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("p.k").alias("k_mean"), F.max("p.k").alias("k_max")))


QUERIES = {
    "histogram": histogram, "histogram_2d": histogram_2d, "ecdf": ecdf, "ks_distance": ks_distance, "wasserstein": wasserstein, "kruskal": kruskal, "mann_whitney": mann_whitney, "variance_partition": variance_partition,
    "weighted_histogram": weighted_histogram, "weighted_ecdf": weighted_ecdf, "consecutive_ks": consecutive_ks, "steps_with_ks": steps_with_ks, "whole_set_trend": whole_set_trend, "range_lines": range_lines, "range_decays": range_decays, "mean_pivot": mean_pivot,
    "line_fits": line_fits, "pooled_trends": pooled_trends, "power_law": power_law, "equal_means": equal_means, "decay_fits": decay_fits, "lognormal_fits": lognormal_fits, "size_classes": size_classes, "run_pivot": run_pivot,
    "ranked_runs": ranked_runs, "event_props": event_props,
}

_CDFS = """kinds AS (SELECT DISTINCT event_type AS k FROM events), pairs AS (SELECT x.k AS a, y.k AS b FROM kinds x JOIN kinds y ON x.k < y.k),
c AS (SELECT event_type AS k, value AS v, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY ALL), n AS (SELECT k, sum(c) AS n FROM c GROUP BY k),
s AS (SELECT a, b, v, sum(df) AS df, sum(dg) AS dg FROM (
  SELECT a, b, v, c / n AS df, 0 AS dg FROM pairs JOIN c ON c.k = a JOIN n ON n.k = a UNION ALL SELECT a, b, v, 0, c / n FROM pairs JOIN c ON c.k = b JOIN n ON n.k = b) GROUP BY a, b, v),
p AS (SELECT a, b, v, sum(df) OVER w AS f, sum(dg) OVER w AS g, lead(v) OVER (PARTITION BY a, b ORDER BY v) AS nx FROM s WINDOW w AS (PARTITION BY a, b ORDER BY v))"""

_KS = """c AS (SELECT run, train, r AS v, count(*) AS c FROM b GROUP BY ALL), t AS (SELECT run, train, sum(c) AS n FROM c GROUP BY ALL),
j AS (SELECT run, lag(train) OVER w AS x, train AS y, lag(n) OVER w AS nx, n AS ny FROM t WINDOW w AS (PARTITION BY run ORDER BY train)), o AS (SELECT * FROM j WHERE nx >= 5 AND ny >= 5),
d AS (SELECT run, x, y, v, sum(f) AS f, sum(g) AS g FROM (SELECT o.run, x, y, v, c / nx AS f, 0 AS g FROM o JOIN c ON c.run = o.run AND c.train = x UNION ALL SELECT o.run, x, y, v, 0, c / ny FROM o JOIN c ON c.run = o.run AND c.train = y) GROUP BY ALL),
u AS (SELECT run, x, y, abs(sum(f) OVER w - sum(g) OVER w) AS d FROM d WINDOW w AS (PARTITION BY run, x, y ORDER BY v)), ks AS (SELECT run, x AS train_from, y AS train_to, max(d) AS d FROM u GROUP BY ALL)"""

ORACLE_SQL = {
    "histogram": f"""WITH {SQL}, b AS (SELECT run, CAST(least(floor(r / 2.5), 19) AS INT) AS bin, count(*) AS count FROM bubbles WHERE r BETWEEN 0 AND 50 GROUP BY ALL)
SELECT run, bin, count, round(count / sum(count) OVER (PARTITION BY run), 6) AS fraction, round(count / sum(count) OVER (PARTITION BY run) / 2.5, 6) AS density FROM b""",
    "histogram_2d": f"""WITH {SQL} SELECT run, CAST(least(floor(r / 7), 6) AS BIGINT) AS cell_x, CAST(least(floor(area / 7000), 8) AS BIGINT) AS cell_y, count(*) AS count
FROM bubbles WHERE r BETWEEN 0 AND 49 AND area / 1000 BETWEEN 0 AND 63 GROUP BY ALL""",
    "weighted_histogram": f"""WITH {SQL}, b AS (SELECT run, CAST(least(floor(r / 2.5), 19) AS INT) AS bin, sum(area) AS w FROM bubbles WHERE r BETWEEN 0 AND 50 GROUP BY ALL)
SELECT run, bin, round(w, 4) AS weight, round(w / sum(w) OVER (PARTITION BY run) / 2.5, 4) AS density FROM b""",
    "weighted_ecdf": f"""WITH {SQL}, c AS (SELECT run, r AS v, sum(area) AS w FROM bubbles GROUP BY ALL), u AS (SELECT *, sum(w) OVER (PARTITION BY run ORDER BY v) AS upto, sum(w) OVER (PARTITION BY run) AS al FROM c)
SELECT run, v, round(upto / al, 6) AS cdf, round((upto - w) / al, 6) + 0.0 AS "before" FROM u""",
    "ecdf": f"""WITH {SQL}, k AS (SELECT run, r AS v, row_number() OVER (PARTITION BY run ORDER BY r) AS k, count(*) OVER (PARTITION BY run) AS n FROM bubbles)
SELECT run, k, v, round(k / n, 6) AS cdf FROM k""",
    "consecutive_ks": f"WITH {SQL}, b AS (FROM bubbles), {_KS} SELECT run, train_from, train_to, round(d, 6) AS d FROM ks",
    "steps_with_ks": f"""WITH {SQL}, b AS (SELECT * FROM bubbles), {_KS.replace(">= 5", ">= 200")}, s AS (
  SELECT run, lag(train) OVER w AS train_from, train AS train_to, n / greatest(lag(n) OVER w, 1) AS count_ratio FROM trains WINDOW w AS (PARTITION BY run ORDER BY train))
SELECT s.run, s.train_from, s.train_to, round(count_ratio, 6) AS count_ratio, round(d, 6) AS d FROM s LEFT JOIN ks USING (run, train_from, train_to) WHERE s.train_from IS NOT NULL""",
    "whole_set_trend": f"""WITH {SQL}, k AS (SELECT run, train, ln(n) AS y, rank() OVER (PARTITION BY run ORDER BY train) AS a, rank() OVER (PARTITION BY run ORDER BY n) + (count(*) OVER (PARTITION BY run, n) - 1) / 2 AS b FROM trains)
SELECT run, count(*) AS n, round(corr(a, b), 6) AS rho, round(regr_slope(y, train), 6) + 0.0 AS slope, round((exp(regr_slope(y, train)) - 1) * 100, 6) + 0.0 AS pct_per_step FROM k GROUP BY run HAVING count(*) >= 4""",
    "range_lines": f"""WITH {SQL}, runs AS (SELECT run, max(train) AS last, row_number() OVER (ORDER BY run) AS pos FROM trains GROUP BY run),
starts AS (SELECT run, pos, coalesce(sum(last * 15.0::DOUBLE + 60) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM runs),
line AS (SELECT run, train, r_mean, s + train * 15.0::DOUBLE AS t_s, row_number() OVER (ORDER BY pos, train) AS seq FROM trains JOIN starts USING (run)),
ranges(range_id, sr, st, er, et) AS (VALUES (1, 'A', 40, 'N', 60), (2, 'R', 90, 'N', 80), (3, 'N', 70, 'N', 71)),
e AS (SELECT range_id, least(a.seq, b.seq) AS lo, greatest(a.seq, b.seq) AS hi FROM ranges JOIN line a ON a.run = sr AND a.train = st JOIN line b ON b.run = er AND b.train = et),
m AS (SELECT range_id, r_mean AS y, t_s, t_s - min(t_s) OVER (PARTITION BY range_id) AS t FROM line JOIN e ON seq BETWEEN lo AND hi),
f AS (SELECT range_id, count(*) AS n, min(t_s) AS t0, max(t_s) AS t1, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, regr_sxx(y, t) AS sxx, regr_syy(y, t) AS syy, regr_sxy(y, t) AS sxy, avg(t) AS mx FROM m GROUP BY range_id),
g AS (SELECT *, sqrt((syy - b * sxy) / (n - 2) / sxx) AS se FROM (SELECT range_id, n, t0, t1, CASE WHEN n >= 3 THEN a END AS a, CASE WHEN n >= 3 THEN b END AS b, sxx, syy, sxy, mx FROM f))
SELECT range_id, n AS n_points, t0 AS t0_s, t1 AS t_end_s, round(a, 8) AS intercept, round(se * sqrt(sxx / n + mx * mx), 8) AS intercept_se, round(b, 8) + 0.0 AS slope_per_s, round(se, 8) AS slope_se, round(b * 60, 8) + 0.0 AS slope_per_min,
       round(se * 60, 8) AS slope_per_min_se, round(b * 60 / a, 8) + 0.0 AS rel_per_min, CASE WHEN n >= 3 THEN round(sxy * sxy / (sxx * syy), 8) END AS r2, CASE WHEN n < 3 THEN printf('only %d points (need 3)', n) ELSE '' END AS note FROM g""",
    "mean_pivot": f"WITH {SQL} SELECT run, " + ", ".join(f'round(avg(r) FILTER (WHERE train = {k}), 6) AS "{k}"' for k in range(1, 13)) + " FROM bubbles GROUP BY run",
    "ks_distance": f"WITH {_CDFS} SELECT a, b, round(max(abs(f - g)), 6) AS d FROM p GROUP BY a, b",
    "wasserstein": f"WITH {_CDFS} SELECT a, b, round(sum(abs(f - g) * (nx - v)), 4) AS w1 FROM p GROUP BY a, b",
    "kruskal": f"""WITH {SQL}, k AS (SELECT run, r, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2 AS rk FROM bubbles),
t AS (SELECT sum(t * t * t - t) AS ties, sum(t) AS n FROM (SELECT count(*)::DOUBLE AS t FROM bubbles GROUP BY r)),
g AS (SELECT run, count(*) AS c, sum(rk) AS s FROM k GROUP BY run HAVING count(*) >= 5),
h AS (SELECT count(*) AS groups, max(n) AS n, (12 * sum(s * s / c) / max(n * (n + 1)) - 3 * (max(n) + 1)) / (1 - max(ties) / max(n * n * n - n)) AS h FROM g, t)
SELECT groups, CAST(n AS BIGINT) AS n, round(h, 4) AS h, round(exp(-h / 2), 4) AS p, round(greatest(0, (h - groups + 1) / (n - groups)), 4) + 0.0 AS epsilon2 FROM h""",
    "mann_whitney": f"""WITH {SQL}, k AS (SELECT run, area > 40000 AS large, rank() OVER (PARTITION BY run ORDER BY r) + (count(*) OVER (PARTITION BY run, r) - 1) / 2 AS rk FROM bubbles)
SELECT run, count(*) FILTER (WHERE large) AS n1, count(*) FILTER (WHERE NOT large) AS n2, round(sum(rk) FILTER (WHERE large) - count(*) FILTER (WHERE large) * (count(*) FILTER (WHERE large) + 1) / 2, 4) AS u FROM k GROUP BY run""",
    # Three runs: once both sides are centred by train, the runs' part is a fit on two columns, which has a closed form.
    "variance_partition": f"""WITH {SQL}, l AS (SELECT 'r_mean' AS metric, run, train, r_mean AS y FROM trains UNION ALL SELECT 'frac_small', run, train, frac_small FROM trains),
tot AS (SELECT metric, var_pop(y) * count(*) AS sst FROM l GROUP BY metric),
own AS (SELECT metric, sum(s) AS s FROM (SELECT metric, var_pop(y) * count(*) AS s FROM l GROUP BY metric, run) GROUP BY metric),
c AS (SELECT metric, y - avg(y) OVER w AS y, (run = 'N')::DOUBLE - avg((run = 'N')::DOUBLE) OVER w AS p, (run = 'R')::DOUBLE - avg((run = 'R')::DOUBLE) OVER w AS q FROM l WINDOW w AS (PARTITION BY metric, train)),
m AS (SELECT metric, sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(p * y) AS py, sum(q * y) AS qy, sum(y * y) AS yy FROM c GROUP BY metric),
r AS (SELECT metric, 1 - own.s / sst AS run_, 1 - yy / sst AS train_, 1 - (yy - (py * py * qq - 2 * py * qy * pq + qy * qy * pp) / (pp * qq - pq * pq)) / sst AS full_ FROM m JOIN tot USING (metric) JOIN own USING (metric))
SELECT metric, round(full_ - train_, 6) AS run_only, round(full_ - run_, 6) AS train_only, round(run_ + train_ - full_, 6) AS shared, round(1 - full_, 6) AS interaction_noise FROM r""",
    "line_fits": f"""WITH {SQL}, s AS (SELECT run, count(*) AS n, regr_slope(r_mean, train) AS b, regr_intercept(r_mean, train) AS a, regr_sxx(r_mean, train) AS sxx, regr_syy(r_mean, train) AS syy, regr_sxy(r_mean, train) AS sxy, avg(train) AS mx FROM trains GROUP BY run)
SELECT run, n AS n_points, round(a, 6) AS intercept, round(sqrt((syy - b * sxy) / (n - 2) / sxx) * sqrt(sxx / n + mx * mx), 6) AS intercept_se, round(b, 6) + 0.0 AS slope, round(sqrt((syy - b * sxy) / (n - 2) / sxx), 6) AS slope_se, round(sxy * sxy / (sxx * syy), 6) AS r2 FROM s WHERE n >= 3""",
    "pooled_trends": f"""WITH {SQL}, t AS (SELECT * FROM trains WHERE (run, train) NOT IN (('A', 5), ('N', 50))),
l AS (SELECT run, train::DOUBLE AS x, 'n' AS metric, ln(greatest(n, 1e-12)) AS y FROM t UNION ALL SELECT run, train, 'r_mean', r_mean FROM t UNION ALL SELECT run, train, 'frac_small', frac_small FROM t),
b AS (SELECT metric, run, x, y, false AS pooled FROM l UNION ALL SELECT metric, NULL, x - avg(x) OVER (PARTITION BY metric, run), y - avg(y) OVER (PARTITION BY metric, run), true FROM l),
k AS (SELECT *, rank() OVER (PARTITION BY metric, pooled, run ORDER BY x) + (count(*) OVER (PARTITION BY metric, pooled, run, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY metric, pooled, run ORDER BY y) + (count(*) OVER (PARTITION BY metric, pooled, run, y) - 1) / 2 AS ry FROM b),
s AS (SELECT metric, run, pooled, count(*) AS n, corr(rx, ry) AS rho, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM k GROUP BY ALL)
SELECT metric, run, pooled, n, round(rho, 6) + 0.0 AS spearman_rho, round(b, 6) + 0.0 AS slope, round(sqrt((syy - b * sxy) / CASE WHEN pooled THEN n - (SELECT count(DISTINCT run) FROM t) - 1 ELSE n - 2 END / sxx), 6) AS slope_se,
       CASE WHEN metric = 'n' THEN round((exp(b) - 1) * 100, 6) + 0.0 END AS pct_per_x FROM s WHERE n >= 3""",
    "power_law": f"""WITH {SQL}, l AS (SELECT run, ln(r) AS x, ln(area) AS y FROM bubbles WHERE r > 0 AND area > 0)
SELECT run, count(*) AS n_points, round(regr_slope(y, x), 6) AS exponent, round(sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 6) AS exponent_se, round(regr_r2(y, x), 6) AS r2 FROM l GROUP BY run""",
    "equal_means": f"""WITH {SQL}, t AS (SELECT run, train, avg(r) AS v, stddev_samp(r) / sqrt(count(r)) AS se FROM bubbles GROUP BY ALL), w AS (SELECT run, v, 1 / (se * se) AS w FROM t WHERE se > 0)
SELECT run, count(*) AS n, round(sum(w * v) / sum(w), 5) AS mean, round(1 / sqrt(sum(w)), 5) AS mean_se, round(greatest(0, sum(w * v * v) - sum(w * v) * sum(w * v) / sum(w)), 5) AS chi2, count(*) - 1 AS dof, round(max(v) / min(v), 5) AS max_over_min FROM w GROUP BY run""",
    "size_classes": f"WITH {SQL} SELECT run, train, " + ", ".join(f"count(*) FILTER (WHERE r >= {a} AND r < {b}) AS c{a}_{b}" for a, b in [(0, 10), (10, 20), (20, 30), (30, 40), (40, 51)]) + " FROM bubbles GROUP BY run, train",
    "run_pivot": f"WITH {SQL} SELECT train, " + ", ".join(f"coalesce(sum(r) FILTER (WHERE run = '{k}'), 0) AS \"{k}\"" for k in "ANR") + " FROM bubbles GROUP BY train",
    "ranked_runs": f"""WITH {SQL} SELECT run, round(avg(r_mean), 6) AS r_mean, round(stddev_samp(r_mean) / sqrt(count(*)), 6) AS r_sem, count(*) AS n_trains, max(n) AS top_n, arg_max(train, (n, -train)) AS top_train FROM trains GROUP BY run""",
    "event_props": "SELECT event_type, count(*) AS n, round(avg(CAST(json_extract(props, '$.k') AS BIGINT)), 6) AS k_mean, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY event_type",
}
