"""Queries of the sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainflow.operators import sequence as seq
from grainflow.plans.base import SQL, bubbles, read, rounded, trains

DT, GAP = 15.0, 60.0


def step_classes(spark, sf_dir):
    s = seq.steps(trains(spark, sf_dir), "run", "train")
    kind = seq.step_kind(F.col("count_ratio"), F.col("r_mean_ratio"), F.col("volume_ratio"))
    return rounded(s.withColumn("kind", kind))


def outlier_steps(spark, sf_dir):
    s = seq.outlier_steps(seq.steps(trains(spark, sf_dir), "run", "train"), "run", z=2.0)
    return rounded(s.select("run", "train_to", "z_lc", "z_lr", "z_ds", "z", "flagged", "fresh", "back", "what"))


def layer_set(spark, sf_dir):
    found = seq.outlier_steps(seq.steps(trains(spark, sf_dir), "run", "train"), "run", z=2.0)
    return seq.layer_set(found, "run", spark.createDataFrame([("A", 3), ("N", 50), ("A", 3)], "run string, train long"))


def known_layers(spark, sf_dir):
    found = seq.outlier_steps(seq.steps(trains(spark, sf_dir), "run", "train"), "run", z=2.0)
    known = trains(spark, sf_dir).filter("n > 250").select("run", "train")
    return seq.known_and_found(seq.layer_set(found, "run"), known, ["run", "train"])


def runs_in_order(spark, sf_dir):
    return seq.distinct_in_order(_line(spark, sf_dir), ["run"], "seq")


def event_alignment(spark, sf_dir):
    t = trains(spark, sf_dir)
    return rounded(seq.align(t, seq.event_train(t, "run", "train", "n"), "run", "train", ["n", "r_mean"]))


def before_after(spark, sf_dir):
    t = trains(spark, sf_dir)
    return rounded(seq.before_after(t, seq.event_train(t, "run", "train", "n"), "run", "train", ["n", "r_mean"]))


def _line(spark, sf_dir):
    starts = spark.createDataFrame([("N", 5000.0)], "run string, start_s double")
    return seq.timeline(trains(spark, sf_dir), "run", "train", DT, GAP, starts)


def timeline(spark, sf_dir):
    return rounded(_line(spark, sf_dir).select("run", "train", "run_pos", "seq", "slot", "t_run_s", "t_s"))


def boundary_jumps(spark, sf_dir):
    return rounded(seq.boundary_jumps(_line(spark, sf_dir), "run", ["n", "r_mean", "volume"]))


def running_values(spark, sf_dir):
    t = trains(spark, sf_dir)
    return rounded(
        t.select(
            "run", "train", seq.running_mean("r_mean", 5, ["run"], "train").alias("mean5"), seq.running_mean("r_mean", 4, ["run"], "train").alias("mean4"), seq.relative_to_first("r_mean", ["run"], "train").alias("rel1"), seq.relative_to_first("r_mean", ["run"], "train", 3).alias("rel3"),
            seq.centred("r_mean", ["run"]).alias("centred"), seq.scaled("r_mean", ["run"]).alias("scaled"), seq.average_rank("r_mean", ["run"]).alias("rank"),
        )
    )


def net_change(spark, sf_dir):
    return rounded(seq.net_change(trains(spark, sf_dir), ["run"], "train", ["n", "r_mean"]))


def drift(spark, sf_dir):
    return rounded(seq.drift(trains(spark, sf_dir), ["run"], "train", "r_mean", "r_median"))


def change_points(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return seq.change_points(e, ["user_id"], "event_id", "event_type")


def range_members(spark, sf_dir):
    line = _line(spark, sf_dir).withColumn("set", F.lit("all"))
    ranges = spark.createDataFrame([(1, "A", 50, "N", 60), (2, "R", 90, "N", 80), (3, "A", 1, "X", 2)], "range_id int, start_run string, start_train long, end_run string, end_train long")
    out = seq.range_members(line, ranges, "run", "train", "set")
    return rounded(out.groupBy("range_id").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("seq_lo"), F.max("seq").alias("seq_hi"), F.avg("r_mean").alias("r_mean")))


def range_notes(spark, sf_dir):
    line = _line(spark, sf_dir).withColumn("set", F.when(F.col("run") == "R", "late").otherwise("early"))
    ranges = spark.createDataFrame([(1, "A", 40, "N", 60), (2, "R", 30, "N", 70), (3, "A", 1, "X", 2), (4, "Y", 7, "X", 2)], "range_id int, start_run string, start_train long, end_run string, end_train long")
    return seq.range_notes(line, ranges, "run", "train", "set")


def scaled_sizes(spark, sf_dir):
    """Each object's size relative to its frame's mean: the frame windows hold one order's lines."""
    b = bubbles(spark, sf_dir).withColumn("rel", seq.scaled("r", ["frame"]))
    return rounded(b.groupBy("run").agg(F.max("rel").alias("rel_max"), F.avg(F.col("rel") * F.col("rel")).alias("rel2")))


QUERIES = {
    "layer_set": layer_set, "known_layers": known_layers, "runs_in_order": runs_in_order, "range_notes": range_notes, "step_classes": step_classes, "outlier_steps": outlier_steps, "event_alignment": event_alignment, "before_after": before_after, "timeline": timeline, "boundary_jumps": boundary_jumps,
    "running_values": running_values, "net_change": net_change, "drift": drift, "change_points": change_points, "range_members": range_members, "scaled_sizes": scaled_sizes,
}

_STEPS = """steps AS (
  SELECT run, lag(train) OVER w AS train_from, train AS train_to, n / greatest(lag(n) OVER w, 1) AS count_ratio,
         CASE WHEN lag(r_mean) OVER w > 0 THEN r_mean / lag(r_mean) OVER w END AS r_mean_ratio,
         CASE WHEN lag(r_median) OVER w > 0 THEN r_median / lag(r_median) OVER w END AS r_median_ratio,
         CASE WHEN lag(volume) OVER w > 0 THEN volume / lag(volume) OVER w END AS volume_ratio,
         frac_small - lag(frac_small) OVER w AS frac_small_change
  FROM trains WINDOW w AS (PARTITION BY run ORDER BY train) QUALIFY lag(train) OVER w IS NOT NULL
)"""
_EVENTS = """events_ AS (
  SELECT run, CASE WHEN max(q) >= 1.3 THEN arg_max(train, (q, -train)) END AS event
  FROM (SELECT run, train, lag(n) OVER (PARTITION BY run ORDER BY train) AS p, n / greatest(p, 1) AS q FROM trains) WHERE p IS NOT NULL GROUP BY run
)"""
_LINE = f"""runs AS (
  SELECT run, max(train) + 1 AS k, row_number() OVER (ORDER BY run) - 1 AS run_pos FROM trains GROUP BY run
), given AS (
  SELECT *, CASE WHEN run = 'N' THEN 5000.0::DOUBLE WHEN run_pos = 0 THEN 0.0::DOUBLE END AS g, coalesce(sum(k) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS slot0 FROM runs
), isles AS (SELECT *, count(g) OVER (ORDER BY run) AS isle FROM given
), starts AS (
  SELECT *, max(g) OVER (PARTITION BY isle) + coalesce(sum((k - 1) * {DT} + {GAP}) OVER (PARTITION BY isle ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_s FROM isles
), line AS (
  SELECT t.*, s.run_pos, CAST(slot0 + train AS BIGINT) AS slot, CAST(train * {DT} AS DOUBLE) AS t_run_s, CAST(start_s + train * {DT} AS DOUBLE) AS t_s,
         row_number() OVER (ORDER BY s.run_pos, train) - 1 AS seq FROM trains t JOIN starts s USING (run)
)"""

_OUTLIERS = f"""{_STEPS}, logs AS (SELECT run, train_to, count_ratio, r_median_ratio, ln(count_ratio) AS lc, ln(r_median_ratio) AS lr, frac_small_change AS ds FROM steps),
med AS (SELECT median(lc) AS mc, median(lr) AS mr, median(ds) AS md FROM logs),
mad AS (SELECT median(abs(lc - mc)) * 1.4826 AS sc, median(abs(lr - mr)) * 1.4826 AS sr, median(abs(ds - md)) * 1.4826 AS sd, stddev_pop(lc) AS pc, stddev_pop(lr) AS pr, stddev_pop(ds) AS pd FROM logs, med),
z AS (SELECT *, (lc - mc) / coalesce(nullif(sc, 0), nullif(pc, 0), 1) AS z_lc, (lr - mr) / coalesce(nullif(sr, 0), nullif(pr, 0), 1) AS z_lr, (ds - md) / coalesce(nullif(sd, 0), nullif(pd, 0), 1) AS z_ds FROM logs, med, mad),
f AS (SELECT *, greatest(abs(z_lc), abs(z_lr), abs(z_ds)) AS z FROM z),
g AS (SELECT *, z > 2 AS flagged, z > 2 AND lc > 0 AND (lr < 0 OR ds > 0) AS fresh FROM f)"""

ORACLE_SQL = {
    "layer_set": f"WITH {SQL}, {_OUTLIERS} SELECT run, train_to AS train FROM g WHERE fresh UNION SELECT 'A', 3 UNION SELECT 'N', 50",
    "known_layers": f"""WITH {SQL}, {_OUTLIERS}, w AS (SELECT DISTINCT run, train_to AS train FROM g WHERE fresh), k AS (SELECT run, train FROM trains WHERE n > 250)
SELECT coalesce(w.run, k.run) AS run, coalesce(w.train, k.train) AS train, CASE WHEN k.run IS NULL THEN 'only found' WHEN w.run IS NULL THEN 'only known' ELSE 'both' END AS "where" FROM w FULL JOIN k ON w.run = k.run AND w.train = k.train""",
    "runs_in_order": f"WITH {SQL}, {_LINE} SELECT run, min(seq)::INT AS seq FROM line GROUP BY run",
    "range_notes": f"""WITH {SQL}, r(range_id, sr, st, er, et) AS (VALUES (1, 'A', 40, 'N', 60), (2, 'R', 30, 'N', 70), (3, 'A', 1, 'X', 2), (4, 'Y', 7, 'X', 2)), j AS (
  SELECT r.*, a.run AS ar, b.run AS br FROM r LEFT JOIN trains a ON a.run = sr AND a.train = st LEFT JOIN trains b ON b.run = er AND b.train = et)
SELECT range_id, CASE WHEN ar IS NULL OR br IS NULL THEN 'no frame for ' || concat_ws(', ', CASE WHEN ar IS NULL THEN sr || ' t' || st END, CASE WHEN br IS NULL THEN er || ' t' || et END)
       WHEN (ar = 'R') <> (br = 'R') THEN 'start and end are in different sets' END AS note FROM j""",
    "step_classes": f"""WITH {SQL}, {_STEPS}
SELECT run, train_from, train_to, round(count_ratio, 6) AS count_ratio, round(r_mean_ratio, 6) AS r_mean_ratio, round(r_median_ratio, 6) AS r_median_ratio, round(volume_ratio, 6) AS volume_ratio,
       round(frac_small_change, 6) + 0.0 AS frac_small_change,
       CASE WHEN count_ratio > 1.1 AND r_mean_ratio < 1 THEN 'new bubbles' WHEN count_ratio < 0.9 AND r_mean_ratio > 1 AND abs(volume_ratio - 1) <= 0.25 THEN 'coalescence'
            WHEN volume_ratio > 1.25 AND count_ratio <= 1.1 THEN 'growth' WHEN volume_ratio < 0.75 AND count_ratio <= 1.1 THEN 'dissolution'
            WHEN count_ratio <= 1.1 AND count_ratio >= 0.9 AND abs(r_mean_ratio - 1) <= 0.1 THEN 'little change' ELSE 'mixed' END AS kind FROM steps""",
    "outlier_steps": f"""WITH {SQL}, {_OUTLIERS}
SELECT run, train_to, round(z_lc, 6) + 0.0 AS z_lc, round(z_lr, 6) + 0.0 AS z_lr, round(z_ds, 6) + 0.0 AS z_ds, round(z, 6) AS z, flagged, fresh,
       flagged AND NOT fresh AND lag(fresh, 1, false) OVER (PARTITION BY run ORDER BY train_to) AS back,
       CASE WHEN flagged THEN concat_ws(', ', CASE WHEN abs(z_lc) > 2 THEN printf('count ×%.2f', count_ratio) END, CASE WHEN abs(z_lr) > 2 THEN printf('median r ×%.2f', r_median_ratio) END,
            CASE WHEN abs(z_ds) > 2 THEN printf('small share %+d pts', CAST(round(ds * 100) AS INT)) END, CASE WHEN lc > 0 AND lr < 0 AND ds > 0 THEN '→ fresh small bubbles (new layer?)' END)
            || CASE WHEN back THEN ' (back to normal after the jump before)' ELSE '' END ELSE '' END AS what FROM g""",
    "event_alignment": f"""WITH {SQL}, {_EVENTS}
SELECT t.run, train, train - event AS x, round(n / max(n) OVER (PARTITION BY t.run), 6) AS n_rel, round(r_mean / max(r_mean) OVER (PARTITION BY t.run), 6) AS r_mean_rel
FROM trains t JOIN events_ e ON t.run = e.run WHERE event IS NOT NULL""",
    "before_after": f"""WITH {SQL}, {_EVENTS}, j AS (SELECT t.*, event FROM trains t JOIN events_ e ON t.run = e.run WHERE event IS NOT NULL),
a AS (SELECT run, max(event) AS event, arg_max(n, train) FILTER (WHERE train < event) AS n_before, max(n) FILTER (WHERE train = event) AS n_after,
      arg_max(r_mean, train) FILTER (WHERE train < event) AS b, max(r_mean) FILTER (WHERE train = event) AS c FROM j GROUP BY run)
SELECT run, event, n_before, n_after, round(b, 6) AS r_mean_before, round(c, 6) AS r_mean_after, round(n_after / n_before, 6) AS n_ratio, round(c / b, 6) AS r_mean_ratio FROM a""",
    "timeline": f"WITH {SQL}, {_LINE} SELECT run, train, run_pos::INT AS run_pos, seq::INT AS seq, slot, round(t_run_s, 6) AS t_run_s, round(t_s, 6) AS t_s FROM line",
    "boundary_jumps": f"""WITH {SQL}, {_LINE}, long AS (
  SELECT run, seq, t_s, 'n' AS metric, CAST(n AS DOUBLE) AS v FROM line UNION ALL SELECT run, seq, t_s, 'r_mean', r_mean FROM line UNION ALL SELECT run, seq, t_s, 'volume', volume FROM line
), p AS (
  SELECT metric, lag(run) OVER w AS from_run, run AS to_run, lag(v) OVER w AS before, v AS after, t_s - lag(t_s) OVER w AS gap_s, ln(v / lag(v) OVER w) AS l FROM long WINDOW w AS (PARTITION BY metric ORDER BY seq)
), q AS (SELECT * FROM p WHERE from_run IS NOT NULL),
s AS (SELECT metric, median(abs(l)) AS typ, median(l) AS med, stddev_pop(l) AS std, count(*) AS k FROM q WHERE from_run = to_run GROUP BY metric),
d AS (SELECT q.metric, median(abs(l - med)) AS mad FROM q JOIN s USING (metric) WHERE from_run = to_run GROUP BY q.metric)
SELECT q.metric, from_run, to_run, round(gap_s, 6) AS gap_s, round(before, 6) AS before, round(after, 6) AS after, round(after / before, 6) AS ratio, round(exp(typ), 6) AS typical_step,
       round((l - med) / CASE WHEN k > 2 AND mad > 0 THEN mad * 1.4826 ELSE nullif(std, 0) END, 6) + 0.0 AS z
FROM q JOIN s USING (metric) JOIN d USING (metric) WHERE from_run <> to_run""",
    "running_values": f"""WITH {SQL}, f AS (SELECT run, avg(r_mean) AS first3 FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY train) AS k FROM trains) WHERE k <= 3 GROUP BY run)
SELECT run, train, round(avg(r_mean) OVER (PARTITION BY run ORDER BY train ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean5,
       round(avg(r_mean) OVER (PARTITION BY run ORDER BY train ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS mean4,
       round(r_mean / first_value(r_mean) OVER (PARTITION BY run ORDER BY train), 6) AS rel1, round(r_mean / first3, 6) AS rel3, round(r_mean - avg(r_mean) OVER (PARTITION BY run), 6) + 0.0 AS centred,
       round(r_mean / avg(r_mean) OVER (PARTITION BY run), 6) AS scaled, rank() OVER (PARTITION BY run ORDER BY r_mean) + (count(*) OVER (PARTITION BY run, r_mean) - 1) / 2 AS rank
FROM trains JOIN f USING (run)""",
    "net_change": f"""WITH {SQL} SELECT run, min(train) AS first_at, max(train) AS last_at, count(*) AS n_rows, arg_min(n, train) AS n_first, arg_max(n, train) AS n_last, round(avg(n), 6) AS n_mean,
       round(arg_min(r_mean, train), 6) AS r_mean_first, round(arg_max(r_mean, train), 6) AS r_mean_last, round(avg(r_mean), 6) AS r_mean_mean,
       round(arg_max(n, train) / arg_min(n, train), 6) AS n_net, round(arg_max(r_mean, train) / arg_min(r_mean, train), 6) AS r_mean_net FROM trains GROUP BY run""",
    "drift": f"""WITH {SQL}, d AS (SELECT run, train, r_mean, r_median, r_mean - lag(r_mean) OVER w AS dx, r_median - lag(r_median) OVER w AS dy FROM trains WINDOW w AS (PARTITION BY run ORDER BY train)),
e AS (SELECT *, sqrt(dx * dx + dy * dy) AS d FROM d)
SELECT run, round(coalesce(sum(d), 0), 6) AS path, round(sqrt(pow(arg_max(r_mean, train) - arg_min(r_mean, train), 2) + pow(arg_max(r_median, train) - arg_min(r_median, train), 2)), 6) AS net,
       round(sqrt(pow(avg(dx / d) FILTER (WHERE d > 0), 2) + pow(avg(dy / d) FILTER (WHERE d > 0), 2)), 6) AS consistency FROM e GROUP BY run""",
    "change_points": """SELECT user_id, event_id, event_type, previous FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events)
WHERE previous <> event_type""",
    "range_members": f"""WITH {SQL}, {_LINE}, ranges(range_id, sr, st, er, et) AS (VALUES (1, 'A', 50, 'N', 60), (2, 'R', 90, 'N', 80), (3, 'A', 1, 'X', 2)),
e AS (SELECT range_id, least(a.seq, b.seq) AS lo, greatest(a.seq, b.seq) AS hi FROM ranges JOIN line a ON a.run = sr AND a.train = st JOIN line b ON b.run = er AND b.train = et)
SELECT range_id, count(*) AS rows, min(seq)::INT AS seq_lo, max(seq)::INT AS seq_hi, round(avg(r_mean), 6) AS r_mean FROM line JOIN e ON seq BETWEEN lo AND hi GROUP BY range_id""",
    "scaled_sizes": f"""WITH {SQL}, s AS (SELECT run, r / avg(r) OVER (PARTITION BY frame) AS rel FROM bubbles) SELECT run, round(max(rel), 6) AS rel_max, round(avg(rel * rel), 6) AS rel2 FROM s GROUP BY run""",
}
