"""Queries of versioned and derived tables, content keys and prepared images."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainflow.functions.content import content_key
from grainflow.functions.storage import new_folder
from grainflow.operators import filters
from grainflow.plans.base import SQL, bubbles, read, rounded
from grainflow.sources.versioned import VersionedTable
from grainflow.streaming.derived import Derived


def content_keys(spark, sf_dir):
    """Orders as documents of two shapes and a region."""
    quarter = lambda c, k: F.col(c).cast("double") / 4 - k
    corner = lambda k: F.array(quarter("o_orderkey", k), quarter("o_custkey", k))
    shape = lambda kind, *k: F.struct(F.lit(kind).alias("type"), F.array(*map(corner, k)).alias("data"))
    bubbles_ = F.array(shape("ellipse", 0, 1, 2, 3), shape("polygon", 1000))
    rois = F.array(F.array(quarter("o_orderkey", 0), quarter("o_custkey", 500)))
    return read(spark, sf_dir, "orders").select("o_orderkey", content_key(bubbles_, rois).alias("key"))


def merged_rows(spark, sf_dir):
    """Customers' balances after rich ones were paid twice and debtors left, in two snapshots."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal")
    table = VersionedTable(spark, new_folder(spark, "merged_rows"), ["key"], buckets=8)
    table.merge(c)
    table.merge(c.filter("c_acctbal > 5000").withColumn("c_acctbal", F.col("c_acctbal") * 2), c.filter("c_acctbal < 0").select("key"))
    return rounded(table.read(), 2)


def _derived(spark, sf_dir):
    """All frames, then each fortieth again with bubbles grown by one."""
    name = F.col("frame").cast("string").alias("frame")
    frames = bubbles(spark, sf_dir).groupBy("run", F.col("train").cast("int").alias("train"), name).agg(F.array_sort(F.collect_list(F.col("r").cast("double"))).alias("r"))
    derived = Derived(spark, new_folder(spark, "derived"), buckets=8)
    derived.apply(frames.withColumn("version", F.lit(1)))
    derived.apply(frames.filter("cast(frame AS long) % 40 = 0").withColumn("r", F.transform("r", lambda v: v + 1)).withColumn("version", F.lit(2)))
    return derived


def refreshed_steps(spark, sf_dir):
    return rounded(_derived(spark, sf_dir).steps.read())


def refreshed_runs(spark, sf_dir):
    return rounded(_derived(spark, sf_dir).runs.read(), 4)


def prepared_images(spark, sf_dir):
    """Vectors as images of 8 x 8 pixels, in tiles of 4 x 4."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") + 3).alias("px"), F.array_repeat(F.lit(1.0), 64).alias("ok"))
    how = filters.Preparation(background=1.0, denoise=0.5, equalise=4, ridges=(0.8,), tile=4)
    tiles = filters.prepared(e, ["vec_id"], "px", "ok", 8, 8, how)
    total = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda a, v: a + v)) / 64
    return rounded(tiles.groupBy("vec_id").agg(*(total(c).alias(c) for c in ("flat", "norm", "clahe", "ridge_z"))))


QUERIES = {"content_keys": content_keys, "merged_rows": merged_rows, "refreshed_steps": refreshed_steps, "refreshed_runs": refreshed_runs, "prepared_images": prepared_images}

_TEXT = lambda x: f"((4 * ({x}))::BIGINT // 4 || CASE (4 * ({x}))::BIGINT % 4 WHEN 0 THEN '.0' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END)"
_NUMBER = lambda x: f"(CASE WHEN ({x}) < 0 THEN '-' ELSE '' END || {_TEXT(f'abs({x})')})"
_POINT = lambda k: f"'[' || {_NUMBER(f'o_orderkey / 4 - {k}')} || ', ' || {_NUMBER(f'o_custkey / 4 - {k}')} || ']'"
_POINTS = " || ', ' || ".join(_POINT(k) for k in (0, 1, 2, 3))
_AFTER = f"""{SQL}, after AS (SELECT run, train, CASE WHEN frame % 40 = 0 THEN r + 1 ELSE r END AS r FROM bubbles),
t AS (SELECT run, train, count(*) AS n, avg(r) AS r_mean, sum(r * r * r * 4 / 3 * pi()) AS volume FROM after GROUP BY run, train)"""

ORACLE_SQL = {
    "content_keys": f"""SELECT o_orderkey, substr(sha1('[[["ellipse", [' || {_POINTS} || ']], ["polygon", [' || {_POINT(1000)} || ']]], [[' || {_NUMBER("o_orderkey / 4")} || ', ' || {_NUMBER("o_custkey / 4 - 500")} || ']]]'), 1, 16) AS key FROM orders""",
    "merged_rows": "SELECT c_custkey AS key, round(CASE WHEN c_acctbal > 5000 THEN 2 * c_acctbal ELSE c_acctbal END, 2) AS c_acctbal FROM customer WHERE c_acctbal >= 0",
    "refreshed_steps": f"""WITH {_AFTER}
SELECT run, CAST(train AS INTEGER) AS train, CAST(lag(train) OVER w AS INTEGER) AS train_from, round(n / lag(n) OVER w, 6) AS n_ratio, round(r_mean / lag(r_mean) OVER w, 6) AS r_mean_ratio, round(volume / lag(volume) OVER w, 6) AS volume_ratio
FROM t WINDOW w AS (PARTITION BY run ORDER BY train) QUALIFY lag(train) OVER w IS NOT NULL""",
    "refreshed_runs": f"WITH {_AFTER} SELECT run, count(*) AS n_trains, CAST(sum(n) AS BIGINT) AS n, round(sum(r_mean * n) / sum(n), 4) AS r_mean, round(sum(volume), 4) AS volume FROM t GROUP BY run",
}
