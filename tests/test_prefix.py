"""Two-level running sums, ranks and percentiles against plain Python; no task holds a group."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainflow.functions.prefix import repeated, running
from grainflow.operators import comparison, distribution


def plain_running(rows):
    """rows: (group, order, value). (group, order, value, before, next, total)."""
    out, groups = [], {}
    for g, o, v in rows:
        groups.setdefault(g, []).append((o, v))
    for g, held in groups.items():
        held.sort(key=lambda x: (x[0] is not None, x[0]))
        for k, (o, v) in enumerate(held):
            out.append((g, o, v, sum(x for _, x in held[:k]), held[k + 1][0] if k + 1 < len(held) else None, sum(x for _, x in held)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [1, 7])
def test_running(spark, ranges):
    """Groups within a range and over several, of one row and of many, null keys and orders."""
    rng = random.Random(ranges)
    rows = [("big", k * 3 % 401, rng.randint(0, 9)) for k in range(400)] + [("one", 5, 2), (None, 1, 3), (None, 2, 4), ("nulls", None, 7), ("nulls", 4, 1)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(ranges == 1).lower())
    try:
        out = running(df, ["g"], ["o"], {"before": F.col("v")}, {"next": "o"}, {"total": "before"})
        assert sorted((tuple(r) for r in out.select("g", "o", "v", "before", "next", "total").collect()), key=repr) == plain_running(rows)
        alone = running(df.filter("g = 'big'").select("o"), [], ["o"], {"k": F.lit(1)}, totals={"n": "k"})
        assert [(r.k, r.n) for r in alone.orderBy("o").collect()] == [(k, 400) for k in range(400)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert running(df.limit(0), ["g"], ["o"], {"before": F.col("v")}).collect() == []


def test_million_values_in_one_group(spark):
    """A group of 10^6 different values: ranks are right, and its rows stay dealt out, an eighth or so in each range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1_000_000).select(F.lit("all").alias("g"), ((F.col("id") * 7919) % 1_000_003).cast("double").alias("v"), (F.col("id") % 2 == 0).alias("flag"))
        placed = running(distribution.counted(df, ["g"], "v"), ["g"], ["v"], {"below": F.col("c")})
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_range" in plan and "SinglePartition" not in plan
        assert placed.filter("below <> 0").count() == 999_999 and placed.agg(F.max("below")).first()[0] == 999_999
        sizes = [r["count"] for r in placed.withColumn("at", F.spark_partition_id()).groupBy("at").count().collect()]
        assert len(sizes) > 3 and max(sizes) < 400_000
        u = distribution.mann_whitney(df, ["g"], "flag", "v").first()
        assert u.n1 == u.n2 == 500_000 and abs(u.u / 500_000**2 - 0.5) < 0.01
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated(spark):
    df = spark.createDataFrame([("a", 5), ("b", 0), ("c", 1)], "g string, c long")
    assert sorted((r.g, r.k) for r in repeated(df, "c", "k", most=2).collect()) == [("a", k) for k in range(5)] + [("c", 0)]


def test_percentiles_are_sparks_own(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(k % 3, rng.choice([None, float(rng.randint(0, 30)), rng.random() * 30])) for k in range(500)] + [(9, 4.0)], "g int, v double")
    points = {"low": 0.16, "mid": 0.5, "high": 0.84, "end": 1.0}
    ours = {r.g: (r.n, *(r[p] for p in points)) for r in distribution.percentiles(df, ["g"], "v", points).collect()}
    theirs = df.groupBy("g").agg(F.count("v").alias("n"), *(F.percentile("v", F.lit(q)).alias(p) for p, q in points.items())).collect()
    assert {g: pytest.approx(v) for g, v in ours.items()} == {r.g: (r.n, *(r[p] for p in points)) for r in theirs}


def test_mean_distances_are_those_of_pairs(spark):
    """Repeated values, frames of one value, trains and runs with one frame."""
    rng = np.random.default_rng(3)
    frames = {(r, t): rng.integers(0, 12, rng.integers(1, 9)).astype(float) for r, t in [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 3), ("c", 9)]}
    df = spark.createDataFrame([(r, t, float(v)) for (r, t), vs in frames.items() for v in vs], "run string, train int, v double")
    grid = np.arange(0, 12)
    cdf = {k: (v[:, None] <= grid).mean(axis=0) for k, v in frames.items()}
    far = {(a, b): np.abs(cdf[a] - cdf[b])[:-1].sum() for a, b in combinations(cdf, 2)}
    mean = lambda want: np.mean([d for (a, b), d in far.items() if want(a, b)])
    row = comparison.mean_distances(df, "run", "train", "v").first()
    assert row.same_run == pytest.approx(mean(lambda a, b: a[0] == b[0])) and row.same_train == pytest.approx(mean(lambda a, b: a[1] == b[1]))
    assert row.both_different == pytest.approx(mean(lambda a, b: a[0] != b[0] and a[1] != b[1]))
    alone = comparison.mean_distances(df.filter("run = 'c'"), "run", "train", "v").first()
    assert (alone.same_run, alone.same_train, alone.both_different) == (None, None, None)
