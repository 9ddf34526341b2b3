"""Populations of frames: sparse frames, weights, scaled curves and their collapse, coverage, snapshots, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainflow.operators.distribution import histogram


def drop_sparse(frames: DataFrame, bubbles: DataFrame, key: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """(frames with ``least`` objects or more, those with fewer), both with n; a frame without objects has 0."""
    counts = bubbles.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    all_ = frames.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return all_.filter(F.col("n") >= least), all_.filter(F.col("n") < least)


def weights(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds weight: each group of ``by`` counts alike, and all weights add up to the number of rows. Counts are joined back, so a large group isn't gathered."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_groups"))
    scale = counts.crossJoin(F.broadcast(total)).select(*by, (F.col("_all") / F.col("_groups") / F.col("_n")).alias("weight"))  # total is one row
    return df.join(scale, by)


def scaled_curves(df: DataFrame, frame: list[str], r: str, lo: float, hi: float, bins: int, least: int = 10) -> DataFrame:
    """Density of r / mean r in equal bins, for each frame of ``least`` objects or more. Bins without objects have no row."""
    means = df.filter(F.col(r).isNotNull()).groupBy(*frame).agg(F.avg(r).alias("_m"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    rel = df.join(means, frame).select(*frame, (F.col(r) / F.col("_m")).alias("x"))
    return histogram(rel, frame, "x", lo, hi, bins).select(*frame, "bin", "density")


def collapse(curves: DataFrame, frame: list[str], first: int, last: int) -> DataFrame:
    """How well scaled curves fall together: per bin the frames' standard deviation over their mean (a missing bin is 0), averaged over the bins ``first`` to ``last``."""
    frames = curves.select(*frame).distinct().agg(F.count(F.lit(1)).alias("k"))
    sums = curves.filter(F.col("bin").between(first, last)).groupBy("bin").agg(F.sum("density").alias("s"), F.sum(F.col("density") * F.col("density")).alias("s2")).crossJoin(F.broadcast(frames))  # one row
    mean = F.col("s") / F.col("k")
    cv = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("k") - mean * mean)) / mean
    return sums.agg(F.max("k").alias("frames"), F.count(F.lit(1)).alias("bins"), F.avg(cv).alias("score"))


def coverage(df: DataFrame, frame: list[str], row: str, col: str, r: str, height: int, width: int) -> DataFrame:
    """Share of a frame's pixels that its discs cover, overlaps counted once. Discs are spread to pixel rows, intervals of a row are united in order."""
    y = F.explode(F.sequence(F.greatest(F.lit(0), F.ceil(F.col(row) - F.col(r))), F.least(F.lit(height - 1), F.floor(F.col(row) + F.col(r)))))
    inside = (F.col(r) > 0) & (F.col(row) + F.col(r) >= 0) & (F.col(row) - F.col(r) <= height - 1) & (F.ceil(F.col(row) - F.col(r)) <= F.floor(F.col(row) + F.col(r)))
    spans = df.filter(inside).select(*frame, row, col, r, y.alias("y"))
    half = F.sqrt(F.greatest(F.lit(0.0), F.col(r) * F.col(r) - F.pow(F.col("y") - F.col(row), 2)))
    spans = spans.select(*frame, "y", F.greatest(F.lit(0), F.ceil(F.col(col) - half)).alias("a"), F.least(F.lit(width - 1), F.floor(F.col(col) + half)).alias("b")).filter("a <= b")
    w = Window.partitionBy(*frame, "y").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a") - 1, F.coalesce(F.max("b").over(w), F.lit(-1))))
    covered = spans.withColumn("new", new).groupBy(*frame).agg(F.sum("new").alias("pixels"))
    return df.select(*frame).distinct().join(covered, frame, "left").select(*frame, (F.coalesce("pixels", F.lit(0)) / (height * width)).alias("coverage"))


def snapshots(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """n evenly spaced rows of each group, first and last included; positions are rounded half to even."""
    w = Window.partitionBy(*by)
    placed = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_k", F.count(F.lit(1)).over(w))
    step = (F.col("_k") - 1) / max(1, n - 1)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.bround(j * step).cast("int"))
    return placed.filter(F.array_contains(wanted, F.col("_i"))).drop("_i", "_k")


def every_kth(df: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).filter(F.col("_i") % k == 0).drop("_i")


def interpolated(points: DataFrame, by: list[str], x: str, y: str, asked: DataFrame, at: str) -> DataFrame:
    """y at each asked place, on the line between the points beside it; beyond the ends the end's y. asked: by, at."""
    w = Window.partitionBy(*by).orderBy(x)
    seg = points.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), F.lead(x).over(w).alias("_x2"), F.lead(y).over(w).alias("_y2"), F.row_number().over(w).alias("_n"))
    a = asked.select(*by, at)
    hit = (F.col(at) >= F.col("_x")) & (F.col("_x2").isNull() | (F.col(at) < F.col("_x2"))) | ((F.col("_n") == 1) & (F.col(at) < F.col("_x")))
    inner = F.col("_x2").isNotNull() & (F.col(at) >= F.col("_x"))
    value = F.when(inner, F.col("_y") + (F.col("_y2") - F.col("_y")) * (F.col(at) - F.col("_x")) / (F.col("_x2") - F.col("_x"))).otherwise(F.col("_y"))
    return a.join(seg, by).filter(hit).select(*by, at, value.alias(y))


#: Rows up to which the signed-rank test counts sign patterns; 2 ** 50 is exact as a double.
EXACT = 50


def signed_rank_tail(n: Column, w: Column) -> Column:
    """The share of the 2 ** n sign patterns of the ranks 1 to n whose positive ranks sum to at most w."""
    added = lambda ways, i: F.zip_with(F.concat(ways, F.array_repeat(F.lit(0.0), i)), F.concat(F.array_repeat(F.lit(0.0), i), ways), lambda a, b: a + b)
    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)), added)
    return F.aggregate(F.slice(ways, F.lit(1), F.floor(w).cast("int") + 1), F.lit(0.0), lambda a, v: a + v) / F.pow(F.lit(2.0), n)


def wilcoxon(df: DataFrame, by: list[str], value: Column, least: int = 6) -> DataFrame:
    """Signed ranks of ``value`` against 0: n (zeros left out), w_plus, w_minus, two-sided p. It is exact for up to ``EXACT`` rows without ties, else
    that of the normal form with tie correction."""
    from grainflow.operators.distribution import normal_sf

    rows = df.select(*by, value.cast("double").alias("v")).filter("v IS NOT NULL AND v <> 0")
    sizes = rows.groupBy(*by, F.abs("v").alias("m")).agg(F.count_if(F.col("v") > 0).alias("up"), F.count(F.lit(1)).alias("t"))
    w = Window.partitionBy(*by).orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("rank", F.coalesce(F.sum("t").over(w), F.lit(0)) + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    out = ranked.groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("w_minus"), F.sum(t * t * t - t).alias("ties")).filter(F.col("n") >= least)
    n = F.col("n").cast("double")
    z = (F.greatest("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    exact = (F.col("n") <= EXACT) & (F.col("ties") == 0)
    p = F.when(exact, signed_rank_tail(F.col("n"), F.least("w_plus", "w_minus"))).otherwise(normal_sf(z)) * 2
    return out.select(*by, "n", "w_plus", "w_minus", F.least(F.lit(1.0), p).alias("p"))
