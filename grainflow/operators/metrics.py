"""Metrics of a population of measured objects, one row per group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainflow.operators.distribution import percentiles
from grainflow.operators.geometry import clark_evans, nearest_neighbours
from grainflow.operators.masks import ellipse_coverage


def population_metrics(df: DataFrame, by: list[str], r: str, area: str | None = None, small: float | None = None) -> DataFrame:
    """Count, moments, robust sizes, Sauter mean and volume proxy of ``r`` per group.

    Nulls in ``r`` are skipped by every statistic but ``n``. ``r_std``, ``r_sem`` and ``log_width`` are null for
    fewer than two values; ``volume`` is 0 and ``r32`` null for a group without values. One shuffle on ``by``.
    """
    x = F.col(r).cast("double")
    aggs: list[Column] = [
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("r_mean"),
        F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x).cast("double"))).alias("r_sem"),
        F.percentile(x, F.lit(0.5)).alias("r_median"),
        F.stddev_samp(x).alias("r_std"),
        F.max(x).alias("r_max"),
        F.percentile(x, F.lit(0.9)).alias("r_p90"),
        F.try_divide(F.sum(x * x * x), F.sum(x * x)).alias("r32"),
        F.try_divide(F.stddev_samp(x), F.avg(x)).alias("polydispersity"),
    ]
    if area is not None:
        aggs.append(F.coalesce(F.sum(F.col(area).cast("double")), F.lit(0.0)).alias("area_total"))
    aggs.append(F.coalesce(F.sum(x * x * x * (4.0 / 3.0 * math.pi)), F.lit(0.0)).alias("volume"))
    if small is not None:
        aggs.append(F.avg((x < small).cast("double")).alias("frac_small"))
    aggs.append(F.stddev_samp(F.when(x > 0, F.ln(x))).alias("log_width"))
    return df.groupBy(*by).agg(*aggs)


def frame_description(bubbles: DataFrame, frames: DataFrame, key: list[str], height: int, width: int, um_per_px: float = 3.2, small_um: float = 10.0, flat: float = 0.8, scale: float = 2.0) -> DataFrame:
    """The row of ``frame_metrics`` with the share of the image that the frame's ellipses cover together (coverage), the mean distance to the nearest centre (nn_um) and the
    Clark-Evans ratio; null for fewer than two or three bubbles. bubbles also has semi_major, semi_minor and angle_deg, in pixels, and bubble_id."""
    sizes = frame_metrics(bubbles, frames, key, um_per_px, small_um, flat)
    covered = ellipse_coverage(bubbles, key, "y", "x", "semi_major", "semi_minor", "angle_deg", height, width, scale)
    spread = clark_evans(nearest_neighbours(bubbles, key, "bubble_id", "x", "y"), bubbles, key, float(width), float(height))
    spread = spread.select(*key, (F.col("nn_mean") * um_per_px).alias("nn_um"), "clark_evans")
    out = sizes.join(covered, key, "left").join(spread, key, "left")
    return out.withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def frame_metrics(bubbles: DataFrame, frames: DataFrame, key: list[str], um_per_px: float = 3.2, small_um: float = 10.0, flat: float = 0.8) -> DataFrame:
    """One row for each frame with everything that describes it: size statistics (see ``population_metrics``), density, aspect, centroid, edge count, packing.

    bubbles: key, r_eq_um, area_um2, x, y, major_axis, minor_axis, edge_truncated. frames: key, image_height_px, image_width_px and any other columns,
    which stay. A frame without bubbles has counts, density, packing and sums of 0, else nulls. One shuffle of the bubbles, partly aggregated before.
    """
    r, a = F.col("r_eq_um").cast("double"), F.col("area_um2").cast("double")
    aspect = F.when(F.col("minor_axis").isNotNull(), F.col("minor_axis") / F.greatest(F.col("major_axis"), F.lit(1e-9)))
    placed = lambda c: F.try_divide(F.sum(F.col(c) * a), F.sum(F.when(F.col(c).isNotNull(), a))) * um_per_px
    sizes = population_metrics(bubbles, key, "r_eq_um", "area_um2", small_um)
    shapes = bubbles.groupBy(*key).agg(
        F.percentile(aspect, F.lit(0.5)).alias("aspect_median"),
        F.avg((aspect < flat).cast("double")).alias("frac_noncircular"),
        placed("x").alias("cx_um"),
        placed("y").alias("cy_um"),
        F.count_if(F.coalesce("edge_truncated", F.lit(False))).alias("n_edge"),
    )
    fov = F.col("image_height_px") * F.col("image_width_px") * (um_per_px**2)
    out = frames.join(sizes.join(shapes, key), key, "left").withColumn("fov_mm2", fov * 1e-6)
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n", "area_total", "volume", "n_edge")}
    out = out.withColumns(zero)
    return out.withColumns({"density_per_mm2": F.try_divide("n", "fov_mm2"), "packing": F.try_divide(F.col("area_total"), F.col("fov_mm2") * 1e6)})


def described(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, column, count, mean, std, min, p25, p50, p75, max: one row for each column of each group. Percentiles come from ranks of counted values, so no task holds a
    group's different values."""
    values = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))
    long = df.select(*by, F.explode(values).alias("v")).select(*by, "v.column", "v.v")
    keys, points = [*by, "column"], {f"p{q}": q / 100 for q in (25, 50, 75)}
    sums = long.groupBy(*keys).agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    placed = percentiles(long, keys, "v", points).select(*(F.col(k).alias(f"_{k}") for k in keys), *points)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return sums.join(placed, same, "left").select(*keys, "count", "mean", "std", "min", *points, "max")


def value_counts(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """How often each value (each combination) is there, nulls too, and its share of its group."""
    by = by or []
    n = df.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("count"))
    total = n.groupBy(*by).agg(F.sum("count").alias("_all"))
    joined = n.join(total, by) if by else n.crossJoin(F.broadcast(total))  # one row
    return joined.select(*by, *columns, "count", (F.col("count") / F.col("_all")).alias("share"))


def share_change_by_kind(steps: DataFrame, kinds: DataFrame, keys: list[str], kind: str, value: str) -> DataFrame:
    """n, mean and standard error of a change (``value`` of steps) by the kind of its step (keys, kind)."""
    v = F.col(value)
    return steps.join(kinds.select(*keys, kind), keys).groupBy(kind).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"))


def top_detections(df: DataFrame, by: list[str], key: str, score: str, least: float, k: int) -> DataFrame:
    """Of each group the ``k`` rows with the largest scores of ``least`` or more; equal scores go by key."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), key))
    return df.filter(F.col(score) >= least).withColumn("_k", place).filter(F.col("_k") <= k).drop("_k")


def analysis_flags(bubbles: DataFrame, drop_edge: bool = False, drop_unreliable: bool = False, margin: float = 0.0) -> DataFrame:
    """Adds in_analysis. bubbles: x, y, edge_truncated, fit_reliable, image_height_px, image_width_px. Rows stay, only the flag is false: for bubbles cut by
    the edge, for unreliable fits, and for centres nearer to the image's border than ``margin`` pixels."""
    keep = F.lit(True)
    if drop_edge:
        keep = keep & ~F.coalesce("edge_truncated", F.lit(False))
    if drop_unreliable:
        keep = keep & F.coalesce("fit_reliable", F.lit(False))
    if margin > 0:
        inside = lambda c, size: F.col(c).between(margin - 0.5, F.col(size) - 0.5 - margin)
        keep = keep & F.coalesce(inside("x", "image_width_px") & inside("y", "image_height_px"), F.lit(False))
    return bubbles.withColumn("in_analysis", keep)


def chosen(df: DataFrame, reviewed_only: bool = True, in_analysis_only: bool = False, exclude: DataFrame | None = None, keys: tuple[str, ...] = ("run", "train")) -> DataFrame:
    """Rows that are reviewed, in the analysis, and of no excluded key, as asked for. Null flags are false."""
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    out = df.filter(yes("reviewed")) if reviewed_only else df
    out = out.filter(yes("in_analysis")) if in_analysis_only else out
    return out if exclude is None else out.join(exclude.select(*keys).distinct(), list(keys), "left_anti")
