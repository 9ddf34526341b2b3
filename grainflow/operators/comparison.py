"""Comparisons between runs and frames: train means, bases, density bands, rank correlation, distances to fits and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainflow.functions.prefix import repeated, running
from grainflow.operators.distribution import counted, histogram, normal_sf, percentiles
from grainflow.operators.sequence import ratio


def train_means(frames: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and standard error (null for one frame) of each metric over the frames of a group, and n_frames. Nulls count for no metric."""
    aggs = [a for m in metrics for a in (F.avg(m).alias(m), (F.stddev_samp(m) / F.sqrt(F.count(m))).alias(f"{m}_sem"))]
    return frames.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("n_frames"))


def relative_to_base(df: DataFrame, by: list[str], left_out: str | Column, metrics: list[str]) -> DataFrame:
    """Adds ``<metric>_rel``: the metric over its median in the group's rows that aren't left out; null without such rows."""
    flag = F.col(left_out) if isinstance(left_out, str) else left_out
    base = df.filter(~F.coalesce(flag, F.lit(False))).groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(*(F.percentile(m, F.lit(0.5)).alias(f"_base_{m}") for m in metrics))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = df.join(base, same, "left")
    return joined.select(*df.columns, *(ratio(F.col(m), F.col(f"_base_{m}")).alias(f"{m}_rel") for m in metrics))


def filled_histogram(df: DataFrame, by: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """by, bin, density of each group with values in range; empty bins have density 0."""
    found = histogram(df, by, value, lo, hi, bins)
    every = found.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(found.select(*by, "bin", "density"), [*by, "bin"], "left").na.fill(0.0, ["density"])


def density_band(df: DataFrame, run: str, value: str, lo: float, hi: float, bins: int, least: int = 50) -> DataFrame:
    """bin, n_runs, and the 16, 50 and 84 % points of the runs' densities. Runs of fewer than ``least`` rows are left out."""
    large = df.groupBy(run).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(run)
    densities = filled_histogram(df.join(large, run, "left_semi"), [run], value, lo, hi, bins)
    points = [F.percentile("density", F.lit(q / 100)).alias(f"p{q}") for q in (16, 50, 84)]
    return densities.groupBy("bin").agg(F.count(F.lit(1)).alias("n_runs"), *points)


def baseline_difference(df: DataFrame, by: list[str], frame: str, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """by, frame, bin, density and its difference to the density of the group's first frame in that bin."""
    h = filled_histogram(df, [*by, frame], value, lo, hi, bins)
    first = h.groupBy(*by, "bin").agg(F.min_by("density", frame).alias("_first"))
    return h.join(first, [*by, "bin"]).select(*by, frame, "bin", "density", (F.col("density") - F.col("_first")).alias("difference"))


def _ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Average ranks of a group's different values, which are counted first."""
    return running(counted(df, by, value), by, ["v"], {"below": F.col("c")}).select(*by, "v", (F.col("below") + (F.col("c") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, rho of each group's rows with both values; null where one of them doesn't vary. Group keys must not be null."""
    rows = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    pairs = rows.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    sides = F.explode(F.array(*(F.struct(F.lit(c).alias("_axis"), F.col(c).alias("_v")) for c in ("_x", "_y")))).alias("s")
    ranks = _ranks(rows.select(*by, sides).select(*by, "s._axis", "s._v"), [*by, "_axis"], "_v")  # both axes in one go
    rx, ry = (ranks.filter(F.col("_axis") == c).select(*by, F.col("v").alias(c), F.col("rank").alias(f"r{c}")) for c in ("_x", "_y"))
    both = pairs.join(rx, [*by, "_x"]).join(ry, [*by, "_y"])
    # Ranks have the same mean (n + 1) / 2, so weighted sums of centred ranks give the correlation.
    n = both.groupBy(*by).agg(F.sum("w").alias("n"))
    d = both.join(n, by) if by else both.crossJoin(F.broadcast(n))  # one row
    a, b, w = F.col("r_x") - (F.col("n") + 1) / 2, F.col("r_y") - (F.col("n") + 1) / 2, F.col("w")
    out = d.groupBy(*by).agg(F.sum("w").cast("long").alias("n"), F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"))
    return out.select(*by, "n", F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))).alias("rho"))


def fit_distance(df: DataFrame, by: list[str], value: str, least: float, fits: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov distance between a group's values from ``least`` on and a lognormal cut off there. fits: by, mu, sigma."""
    c = running(counted(df.filter(F.col(value) >= least), by, value), by, ["v"], {"below": F.col("c")}, totals={"n": "below"})
    steps = c.select(*by, "v", ((F.col("below") + F.col("c")) / F.col("n")).alias("after"), (F.col("below") / F.col("n")).alias("before"))
    tail = lambda x: normal_sf((F.ln(x) - F.col("mu")) / F.col("sigma"))
    fitted = fits.withColumn("_tail", tail(F.lit(float(least))) if least > 0 else F.lit(1.0))
    cdf = 1 - tail(F.col("v")) / F.col("_tail")
    far = steps.join(fitted, by).select(*by, F.greatest(F.abs(F.col("after") - cdf), F.abs(F.col("before") - cdf)).alias("d"))
    return far.groupBy(*by).agg(F.max("d").alias("d"))


def spacing(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """by, n, and the median distance from a row to the next; null for one row. Rows without ``at`` or a group don't count."""
    known = df.select(*by, at).dropna()
    steps = running(known, by, [at], {}, {"_next": at}).select(*by, (F.col("_next") - F.col(at)).alias("_d"))
    n = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return n.join(percentiles(steps, by, "_d", {"spacing": 0.5}).drop("n"), by, "left")


def mean_distances(df: DataFrame, run: str, train: str, value: str) -> DataFrame:
    """One row: the mean Wasserstein-1 distance over the pairs of frames (run, train) of the same run, of the same train, and of neither: same_run,
    same_train, both_different.

    No pairs are made. The distance of two frames is the integral of |F - G| over the values, and at each value the sum of |F - G| over all pairs follows from the
    frames' sorted F: the k-th of m counts 2 k - m - 1 times. So for all frames, for those of each run and for those of each train the sums are
    ranks; the work is frames times different values, in two-level sorts.
    """
    c = counted(df.select(F.col(run).alias("run"), F.col(train).alias("train"), F.col(value).alias("value")), ["run", "train"], "value")
    values = running(c.select("v").distinct(), [], ["v"], {"at": F.lit(1).cast("long")}, {"next": "v"})
    steps = running(c.join(values.select("v", "at"), "v"), ["run", "train"], ["v"], {"below": F.col("c")}, {"upto": "at"}, {"n": "below"})
    last = F.broadcast(values.agg(F.count(F.lit(1)).alias("all")))  # one row
    spans = steps.crossJoin(last).select("run", "train", "at", ((F.col("below") + F.col("c")) / F.col("n")).alias("f"), (F.coalesce("upto", "all") - F.col("at")).alias("width"))
    grid = repeated(spans, "width", "step").select("run", "train", (F.col("at") + F.col("step")).alias("at"), "f")
    grid = grid.join(values.filter("next IS NOT NULL").select("at", (F.col("next") - F.col("v")).alias("gap")), "at")
    frames = c.select("run", "train").distinct()

    def summed(of: list[str]) -> tuple[DataFrame, DataFrame]:
        """The integral over the pairs that agree in ``of``, and the number of such pairs."""
        m = frames.groupBy(*of).agg(F.count(F.lit(1)).alias("m"))
        ranks = running(grid, ["at", *of], ["f", "run", "train"], {"k": F.lit(1).cast("long")}, totals={"seen": "k"})
        ranks = ranks.join(m, of) if of else ranks.crossJoin(F.broadcast(m))  # one row
        # Frames without a value yet have F = 0: they come first and add nothing.
        place = F.col("m") - F.col("seen") + F.col("k") + 1
        return ranks.agg(F.sum((2 * place - F.col("m") - 1) * F.col("f") * F.col("gap")).alias("d")), m.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs"))

    out = None
    for name, of in (("run", ["run"]), ("train", ["train"]), ("all", [])):
        for part, c in zip(summed(of), ("d", "pairs")):
            part = part.select(F.coalesce(c, F.lit(0.0)).alias(f"{c}_{name}"))  # one row
            out = part if out is None else out.crossJoin(part)
    apart = F.try_divide(F.col("d_all") - F.col("d_run") - F.col("d_train"), F.col("pairs_all") - F.col("pairs_run") - F.col("pairs_train"))
    return out.select(F.try_divide("d_run", "pairs_run").alias("same_run"), F.try_divide("d_train", "pairs_train").alias("same_train"), apart.alias("both_different"))
