"""Distributions and tests: histograms, empirical CDFs, rank tests, distances between samples, special functions.

Raw values are counted by (group, value) first, so that repeated values, however many, are one row with a count. Ranks and running sums
of a group's different values are two-level ones (``functions.prefix``): no task holds a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainflow.functions.prefix import repeated, running

_MATH = "org.apache.commons.math3.special."


def _reflect(name: str, *args: Column) -> Column:
    kind, method = name.split(".")
    known = F.lit(True)
    for a in args:
        known = known & a.isNotNull() & ~F.isnan(a.cast("double"))
    return F.when(known, F.reflect(F.lit(_MATH + kind), F.lit(method), *(F.coalesce(a.cast("double"), F.lit(0.5)) for a in args)).cast("double"))


def normal_sf(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution."""
    return _reflect("Erf.erfc", z / F.sqrt(F.lit(2.0))) / 2


def chi2_sf(x: Column, k: Column) -> Column:
    """P(X > x) of the chi-squared distribution with k degrees of freedom."""
    return _reflect("Gamma.regularizedGammaQ", k / 2, F.greatest(x, F.lit(0.0)) / 2)


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| > |t|) of Student's distribution; null without degrees of freedom."""
    return F.when(dof > 0, _reflect("Beta.regularizedBeta", dof / (dof + t * t), dof / 2, F.lit(0.5)))


def counted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, v, c: each different value of each group and how often it is there. Nulls go."""
    return df.select(*by, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c"))


def histogram(df: DataFrame, by: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """bin, count, fraction (of the group's rows in range) and density for equal bins; the last one is closed."""
    width = (hi - lo) / bins
    v = F.col(value).cast("double")
    at = F.when((v >= lo) & (v <= hi), F.least(F.floor((v - lo) / width), F.lit(bins - 1)))
    n = df.withColumn("bin", at).filter("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(*by))
    return n.select(*by, F.col("bin").cast("int").alias("bin"), "count", (F.col("count") / total).alias("fraction"), (F.col("count") / total / width).alias("density"))


def weighted_histogram(df: DataFrame, by: list[str], value: str, weight: str, lo: float, hi: float, bins: int) -> DataFrame:
    """bin, weight and density (of the group's weight in range) for equal bins; the last one is closed."""
    width, v = (hi - lo) / bins, F.col(value).cast("double")
    at = F.when((v >= lo) & (v <= hi), F.least(F.floor((v - lo) / width), F.lit(bins - 1))).cast("int")
    n = df.withColumn("bin", at).filter("bin IS NOT NULL").groupBy(*by, "bin").agg(F.sum(F.col(weight).cast("double")).alias("weight"))
    return n.select(*by, "bin", "weight", (F.col("weight") / F.sum("weight").over(Window.partitionBy(*by)) / width).alias("density"))


def histogram_2d(df: DataFrame, by: list[str], x: str, y: str, cell: float, width: float, height: float) -> DataFrame:
    """Counts of points in square cells over [0, width] x [0, height], the last cells whole. Their far edges belong to them; what is beyond is left out."""

    def place(c: str, size: float) -> Column:
        last = max(1, -int(-size // cell))
        v = F.col(c).cast("double")
        return F.when((v >= 0) & (v <= last * cell), F.least(F.floor(v / cell), F.lit(last - 1)))

    cells = df.select(*by, place(x, width).alias("cell_x"), place(y, height).alias("cell_y")).filter("cell_x IS NOT NULL AND cell_y IS NOT NULL")
    return cells.groupBy(*by, "cell_x", "cell_y").agg(F.count(F.lit(1)).alias("count"))


def ecdf(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, k, v, cdf: the k-th smallest value of the group and k over their number, a step for each row, equal values too.
    Ranks are of different values; steps are dealt out from there, however many."""
    placed = running(counted(df, by, value), by, ["v"], {"below": F.col("c")}, totals={"n": "below"})
    steps = repeated(placed, "c", "step").withColumn("k", F.col("below") + F.col("step") + 1)
    return steps.select(*by, "k", "v", (F.col("k") / F.col("n")).alias("cdf"))


def weighted_ecdf(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """by, v, cdf, before: the share of the group's weight at v or below, and below v. Weights of equal values are added up first."""
    rows = df.select(*by, F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w")).filter("v IS NOT NULL AND w IS NOT NULL")
    sums = running(rows.groupBy(*by, "v").agg(F.sum("w").alias("w")), by, ["v"], {"below": F.col("w")}, totals={"total": "below"})
    return sums.select(*by, "v", ((F.col("below") + F.col("w")) / F.col("total")).alias("cdf"), (F.col("below") / F.col("total")).alias("before"))


def percentiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """by, n and for each of ``points`` (name: share) the group's percentile, interpolated between neighbours as ``F.percentile`` does it, but from ranks of
    counted values, so that no buffer holds a group's different values."""
    placed = running(counted(df, by, value), by, ["v"], {"below": F.col("c")}, totals={"n": "below"})
    at = lambda q: (F.col("n") - 1) * F.lit(float(q))
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("c"))
    sides = [F.max(F.when(holds(side(at(q))), F.col("v"))).alias(f"_{name}_{k}") for name, q in points.items() for k, side in enumerate((F.floor, F.ceil))]
    found = placed.groupBy(*by).agg(F.max("n").alias("n"), *sides)
    between = lambda name, q: F.col(f"_{name}_0") + (at(q) - F.floor(at(q))) * (F.col(f"_{name}_1") - F.col(f"_{name}_0"))
    return found.select(*by, "n", *(between(name, q).alias(name) for name, q in points.items()))


def _paired(df: DataFrame, group: str, value: str, pairs: DataFrame) -> DataFrame:
    """a, b, v, the CDFs f and g of both groups at each of their values, and the next value; in one pass over the counts of both sides."""
    c = counted(df, [group], value)
    total = c.groupBy(group).agg(F.sum("c").alias("n"))
    of = lambda side: pairs.select("a", "b").join(total.withColumnRenamed(group, side), side).join(c.withColumnRenamed(group, side), side)
    left = of("a").select("a", "b", "v", (F.col("c") / F.col("n")).alias("df"), F.lit(0.0).alias("dg"))
    right = of("b").select("a", "b", "v", F.lit(0.0).alias("df"), (F.col("c") / F.col("n")).alias("dg"))
    steps = left.unionByName(right).groupBy("a", "b", "v").agg(F.sum("df").alias("df"), F.sum("dg").alias("dg"))
    placed = running(steps, ["a", "b"], ["v"], {"f": F.col("df"), "g": F.col("dg")}, {"next": "v"})
    return placed.select("a", "b", "v", (F.col("f") + F.col("df")).alias("f"), (F.col("g") + F.col("dg")).alias("g"), "next")


def ks_distance(df: DataFrame, group: str, value: str, pairs: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of each pair (a, b) of groups."""
    return _paired(df, group, value, pairs).groupBy("a", "b").agg(F.max(F.abs(F.col("f") - F.col("g"))).alias("d"))


#: Rows of the larger sample up to which the p of the two-sample test is counted; beyond, Kolmogorov's limit serves.
KS_EXACT = 10_000


def ks_p(d: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Two-sided p of the distance d of samples of n1 and n2 values.

    Shuffled, both samples are a walk on a lattice; p is the chance that it strays by d or more. The walk's length goes up step by step, and
    the chances of all places of that length are one array.
    """
    out = np.full(len(d), np.nan)
    for k, (dist, m, n) in enumerate(zip(d, n1.astype(int), n2.astype(int))):
        if not (m and n) or np.isnan(dist):
            continue
        if max(m, n) > KS_EXACT:
            root = np.sqrt(m * n / (m + n)) * dist
            j = np.arange(1, 101)
            out[k] = 1.0 if root < 0.2 else min(1.0, max(0.0, 2 * float(((-1.0) ** (j - 1) * np.exp(-2 * (j * root) ** 2)).sum())))
            continue
        least = round(dist * m * n) - 0.5  # distances are multiples of 1 / (m n)
        inside = np.ones(1)  # chances of i values of the first sample among the first `size` values, by i
        for size in range(1, m + n + 1):
            i = np.arange(min(size, m) + 1)
            came = np.zeros(len(i))
            came[: len(inside)] += inside * np.maximum(size - i[: len(inside)], 0) / size
            came[1:] += inside[: len(i) - 1] * i[1:] / size
            inside = np.where((size - i <= n) & (np.abs(i * n - (size - i) * m) < least), came, 0.0)
        out[k] = min(1.0, max(0.0, 1 - inside[m])) if least > 0 else 1.0
    return out


def consecutive_ks(df: DataFrame, run: str, order: str, value: str, least: int = 5) -> DataFrame:
    """run, train_from, train_to, d, p: the two-sample test between each train and the next of its run, where both have ``least`` values."""
    key = F.struct(F.col(run).alias("run"), F.col(order).alias("train"))
    rows = df.filter(F.col(value).isNotNull()).select(key.alias("key"), F.col(value).alias("value"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    trains = df.select(key.alias("key")).distinct().join(sizes, "key", "left")
    w = Window.partitionBy("key.run").orderBy("key.train")
    pairs = trains.select(F.lag("key").over(w).alias("a"), F.col("key").alias("b"), F.lag("n").over(w).alias("n1"), F.col("n").alias("n2")).filter((F.col("n1") >= least) & (F.col("n2") >= least))
    far = ks_distance(rows, "key", "value", pairs.select("a", "b")).join(pairs, ["a", "b"])
    p = F.pandas_udf(lambda d, n1, n2: pd.Series(ks_p(d.to_numpy(float), n1.to_numpy(), n2.to_numpy())), "double")
    return far.select(F.col("a.run").alias(run), F.col("a.train").alias("train_from"), F.col("b.train").alias("train_to"), "d", p("d", "n1", "n2").alias("p"))


def wasserstein(df: DataFrame, group: str, value: str, pairs: DataFrame) -> DataFrame:
    """Wasserstein-1 distance of each pair of groups."""
    gap = F.abs(F.col("f") - F.col("g")) * (F.col("next") - F.col("v"))
    return _paired(df, group, value, pairs).groupBy("a", "b").agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("w1"))


def ranked(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """by, group, n, rank_sum and ties (the sum of t^3 - t, the same for all groups): what rank tests need. Ranks are mean ranks.

    Values are counted before they are ranked, and ranks are running sums of the counts.
    """
    c = counted(df, [*by, group], value)
    all_ = c.groupBy(*by, "v").agg(F.sum("c").alias("t"))
    ranks = running(all_, by, ["v"], {"below": F.col("t")}).select(*by, "v", "t", (F.col("below") + (F.col("t") + 1) / 2).alias("rank"))
    keys = [*by, "v"]
    joined = c.join(ranks, keys)
    out = joined.groupBy(*by, group).agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("c")).alias("rank_sum"))
    t = F.col("t").cast("double")
    ties = all_.groupBy(*by).agg(F.sum(t * t * t - t).alias("ties"), F.sum("t").alias("total"))
    return out.join(ties, by) if by else out.crossJoin(F.broadcast(ties))  # one row


def kruskal(df: DataFrame, by: list[str], group: str, value: str, least: int = 5) -> DataFrame:
    """Kruskal-Wallis over the groups of at least ``least`` values: groups, n, H with the tie correction, p, epsilon squared."""
    big = df.filter(F.col(value).isNotNull()).groupBy(*by, group).count().filter(F.col("count") >= least).select(*by, group)
    r = ranked(df.join(big, [*by, group], "left_semi"), by, group, value)
    out = r.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"), F.max("total").alias("n"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"), F.max("ties").alias("ties"))
    n = F.col("n").cast("double")
    h = (F.col("s") * 12 / (n * (n + 1)) - (n + 1) * 3) / (1 - F.col("ties") / (n * n * n - n))
    out = out.withColumn("h", h)
    return out.select(*by, "groups", "n", "h", chi2_sf(F.col("h"), (F.col("groups") - 1)).alias("p"), F.greatest(F.lit(0.0), (F.col("h") - F.col("groups") + 1) / (n - F.col("groups"))).alias("epsilon2"))


#: Size of the smaller sample, and pairs of both, up to which the p of the rank sum test is counted where no values are tied.
EXACT_SMALL, EXACT_PAIRS = 8, 20_000


def rank_sum_p(u: float, m: int, n: int) -> float:
    """Two-sided p of U of samples of m and n values without ties: how many of the ways to choose the m ranks give a U as far from the middle.

    In the generating function of U each further value of the larger sample adds the choices that hold it; the coefficients are an array by (chosen so far, U), as shares so that
    they stay in range.
    """
    m, n = min(m, n), max(m, n)
    ways = np.zeros((m + 1, m * n + 1))
    ways[0, 0] = 1.0
    for rank in range(1, m + n + 1):
        # A chosen value of this rank beats the values below it that aren't chosen.
        for chosen in range(min(m, rank), 0, -1):
            beats = rank - chosen
            if beats <= n:
                ways[chosen, beats:] += ways[chosen - 1, : m * n + 1 - beats]
        if ways.max() > 1e250:
            ways *= 1e-250
    counts = ways[m] / ways[m].sum()
    return min(1.0, 2 * float(counts[int(round(max(u, m * n - u))) :].sum()))


def mann_whitney(df: DataFrame, by: list[str], flag: str, value: str) -> DataFrame:
    """U of the rows with ``flag`` against those without, and its two-sided p: counted where one side has ``EXACT_SMALL`` values or fewer, none are tied and both together are small;
    else of the normal form with tie and continuity corrections."""
    r = ranked(df, by, flag, value)
    out = r.groupBy(*by).agg(
        F.max(F.when(F.col(flag), F.col("n"))).alias("n1"), F.max(F.when(~F.col(flag), F.col("n"))).alias("n2"), F.max(F.when(F.col(flag), F.col("rank_sum"))).alias("r1"), F.max("ties").alias("ties"), F.max("total").cast("double").alias("n")
    )
    n1, n2, n = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("n")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, spread)
    few = (F.col("ties") == 0) & (F.least("n1", "n2") <= EXACT_SMALL) & (n1 * n2 <= EXACT_PAIRS)
    counted_ = F.pandas_udf(lambda u, a, b: pd.Series([rank_sum_p(*x) if x[1] > 0 else None for x in zip(u, a.fillna(0).astype(int), b.fillna(0).astype(int))], dtype=float), "double")
    exact = counted_(F.when(few, u), F.when(few, F.col("n1")), F.when(few, F.col("n2")))
    return out.select(*by, "n1", "n2", u.alias("u"), F.when(few, exact).when(z.isNotNull(), F.least(F.lit(1.0), normal_sf(z) * 2)).alias("p"))


def variance_partition(df: DataFrame, run: str, train: str, metrics: list[str]) -> DataFrame:
    """For each metric the shares of its variance that only the run explains, only the train, both alike, and neither: metric, run_only,
    train_only, shared, interaction_noise. Metrics with fewer than two runs or trains are left out.

    Both factors together are fitted by least squares on sums of the (run, train) cells. Cells are few, a metric's are one group.
    """
    values = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("y")) for m in metrics))
    long = df.select(F.col(run).alias("run"), F.col(train).alias("train"), F.explode(values).alias("v")).select("run", "train", "v.metric", "v.y").filter("y IS NOT NULL AND run IS NOT NULL AND train IS NOT NULL")
    cells = long.groupBy("metric", "run", "train").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count(F.lit(1))).alias("within"))
    shares = ("run_only", "train_only", "shared", "interaction_noise")

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n, y = frame["n"].to_numpy(), frame["mean"].to_numpy()
        (at_run, runs), (at_train, trains) = (pd.factorize(frame[c]) for c in ("run", "train"))
        total = float(frame["within"].sum() + (n * (y - (n * y).sum() / n.sum()) ** 2).sum())
        if len(runs) < 2 or len(trains) < 2 or total <= 0:
            return pd.DataFrame(columns=["metric", *shares])
        flags = [np.eye(len(levels))[at] for at, levels in ((at_run, runs), (at_train, trains))]

        def explained(design: np.ndarray) -> float:
            root = np.sqrt(n)[:, None]
            left = y - design @ np.linalg.lstsq(design * root, y * root[:, 0], rcond=None)[0]
            return 1 - float(frame["within"].sum() + (n * left * left).sum()) / total

        of_run, of_train, both = explained(flags[0]), explained(flags[1]), explained(np.hstack(flags))
        return pd.DataFrame([[key[0], both - of_train, both - of_run, of_run + of_train - both, 1 - both]], columns=["metric", *shares])

    return cells.groupBy("metric").applyInPandas(fit, "metric string, " + ", ".join(f"{c} double" for c in shares))
