"""Regressions and fits. Lines are closed forms of sums; curves are fitted group by group in numpy, from summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainflow.functions.storage import settled
from grainflow.operators.comparison import spearman
from grainflow.operators.distribution import chi2_sf, t_two_sided


def line_fit(df: DataFrame, by: list[str], x: str | Column, y: str | Column, least: int = 3) -> DataFrame:
    """Ordinary least squares per group: n_points, intercept, slope, their standard errors, r2, two-sided p of the slope.

    Rows with a null in x or y go; groups with fewer than ``least`` rows too. Partial sums are combined before the shuffle.
    """
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    rows = df.select(*by, x.cast("double").alias("_x"), y.cast("double").alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_points"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.regr_sxx("_y", "_x").alias("sxx"), F.regr_syy("_y", "_x").alias("syy"), F.regr_sxy("_y", "_x").alias("sxy"), F.avg("_x").alias("mx")
    )
    sums = sums.filter(F.col("n_points") >= least)
    dof = F.col("n_points") - 2
    sse = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    sums = sums.withColumn("slope_se", F.when(dof > 0, F.sqrt(F.try_divide(sse / dof, F.col("sxx")))))
    sums = sums.withColumn("intercept_se", F.col("slope_se") * F.sqrt(F.col("sxx") / F.col("n_points") + F.col("mx") * F.col("mx")))
    r2 = F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy"))
    p = F.when((F.col("slope_se") == 0) & (F.col("slope") != 0), 0.0).otherwise(t_two_sided(F.try_divide(F.col("slope"), F.col("slope_se")), dof))
    return sums.select(*by, "n_points", "intercept", "intercept_se", "slope", "slope_se", r2.alias("r2"), p.alias("p"))


def rank_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation by Student's distribution; 0 for a perfect one, null for fewer than three rows."""
    t = rho * F.sqrt((n - 2) / F.nullif(1 - rho * rho, F.lit(0.0)))
    return F.when((n > 2) & (F.abs(rho) >= 1), F.lit(0.0)).otherwise(t_two_sided(t, n - 2))


def trends(df: DataFrame, run: str, x: str, metrics: list[str], log_metrics: list[str] | None = None, exclude: DataFrame | None = None, train: str = "train") -> DataFrame:
    """Spearman's rho and the slope of each metric on x in each run; a row with ``pooled`` pools runs after centring both on their run's means.

    metric, run, pooled, n, spearman_rho, spearman_p, slope, slope_se, slope_p, pct_per_x. ``log_metrics`` are fitted on logarithms (of 1e-12 at least) and have a
    change in percent. exclude: run and train of rows to leave out. Fewer than three rows give none. Pooled degrees of freedom count a mean for each run.

    Slopes are sums: those of a run are added up for the pooled ones. Values are counted before ranks go over them. Values and centred values, a row for each of df, are
    written first: means depend on the order in which Spark adds up, and ranks are joined back by value, so each must be found once only.
    """
    logs = log_metrics or []
    rows = df if exclude is None else df.join(exclude.select(run, train).distinct(), [run, train], "left_anti")
    y = lambda m: F.ln(F.greatest(F.col(m).cast("double"), F.when(F.col(m).isNotNull(), 1e-12))) if m in logs else F.col(m).cast("double")
    values = F.array(*(F.struct(F.lit(m).alias("metric"), y(m).alias("y")) for m in metrics))
    long = rows.select(F.col(run).alias("_run"), F.col(x).cast("double").alias("x"), F.explode(values).alias("v")).select("_run", "x", "v.metric", "v.y").filter("x IS NOT NULL AND y IS NOT NULL")
    long = settled(long, "trends")
    sums = long.groupBy("metric", "_run").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    centred = long.join(sums.select("metric", "_run", "mx", "my"), ["metric", "_run"]).select("metric", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    # Runs and the pool of all are groups of one ranking.
    one, pool = F.concat(F.lit("="), F.col("_run").cast("string")), F.lit("")
    groups = settled(long.select("metric", one.alias("_group"), "x", "y").unionByName(centred.select("metric", pool.alias("_group"), "x", "y")), "trends")
    ranked = spearman(groups, ["metric", "_group"], "x", "y").drop("n")
    own = sums.withColumn("_group", one).join(ranked, ["metric", "_group"]).withColumns({"pooled": F.lit(False), "dof": F.col("n") - 2})
    added = sums.groupBy("metric").agg(*(F.sum(c).alias(c) for c in ("n", "sxx", "syy", "sxy")), F.count(F.lit(1)).alias("runs"))
    pooled = added.withColumn("_group", pool).join(ranked, ["metric", "_group"]).withColumns({"_run": F.lit(None).cast(df.schema[run].dataType), "pooled": F.lit(True), "dof": F.greatest(F.lit(1), F.col("n") - F.col("runs") - 1)})
    columns = ["metric", "_run", "pooled", "n", "rho", "sxx", "syy", "sxy", "dof"]
    out = own.select(*columns).unionByName(pooled.select(*columns)).filter("n >= 3").withColumn("slope", F.try_divide("sxy", "sxx"))
    left = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    out = out.withColumn("slope_se", F.when(F.col("dof") > 0, F.sqrt(F.try_divide(left / F.col("dof"), F.col("sxx")))))
    pct = F.when(F.col("metric").isin(logs), F.expm1("slope") * 100) if logs else F.lit(None).cast("double")
    p = F.when(~F.col("pooled") & (F.col("slope_se") == 0) & (F.col("slope") != 0), 0.0).otherwise(t_two_sided(F.try_divide("slope", "slope_se"), F.col("dof")))
    return out.select("metric", F.col("_run").alias(run), "pooled", "n", F.col("rho").alias("spearman_rho"), rank_p(F.col("rho"), F.col("n")).alias("spearman_p"), "slope", "slope_se", p.alias("slope_p"), pct.alias("pct_per_x"))


def whole_set_trend(df: DataFrame, set_: str, x: str, metric: str, log: bool = True, least: int = 4) -> DataFrame:
    """set, n, rho, p, slope, slope_p and pct_per_step of a metric over each set as a whole. With ``log`` only positive values count, by their logarithms."""
    y = F.when(F.col(metric) > 0, F.ln(F.col(metric).cast("double"))) if log else F.col(metric).cast("double")
    rows = df.select(set_, F.col(x).cast("double").alias("_sx"), y.alias("_sy")).filter("_sx IS NOT NULL AND _sy IS NOT NULL")
    lines = line_fit(rows, [set_], "_sx", "_sy", least).select(set_, "slope", F.col("p").alias("slope_p"))
    out = lines.join(spearman(rows, [set_], "_sx", "_sy"), set_)
    pct = F.expm1("slope") * 100 if log else F.lit(None).cast("double")
    return out.select(set_, "n", "rho", rank_p(F.col("rho"), F.col("n")).alias("p"), "slope", "slope_p", pct.alias("pct_per_step"))


def range_lines(members: DataFrame, by: list[str], t: str, y: str) -> DataFrame:
    """A straight line over each range (rows of ``range_members``), t from the range's first row: n_points, t0_s, t_end_s, intercept, its error, slopes per
    second and minute with errors, rel_per_min (of the intercept), r2, p, note. Fewer than three points give a note only."""
    rows = members.filter(F.col(y).isNotNull())
    ends = rows.groupBy(*by).agg(F.min(t).alias("t0_s"), F.max(t).alias("t_end_s"), F.count(F.lit(1)).alias("n_points"))
    from_start = rows.join(ends.select(*by, "t0_s"), by).withColumn("_t", F.col(t) - F.col("t0_s"))
    fit = line_fit(from_start, by, "_t", y).drop("n_points")
    note = F.when(F.col("n_points") < 3, F.format_string("only %d points (need 3)", "n_points")).otherwise("")
    out = ends.join(fit, by, "left")
    return out.select(
        *by, "n_points", "t0_s", "t_end_s", "intercept", "intercept_se", F.col("slope").alias("slope_per_s"), "slope_se", (F.col("slope") * 60).alias("slope_per_min"), (F.col("slope_se") * 60).alias("slope_per_min_se"),
        F.try_divide(F.col("slope") * 60, F.col("intercept")).alias("rel_per_min"), "r2", "p", note.alias("note"),
    )


def power_law(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Exponent and r2 of y ~ x^b per group, over positive values."""
    logs = lambda c: F.when(F.col(c) > 0, F.ln(F.col(c).cast("double")))
    return line_fit(df, by, logs(x), logs(y)).select(*by, "n_points", F.col("slope").alias("exponent"), F.col("slope_se").alias("exponent_se"), "r2")


def equal_means(df: DataFrame, by: list[str], value: str, se: str) -> DataFrame:
    """Whether estimates with standard errors agree: weighted mean, its error, chi squared, degrees of freedom, p, largest over smallest."""
    w = 1 / (F.col(se) * F.col(se))
    ok = df.filter((F.col(se) > 0) & F.col(value).isNotNull()).select(*by, F.col(value).alias("v"), w.alias("w"))
    sums = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("v")).alias("swv"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("swv2"), (F.max("v") / F.min("v")).alias("max_over_min"))
    chi2 = F.greatest(F.lit(0.0), F.col("swv2") - F.col("swv") * F.col("swv") / F.col("sw"))
    return sums.select(*by, "n", (F.col("swv") / F.col("sw")).alias("mean"), (1 / F.sqrt("sw")).alias("mean_se"), chi2.alias("chi2"), (F.col("n") - 1).alias("dof"), F.when(F.col("n") > 1, chi2_sf(chi2, F.col("n") - 1)).alias("p"), "max_over_min")


#: The bounds of a decay time in seconds; n0 and n_inf aren't negative.
TAU = (1e-3, 1e6)
_DECAY = ("n0", "n0_se", "tau", "tau_se", "n_inf", "n_inf_se", "r2", "rmse")


def decay_curve(t: np.ndarray, y: np.ndarray, offset: bool) -> dict:
    """y = n_inf + (n0 - n_inf) exp(-t / tau), n_inf 0 without ``offset``, by least squares within bounds; nones where there are too few points.

    For a given tau the other two are a linear problem, so tau alone is searched: on a grid of its logarithm, then by golden sections around
    the best place. Standard errors are those of the linearised model at the solution.
    """
    k = 3 if offset else 2
    none = dict.fromkeys(_DECAY)
    if len(t) < k + 1 or np.ptp(t) == 0:
        return none
    t = t - t.min()

    def at(log_tau: float) -> tuple[float, float, float]:
        e = np.exp(-t / np.exp(log_tau))
        n0, n_inf = max(0.0, float(e @ y / (e @ e))), 0.0
        if offset:
            a, b = np.linalg.lstsq(np.column_stack([e, 1 - e]), y, rcond=None)[0]
            if a < 0 or b < 0:  # at a bound: the better of the two edges
                edge = max(0.0, float((1 - e) @ y / max((1 - e) @ (1 - e), 1e-300)))
                a, b = min(((n0, 0.0), (0.0, edge)), key=lambda p: ((y - p[0] * e - p[1] * (1 - e)) ** 2).sum())
            n0, n_inf = float(a), float(b)
        return float(((y - n0 * e - n_inf * (1 - e)) ** 2).sum()), n0, n_inf

    grid = np.linspace(*np.log(TAU), 400)
    best = int(np.argmin([at(g)[0] for g in grid]))
    lo, hi, gold = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)], (5**0.5 - 1) / 2
    for _ in range(80):
        left, right = hi - gold * (hi - lo), lo + gold * (hi - lo)
        lo, hi = (lo, right) if at(left)[0] <= at(right)[0] else (left, hi)
    tau = float(np.exp(min((lo, hi, (lo + hi) / 2), key=lambda g: at(g)[0])))
    cost, n0, n_inf = at(np.log(tau))
    e = np.exp(-t / tau)
    jac = np.column_stack([e, (n0 - n_inf) * e * t / tau**2, 1 - e])[:, :k]
    scale = np.maximum(np.sqrt((jac * jac).sum(axis=0)), 1e-300)
    cov = np.linalg.pinv((jac / scale).T @ (jac / scale)) / np.outer(scale, scale) * cost / (len(t) - k)
    se, sst = np.sqrt(np.maximum(np.diag(cov), 0.0)), float(((y - y.mean()) ** 2).sum())
    found = (n0, float(se[0]), tau, float(se[1]), n_inf, float(se[2]) if offset else None, 1 - cost / sst if sst > 0 else None, float(np.sqrt(cost / len(t))))
    return dict(zip(_DECAY, found))


def decay_fits(df: DataFrame, by: list[str], t: str, y: str, offset: bool = True) -> DataFrame:
    """An exponential decay per group of summary rows (a run, or a range of ``range_members``): n_points, n0, tau, n_inf with errors, r2, rmse, half_life,
    rate_per_min, note. The note says why nothing was fitted, or why not to trust it; then, or with too few points, values may be null."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_t")
        found = decay_curve(frame["_t"].to_numpy(float), frame["_y"].to_numpy(float), offset)
        return pd.DataFrame([[*key, len(frame), float(np.ptp(frame["_t"])), *(found[n] for n in _DECAY)]], columns=[*by, "n_points", "length", *_DECAY])

    rows = df.select(*by, F.col(t).cast("double").alias("_t"), F.col(y).cast("double").alias("_y")).filter("_t IS NOT NULL AND _y IS NOT NULL")
    out = rows.groupBy(*by).applyInPandas(fit, f"{kinds}, n_points long, length double, " + ", ".join(f"{n} double" for n in _DECAY))
    need, tau = 4 if offset else 3, F.col("tau")
    note = (
        F.when(F.col("n_points") < need, F.format_string(f"only %d points (need {need})", "n_points"))
        .when(tau.isNull(), "fit failed")
        .when((tau >= 0.99 * TAU[1]) | (tau > 20 * F.greatest(F.col("length"), F.lit(1.0))), "no decay in this range (τ ≫ the range)")
        .when(F.col("tau_se").isNull() | F.isnan("tau_se") | (F.col("tau_se") > tau * 0.5), "τ poorly determined (s.e. > 50 %)")
        .otherwise("")
    )
    return out.withColumns({"half_life": tau * F.ln(F.lit(2.0)), "rate_per_min": 60 / tau, "note": note}).drop("length")


def lognormal_fits(df: DataFrame, by: list[str], value: str, least: float) -> DataFrame:
    """Left-truncated lognormal by maximum likelihood per group: n, mu, sigma, nll, aic.

    Values at or above ``least`` are counted per group and value first, so a group in a task is its different values.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    rows = df.select(*by, F.col(value).cast("double").alias("v")).filter((F.col("v") >= least) & (F.col("v") > 0)).groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c"))

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        mu, sigma, nll = truncated_lognormal(frame["v"].to_numpy(), frame["c"].to_numpy(float), least)
        return pd.DataFrame([[*key, int(frame["c"].sum()), mu, sigma, nll, None if nll is None else 4 + 2 * nll]], columns=[*by, "n", "mu", "sigma", "nll", "aic"])

    return rows.groupBy(*by).applyInPandas(fit, f"{kinds}, n long, mu double, sigma double, nll double, aic double")


def truncated_lognormal(v: np.ndarray, w: np.ndarray, least: float) -> tuple:
    """Newton's method on (mu, ln sigma) with numerical derivatives, halving steps that don't help."""
    from math import erfc

    n, x = w.sum(), np.log(v)
    mean = (w * x).sum() / n
    spread = np.sqrt((w * (x - mean) ** 2).sum() / n)
    if n < 3 or spread == 0:
        return None, None, None
    s1, s2, edge = (w * x).sum(), (w * x * x).sum(), np.log(least) if least > 0 else -np.inf

    def nll(p):
        mu, sigma = p[0], np.exp(p[1])
        inside = 0.5 * erfc((edge - mu) / sigma / np.sqrt(2)) if np.isfinite(edge) else 1.0
        return np.inf if inside <= 1e-300 else s1 + n * (p[1] + 0.5 * np.log(2 * np.pi) + np.log(inside)) + (s2 - 2 * mu * s1 + n * mu * mu) / (2 * sigma * sigma)

    p, h = np.array([mean, np.log(spread)]), 1e-4
    best = nll(p)
    for _ in range(60):
        e = np.eye(2) * h
        g = np.array([(nll(p + d) - nll(p - d)) / (2 * h) for d in e])
        hess = np.array([[(nll(p + a + b) - nll(p + a - b) - nll(p - a + b) + nll(p - a - b)) / (4 * h * h) for b in e] for a in e])
        step = np.linalg.solve(hess, g) if np.all(np.linalg.eigvalsh(hess) > 0) else g / max(1.0, np.abs(g).max())
        scale = 1.0
        while scale > 1e-6 and not nll(p - scale * step) < best:
            scale /= 2
        if scale <= 1e-6:
            break
        p = p - scale * step
        new = nll(p)
        if best - new < 1e-10 * abs(best):
            best = new
            break
        best = new
    return float(p[0]), float(np.exp(p[1])), float(best)
