"""Size models: left-truncated likelihood fits of several families, an AIC table, and a bootstrap over whole runs.

A fit sees a group's different values with their weights, added up by Spark before.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _log_gamma_pdf(x, p):
    k, s = np.exp(p)
    return (k - 1) * np.log(x) - x / s - k * np.log(s) - math.lgamma(k)


def _log_weibull_pdf(x, p):
    k, s = np.exp(p)
    return np.log(k) - k * np.log(s) + (k - 1) * np.log(x) - (x / s) ** k


def _log_lognormal_pdf(x, p):
    mu, sigma = p[0], np.exp(p[1])
    return -np.log(x * sigma * math.sqrt(2 * math.pi)) - (np.log(x) - mu) ** 2 / (2 * sigma * sigma)


def _log_generalised_gamma_pdf(x, p):
    a, c, s = np.exp(p)
    return np.log(c) - np.log(s) + (c * a - 1) * np.log(x / s) - (x / s) ** c - math.lgamma(a)


def _log_mixture_pdf(x, p):
    """Two lognormals; p[0] is the logit of the first one's share."""
    return np.logaddexp(-np.logaddexp(0, -p[0]) + _log_lognormal_pdf(x, p[1:3]), -np.logaddexp(0, p[0]) + _log_lognormal_pdf(x, p[3:5]))


def _mean_sd(x, w):
    m = (w * x).sum() / w.sum()
    return m, math.sqrt(max(1e-12, (w * (x - m) ** 2).sum() / w.sum()))


def _start_gamma(x, w):
    m, s = _mean_sd(x, w)
    return np.log([m * m / (s * s), s * s / m])


def _start_weibull(x, w):
    m, s = _mean_sd(x, w)
    return np.log([max(0.2, (s / m) ** -1.086), m])


def _start_lognormal(x, w):
    m, s = _mean_sd(np.log(x), w)
    return np.array([m, math.log(max(s, 1e-6))])


def _start_generalised_gamma(x, w):
    return np.array([0.0, *_start_weibull(x, w)])


def _start_mixture(x, w):
    m, s = _mean_sd(np.log(x), w)
    spread = math.log(max(0.6 * s, 1e-6))
    return np.array([0.0, m - 0.8 * s, spread, m + 0.8 * s, spread])


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: the series of the lower part for small x, else a continued fraction."""
    if x <= 0:
        return 1.0
    if not math.isfinite(x) or a <= 0:
        return 0.0
    front = math.exp(min(700.0, a * math.log(x) - x - math.lgamma(a)))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 2000):
            term *= x / (a + n)
            total += term
            if term < 1e-16 * total:
                break
        return min(1.0, max(0.0, 1 - front * total))
    # x + 1 - a - 1 (1 - a) / (x + 3 - a - 2 (2 - a) / (x + 5 - a - ...)), from the front, numerators and denominators as two ratios
    level, tiny = x + 1 - a, 1e-300
    above, below = 1 / tiny, 1 / (level or tiny)
    value = below
    for n in range(1, 2000):
        turn = -n * (n - a)
        level += 2
        below, above = 1 / ((level + turn * below) or tiny), (level + turn / above) or tiny
        value *= above * below
        if abs(above * below - 1) < 1e-15:
            break
    return min(1.0, max(0.0, front * value))


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _lognormal_tail(x, p):
    return _normal_tail((math.log(x) - p[0]) / math.exp(p[1])) if x > 0 else 1.0


def _gamma_law_tail(x, p):
    return gamma_tail(math.exp(p[0]), x / math.exp(p[1]))


def _weibull_tail(x, p):
    return math.exp(-((x / math.exp(p[1])) ** math.exp(p[0])))


def _generalised_gamma_tail(x, p):
    return gamma_tail(math.exp(p[0]), (x / math.exp(p[2])) ** math.exp(p[1]))


def _mixture_tail(x, p):
    share = 1 / (1 + math.exp(-p[0]))
    return share * _lognormal_tail(x, p[1:3]) + (1 - share) * _lognormal_tail(x, p[3:5])


#: name -> (log density, start, tail beyond x). Add a family by adding an entry.
MODELS: dict[str, tuple[Callable, Callable, Callable]] = {
    "lognormal": (_log_lognormal_pdf, _start_lognormal, _lognormal_tail), "gamma": (_log_gamma_pdf, _start_gamma, _gamma_law_tail), "weibull": (_log_weibull_pdf, _start_weibull, _weibull_tail),
    "generalised_gamma": (_log_generalised_gamma_pdf, _start_generalised_gamma, _generalised_gamma_tail), "mixture": (_log_mixture_pdf, _start_mixture, _mixture_tail),
}


def tail(name: str, x: float, p: np.ndarray) -> float:
    """P(R > x); 0 where the parameters are beyond what numbers hold."""
    try:
        return MODELS[name][2](x, p) if x > 0 else 1.0
    except (OverflowError, ValueError):
        return 0.0


def weighted_ks(name: str, p: np.ndarray, x: np.ndarray, w: np.ndarray, least: float) -> float:
    """The largest distance between the weighted empirical distribution (values ascending) and the family cut off at ``least``."""
    inside = tail(name, least, p)
    if inside <= 0:
        return math.nan
    fitted = np.array([1 - tail(name, v, p) / inside for v in x])
    after = np.cumsum(w) / w.sum()
    return float(np.maximum(np.abs(after - fitted), np.abs(after - w / w.sum() - fitted)).max())


def fit_model(name: str, x: np.ndarray, w: np.ndarray, least: float) -> tuple[np.ndarray, float] | None:
    """Parameters and negative log likelihood, by Nelder-Mead; the mass above ``least`` is a closed form. None for fewer than 3 different values."""
    if len(x) < 3:
        return None
    log_pdf, start, _ = MODELS[name]
    n = w.sum()

    def nll(p):
        with np.errstate(all="ignore"):
            mass = tail(name, least, p)
            value = -(w * log_pdf(x, p)).sum() + n * math.log(mass) if mass > 1e-12 and np.isfinite(mass) else math.inf
        return value if np.isfinite(value) else 1e300

    best = np.array(start(x, w), float)
    simplex = [best, *(best + step for step in np.eye(len(best)) * 0.3)]
    values = [nll(p) for p in simplex]
    for _ in range(200 * len(best)):
        order = np.argsort(values, kind="stable")
        simplex, values = [simplex[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] <= 1e-10 * abs(values[0]) + 1e-10:
            break
        centre = np.mean(simplex[:-1], axis=0)
        trial = 2 * centre - simplex[-1]
        v = nll(trial)
        if v < values[0]:
            far = 3 * centre - 2 * simplex[-1]
            vf = nll(far)
            simplex[-1], values[-1] = (far, vf) if vf < v else (trial, v)
        elif v < values[-2]:
            simplex[-1], values[-1] = trial, v
        else:
            near = (centre + simplex[-1]) / 2
            vn = nll(near)
            if vn < values[-1]:
                simplex[-1], values[-1] = near, vn
            else:
                simplex = [simplex[0], *((p + simplex[0]) / 2 for p in simplex[1:])]
                values = [values[0], *(nll(p) for p in simplex[1:])]
    k = int(np.argmin(values))
    return simplex[k], values[k]


def moments(name: str, p: np.ndarray, x: np.ndarray) -> tuple[float, float, float]:
    """Mode, mean and skewness of a family that isn't cut off, by quadrature on a grid around the values ``x``."""
    grid = np.exp(np.linspace(math.log(x.min() * 1e-3), math.log(x.max() * 20), 8001))
    with np.errstate(all="ignore"):
        f = np.nan_to_num(np.exp(MODELS[name][0](grid, p)))
    integral = lambda y: float(((y[1:] + y[:-1]) / 2 * np.diff(grid)).sum())
    mass = max(integral(f), 1e-300)
    mean = integral(grid * f) / mass
    second, third = (integral((grid - mean) ** k * f) / mass for k in (2, 3))
    return float(grid[int(np.argmax(f))]), mean, third / max(second, 1e-300) ** 1.5


def model_table(df: DataFrame, by: list[str], value: str, least: float, weight: str | None = None) -> DataFrame:
    """by, model, params, nll, mode, mean, skewness, ks (weighted distance to the fit), aic, daic (to the group's best) and rank, for each family. Each (group, family) is a task's work of its own."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*by, F.col(value).cast("double").alias("v"), w.alias("w")).filter((F.col("v") >= least) & (F.col("v") > 0)).groupBy(*by, "v").agg(F.sum("w").alias("w"))
    rows = rows.withColumn("model", F.explode(F.array(*map(F.lit, MODELS))))

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("v")
        x = frame["v"].to_numpy(float)
        found = fit_model(key[-1], x, frame["w"].to_numpy(float), least)
        row = [list(found[0]), found[1], *moments(key[-1], found[0], x), weighted_ks(key[-1], found[0], x, frame["w"].to_numpy(float), least)] if found else [None] * 6
        return pd.DataFrame([[*key, *row]], columns=[*by, "model", "params", "nll", "mode", "mean", "skewness", "ks"])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    fits = rows.groupBy(*by, "model").applyInPandas(fit, f"{kinds}model string, params array<double>, nll double, mode double, mean double, skewness double, ks double")
    own = Window.partitionBy(*by)
    fits = fits.withColumn("aic", 2 * F.col("nll") + 2 * F.size("params"))
    return fits.select("*", (F.col("aic") - F.min("aic").over(own)).alias("daic"), F.row_number().over(own.orderBy(F.col("aic").asc_nulls_last(), "model")).alias("rank"))


def bootstrap_runs(df: DataFrame, run: str, value: str, least: float, resamples: int = 100, seed: int = 0, model: str = "lognormal", weight: str | None = None, equal: list[str] | None = None) -> DataFrame:
    """resample, params, mode, mean, skewness: refits to whole runs drawn with replacement. Draws are made from the few run names; values are counted (or
    their weights added up) per run before.

    With ``equal`` the groups of these columns (frames of a run, or the runs themselves) weigh alike within each resample, their weights scaled to its number of rows: one that is
    drawn twice counts once.
    """
    if weight and equal is not None:
        raise ValueError("weight or equal, not both")
    v = F.col(value).cast("double")
    known = df.select(run, *(c for c in equal or [] if c != run), v.alias("v"), *([weight] if weight else [])).filter((F.col("v") >= least) & (F.col("v") > 0))
    of = [run, *(c for c in equal or [] if c != run)]
    counts = known.groupBy(*of, "v").agg((F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1)).cast("double")).alias("c"))
    runs = [r[0] for r in counts.select(run).distinct().orderBy(run).collect()]
    rng = np.random.default_rng(seed)
    draws = [(k, runs[i], int(n)) for k in range(resamples) for i, n in enumerate(np.bincount(rng.integers(0, len(runs), len(runs)), minlength=len(runs))) if n] if runs else []
    plan = df.sparkSession.createDataFrame(draws, f"resample int, `{run}` {df.schema[run].dataType.simpleString()}, times int")
    if equal is None:
        rows = counts.join(plan, run).groupBy("resample", "v").agg(F.sum(F.col("c") * F.col("times")).alias("w"))
    else:
        sizes = counts.groupBy(*of).agg(F.sum("c").alias("size"))
        shares = counts.join(sizes, of).groupBy(run, "v").agg(F.sum(F.col("c") / F.col("size")).alias("c"))
        per_run = sizes.groupBy(run).agg(F.sum("size").alias("rows"), F.count(F.lit(1)).alias("groups"))
        scale = plan.join(per_run, run).groupBy("resample").agg((F.sum(F.col("rows") * F.col("times")) / F.sum("groups")).alias("scale"))
        rows = shares.join(plan, run).groupBy("resample", "v").agg(F.sum("c").alias("w")).join(scale, "resample").select("resample", "v", (F.col("w") * F.col("scale")).alias("w"))

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("v")
        x = frame["v"].to_numpy(float)
        found = fit_model(model, x, frame["w"].to_numpy(float), least)
        mode, mean, skewness = moments(model, found[0], x) if found else (None, None, None)
        return pd.DataFrame({"resample": [key[0]], "params": [list(found[0]) if found else None], "mode": [mode], "mean": [mean], "skewness": [skewness]})

    return rows.groupBy("resample").applyInPandas(fit, "resample int, params array<double>, mode double, mean double, skewness double")
