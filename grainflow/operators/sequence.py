"""Operators on ordered sequences: steps, outliers, events, alignment, timelines, running values.

All are window functions over a group's own order, or aggregates joined back. Groups are runs, whose rows are summaries (one for each
train), so a window's partition is small; where an operator takes raw rows, its docstring says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826  # fixed value: makes the median absolute deviation a standard deviation for normal data


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or not positive."""
    return F.when(b > 0, a / b)


def steps(df: DataFrame, run: str, order: str, n: str = "n", size: str = "r_mean", median: str = "r_median", volume: str = "volume", small: str = "frac_small", coverage: str | None = None) -> DataFrame:
    """Each row against the one before it in its run: ratios of count, sizes and volume, change of the small share and of the coverage. The first row of a run has none."""
    w = Window.partitionBy(run).orderBy(order)
    before = {c: F.lag(c).over(w) for c in (order, n, size, median, volume, small, *([coverage] if coverage else []))}
    more = [(F.col(coverage) - before[coverage]).alias("coverage_change")] if coverage else []
    out = df.select(
        run,
        before[order].alias("train_from"),
        F.col(order).alias("train_to"),
        (F.col(n) / F.greatest(before[n], F.lit(1))).alias("count_ratio"),
        ratio(F.col(size), before[size]).alias("r_mean_ratio"),
        ratio(F.col(median), before[median]).alias("r_median_ratio"),
        ratio(F.col(volume), before[volume]).alias("volume_ratio"),
        (F.col(small) - before[small]).alias("frac_small_change"),
        *more,
    )
    return out.filter("train_from IS NOT NULL")


def step_kind(count: Column, size: Column, volume: Column, tol_n: float = 0.10, tol_v: float = 0.25) -> Column:
    """What a step was. The first that fits: new bubbles, coalescence, growth, dissolution, little change (of count and size); else mixed."""
    more, fewer = count > 1 + tol_n, count < 1 - tol_n
    same_volume, steady = F.abs(volume - 1) <= tol_v, ~more & ~fewer & (F.abs(size - 1) <= tol_n)
    return (
        F.when(more & (size < 1), "new bubbles")
        .when(fewer & (size > 1) & same_volume, "coalescence")
        .when((volume > 1 + tol_v) & ~more, "growth")
        .when((volume < 1 - tol_v) & ~more, "dissolution")
        .when(steady, "little change")
        .otherwise("mixed")
    )


def robust_z(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds z_<c>: (value - median) / (1.4826 * MAD) over the table or each group; where the MAD is 0 the population's standard deviation, or else 1, divides.

    Medians count a group's different values in one task; rows are summaries (steps, trains), so these are few beside the raw table. Null values stay null."""
    by = by or []
    one = df.withColumn("_one", F.lit(1)) if not by else df
    keys = by or ["_one"]
    medians = one.groupBy(*keys).agg(*(F.percentile(F.col(c), F.lit(0.5)).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    centred = one.join(F.broadcast(medians) if not by else medians, keys)
    mads = centred.groupBy(*keys).agg(*(F.percentile(F.abs(F.col(c) - F.col(f"_m_{c}")), F.lit(0.5)).alias(f"_d_{c}") for c in columns))
    out = centred.join(F.broadcast(mads) if not by else mads, keys)
    scale = lambda c: F.coalesce(F.nullif(F.col(f"_d_{c}") * MAD_SCALE, F.lit(0.0)), F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0))
    return out.select(*(f"`{c}`" for c in df.columns), *(((F.col(c) - F.col(f"_m_{c}")) / scale(c)).alias(f"z_{c}") for c in columns))


def outlier_steps(stepped: DataFrame, run: str, z: float = 3.0) -> DataFrame:
    """Steps with robust z of log count ratio, log median ratio and small share over all runs; flagged, fresh and back-to-normal marks, and ``what`` in words."""
    logged = stepped.withColumns({"lc": F.when(F.col("count_ratio") > 0, F.ln("count_ratio")), "lr": F.when(F.col("r_median_ratio") > 0, F.ln("r_median_ratio")), "ds": F.col("frac_small_change")})
    scored = robust_z(logged, ["lc", "lr", "ds"])
    scored = scored.withColumn("z", F.greatest(F.abs("z_lc"), F.abs("z_lr"), F.abs("z_ds"))).withColumn("flagged", F.coalesce(F.col("z") > z, F.lit(False)))
    fresh = F.col("flagged") & (F.col("lc") > 0) & ((F.col("lr") < 0) | (F.col("ds") > 0))
    w = Window.partitionBy(run).orderBy("train_to")
    marked = scored.withColumn("fresh", F.coalesce(fresh, F.lit(False)))
    marked = marked.withColumn("back", F.col("flagged") & ~F.col("fresh") & F.lag("fresh", 1, False).over(w))
    return marked.withColumn("what", outlier_text(z)).drop("lc", "lr", "ds")


def outlier_text(z: float) -> Column:
    """What stands out in a flagged step; empty for others."""
    points = F.round(F.col("frac_small_change") * 100).cast("int")
    said = [
        F.when(F.abs("z_lc") > z, F.format_string("count ×%.2f", "count_ratio")),
        F.when(F.abs("z_lr") > z, F.format_string("median r ×%.2f", "r_median_ratio")),
        F.when(F.abs("z_ds") > z, F.format_string("small share %+d pts", points)),
        F.when((F.col("count_ratio") > 1) & (F.col("r_median_ratio") < 1) & (F.col("frac_small_change") > 0), "→ fresh small bubbles (new layer?)"),
    ]
    back = F.when(F.col("back"), " (back to normal after the jump before)").otherwise("")
    return F.when(F.col("flagged"), F.concat(F.array_join(F.array_compact(F.array(*said)), ", "), back)).otherwise("")


def layer_set(outliers: DataFrame, run: str, known: DataFrame | None = None) -> DataFrame:
    """run, train: the trains that fresh steps lead to, and the known ones (run, train), each once."""
    found = outliers.filter("fresh").select(run, F.col("train_to").alias("train"))
    return (found if known is None else found.unionByName(known.select(run, "train"))).distinct()


def known_and_found(found: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Each of both sets' keys once, with ``where``: both, only found, only known."""
    both = found.select(*keys, F.lit(1).alias("f"), F.lit(0).alias("k")).unionByName(known.select(*keys, F.lit(0).alias("f"), F.lit(1).alias("k")))
    both = both.groupBy(*keys).agg(F.max("f").alias("f"), F.max("k").alias("k"))
    return both.select(*keys, F.when(F.col("f") + F.col("k") == 2, "both").when(F.col("f") == 1, "only found").otherwise("only known").alias("where"))


def distinct_in_order(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The different values of ``columns`` with the first place of each (``order``)."""
    return df.groupBy(*columns).agg(F.min(order).alias(order))


def event_train(df: DataFrame, run: str, order: str, n: str, least: float = 1.3, override: DataFrame | None = None) -> DataFrame:
    """The train of each run's largest count ratio to the train before, the first of equals, if it is at least ``least``; else null.

    override: run, event. A run that it has gets its event, null too.
    """
    w = Window.partitionBy(run).orderBy(order)
    last = F.lag(n).over(w)
    rated = df.select(run, order, F.when(last.isNotNull(), F.col(n) / F.greatest(last, F.lit(1))).alias("q"))  # greatest skips nulls
    best = rated.groupBy(run).agg(F.max(F.when(F.col("q").isNotNull(), F.struct("q", (-F.col(order)).alias("minus")))).alias("b"))
    found = best.select(run, F.when(F.col("b.q") >= least, -F.col("b.minus")).alias("event"), F.col("b.q").alias("event_ratio"))
    if override is None:
        return found
    given = override.select(F.col(run).alias("_run"), F.col("event").alias("_event"))
    joined = found.join(given, F.col(run) == F.col("_run"), "left")
    return joined.select(run, F.when(F.col("_run").isNotNull(), F.col("_event")).otherwise(F.col("event")).alias("event"), "event_ratio")


def align(df: DataFrame, events: DataFrame, run: str, order: str, metrics: list[str]) -> DataFrame:
    """Adds x (trains since the run's event) and each metric relative to its run's largest value, its standard error (``<metric>_sem``, if there is one) by the same;
    runs without event go. The largest value of a run is an aggregate joined back; 0 or less gives null."""
    joined = df.join(events.filter("event IS NOT NULL").select(run, "event"), run)
    tops = joined.groupBy(run).agg(*(F.max(m).alias(f"_top_{m}") for m in metrics))
    rel = [ratio(F.col(f"{m}{x}"), F.col(f"_top_{m}")).alias(f"{m}_rel{x}") for m in metrics for x in ("", "_sem") if f"{m}{x}" in df.columns]
    return joined.join(tops, run).select(run, order, (F.col(order) - F.col("event")).alias("x"), *rel)


def before_after(df: DataFrame, events: DataFrame, run: str, order: str, metrics: list[str]) -> DataFrame:
    """Each metric in the last train before the event, at the event, and their ratio."""
    joined = df.join(events.filter("event IS NOT NULL").select(run, "event"), run)
    last, now = F.col(order) < F.col("event"), F.col(order) == F.col("event")
    aggs = [a for m in metrics for a in (F.max_by(F.when(last, F.col(m)), F.when(last, F.col(order))).alias(f"{m}_before"), F.max(F.when(now, F.col(m))).alias(f"{m}_after"))]
    out = joined.groupBy(run).agg(F.max("event").alias("event"), *aggs)
    return out.select("*", *(ratio(F.col(f"{m}_after"), F.col(f"{m}_before")).alias(f"{m}_ratio") for m in metrics))


def timeline(df: DataFrame, run: str, order: str, dt: float, gap: float, starts: DataFrame | None = None, set_: list[str] | None = None) -> DataFrame:
    """One timeline of consecutive runs: run_pos, seq, slot, t_run_s, t_s.

    A run starts where ``starts`` (run, start_s) says; else ``gap`` after the end of the run before. A given start begins a new island; starts in an
    island are running sums from its base. Only a row for each run reaches the windows that go over runs: seq is the rank within the run and the
    rows of the runs before.
    """
    set_ = set_ or []
    runs = df.groupBy(*set_, run).agg((F.max(order) + 1).alias("_trains"), F.count(F.lit(1)).alias("_rows"))
    if starts is not None:
        runs = runs.join(starts.withColumnRenamed("start_s", "_given"), run, "left")
    else:
        runs = runs.withColumn("_given", F.lit(None).cast("double"))
    w = Window.partitionBy(*set_).orderBy(run)
    runs = runs.withColumn("run_pos", F.row_number().over(w) - 1)
    runs = runs.withColumn("_given", F.when(F.col("_given").isNotNull(), F.col("_given")).when(F.col("run_pos") == 0, 0.0))
    runs = runs.withColumn("_island", F.count("_given").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("slot0", F.coalesce(F.sum("_trains").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.withColumn("seq0", F.coalesce(F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.withColumn("_length", (F.col("_trains") - 1) * dt + gap)
    isle = Window.partitionBy(*set_, "_island").orderBy("run_pos")
    base = F.first("_given").over(isle.rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("start_s", base + F.coalesce(F.sum("_length").over(isle.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = df.join(runs.select(*set_, run, "run_pos", "slot0", "seq0", "start_s"), [*set_, run])
    out = out.withColumn("t_run_s", F.col(order) * dt).withColumn("t_s", F.col("start_s") + F.col("t_run_s")).withColumn("slot", F.col("slot0") + F.col(order))
    own = F.row_number().over(Window.partitionBy(*set_, run).orderBy(order)) - 1
    return out.withColumn("seq", (F.col("seq0") + own).cast("int")).drop("slot0", "seq0", "start_s")


def with_time(df: DataFrame, times: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """``df`` (run, train) with t: that of ``times``, a table of (run, train, t) or, for all runs alike, (train, t); without ``times`` the train's number. A train that it doesn't
    have has a null, or with ``strict`` fails the job."""
    if times is None:
        return df.withColumn("t", F.col("train").cast("double"))
    on = [c for c in ("run", "train") if c in times.columns]
    joined = df.join(times.select(*on, F.col("t").cast("double").alias("t"), F.lit(True).alias("_known")), on, "left")
    t = F.when(F.col("_known").isNull(), F.raise_error(F.concat_ws(" ", F.lit("no time for"), *on)).cast("double")).otherwise(F.col("t")) if strict else F.col("t")
    return joined.select(*df.columns, t.alias("t"))


def boundary_jumps(line: DataFrame, run: str, metrics: list[str], set_: list[str] | None = None) -> DataFrame:
    """Jumps where the run changes along a timeline, for each metric: before, after, ratio, the typical step within runs, and robust z of the log jump, negative where it is below the steps' median.

    Steps within runs come from windows of one run each; jumps from the first and last row of each run, of which a set's window over runs holds one row each.
    """
    set_ = set_ or []
    keys = [*set_, "metric"]
    keyed = line.withColumns({"_v": F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))})
    long = keyed.select(*set_, run, "seq", "t_s", F.explode("_v").alias("v")).select(*set_, run, "seq", "t_s", "v.metric", "v.value")
    log = lambda a, b: F.when((a > 0) & (b > 0), F.ln(b / a))
    last = F.lag("value").over(Window.partitionBy(*keys, run).orderBy("seq"))
    inside = long.select(*keys, log(last, F.col("value")).alias("log")).filter("log IS NOT NULL")
    half = lambda c: F.percentile(c, F.lit(0.5))
    typical = inside.groupBy(*keys).agg(half(F.abs("log")).alias("_typ"), half("log").alias("_med"), F.stddev_pop("log").alias("_std"), F.count("log").alias("_n"))
    spread = inside.join(typical, keys).groupBy(*keys).agg(half(F.abs(F.col("log") - F.col("_med"))).alias("_mad"))
    ends = long.groupBy(*keys, run).agg(F.min(F.struct("seq", "t_s", "value")).alias("first"), F.max(F.struct("seq", "t_s", "value")).alias("last"))
    w = Window.partitionBy(*keys).orderBy("first.seq")
    pairs = ends.select(*keys, F.lag(run).over(w).alias("from_run"), F.col(run).alias("to_run"), F.lag("last").over(w).alias("a"), F.col("first").alias("b")).filter("from_run IS NOT NULL")
    pairs = pairs.select(*keys, "from_run", "to_run", (F.col("b.t_s") - F.col("a.t_s")).alias("gap_s"), F.col("a.value").alias("before"), F.col("b.value").alias("after"), log(F.col("a.value"), F.col("b.value")).alias("log"))
    out = pairs.join(typical, keys).join(spread, keys, "left")
    scale = F.when((F.col("_n") > 2) & (F.col("_mad") > 0), F.col("_mad") * MAD_SCALE).otherwise(F.nullif(F.col("_std"), F.lit(0.0)))
    return out.select(*keys, "from_run", "to_run", "gap_s", "before", "after", ratio(F.col("after"), F.col("before")).alias("ratio"), F.exp("_typ").alias("typical_step"), ((F.col("log") - F.col("_med")) / scale).alias("z"))


def running_mean(value: str, width: int, by: list[str], order: str) -> Column:
    """Mean over ``width`` rows around each; fewer at the ends. An even width takes one more row before than behind."""
    return F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2))


def relative_to_first(value: str, by: list[str], order: str, first: int = 1) -> Column:
    """value / the mean of the group's first ``first`` rows."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.slice(F.collect_list(F.col(value).cast("double")).over(w), F.lit(1), F.lit(first))
    base = F.first(F.col(value).cast("double")).over(w) if first == 1 else F.aggregate(head, F.lit(0.0), lambda a, x: a + x) / F.size(head)
    return ratio(F.col(value), base)


def centred(value: str, by: list[str]) -> Column:
    return F.col(value) - F.avg(value).over(Window.partitionBy(*by))


def scaled(value: str, by: list[str]) -> Column:
    return ratio(F.col(value), F.avg(value).over(Window.partitionBy(*by)))


def net_change(df: DataFrame, by: list[str], order: str, metrics: list[str]) -> DataFrame:
    """First, last, mean and last/first of each metric in the order of each group."""
    aggs = [a for m in metrics for a in (F.min_by(m, order).alias(f"{m}_first"), F.max_by(m, order).alias(f"{m}_last"), F.avg(m).alias(f"{m}_mean"))]
    out = df.groupBy(*by).agg(F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.count(F.lit(1)).alias("n_rows"), *aggs)
    return out.select("*", *(ratio(F.col(f"{m}_last"), F.col(f"{m}_first")).alias(f"{m}_net") for m in metrics))


def drift(df: DataFrame, by: list[str], order: str, x: str, y: str) -> DataFrame:
    """Path length, net displacement and the consistency of direction (length of the mean unit vector) of a moving point."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.select(*by, order, x, y, (F.col(x) - F.lag(x).over(w)).alias("dx"), (F.col(y) - F.lag(y).over(w)).alias("dy")).withColumn("d", F.hypot("dx", "dy"))
    moved = F.col("d") > 0
    out = d.groupBy(*by).agg(
        F.coalesce(F.sum("d"), F.lit(0.0)).alias("path"),
        F.hypot(F.max_by(x, order) - F.min_by(x, order), F.max_by(y, order) - F.min_by(y, order)).alias("net"),
        F.hypot(F.avg(F.when(moved, F.col("dx") / F.col("d"))), F.avg(F.when(moved, F.col("dy") / F.col("d")))).alias("consistency"),
    )
    return out


def change_points(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("previous", F.lag(value).over(w)).filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks with ties at their mean, as rank tests need them."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(w.partitionBy(*by, value)) - 1) / 2


def range_members(line: DataFrame, ranges: DataFrame, run: str, order: str, set_: str) -> DataFrame:
    """Rows of a timeline between two (run, train) ends in seq order, both inclusive, the ends in either order.

    ranges: range_id, start_run, start_train, end_run, end_train. A range is of the first set that has both ends; one without such a set has no rows.
    """
    ends = line.select(set_, F.col(run).alias("_r"), F.col(order).alias("_o"), F.col("seq").alias("_s"))
    first = ranges.join(ends, (F.col("start_run") == F.col("_r")) & (F.col("start_train") == F.col("_o"))).select("range_id", set_, F.col("_s").alias("a"))
    last = ranges.join(ends, (F.col("end_run") == F.col("_r")) & (F.col("end_train") == F.col("_o"))).select("range_id", set_, F.col("_s").alias("b"))
    both = first.join(last, ["range_id", set_]).groupBy("range_id").agg(F.min(F.struct(F.col(set_).alias("s"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))).alias("e"))
    both = both.select("range_id", F.col("e.s").alias("_set"), F.col("e.lo").alias("_lo"), F.col("e.hi").alias("_hi"))
    return line.join(both, (F.col(set_) == F.col("_set")) & F.col("seq").between(F.col("_lo"), F.col("_hi"))).drop("_set", "_lo", "_hi")


def range_notes(line: DataFrame, ranges: DataFrame, run: str, order: str, set_: str) -> DataFrame:
    """range_id, note: why a range of ``range_members`` has no rows (an end without a frame, ends in different sets); null where it has some."""
    ends = line.groupBy(F.col(run).alias("_r"), F.col(order).alias("_o")).agg(F.collect_set(set_).alias("_s"))
    at = lambda side: ends.select(*(F.col(c).alias(f"{c}_{side}") for c in ends.columns))
    on = lambda side: (F.col(f"{side}_run") == F.col(f"_r_{side}")) & (F.col(f"{side}_train") == F.col(f"_o_{side}"))
    joined = ranges.join(at("start"), on("start"), "left").join(at("end"), on("end"), "left")
    lost = lambda side: F.when(F.col(f"_s_{side}").isNull(), F.concat_ws(" t", f"{side}_run", f"{side}_train"))
    none = F.concat(F.lit("no frame for "), F.concat_ws(", ", lost("start"), lost("end")))
    note = F.when(F.col("_s_start").isNull() | F.col("_s_end").isNull(), none).when(~F.arrays_overlap("_s_start", "_s_end"), "start and end are in different sets")
    return joined.select("range_id", note.alias("note"))
