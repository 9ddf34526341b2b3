"""Analyses as a whole: options in one place, tables by name. Nothing runs until a table is used."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainflow.operators import distribution as dist
from grainflow.operators import metrics, population
from grainflow.operators import regression as reg
from grainflow.operators import sequence as seq

TREND_METRICS = ("n", "r_mean", "r_median", "r32", "frac_small", "log_width", "polydispersity")


@dataclass(frozen=True)
class RunComparison:
    """Runs frame by frame: metrics, steps, outliers, layers, trends, variance shares, consecutive distributions.

    reviewed_only, in_analysis_only, exclude (run and train) choose rows; least is the number of bubbles below which a frame is left out.
    """

    um_per_px: float = 3.2
    small_um: float = 10.0
    least: int = 30
    reviewed_only: bool = True
    in_analysis_only: bool = True
    step_count: float = 0.10
    step_volume: float = 0.25
    outlier_z: float = 3.0
    trend_metrics: tuple[str, ...] = TREND_METRICS
    log_metrics: tuple[str, ...] = ("n",)
    exclude: DataFrame | None = field(default=None, compare=False)
    image: tuple[int, int] | None = None

    def tables(self, bubbles: DataFrame, frames: DataFrame) -> dict[str, DataFrame]:
        """bubbles and frames as ``frame_metrics`` wants them, with run, train, reviewed and in_analysis. With the ``image``'s height and width, frames are described as in
        ``frame_description``, which needs more columns, and steps have coverage_change."""
        key = ["run", "train", "frame"]
        frames = metrics.chosen(frames, self.reviewed_only, False, self.exclude)
        bubbles = metrics.chosen(bubbles, False, self.in_analysis_only, self.exclude).join(frames.select(*key), key, "left_semi")
        kept, sparse = population.drop_sparse(frames, bubbles, key, self.least)
        bubbles = bubbles.join(kept.select(*key), key, "left_semi")
        described = metrics.frame_description if self.image else metrics.frame_metrics
        per_frame = described(bubbles, kept.drop("n"), key, *(self.image or ()), um_per_px=self.um_per_px, small_um=self.small_um)
        steps = seq.steps(per_frame, "run", "train", coverage="coverage" if self.image else None)
        steps = steps.withColumn("kind", seq.step_kind(F.col("count_ratio"), F.col("r_mean_ratio"), F.col("volume_ratio"), self.step_count, self.step_volume))
        outliers = seq.outlier_steps(steps, "run", self.outlier_z)
        ks = dist.consecutive_ks(bubbles, "run", "train", "r_eq_um")
        return {
            "frame_metrics": per_frame,
            "sparse": sparse,
            "steps": steps.join(ks, ["run", "train_from", "train_to"], "left"),
            "step_kinds": metrics.value_counts(steps, ["kind"], ["run"]),
            "outliers": outliers,
            "layers": seq.layer_set(outliers, "run"),
            "trends": reg.trends(per_frame, "run", "train", list(self.trend_metrics), list(self.log_metrics)),
            "coarsening": reg.power_law(per_frame, ["run"], "train", "r32"),
            "variance": dist.variance_partition(per_frame, "run", "train", list(self.trend_metrics)),
            "kruskal": dist.kruskal(bubbles, ["train"], "run", "r_eq_um"),
        }


@dataclass(frozen=True)
class SetTimeline:
    """The frames of a set on one time axis: timeline, jumps between runs, net changes, whole-set trends, and fits over ranges.

    ranges: range_id, start_run, start_train, end_run, end_train. starts: run, start_s.
    """

    seconds_per_train: float
    gap_s: float
    metrics: tuple[str, ...] = ("n", "r_mean", "volume")
    trend_metric: str = "n"
    decay_metric: str = "n"
    line_metric: str = "r_mean"
    offset: bool = False

    def tables(self, per_frame: DataFrame, ranges: DataFrame, starts: DataFrame | None = None) -> dict[str, DataFrame]:
        """per_frame: set, run, train and the metrics."""
        line = seq.timeline(per_frame, "run", "train", self.seconds_per_train, self.gap_s, starts, ["set"])
        members = seq.range_members(line, ranges, "run", "train", "set")
        notes = seq.range_notes(line, ranges, "run", "train", "set").filter("note IS NOT NULL").withColumnRenamed("note", "lost")
        noted = lambda fits: fits.join(notes, "range_id", "full").withColumn("note", F.coalesce("lost", "note")).drop("lost")
        decays = reg.decay_fits(members, ["range_id"], "t_s", self.decay_metric, self.offset)
        return {
            "timeline": line,
            "jumps": seq.boundary_jumps(line, "run", list(self.metrics), ["set"]),
            "net_change": seq.net_change(line, ["set", "run"], "train", list(self.metrics)),
            "trend": reg.whole_set_trend(line, "set", "seq", self.trend_metric),
            "decays": noted(decays),
            "equal_decays": reg.equal_means(decays.filter("note = ''").withColumn("fits", F.lit("all")), ["fits"], "tau", "tau_se"),
            "lines": noted(reg.range_lines(members, ["range_id"], "t_s", self.line_metric)),
        }


@dataclass(frozen=True)
class AlignedRuns:
    """Runs side by side from an event on, the train where their count grows most: events, aligned rows, values before and after.

    override: run, event. known: run and train of layers that are known beforehand.
    """

    metrics: tuple[str, ...] = ("n", "r_mean", "volume")
    least: float = 1.3
    size: str = "r_mean"

    def tables(self, per_train: DataFrame, override: DataFrame | None = None, layers: DataFrame | None = None) -> dict[str, DataFrame]:
        """per_train: run, train, n and the metrics. layers (run, train): those trains' sizes against the others', each relative to its run's mean."""
        events = seq.event_train(per_train, "run", "train", "n", self.least, override)
        out = {
            "events": events,
            "aligned": seq.align(per_train, events, "run", "train", list(self.metrics)),
            "before_after": seq.before_after(per_train, events, "run", "train", list(self.metrics)),
            "drifts": seq.net_change(per_train, ["run"], "train", list(self.metrics)),
        }
        if layers is not None:
            marked = per_train.join(layers.select("run", "train").distinct().withColumn("layer", F.lit(True)), ["run", "train"], "left").withColumn("layer", F.coalesce("layer", F.lit(False)))
            relative = marked.withColumn("relative", seq.scaled(self.size, ["run"])).withColumn("all", F.lit("all"))
            out["layers_differ"] = dist.mann_whitney(relative, ["all"], "layer", "relative")
        return out


@dataclass(frozen=True)
class TrainFrames:
    """One train frame by frame, at times t = frame_idx x interval: metrics with running means and relative to the first frames, snapshots and their distributions,
    size classes, drift of the bubbles' common centre."""

    interval: float
    um_per_px: float = 3.2
    snapshots: int = 6
    smooth: int = 5
    first: int = 1
    classes: tuple[tuple[float, float], ...] = ((0.0, 10.0), (10.0, 20.0), (20.0, 40.0), (40.0, 1e9))
    histogram: tuple[float, float, int] = (0.0, 100.0, 25)
    metrics: tuple[str, ...] = ("n", "r_mean", "volume")

    def tables(self, bubbles: DataFrame, frames: DataFrame) -> dict[str, DataFrame]:
        """bubbles and frames as ``frame_metrics`` wants them, with frame and frame_idx; of one train or of several (run, train)."""
        by, key = ["run", "train"], ["run", "train", "frame"]
        rows = metrics.frame_metrics(bubbles, frames, key, self.um_per_px).withColumn("t", F.col("frame_idx") * self.interval)
        smooth = {f"{m}_smooth": seq.running_mean(m, self.smooth, by, "frame_idx") for m in self.metrics}
        relative = {f"{m}_relative": seq.relative_to_first(m, by, "frame_idx", self.first) for m in self.metrics}
        shown = population.snapshots(rows.select(*key, "frame_idx", "t"), by, "frame_idx", self.snapshots)
        of_shown = bubbles.join(shown.select(*key), key, "left_semi")
        r = F.col("r_eq_um")
        return {
            "frame_metrics": rows.withColumns(smooth | relative),
            "described": metrics.described(rows, by, list(self.metrics)),
            "snapshots": shown,
            "histograms": dist.histogram(of_shown, key, "r_eq_um", *self.histogram),
            "cdfs": dist.ecdf(of_shown, key, "r_eq_um"),
            "scaled": population.scaled_curves(of_shown, key, "r_eq_um", 0.0, 2.5, 25),
            "size_classes": bubbles.groupBy(*key).agg(*(F.count_if((r >= lo) & (r < hi)).alias(f"from_{lo:g}") for lo, hi in self.classes)),
            "drift": seq.drift(rows, by, "frame_idx", "cx_um", "cy_um"),
        }
