"""Derived tables kept up to date by what changed: bubbles, frame metrics, trains, steps and runs, each a versioned table.

A changed frame is a changed row of the metrics; its train is summed up again from that train's frames; its steps are the train's own and that of the next
train; its run is summed up from the run's trains. Rows of a run share a bucket from the metrics on, so a change reads and writes the buckets of the frames and runs it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainflow.functions.storage import settled
from grainflow.operators.maintenance import newest
from grainflow.operators.metrics import population_metrics
from grainflow.operators.sequence import ratio
from grainflow.sources.versioned import VersionedTable

FRAME, TRAIN = ["run", "train", "frame"], ["run", "train"]


def frame_rows(bubbles: DataFrame) -> DataFrame:
    """run, train, frame and the metrics of each frame that has bubbles (run, train, frame, r)."""
    return population_metrics(bubbles, FRAME, "r").select(*FRAME, "n", "r_mean", "r_median", "volume")


def train_rows(frames: DataFrame) -> DataFrame:
    """run, train, n_frames, n (bubbles), r_mean (over all bubbles) and volume of each train's frames."""
    return frames.groupBy(*TRAIN).agg(F.count(F.lit(1)).alias("n_frames"), F.sum("n").alias("n"), (F.sum(F.col("r_mean") * F.col("n")) / F.sum("n")).alias("r_mean"), F.sum("volume").alias("volume"))


def step_rows(trains: DataFrame) -> DataFrame:
    """run, train, train_from and the ratios of each train to the one before it in its run."""
    w = Window.partitionBy("run").orderBy("train")
    before = {c: F.lag(c).over(w) for c in ("train", "n", "r_mean", "volume")}
    out = trains.select(*TRAIN, before["train"].alias("train_from"), *(ratio(F.col(c), before[c]).alias(f"{c}_ratio") for c in ("n", "r_mean", "volume")))
    return out.filter("train_from IS NOT NULL")


def run_rows(trains: DataFrame) -> DataFrame:
    """run, n_trains, n, r_mean and volume of each run."""
    return trains.groupBy("run").agg(F.count(F.lit(1)).alias("n_trains"), F.sum("n").alias("n"), (F.sum(F.col("r_mean") * F.col("n")) / F.sum("n")).alias("r_mean"), F.sum("volume").alias("volume"))


class Derived:
    """The tables below ``path``. Documents are rows of (run, train, frame, version, r: array of sizes); an empty array takes a frame away."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        table = lambda name, key, by: VersionedTable(spark, f"{path}/{name}", key, buckets, by)
        self.documents, self.frames = table("documents", FRAME, FRAME), table("frames", FRAME, ["run"])
        self.trains, self.steps, self.runs = table("trains", TRAIN, ["run"]), table("steps", TRAIN, ["run"]), table("runs", ["run"], ["run"])

    def apply(self, changes: DataFrame) -> None:
        """Takes the newest version of each changed frame, unless the table holds a newer one, and carries it through. Safe to repeat: a change that was cut short is
        finished by applying it again."""
        changes = newest(changes, FRAME, "version", [F.xxhash64(F.to_json("r"))])
        held = self.documents.read()
        if held is not None:
            known = self.documents.where(changes).select(*FRAME, F.col("version").alias("_known"))
            changes = changes.join(known, FRAME, "left").filter("_known IS NULL OR version >= _known").drop("_known")
        changes = settled(changes, "changes")
        self.documents.merge(changes)
        frames = settled(frame_rows(changes.select(*FRAME, F.explode("r").alias("r"))), "frames")
        self._replace(self.frames, frames, changes.select(*FRAME), FRAME)
        touched = settled(changes.select(*TRAIN).distinct(), "trains")
        trains = settled(train_rows(self.frames.where(touched).join(touched, TRAIN, "left_semi")), "train_rows")
        self._replace(self.trains, trains, touched, TRAIN)
        # The trains of the runs concerned are few rows; of their steps the train's own and the next one's can differ.
        near = settled(self.trains.where(touched), "near")
        after = near.join(touched.withColumnRenamed("train", "_t"), "run").filter("train > _t").groupBy("run", "_t").agg(F.min("train").alias("train")).select(*TRAIN)
        concerned = settled(touched.unionByName(after).distinct(), "concerned")
        steps = settled(step_rows(near).join(concerned, TRAIN, "left_semi"), "steps")
        self._replace(self.steps, steps, concerned, TRAIN)
        runs = settled(run_rows(near), "runs")
        self._replace(self.runs, runs, touched.select("run").distinct(), ["run"])

    @staticmethod
    def _replace(table: VersionedTable, rows: DataFrame, concerned: DataFrame, key: list[str]) -> None:
        """``rows`` are all that ``concerned`` keys have now: the others of them go."""
        table.merge(rows, concerned.join(rows.select(*key), key, "left_anti"))

    def follow(self, changes: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Applies each micro-batch of a stream of documents; a batch that runs again gives the same tables."""
        writer = changes.writeStream.foreachBatch(lambda batch, _: self.apply(batch)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
