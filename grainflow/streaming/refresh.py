"""Derived tables kept up to date from a stream of changed frames, and step detection as summaries arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainflow.operators.maintenance import newest


def refresh(changes: DataFrame, target: str, key: list[str], version: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends each micro-batch's newest version of each key to a versioned table; ``current`` reads the latest.

    A batch that runs again overwrites its own partition, so a restart leaves no row twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = newest(batch, key, version, [F.xxhash64(*batch.columns)])
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, target: str, key: list[str], version: str) -> DataFrame:
    """The newest version of each key in the table that ``refresh`` writes; of equal versions the later batch's."""
    rows = spark.read.parquet(target)
    return newest(rows, key, version, [F.col("batch").desc()]).drop("batch")


def windowed_metrics(events: DataFrame, time: str, by: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and Sauter mean per group and tumbling window; rows later than ``late`` behind the newest are left out."""
    v = F.col(value)
    out = events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("r_mean"), F.try_divide(F.sum(v * v * v), F.sum(v * v)).alias("r32"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "r_mean", "r32")
