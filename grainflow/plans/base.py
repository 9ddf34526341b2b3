"""Tables that the queries start from, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums doesn't show; -0.0 becomes 0.0."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as measured objects: run (return flag), train (month), frame (order), size r (quantity), area (price)."""
    train = (F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate")
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run"), train.cast("long").alias("train"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("bubble"), F.col("l_quantity").alias("r"), F.col("l_extendedprice").alias("area"), F.col("l_suppkey").alias("supplier"))


def trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each run and train: n, r_mean, r_median, volume, frac_small."""
    r = F.col("r")
    return bubbles(spark, sf_dir).groupBy("run", "train").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("r_mean"), F.percentile("r", F.lit(0.5)).alias("r_median"), F.sum(r * r * r).alias("volume"), F.avg((r < 10).cast("double")).alias("frac_small")
    )


SQL = """bubbles AS (
  SELECT l_returnflag AS run, CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) AS BIGINT) AS train, l_orderkey AS frame, l_linenumber AS bubble,
         l_quantity AS r, l_extendedprice AS area, l_suppkey AS supplier FROM lineitem
), trains AS (
  SELECT run, train, count(*) AS n, avg(r) AS r_mean, quantile_cont(r, 0.5) AS r_median, sum(r * r * r) AS volume, avg(CAST(r < 10 AS DOUBLE)) AS frac_small
  FROM bubbles GROUP BY run, train
)"""
