"""Queries of the population metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.operators.metrics import population_metrics


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_quantity", "l_extendedprice")
    out = population_metrics(items, ["l_suppkey"], r="l_quantity", area="l_extendedprice", small=10.0)
    return out.select("l_suppkey", "n", *(F.round(c, 6).alias(c) for c in out.columns if c not in ("l_suppkey", "n")))


QUERIES = {"population_metrics": population}

ORACLE_SQL = {
    "population_metrics": """
SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n,
       round(avg(l_quantity), 6) AS r_mean, round(stddev_samp(l_quantity) / sqrt(count(*)), 6) AS r_sem,
       round(quantile_cont(l_quantity, 0.5), 6) AS r_median, round(stddev_samp(l_quantity), 6) AS r_std,
       round(max(l_quantity), 6) AS r_max, round(quantile_cont(l_quantity, 0.9), 6) AS r_p90,
       round(sum(l_quantity * l_quantity * l_quantity) / nullif(sum(l_quantity * l_quantity), 0), 6) AS r32,
       round(stddev_samp(l_quantity) / nullif(avg(l_quantity), 0), 6) AS polydispersity,
       round(sum(l_extendedprice), 6) AS area_total,
       round(coalesce(sum(4.0::DOUBLE / 3.0::DOUBLE * pi() * l_quantity * l_quantity * l_quantity), 0), 6) AS volume,
       round(avg(CASE WHEN l_quantity < 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS frac_small,
       round(stddev_samp(CASE WHEN l_quantity > 0 THEN ln(l_quantity) END), 6) AS log_width
FROM lineitem GROUP BY l_suppkey"""
}
