"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.functions.prefix import repeated
from grainflow.functions.storage import new_folder as workspace
from grainflow.functions.storage import remove

__all__ = ["LOWER", "UPPER", "ascii_lower", "in_small_batches", "one_of_each", "read", "remove", "repeated", "text_or_empty", "unused", "with_totals", "workspace", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet at ``path`` and read back: lineage ends there, and a lost executor loses nothing."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session hands Python 1,000 rows at a time instead of Spark's default of 10,000: rows are whole texts here, and a batch of them is held several times, in and
    outside the JVM. Another number in the session's settings stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, "1000")
    return df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ASCII texts take the fast built-in; ``translate`` serves the others."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores if a column of ``df`` has it (names are compared as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_totals(rows: DataFrame, keys: list[str], spread_by: list[str], partial: list[Column], whole: list[Column], parts: int = 256) -> DataFrame:
    """``rows`` with aggregates of their group: ``partial`` of a part of the group, ``whole`` of its partial ones. Keys aren't null.

    A group is dealt out to ``parts`` parts by ``spread_by``, before the aggregation and for the join back, so that
    no task has a whole one. Of the aggregates there are only as many rows as parts that occur.
    """
    part, held = unused(rows, "gf_part"), unused(rows, "gf_parts")
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(*spread_by), F.lit(parts)))
    totals = dealt.groupBy(*keys, part).agg(*partial).groupBy(*keys).agg(*whole, F.collect_set(part).alias(held))
    return dealt.join(totals.withColumn(part, F.explode(held)).drop(held), [*keys, part]).drop(part)


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of ``keys``, columns as in ``rows``: that with the least hash of its JSON, whatever the order of the rows."""
    whole, least = unused(rows, "gf_row"), F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))))
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), least).alias(whole))
    return first.select(*(F.col(whole)[c].alias(c) for c in rows.columns))
