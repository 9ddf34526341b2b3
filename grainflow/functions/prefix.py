"""Running sums over groups of any size, in two levels.

Rows are dealt out to ranges of (group, order). A range's rows are summed up in a window of its own, and of the ranges there are only their sums, which say
what lies before each. So no task holds a group, whatever its size; a range is as large as Spark's shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainflow.functions.storage import settled


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], following: dict[str, str] | None = None, totals: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the sum of each of ``sums`` (name: column) over the rows of the group that come before; with the next row's value of each of
    ``following`` (name: column; null in the last row); and with the whole group's sum for each of ``totals`` (name: one of sums).

    Rows alike in ``order`` follow each other in any order. Keys may be null, nulls come first. New names must not be in ``df``.
    """
    following, totals = following or {}, totals or {}
    ranged = df.select("*", *(v.alias(f"_v_{name}") for name, v in sums.items())).repartitionByRange(*by, *order)
    rows = settled(ranged.withColumn("_range", F.spark_partition_id()), "running")
    whole = Window.partitionBy("_range", *by)
    sorted_ = whole.orderBy(*order)
    before = sorted_.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        *df.columns,
        "_range",
        *(F.sum(f"_v_{name}").over(before).alias(name) for name in sums),
        *(F.lead(c).over(sorted_).alias(name) for name, c in following.items()),
        *(F.sum(f"_v_{name}").over(whole).alias(total) for total, name in totals.items()),
    )
    first = F.struct(*order)
    ranges = rows.groupBy(*by, "_range").agg(*(F.sum(f"_v_{name}").alias(f"_v_{name}") for name in sums), *(F.min_by(c, first).alias(f"_f_{name}") for name, c in following.items()))
    of_group = Window.partitionBy(*by)
    w = of_group.orderBy("_range")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        *(F.col(c).alias(f"_b_{c}") for c in by),
        F.col("_range").alias("_at"),
        F.count(F.lit(1)).over(of_group).alias("_held"),
        *(F.coalesce(F.sum(f"_v_{name}").over(upto), F.lit(0)).alias(f"_o_{name}") for name in sums),
        *(F.lead(f"_f_{name}").over(w).alias(f"_n_{name}") for name in following),
        *(F.sum(f"_v_{name}").over(of_group).alias(f"_t_{total}") for total, name in totals.items()),
    ).filter("_held > 1")
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    # Groups that go on in another range: two rows a range at most.
    joined = local.join(F.broadcast(offsets), same, "left")
    before_here = [(F.coalesce(name, F.lit(0)) + F.coalesce(f"_o_{name}", F.lit(0))).alias(name) for name in sums]
    return joined.select(*df.columns, *before_here, *(F.coalesce(name, f"_n_{name}").alias(name) for name in following), *(F.coalesce(f"_t_{total}", total).alias(total) for total in totals))


def repeated(rows: DataFrame, copies: str, number: str, most: int = 1 << 16) -> DataFrame:
    """Each row ``copies`` times, numbered from 0 in ``number``, without an array of more than ``most`` numbers."""
    first, taken = "_first", {c.lower() for c in rows.columns}
    while first in taken:
        first += "_"
    upto = F.explode(F.sequence(F.lit(0), (F.col(copies) - 1).cast("long"), F.lit(most)))
    last = F.least(F.col(first) + most, F.col(copies).cast("long")) - 1
    return rows.filter(F.col(copies) > 0).withColumn(first, upto).withColumn(number, F.explode(F.sequence(F.col(first), last))).drop(first)
