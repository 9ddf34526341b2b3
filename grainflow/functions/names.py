"""Small column functions: labels, log bins, p-value texts, union coverage."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def train_label(run: Column, train: Column) -> Column:
    return F.format_string("%s train %d", run, train)


def range_label(start_run: Column, start: Column, end_run: Column, end: Column) -> Column:
    """``r562 t5-9`` in one run, ``r562 t5 to r563 t3`` across runs."""
    return F.when(start_run == end_run, F.format_string("%s t%d-%d", start_run, start, end)).otherwise(F.format_string("%s t%d to %s t%d", start_run, start, end_run, end))


def p_text(p: Column) -> Column:
    return F.when(p < 1e-3, F.format_string("%.1e", p)).otherwise(F.format_string("%.3f", p))


def log_edges(lo: float, hi: float, bins: int) -> Column:
    """bins + 1 edges from lo to hi, equally far apart in logarithm."""
    step = (math.log(hi) - math.log(lo)) / bins
    return F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.exp(F.lit(math.log(lo)) + i * step))


def bin_centres(edges: Column) -> Column:
    return F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: F.sqrt(a * b))


def angle_in_half_turn(degrees: Column) -> Column:
    """An axis' angle in [-90, 90)."""
    return F.pmod(degrees + 90, F.lit(180.0)) - 90
