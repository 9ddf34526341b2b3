"""Image rows as arrays: scaling, stretch, statistics. The flat field is in ``flatfield``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainflow.operators.flatfield import FlatField as FlatField


def scaled_to(pixels: Column, lo: float, hi: float, most: int = 255) -> Column:
    """Pixels between lo and hi as integers 0 to ``most``; beyond, they are cut off; nulls and NaN are 0."""
    one = lambda v: F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise((v - lo) / (hi - lo))
    return F.transform(pixels, lambda v: F.round(F.least(F.greatest(one(v), F.lit(0.0)), F.lit(1.0)) * most).cast("int"))


def divided(pixels: Column, flat: Column) -> Column:
    return F.zip_with(pixels, flat, lambda a, b: F.try_divide(a, b))


def stretched(pixels: Column, lo: float, hi: float) -> Column:
    """Pixels stretched so that an image's own percentiles lo and hi (0 to 1, linear between ranks) become 0 and 1, and cut off there."""
    ordered = F.array_sort(pixels)

    def at(q: float) -> Column:
        place = (F.size(pixels) - 1) * F.lit(float(q))
        low = F.floor(place).cast("int")
        a, b = F.get(ordered, low).cast("double"), F.get(ordered, F.ceil(place).cast("int")).cast("double")
        return a + (b - a) * (place - low)

    # Bound once: the percentiles of an image are not looked for again at each pixel.
    ends = F.transform(F.array(F.struct(at(lo).alias("lo"), at(hi).alias("hi"))), lambda e: F.transform(pixels, lambda v: F.least(F.greatest(F.try_divide(v - e["lo"], e["hi"] - e["lo"]), F.lit(0.0)), F.lit(1.0))))
    return F.get(ends, F.lit(0))


def without_boxes(pixels: Column, height: int, width: int, boxes: list[tuple[float, float, float, float]]) -> Column:
    """Row-major pixels with null where a box lies; boxes are (top, bottom, left, right) as fractions of the image, ends exclusive."""
    inside = F.lit(False)
    cuts = [(round(a * height), round(b * height), round(c * width), round(d * width)) for a, b, c, d in boxes]
    return F.transform(pixels, lambda v, i: F.when(_any(inside, [(F.floor(i / width) >= a) & (F.floor(i / width) < b) & (i % width >= c) & (i % width < d) for a, b, c, d in cuts]), F.lit(None)).otherwise(v))


def _any(start: Column, conditions: list[Column]) -> Column:
    for c in conditions:
        start = start | c
    return start


def image_stats(df: DataFrame, key: list[str], pixels: str) -> DataFrame:
    """Mean and the share of clipped pixels (below 0.01 or above 0.99)."""
    n = F.size(pixels)
    total = F.aggregate(pixels, F.lit(0.0), lambda a, v: a + v)
    clipped = F.size(F.filter(pixels, lambda v: (v < 0.01) | (v > 0.99)))
    return df.select(*key, (total / n).alias("mean"), (clipped / n).alias("clipped"))


def percentile_range(df: DataFrame, pixels: str, lo: float, hi: float, accuracy: int = 10_000) -> DataFrame:
    """Approximate percentiles over all pixels of all images, a mergeable sketch in each task."""
    at = F.percentile_approx("v", F.array(F.lit(lo), F.lit(hi)), accuracy)
    return df.select(F.explode(pixels).alias("v")).agg(at.alias("q")).select(F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
