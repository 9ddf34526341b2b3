"""Content keys of shapes, equal to those that the annotation format holds: a digest of the shapes' JSON text, numbers rounded to three decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From here on, doubles are farther apart than the last digits of three decimals can tell; they stay as they are.
LARGE = 1e12


def _thousands(x: Column) -> Column:
    """The integer nearest to 1000 x, of the exact product: of two as near the even one. x is not negative and below ``LARGE``."""

    def nearest(s: Column) -> Column:
        # The product's rounding error is known exactly once x is split in halves of its digits.
        high = s["wide"] - (s["wide"] - s["x"])
        error = (high * 1000 - s["p"]) + (s["x"] - high) * 1000
        floor = F.floor(s["p"])
        over = (s["p"] - floor - 0.5) + error
        return F.when((over > 0) | ((over == 0) & (floor % 2 == 1)), floor + 1).otherwise(floor)

    parts = F.struct(x.alias("x"), (x * 134217729.0).alias("wide"), (x * 1000).alias("p"))
    return F.get(F.transform(F.array(parts), nearest), F.lit(0))


def number_text(x: Column) -> Column:
    """A double, rounded to three decimals, as JSON writes it: shortest digits, ``-0.0``, exponents from 1e16 on."""
    x = x.cast("double")
    plain = x.cast("string")
    sign, size = F.when(F.startswith(plain, F.lit("-")), "-").otherwise(""), F.abs(x)

    def small(k: Column) -> Column:
        decimals = F.rtrim(F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("0"))
        return F.concat(F.floor(k / 1000).cast("string"), F.lit("."), F.when(decimals == "", "0").otherwise(decimals))

    def large(text: Column) -> Column:
        digits = F.rtrim(F.regexp_replace(F.regexp_extract(text, "^([0-9.]+)E", 1), "[.]", ""), F.lit("0"))
        power = F.regexp_extract(text, "E([0-9]+)$", 1).cast("int")
        whole = F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, "0")
        rest = F.substring(digits, power + 2, F.length(digits))
        fraction = F.concat(whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))
        tail = F.substring(digits, F.lit(2), F.length(digits))
        scientific = F.concat(F.substring(digits, 1, 1), F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)), F.lit("e+"), power.cast("string"))
        return F.when(power < 16, fraction).otherwise(scientific)

    body = F.get(F.transform(F.array(_thousands(F.when(size < LARGE, size).otherwise(0.0))), small), F.lit(0))
    return F.when(F.isnan(x), "NaN").when(plain.isin("Infinity", "-Infinity"), plain).when(size < LARGE, F.concat(sign, body)).otherwise(F.concat(sign, large(size.cast("string"))))


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def content_key(bubbles: Column, rois: Column) -> Column:
    """16 hex digits of a document's shapes (array of structs with type and data, points of numbers) and regions (arrays of numbers). Missing ones count as empty."""
    numbers = lambda v: _list(F.transform(v, number_text))
    escaped = lambda s: F.regexp_replace(F.regexp_replace(s, r"\\", r"\\\\"), '"', r'\\"')
    kind = lambda s: F.coalesce(F.concat(F.lit('"'), escaped(s["type"]), F.lit('"')), F.lit("null"))
    shape = lambda s: _list(F.array(kind(s), F.coalesce(_list(F.transform(s["data"], numbers)), F.lit("[]"))))
    shapes = F.when(bubbles.isNotNull(), _list(F.transform(bubbles, shape))).otherwise("[]")
    regions = F.when(rois.isNotNull(), _list(F.transform(rois, numbers))).otherwise("[]")
    return F.substring(F.sha1(_list(F.array(shapes, regions))), 1, 16)
