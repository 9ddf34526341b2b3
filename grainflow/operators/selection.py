"""Selection of frames by run, train and frame number: item language, semi-join, report of what is missing, compact ranges."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGES = "run string, train_lo long, train_hi long, frame_lo long, frame_hi long"
_ALL = (0, 2**31 - 1)
_ITEM = re.compile(r"(?:r?(?P<run>\d+))?(?:_?(?:tid|train)(?P<train>\d+))?(?:(?:_|frame)(?P<frame>\d+))?$")


def number_ranges(spec) -> list[tuple[int, int]]:
    """Inclusive ranges of a number specification: an int, a list, a ``range`` (end excluded), "10-20,30" (ends included), or all of them."""
    if spec is None or spec == "" or spec == [] or (isinstance(spec, str) and spec.strip().lower() in ("all", "*")):
        return [_ALL]
    if isinstance(spec, int):
        return [(spec, spec)]
    if isinstance(spec, range):
        return [(n, n) for n in spec] if spec.step != 1 else [(spec.start, spec.stop - 1)] if len(spec) else []
    if isinstance(spec, str):
        out = []
        for part in spec.split(","):
            lo, _, hi = part.strip().partition("-")
            if not lo.isdigit() or (hi and not hi.isdigit()):
                raise ValueError(f"not a number or range: {part!r}")
            out.append((int(lo), int(hi or lo)))
        return out
    return [r for x in spec for r in number_ranges(x)]


def run_id(run) -> str:
    """r and at least three digits, from 563, "563", "r563" or a path that ends so."""
    found = re.search(r"(\d+)\D*$", str(run).rstrip("/").rsplit("/", 1)[-1].split("_tid")[0])
    if not found:
        raise ValueError(f"no run number in {run!r}")
    return f"r{int(found[1]):03d}"


def parse_item(item) -> list[tuple]:
    """Ranges of one item: (run, train, frames), (train, frames), or text such as r571, r571_tid3, r571_tid3_010, tid3_010, train3frame010, all."""
    if isinstance(item, tuple):
        run, train, frames = item if len(item) == 3 else (None, *item)
        name = None if run is None else run_id(run)
        return [(name, *t, *f) for t in number_ranges(train) for f in number_ranges(frames)]
    text = str(item).strip().lower()
    if text in ("all", "*"):
        return [(None, *_ALL, *_ALL)]
    m = _ITEM.match(text)
    if not m or not (m["train"] or (m["run"] and text.startswith("r"))):
        raise ValueError(f"can't tell what {item!r} selects")
    one = lambda s: (int(s), int(s)) if s is not None else _ALL
    return [(run_id(m["run"]) if m["run"] else None, *one(m["train"]), *one(m["frame"]))]


def selection(spark: SparkSession, items) -> DataFrame:
    """The ranges of all items, a small table."""
    items = items if isinstance(items, list) else [items]
    return spark.createDataFrame([r for i in items for r in parse_item(i)], RANGES)


def select_frames(manifest: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of the manifest (run, train, frame_idx) that any range has, each once."""
    m, within = manifest.alias("m"), F.col("m.train").between(F.col("r.train_lo"), F.col("r.train_hi")) & F.col("m.frame_idx").between(F.col("r.frame_lo"), F.col("r.frame_hi"))
    named, anywhere = ranges.filter("run IS NOT NULL").alias("r"), ranges.filter("run IS NULL").alias("r")
    of_run = within & (F.col("r.run") == F.col("m.run"))
    # Ranges of a run meet it by its name; only those of no run are tried on all rows.
    return m.join(named, of_run, "left_semi").unionByName(m.join(named, of_run, "left_anti").alias("m").join(anywhere, within, "left_semi"))


def compact_ranges(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Numbers of each group as text like ``1-3, 7``: islands of consecutive numbers."""
    d = df.select(*by, F.col(number).cast("long").alias("n")).distinct()
    d = d.withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy(*by).orderBy("n")))
    isles = d.groupBy(*by, "island").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    listed = F.array_sort(F.collect_list(F.struct("lo", text.alias("t"))))
    return isles.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["t"]), ", ").alias("ranges"))


def missing(requested: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Requested keys that the manifest doesn't have."""
    return requested.select(*keys).distinct().join(manifest.select(*keys), keys, "left_anti")
