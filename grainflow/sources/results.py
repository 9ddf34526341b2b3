"""Result folders: the bubbles and frames tables in them, which runs they hold, their settings, logs and findings."""

from __future__ import annotations

import json
import textwrap

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.sources.shapes import frame_keys, ordered_runs, stem

#: Columns of a bubbles table that aren't numbers with fractions; all others are doubles.
BUBBLE_TYPES = {
    "frame": "string", "run": "string", "train": "int", "frame_idx": "int", "reviewed": "boolean", "bubble_id": "int", "fit_kind": "string", "edge_truncated": "boolean", "fit_reliable": "boolean", "in_analysis": "boolean",
}
EMPTY_BUBBLES = ["frame", "run", "train", "frame_idx", "reviewed", "bubble_id", "in_analysis"]


def read_bubbles_csv(spark: SparkSession, path: str) -> DataFrame:
    """A bubbles table with the columns of its header. Of a file without run the frame's name gives it; an empty file is an empty table."""
    header = spark.read.text(path).limit(1).collect()  # one line
    names = header[0][0].split(",") if header else EMPTY_BUBBLES
    schema = ", ".join(f"`{n}` {BUBBLE_TYPES.get(n, 'double')}" for n in names)
    if not header:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("header", True).csv(path)
    own = frame_keys(F.col("frame"))["run"]
    return rows.withColumn("run", F.coalesce("run", own) if "run" in names else own)


def result_folders(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """folder, has_table, has_shapes of the folders right below ``root`` with a bubbles.csv or shapes. Names that begin with _ or . are left out. Only names are
    listed, no contents read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{csv,json}").load(root).select("path")
    parts = F.split("path", "/")
    at = lambda k: F.element_at(parts, -k)
    table, shape = at(1) == "bubbles.csv", (at(2) == "shapes") & at(1).endswith(".json")
    found = files.select(F.when(table, at(2)).when(shape, at(3)).alias("folder"), F.when(table, F.element_at(parts, -3)).when(shape, F.element_at(parts, -4)).alias("above"), table.alias("t"), shape.alias("s"))
    found = found.filter((F.col("above") == root.rstrip("/").rsplit("/", 1)[-1]) & ~F.col("folder").rlike("^[_.]"))
    found = found.filter(F.col("folder").isin(only)) if only is not None else found
    return found.groupBy("folder").agg(F.bool_or("t").alias("has_table"), F.bool_or("s").alias("has_shapes"))


def runs_of_folders(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """folder, run: the runs in each folder below ``root``, from the frame column of its frames.csv, or else the names of its shape files."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{csv,json}").load(root).select("path")
    tables = listed.filter(F.col("path").rlike("/frames\\.csv$")).select(F.element_at(F.split("path", "/"), -2).alias("folder"))
    shapes = listed.filter(F.element_at(F.split("path", "/"), -2) == "shapes").select(F.element_at(F.split("path", "/"), -3).alias("folder"), stem(F.col("path")).alias("frame"))
    lines = spark.createDataFrame([], "folder string, frame string")
    if not tables.isEmpty():  # the header is dropped by its name, so tables of both layouts can be read at once
        text = spark.read.text(f"{root}/{pattern}/frames.csv").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("folder"), F.substring_index("value", ",", 1).alias("frame"))
        lines = text.filter("frame <> 'frame' AND frame <> ''")
    other = shapes.join(lines.select("folder").distinct(), "folder", "left_anti")
    every = lines.unionByName(other).withColumn("run", frame_keys(F.col("frame"))["run"])
    like = "^" + pattern.replace(".", "\\.").replace("*", ".*") + "$"
    return every.filter(F.col("folder").rlike(like) & F.col("run").isNotNull()).select("folder", "run").distinct()


def discover_sets(spark: SparkSession, root: str) -> DataFrame:
    """set, runs (in the order of their numbers) of each folder ``<name>_set`` below ``root``."""
    return ordered_runs(runs_of_folders(spark, root, "*_set").withColumnRenamed("folder", "set"))


def log_run(spark: SparkSession, path: str, folder: str, info: dict, selection: list | None = None) -> None:
    """Appends an entry to the run log at ``path``; ``latest_run_info`` reads the newest, with the history of selections."""
    row = spark.createDataFrame([(folder, json.dumps(info, default=str, sort_keys=True), None if selection is None else [repr(x) for x in selection])], "folder string, info string, selection array<string>")
    row.select("folder", F.current_timestamp().alias("at"), "info", "selection").write.mode("append").parquet(path)


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """Settings beside a table, as one JSON document."""
    spark.createDataFrame([(json.dumps(settings, default=str),)], "value string").write.mode("overwrite").text(path)


def findings_text(findings: list[tuple[str, str]], header: str = "", width: int = 108) -> str:
    """One-line findings by section, wrapped, in a box."""
    lines, last = [header] if header else [], None
    for section, text in findings:
        if section != last:
            lines += ([""] if lines else []) + [f"[{section}]"]
            last = section
        lines += textwrap.wrap(text, width, initial_indent="- ", subsequent_indent="  ")
    size = max((len(line) for line in lines), default=0)
    bar = "=" * (size + 4)
    return "\n".join([bar, *(f"| {line:<{size}} |" for line in lines), bar])


def write_findings(spark: SparkSession, findings: list[tuple[str, str]], path: str, header: str = "") -> None:
    """The box as a text file."""
    spark.createDataFrame([(line,) for line in findings_text(findings, header).split("\n")], "value string").coalesce(1).write.mode("overwrite").text(path)
