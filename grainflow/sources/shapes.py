"""Shape documents (one JSON a frame) and the tables made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.operators.geometry import box_centre, box_halves, ellipse_corners, ellipse_of, polygon_ellipse

#: Fixed values, the annotation format's fields and the tables' columns. Declared, because empty lists would be read as lists of text.
SHAPE_SCHEMA = (
    "image string, reviewed boolean, model string, model_saved string, drafted_at string, edited_at string, frame_path string, score_thresh double, copied_from string, draft boolean, "
    "imported_at double, imported_key string, bubbles array<struct<type:string,data:array<array<double>>,fit_kind:string>>, rois array<array<double>>"
)
FRAME_COLUMNS = "frame string, run string, train int, frame_idx int, reviewed boolean, n_bubbles bigint, n_in_analysis bigint, image_height_px int, image_width_px int, model string, shapes_key string"
OLD_FRAME_COLUMNS = "frame string, train int, frame_idx int, reviewed boolean, n_bubbles bigint, n_in_analysis bigint, image_height_px int, image_width_px int, model string"


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def frame_keys(name: Column) -> dict[str, Column]:
    """run (r and three digits or more), train and frame_idx of a frame's name; nulls where the name doesn't have them."""
    digits = _or_null(F.regexp_extract(name, r"r(\d+)", 1))
    number = F.nullif(F.regexp_replace(digits, "^0+(?=.)", ""), F.lit(""))
    run = F.concat(F.lit("r"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")))
    return {"run": run, "train": _or_null(F.regexp_extract(name, r"_tid(\d+)_(\d+)", 1)).cast("int"), "frame_idx": _or_null(F.regexp_extract(name, r"_tid(\d+)_(\d+)", 2)).cast("int")}


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def list_frames(spark: SparkSession, folder: str, pattern: str = "*.{jpg,png,tif}", runs: list[str] | None = None) -> DataFrame:
    """Image files below ``folder``: frame, run, train, frame_idx, path. Folders named *_annotated are left out, names without a key too. Contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path")
    files = files.filter(~F.col("path").rlike("_annotated/[^/]*$")).withColumn("frame", stem(F.col("path")))
    out = files.withColumns(frame_keys(F.col("frame"))).filter("train IS NOT NULL").distinct()
    return out.filter(F.col("run").isin(runs)) if runs else out


def index_frames(frames: DataFrame) -> DataFrame:
    """One path for each key; a key with several fails the job."""
    one = frames.groupBy("run", "train", "frame_idx").agg(F.min("path").alias("path"), F.count_distinct("path").alias("paths"))
    clash = F.raise_error(F.concat_ws(" ", F.lit("several files for"), "run", "train", "frame_idx"))
    return one.select("run", "train", "frame_idx", F.when(F.col("paths") > 1, clash).otherwise(F.col("path")).alias("path"))


def describe_index(frames: DataFrame) -> DataFrame:
    """Trains and frames of each run."""
    return frames.groupBy("run").agg(F.array_sort(F.collect_set("train")).alias("trains"), F.count(F.lit(1)).alias("n_frames"))


def read_shapes(spark: SparkSession, *paths: str) -> DataFrame:
    """A row for each document, with its frame's key (from the file's name, else from frame_path) and the file's time of change."""
    docs = spark.read.schema(SHAPE_SCHEMA).option("multiLine", True).json(list(paths)).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"))
    named = stem(F.col("path"))
    frame = F.when(named.rlike(r"_tid\d+_\d+"), named).otherwise(stem(F.col("frame_path")))
    return docs.withColumn("frame", frame).withColumns(frame_keys(F.col("frame")))


def as_ellipses(shapes: DataFrame) -> DataFrame:
    """Documents with their polygons (and paths) as ellipses of the same area, centre and direction, and n_polygons, how many there were.

    Places in the list stay, so do shapes that can't be converted. To see what a rewrite would change, look at n_polygons alone.
    """
    polygon = lambda s: F.coalesce(s["type"].isin("polygon", "path"), F.lit(False))

    def ellipse(e: Column) -> Column:
        corners = ellipse_corners(e["row"], e["col"], e["semi_major"], e["semi_minor"], e["angle_deg"])
        return F.when(e.isNotNull(), F.struct(F.lit("ellipse").alias("type"), corners.alias("data"), F.lit("from_polygon").alias("fit_kind")))

    def converted(s: Column) -> Column:
        fitted = F.array(polygon_ellipse(F.transform(s["data"], lambda p: F.slice(p, -2, 2))))
        return F.when(polygon(s), F.coalesce(F.get(F.transform(fitted, ellipse), F.lit(0)), s)).otherwise(s)

    count = F.coalesce(F.size(F.filter("bubbles", polygon)), F.lit(0))
    some = F.exists("bubbles", polygon)
    return shapes.withColumn("n_polygons", count).withColumn("bubbles", F.when(some, F.transform("bubbles", converted)).otherwise(F.col("bubbles")))


def bubbles_of(shapes: DataFrame, um_per_px: float = 3.2) -> DataFrame:
    """A row for each ellipse: key, bubble_id (its place in the list), centre, area, r_eq, axes, angle, in pixels and micrometres.
    To measure the polygons of older documents too, pass them through ``as_ellipses`` first."""
    rows = shapes.select("frame", "run", "train", "frame_idx", F.coalesce("reviewed", F.lit(False)).alias("reviewed"), F.posexplode("bubbles").alias("bubble_id", "shape")).filter("shape.type = 'ellipse' AND size(shape.data) = 4")
    corners = F.col("shape.data")
    e = ellipse_of(*box_halves(corners))
    y, x = box_centre(corners)
    rows = rows.select("frame", "run", "train", "frame_idx", "reviewed", "bubble_id", "shape.fit_kind", x.alias("x"), y.alias("y"), *(v.alias(k) for k, v in e.items()))
    return rows.withColumns({"r_eq_um": F.col("r_eq") * um_per_px, "area_um2": F.col("area") * um_per_px**2})


def read_frames_csv(spark: SparkSession, path: str) -> DataFrame:
    """A frames table of either layout, in the current one. Of a file without run, the frame's name gives it; an empty file is an empty table."""
    header = spark.read.text(path).limit(1).collect()
    if not header:
        return spark.createDataFrame([], FRAME_COLUMNS)
    schema = FRAME_COLUMNS if "run" in header[0][0].split(",") else OLD_FRAME_COLUMNS
    rows = spark.read.schema(schema).option("header", True).csv(path)
    for c in ("run", "shapes_key"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    run = F.coalesce("run", frame_keys(F.col("frame"))["run"])
    return rows.withColumn("run", run).select(*(c.split()[0] for c in FRAME_COLUMNS.split(", ")))


def read_all_frames(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several frames tables, each read by its own header, with the folder's place in ``folder_ord``."""
    parts = [read_frames_csv(spark, p).withColumn("folder_ord", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A table at rest: Parquet by run, or CSV with a header."""
    writer = df.write.mode(mode).partitionBy(*(by or [])) if by else df.write.mode(mode)
    writer.option("header", True).format(form).save(path)


def to_json_documents(bubbles: DataFrame, key: list[str]) -> DataFrame:
    """One JSON text for each frame, its shapes in the order of bubble_id. A frame's shapes are one document, as the format asks."""
    shapes = F.array_sort(F.collect_list(F.struct("bubble_id", "shape")))
    return bubbles.groupBy(*key).agg(F.to_json(F.struct(F.transform(shapes, lambda s: s["shape"]).alias("bubbles"))).alias("document"))


def frames_numbered(index: DataFrame, number: int, runs: list[str] | None = None) -> DataFrame:
    """One frame number of every train: the rows of an index with that frame_idx, in run order."""
    hit = index.filter(F.col("frame_idx") == number)
    return (hit.filter(F.col("run").isin(runs)) if runs else hit).orderBy(*run_order(F.col("run")), "train")


def run_order(run: Column) -> list[Column]:
    """Sort keys of run names: by the number in the name, then by the name."""
    return [_or_null(F.regexp_replace(run, r"\D", "")).cast("long").asc(), run.asc()]


def ordered_runs(members: DataFrame) -> DataFrame:
    """set, runs: the runs of each set (set, run), each once, in the order of ``run_order``."""
    number = F.coalesce(_or_null(F.regexp_replace("run", r"\D", "")).cast("long"), F.lit(-1))
    return members.groupBy("set").agg(F.array_sort(F.collect_set(F.struct(number.alias("number"), "run"))).alias("runs")).select("set", F.col("runs.run").alias("runs"))


def resolve_images(frames: DataFrame, files: DataFrame) -> DataFrame:
    """frames (frame, run, frame_path) with image: the first that is among files (path) of the frame's TIF, frame_path and raw/jpg_<run>/<frame>.jpg; else null."""
    name = F.element_at(F.split("path", "/"), -1)
    tifs = files.filter(name.rlike(r"(?i)\.tiff?$")).groupBy(stem(F.col("path")).alias("_t")).agg(F.min("path").alias("_tif"))
    own = files.select(F.col("path").alias("_own")).distinct()
    raw = files.groupBy(F.substring_index("path", "/", -2).alias("_r")).agg(F.min("path").alias("_raw"))
    wanted = F.concat(F.lit("jpg_"), F.col("run"), F.lit("/"), F.col("frame"), F.lit(".jpg"))
    found = frames.join(tifs, F.col("frame") == F.col("_t"), "left").join(own, F.col("frame_path") == F.col("_own"), "left").join(raw, wanted == F.col("_r"), "left")
    return found.select(*frames.columns, F.coalesce("_tif", "_own", "_raw").alias("image"))


def latest_run_info(log: DataFrame, key: list[str]) -> DataFrame:
    """The newest entry of an append-only run log (key, at, info, selection) and the selections of all entries, oldest first."""
    return log.groupBy(*key).agg(F.max("at").alias("at"), F.max_by("info", "at").alias("info"), F.transform(F.array_sort(F.collect_list(F.struct("at", "selection"))), lambda e: e["selection"]).alias("selections"))
