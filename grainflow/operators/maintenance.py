"""Maintenance of derived tables: newest versions, first-folder-wins, staleness, conditional merges, hold-out splits, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, key: list[str], version: Column | str, tie: list[str]) -> DataFrame:
    """One row for each key, of the largest version; ``tie`` (ascending) decides between equals."""
    v = F.col(version) if isinstance(version, str) else version
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(v.desc(), *tie))).filter("_n = 1").drop("_n")


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in ``order``: the first folder that has it, and the first of rows repeated there."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def stale(exports: DataFrame, sources: DataFrame, key: list[str], exported: str, changed: str, slack_s: float = 1.0, least_bytes: int = 10) -> DataFrame:
    """Whether each key must be exported anew: no export, one of fewer than ``least_bytes`` bytes, or a source that changed over ``slack_s`` later."""
    last = sources.groupBy(*key).agg(F.max(changed).alias("_changed"))
    joined = last.join(exports.select(*key, exported, "n_bytes"), key, "left")
    reason = F.when(F.col(exported).isNull(), "missing").when(F.col("n_bytes") < least_bytes, "empty").when(F.col("_changed").cast("double") > F.col(exported).cast("double") + slack_s, "changed").otherwise("fresh")
    return joined.select(*key, reason.alias("status"))


def merge_actions(incoming: DataFrame, stage: DataFrame, excluded: DataFrame, key: str, digest: str) -> DataFrame:
    """What a merge does with each incoming row: the first rule that fits.

    stage: key, digest, n_shapes, n_rois, draft, reviewed, imported_key (digest of what was imported; null for rows of one's own). Excluded keys are skipped
    and new ones copied. Of one's own rows an empty one and an uncorrected draft (neither reviewed nor with regions) are replaced, the
    others stay. An imported row that was edited since stays too; else it is up to date or updated.
    """
    s = stage.select(F.col(key).alias("_k"), F.col(digest).alias("_d"), "n_shapes", "n_rois", "draft", "reviewed", "imported_key")
    x = excluded.select(F.col(key).alias("_x")).distinct()
    joined = incoming.join(s, F.col(key) == F.col("_k"), "left").join(x, F.col(key) == F.col("_x"), "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    own = F.col("imported_key").isNull()
    action = (
        F.when(F.col("_x").isNotNull(), "skipped (excluded)")
        .when(F.col("_k").isNull(), "copied")
        .when(own & none("n_shapes") & none("n_rois"), "updated (replaces an empty row)")
        .when(own & yes("draft") & ~yes("reviewed") & none("n_rois"), "updated (replaces an uncorrected draft)")
        .when(own, "skipped (own)")
        .when(~F.col("_d").eqNullSafe(F.col("imported_key")), "skipped (edited since)")
        .when(F.col("imported_key") == F.col(digest), "up to date")
        .otherwise("updated")
    )
    return joined.select(*incoming.columns, action.alias("action"))


def reviewed_documents(shapes: DataFrame) -> DataFrame:
    """frame, path, changed, n_bubbles of reviewed documents with bubbles (of ``read_shapes``). Those of a folder ``tracked``, or marked so, are none."""
    marked = F.coalesce(F.col("tracked"), F.lit(False)) if "tracked" in shapes.columns else F.lit(False)
    n = F.coalesce(F.size("bubbles"), F.lit(0)).cast("long")
    good = F.coalesce("reviewed", F.lit(False)) & (n > 0) & ~marked & ~F.array_contains(F.split("path", "/"), "tracked")
    return shapes.filter(good).select("frame", "path", "changed", n.alias("n_bubbles"))


def trainable(documents: DataFrame) -> DataFrame:
    """Adds eligible: a document with bubbles that isn't a draft, or is one that was reviewed or has regions. documents: draft, reviewed, n_rois, n_bubbles."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    checked = ~yes("draft") | yes("reviewed") | (F.coalesce("n_rois", F.lit(0)) > 0)
    return documents.withColumn("eligible", checked & (F.coalesce("n_bubbles", F.lit(0)) > 0))


def changed_since(exported: DataFrame, current: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Keys whose content isn't what was exported: key, exported and current digest. Keys that only one side has aren't changed."""
    now = current.select(*key, F.col(digest).alias("current"))
    return exported.select(*key, F.col(digest).alias("exported")).join(now, key).filter(~F.col("exported").eqNullSafe(F.col("current")))


def edited_payload(saved: DataFrame, edits: DataFrame, key: list[str], fields: list[str], at: str) -> DataFrame:
    """``saved`` with the fields of ``edits`` (key, fields, at) in their place; other columns stay. edited_at is ``at`` where a field really differs, else as it was."""
    e = edits.select(*(F.col(c).alias(f"_{c}") for c in (*key, *fields, at)))
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"_{k}"))
    found = F.col(f"_{key[0]}").isNotNull()
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    columns = [F.when(found, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in saved.columns if c != "edited_at"]
    return saved.join(e, same, "left").select(*columns, F.when(found & differs, F.col(f"_{at}")).otherwise(F.col("edited_at")).alias("edited_at"))


def as_draft(saved: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """Predictions (key, bubbles, model, drafted_at) as drafts: a saved document keeps its other columns, but its review is void."""
    void = ("reviewed", "edited_at", "imported_key", "imported_at", "rois")
    new = predicted.select(*key, *(F.col(c).alias(f"_{c}") for c in ("bubbles", "model", "drafted_at")))
    joined = new.join(saved, key, "left")
    typed = lambda c: F.lit(None).cast(saved.schema[c].dataType)
    columns = [F.col(f"_{c}").alias(c) if f"_{c}" in new.columns else typed(c).alias(c) if c in void else F.col(c) for c in saved.columns if c != "draft"]
    return joined.select(*columns, F.lit(True).alias("draft"))


def unit_hash(seed: int, key: Column) -> Column:
    """A number in [0, 1] that seed and key name: the first 8 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / float(0xFFFFFFFF)


def hold_out(df: DataFrame, key: str, share: float, seed: int = 0, frame: str | None = None) -> DataFrame:
    """Adds held_out by hash. Fewer than three rows, or a share of 0 or less, hold out nothing. Else, if the hash would hold out nothing, the key with the
    least hash is; if everything, the one with the largest isn't. Rows of one key, and of one ``frame`` if there are three frames or more, go together."""
    if share <= 0:
        return df.withColumn("held_out", F.lit(False))
    name = F.col(key).cast("string")
    sizes = df.agg(F.count(F.lit(1)).alias("n"), *([F.count_distinct(frame).alias("frames")] if frame else []))
    sized = df.crossJoin(F.broadcast(sizes))  # one row
    unit = F.when(F.col("frames") >= 3, F.col(frame).cast("string")).otherwise(name) if frame else name
    hashed = sized.withColumn("_key", unit).withColumn("_u", unit_hash(seed, F.col("_key")))
    me = F.struct("_u", "_key")
    ends = hashed.agg(F.min(me).alias("lo"), F.max(me).alias("hi"))
    joined = hashed.crossJoin(F.broadcast(ends))  # one row
    held = F.when(F.col("n") < 3, F.lit(False)).when(F.col("lo._u") >= share, me == F.col("lo")).when(F.col("hi._u") < share, me != F.col("hi")).otherwise(F.col("_u") < share)
    return joined.select(*df.columns, held.alias("held_out"))


def draft_status(wanted: DataFrame, documents: DataFrame, elsewhere: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """What drafting does with each wanted frame: skip what exists, copy what was reviewed elsewhere, predict the rest.

    documents: key, reviewed, edited (nulls are false). With ``overwrite``, a document that nobody reviewed or edited is drafted anew.
    """
    d = documents.groupBy(F.col(key).alias("_k")).agg(F.bool_or(F.coalesce("reviewed", F.lit(False))).alias("_r"), F.bool_or(F.coalesce("edited", F.lit(False))).alias("_e"))
    e = elsewhere.select(F.col(key).alias("_x")).distinct()
    joined = wanted.join(d, F.col(key) == F.col("_k"), "left").join(e, F.col(key) == F.col("_x"), "left")
    status = (
        F.when(F.col("_r"), "skipped (exists, reviewed)")
        .when(F.col("_e"), "skipped (exists, corrected)")
        .when(F.col("_k").isNotNull() & F.lit(not overwrite), "skipped (exists)")
        .when(F.col("_x").isNotNull(), "copied (reviewed elsewhere)")
        .otherwise("predict")
    )
    return joined.select(*wanted.columns, status.alias("status"))


def to_stage(candidates: DataFrame, stage: DataFrame, key: str) -> DataFrame:
    """Candidates that the stage doesn't hold yet, each key once; what is staged is never overwritten."""
    return candidates.join(stage.select(key), key, "left_anti").dropDuplicates([key])


def next_work(documents: DataFrame, folder: str, name: str) -> DataFrame:
    """The document to open next in each folder: folder, mode, next, n_open.

    A folder with drafts is a results folder: the first unreviewed document is next. Else it holds training frames: the first without bubbles,
    or with an uncorrected draft, is. Where nothing is open, the first document is.
    documents: reviewed, drafted_at, n_bubbles, draft, n_rois.
    """
    no = F.lit(False)
    touched = F.coalesce("reviewed", no) | (F.coalesce("n_rois", F.lit(0)) > 0)
    unreviewed, unfinished = ~F.coalesce("reviewed", no), (F.coalesce("n_bubbles", F.lit(0)) == 0) | (F.coalesce("draft", no) & ~touched)
    per = documents.groupBy(folder).agg(
        F.bool_or(F.col("drafted_at").isNotNull()).alias("results"),
        F.min(name).alias("first"),
        F.min(F.when(unreviewed, F.col(name))).alias("r"),
        F.min(F.when(unfinished, F.col(name))).alias("t"),
        F.count_if(unreviewed).alias("nr"),
        F.count_if(unfinished).alias("nt"),
    )
    results = F.col("results")
    return per.select(folder, F.when(results, "results").otherwise("training").alias("mode"), F.coalesce(F.when(results, F.col("r")).otherwise(F.col("t")), F.col("first")).alias("next"), F.when(results, F.col("nr")).otherwise(F.col("nt")).alias("n_open"))
