"""Tables that change by whole snapshots: rows of some keys are replaced, everything else stays where it is.

Rows lie in buckets by the hash of their key. A change reads the buckets it touches, writes them anew beside the old ones, and at last a small file that says which
folder holds each bucket. A reader sees one such file or the other, never a part; a run that is killed before leaves folders that nobody refers to. Doing
the same change again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainflow.functions.content import content_key
from grainflow.functions.storage import listed, read_text, remove, settled, write_once
from grainflow.operators.maintenance import merge_actions
from grainflow.sources.shapes import as_ellipses


class VersionedTable:
    """A table at ``path`` with unique ``key``s. ``buckets`` counts at its first snapshot only; ``by``, part of the key, keeps rows together (a run's, say)."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64, by: list[str] | None = None):
        self.spark, self.path, self.key, self.by = spark, path.rstrip("/"), key, by or key
        held = self._snapshot()
        self.buckets = held["buckets"] if held else buckets

    def _snapshot(self) -> dict | None:
        names = [n for n in listed(self.spark, f"{self.path}/snapshots") if n.endswith(".json")]
        return json.loads(read_text(self.spark, f"{self.path}/snapshots/{max(names)}")) if names else None

    def version(self) -> int:
        """The number of the last snapshot, 0 before the first."""
        return (self._snapshot() or {"version": 0})["version"]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def read(self, of: list[int] | None = None) -> DataFrame | None:
        """The rows of the last snapshot, or of some of its buckets; None before the first one."""
        held = self._snapshot()
        return None if held is None else self._rows(held, of)

    def _rows(self, held: dict, of: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(held["schema"])
        paths = [f"{self.path}/data/{folder}/_bucket={b}" for b, folder in held["folders"].items() if of is None or int(b) in of]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def where(self, keys: DataFrame) -> DataFrame:
        """The rows of some values of ``by`` (a column of ``keys`` each), read from their buckets alone."""
        touched = [r[0] for r in keys.select(self.bucket()).distinct().collect()]  # numbers of buckets
        return self.read(touched).join(keys.select(*self.by).distinct(), self.by, "left_semi")

    def merge(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """Replaces the rows of the same keys and adds the others; keys of ``gone`` go. Rows are of one schema and have each key once. Returns the new snapshot's number, the
        old one's where there is nothing to do. Two writers at the same time: the second fails and can start over."""
        held = self._snapshot()
        folder, known = uuid.uuid4().hex, held or {"version": 0, "buckets": self.buckets, "schema": json.loads(rows.schema.json()), "folders": {}}
        leaving = rows.select(*self.key) if gone is None else rows.select(*self.key).unionByName(gone.select(*self.key))
        touched = sorted(r[0] for r in leaving.select(self.bucket()).distinct().collect())  # numbers of buckets
        if not touched:
            return known["version"]
        columns = [f["name"] for f in known["schema"]["fields"]]
        new = rows.select(*columns)
        if held:
            new = new.unionByName(self._rows(held, touched).join(leaving, self.key, "left_anti").select(*columns))
        new.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        written = {n.split("=")[1] for n in listed(self.spark, f"{self.path}/data/{folder}") if n.startswith("_bucket=")}
        folders = {b: f for b, f in known["folders"].items() if int(b) not in touched} | {b: folder for b in written}
        self._commit({**known, "version": known["version"] + 1, "folders": folders})
        return known["version"] + 1

    def _commit(self, snapshot: dict) -> None:
        if not write_once(self.spark, f"{self.path}/snapshots/{snapshot['version']:09d}.json", json.dumps(snapshot)):
            raise RuntimeError(f"snapshot {snapshot['version']} of {self.path} was written by someone else: start over")

    def add_missing(self, rows: DataFrame) -> int:
        """Adds rows whose key isn't there yet; the others stay as they are."""
        held = self.read()
        return self.merge(rows if held is None else rows.join(held.select(*self.key), self.key, "left_anti"))

    def clean(self) -> list[str]:
        """Deletes older snapshots and folders that the last one doesn't refer to. Not while someone reads these or writes."""
        held = self._snapshot()
        last = f"{held['version']:09d}.json" if held else ""
        old = [f"{self.path}/snapshots/{n}" for n in listed(self.spark, f"{self.path}/snapshots") if n != last]
        old += [f"{self.path}/data/{n}" for n in listed(self.spark, f"{self.path}/data") if not held or n not in held["folders"].values()]
        for path in old:
            remove(self.spark, path)
        return old


#: Columns that a training document has for where it came from.
ORIGIN = ["imported_from", "imported_at", "imported_key"]


def merge_reviewed(stage: VersionedTable, incoming: DataFrame, excluded: DataFrame, now: float) -> DataFrame:
    """Takes reviewed documents (frame, bubbles, rois, path and any columns of the stage; a frame once) into the training table and returns frame, action of each.

    Copied and updated ones replace the frame's row, with the content key of what was taken; own and edited rows stay, and so does what is excluded. Actions are those of
    ``merge_actions``. Done twice, the second time everything is up to date.
    """
    new = incoming.withColumn("_key", content_key(F.col("bubbles"), F.col("rois")))
    held = stage.read()
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    if held is None:
        held = new.select("frame", "bubbles", "rois", *(F.lit(None).cast(t).alias(c) for c, t in (("draft", "boolean"), ("reviewed", "boolean"), ("imported_key", "string")))).limit(0)
    own = held.select("frame", content_key(F.col("bubbles"), F.col("rois")).alias("_key"), size("bubbles").alias("n_shapes"), size("rois").alias("n_rois"), "draft", "reviewed", "imported_key")
    actions = new.join(merge_actions(new.select("frame", "_key"), own, excluded, "frame", "_key").drop("_key"), "frame")
    # Settled: what is read afterwards is what was decided before the table changed.
    actions = settled(actions, "merge")
    taken = actions.filter((F.col("action") == "copied") | F.startswith("action", F.lit("updated")))
    rows = taken.withColumns({"imported_from": F.col("path"), "imported_at": F.lit(now), "imported_key": F.col("_key"), "draft": F.lit(None).cast("boolean")}).drop("_key", "action", "path")
    stage.merge(rows)
    return actions.select("frame", "action")


def rewrite_polygons(table: VersionedTable, dry_run: bool = False) -> int:
    """Replaces documents with polygons (frame, bubbles, changed, ...) by the same with ellipses; other columns, the time of change too, stay. Returns how many have polygons."""
    held = table.read()
    found = as_ellipses(held).filter("n_polygons > 0")
    n = found.count()
    if n and not dry_run:
        table.merge(found.drop("n_polygons"))
    return n
