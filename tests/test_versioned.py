"""Versioned tables: merges that can be repeated and cut short; derived tables against a full recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from grainflow.sources.versioned import VersionedTable, merge_reviewed, rewrite_polygons
from grainflow.streaming.derived import Derived, frame_rows, run_rows, step_rows, train_rows

ROW = "k int, v string"


def held(table):
    return {r.k: r.v for r in table.read().collect()}


def test_merge(spark, tmp_path):
    """Replaced, new and removed keys; untouched buckets keep their files; old snapshots stay until they are cleaned."""
    table = VersionedTable(spark, f"file://{tmp_path}/t", ["k"], buckets=8)
    assert table.read() is None and table.version() == 0
    rows = lambda items: spark.createDataFrame(list(items.items()), ROW)
    assert table.merge(rows({k: f"a{k}" for k in range(40)})) == 1
    before = table._snapshot()["folders"]
    assert table.merge(rows({3: "b3", 99: "new"}), spark.createDataFrame([(5,), (6,)], "k int")) == 2
    want = {k: f"a{k}" for k in range(40) if k not in (5, 6)} | {3: "b3", 99: "new"}
    assert held(table) == want
    after = table._snapshot()["folders"]
    assert 0 < sum(before[b] == after.get(b) for b in before) < 8
    assert table.merge(rows({})) == 2 and table.add_missing(rows({3: "other", 100: "c"})) == 3
    assert held(table) == want | {100: "c"} and held(VersionedTable(spark, f"file://{tmp_path}/t", ["k"])) == want | {100: "c"}
    assert len(table.clean()) == 2 and held(table) == want | {100: "c"} and table.clean() == []
    one = table.where(spark.createDataFrame([(3,)], "k int"))
    assert [r.v for r in one.collect()] == ["b3"] and 0 < len(one.inputFiles()) <= 2


def test_killed_between_stages(spark, tmp_path, monkeypatch):
    """Data written but no snapshot: the old one stays; the merge done again succeeds. A writer that comes second fails."""
    table = VersionedTable(spark, f"file://{tmp_path}/t", ["k"], buckets=4)
    table.merge(spark.createDataFrame([(1, "a"), (2, "a")], ROW))
    change = spark.createDataFrame([(2, "b"), (3, "b")], ROW)
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            table.merge(change)
    assert held(table) == {1: "a", 2: "a"} and table.version() == 1
    assert table.merge(change) == 2 and held(table) == {1: "a", 2: "b", 3: "b"}
    snapshot = table._snapshot()
    with pytest.raises(RuntimeError, match="start over"):
        table._commit(snapshot)
    assert table.version() == 2


DOC = "frame string, bubbles array<struct<type:string,data:array<array<double>>,fit_kind:string>>, rois array<array<double>>, draft boolean, reviewed boolean, changed timestamp, imported_from string, imported_at double, imported_key string"
NEW = "frame string, bubbles array<struct<type:string,data:array<array<double>>,fit_kind:string>>, rois array<array<double>>, reviewed boolean, changed timestamp, path string"


def square(x):
    return ("ellipse", [[0.0, x], [0.0, x + 4], [4.0, x + 4], [4.0, x]], "circle")


def test_reviewed_documents_are_taken_in(spark, tmp_path):
    """New, own, drafted, empty, edited, excluded and updated frames; twice gives the first result."""
    stage = VersionedTable(spark, f"file://{tmp_path}/stage", ["frame"], buckets=4)
    none = spark.createDataFrame([], "frame string")
    take = lambda rows, out=none: {r.frame: r.action for r in merge_reviewed(stage, spark.createDataFrame(rows, NEW), out, 7.0).collect()}
    new = lambda frame, x: (frame, [square(x)], [], True, None, f"/r/{frame}.json")
    assert take([new("a", 1.0), new("b", 1.0)]) == {"a": "copied", "b": "copied"}
    stage.merge(spark.createDataFrame([("own", [square(9.0)], [], None, None, None, None, None, None), ("draft", [square(9.0)], [], True, None, None, None, None, None), ("empty", [], [], None, None, None, None, None, None)], DOC).select(*stage.read().columns))
    edited = stage.read().filter("frame = 'b'").withColumn("bubbles", F.array(F.struct(*(F.lit(v).alias(n) for n, v in (("type", "ellipse"),)), F.expr("array(array(0.0D, 5.0D))").alias("data"), F.lit("circle").alias("fit_kind"))))
    stage.merge(edited)
    rows = [new("a", 2.0), new("b", 2.0), new("own", 2.0), new("draft", 2.0), new("empty", 2.0), new("c", 2.0), new("gone", 2.0)]
    gone = spark.createDataFrame([("gone",)], "frame string")
    first = take(rows, gone)
    assert first == {
        "a": "updated", "b": "skipped (edited since)", "own": "skipped (own)", "draft": "updated (replaces an uncorrected draft)", "empty": "updated (replaces an empty row)", "c": "copied", "gone": "skipped (excluded)"
    }
    content = lambda: sorted((r.frame, r.bubbles[0].data[0][1], r.imported_at) for r in stage.read().collect())
    assert content() == [("a", 2.0, 7.0), ("b", 5.0, 7.0), ("c", 2.0, 7.0), ("draft", 2.0, 7.0), ("empty", 2.0, 7.0), ("own", 9.0, None)]
    before, version = content(), stage.version()
    second = take(rows, gone)
    assert {second[f] for f in ("a", "draft", "empty", "c")} == {"up to date"} and content() == before and stage.version() == version


def test_polygons_are_rewritten(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/docs", ["frame"], buckets=2)
    polygon = ("polygon", [[0.0, 0.0], [0.0, 8.0], [4.0, 8.0], [4.0, 0.0]], None)
    rows = spark.createDataFrame([("p", [polygon, square(1.0)], [], None, True, None, None, None, None), ("e", [square(1.0)], [], None, True, None, None, None, None)], DOC).withColumn("changed", F.to_timestamp(F.lit("2024-01-02")))
    table.merge(rows)
    assert rewrite_polygons(table, dry_run=True) == 1 and table.version() == 1
    assert rewrite_polygons(table) == 1 and table.version() == 2 and rewrite_polygons(table) == 0
    kinds = {r.frame: [b.fit_kind for b in r.bubbles] for r in table.read().collect()}
    assert kinds == {"p": ["from_polygon", "circle"], "e": ["circle"]} and table.read().select("changed").distinct().count() == 1


CHANGE = "run string, train int, frame string, version int, r array<double>"


def test_derived_tables_follow(spark, tmp_path):
    """After random edits, new and emptied frames, old versions and repeated changes, every table equals its full recomputation."""
    rng = random.Random(6)
    derived, current = Derived(spark, f"file://{tmp_path}/d", buckets=4), {}

    def change(n, version):
        out = {}
        for _ in range(n):
            key = (f"r{rng.randrange(3)}", rng.randrange(5), f"f{rng.randrange(3)}")
            out[key] = (*key, version, [] if rng.random() < 0.2 else [float(rng.randint(1, 20)) for _ in range(rng.randint(1, 5))])
        return list(out.values())

    for version, n in ((1, 40), (2, 5), (4, 2)):
        rows = change(n, version)
        current |= {r[:3]: r for r in rows}
        derived.apply(spark.createDataFrame(rows, CHANGE))
    derived.apply(spark.createDataFrame(rows, CHANGE))
    derived.apply(spark.createDataFrame([(*next(iter(current)), 0, [99.0])], CHANGE))
    bubbles = spark.createDataFrame([(*k, x) for k, r in current.items() for x in r[4]], "run string, train int, frame string, r double")
    frames = frame_rows(bubbles)
    trains = train_rows(frames)
    for table, want in ((derived.frames, frames), (derived.trains, trains), (derived.steps, step_rows(trains)), (derived.runs, run_rows(trains))):
        columns = sorted(want.columns)
        rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())  # noqa: E731,B023
        assert rows(table.read()) == rows(want)
    touched = derived.trains.where(spark.createDataFrame([("r1",)], "run string"))
    assert 0 < len(touched.inputFiles()) < len(derived.trains.read().inputFiles())


def test_derived_tables_follow_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("r0", 0, "f0", 1, [1.0, 3.0]), ("r0", 1, "f0", 1, [2.0])], CHANGE).write.parquet(str(source))
    derived = Derived(spark, f"file://{tmp_path}/d", buckets=2)
    stream = lambda: spark.readStream.schema(CHANGE).parquet(str(source))
    derived.follow(stream(), f"{tmp_path}/state").awaitTermination()
    spark.createDataFrame([("r0", 1, "f0", 2, [4.0])], CHANGE).write.mode("append").parquet(str(source))
    derived.follow(stream(), f"{tmp_path}/state").awaitTermination()
    assert [(r.train, r.r_mean_ratio) for r in derived.steps.read().collect()] == [(1, 2.0)]
