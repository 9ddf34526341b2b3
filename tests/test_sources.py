"""Sources, sinks and streams, on files that the tests write."""

import json

import pytest
from pyspark.sql import functions as F

from grainflow.sources import results, shapes
from grainflow.streaming.refresh import current, refresh, windowed_metrics


def test_shape_documents(spark, tmp_path):
    (tmp_path / "r562_svd_tr050_tid0_010.json").write_text(json.dumps({"reviewed": True, "rois": [], "bubbles": [{"type": "ellipse", "data": [[0, 0], [0, 8], [4, 8], [4, 0]], "fit_kind": "ellipse"}, {"type": "polygon", "data": [[0, 0], [1, 1], [1, 0]]}]}))
    (tmp_path / "odd.json").write_text(json.dumps({"frame_path": "/raw/r7_tid2_003.tif", "bubbles": []}))
    docs = shapes.read_shapes(spark, f"{tmp_path}/*.json")
    keys = {(r.run, r.train, r.frame_idx) for r in docs.collect()}
    assert keys == {("r562", 0, 10), ("r007", 2, 3)}
    rows = shapes.bubbles_of(docs).collect()
    assert len(rows) == 1 and rows[0].bubble_id == 0 and (rows[0].x, rows[0].y) == (4, 2) and rows[0].r_eq_um == pytest.approx(8**0.5 * 3.2)


def test_frame_files(spark, tmp_path):
    for name in ("jpg_r1/r1_tid0_001.jpg", "jpg_r1/r1_tid0_002.jpg", "jpg_r1/notes.jpg", "jpg_r1_annotated/r1_tid0_001.jpg", "jpg_r2/r2_tid0_001.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    frames = shapes.list_frames(spark, str(tmp_path))
    assert frames.count() == 3 and shapes.list_frames(spark, str(tmp_path), runs=["r002"]).count() == 1
    assert {r.run: (r.trains, r.n_frames) for r in shapes.describe_index(frames).collect()} == {"r001": ([0], 2), "r002": ([0], 1)}
    twice = frames.unionByName(frames.withColumn("path", F.concat("path", F.lit("2"))))
    with pytest.raises(Exception, match="several files"):
        shapes.index_frames(twice).collect()


def test_frames_tables_of_both_layouts(spark, tmp_path):
    new, old, empty = tmp_path / "new.csv", tmp_path / "old.csv", tmp_path / "empty.csv"
    new.write_text("frame,run,train,frame_idx,reviewed,n_bubbles,n_in_analysis,image_height_px,image_width_px,model,shapes_key\nr5_tid0_001,r005,0,1,True,3,2,250,400,m,0123456789012345\n")
    old.write_text("frame,train,frame_idx,reviewed,n_bubbles,n_in_analysis,image_height_px,image_width_px,model\nr6_tid1_001,1,1,False,4,4,250,400,m\n")
    empty.write_text("")
    out = shapes.read_all_frames(spark, [str(new), str(old), str(empty)])
    assert {(r.run, r.n_bubbles, r.shapes_key) for r in out.collect()} == {("r005", 3, "0123456789012345"), ("r006", 4, None)}
    shapes.write_table(out, f"{tmp_path}/out", by=["run"])
    assert spark.read.parquet(f"{tmp_path}/out").filter("run = 'r006'").count() == 1


def test_refresh_twice(spark, tmp_path):
    source, target, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    first = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5)], "k string, version int, v int")
    first.write.parquet(str(source))
    stream = lambda: spark.readStream.schema(first.schema).parquet(str(source))
    refresh(stream(), str(target), ["k"], "version", str(state)).awaitTermination()
    spark.createDataFrame([("b", 3, 7), ("c", 1, 1)], first.schema).write.mode("append").parquet(str(source))
    refresh(stream(), str(target), ["k"], "version", str(state)).awaitTermination()
    assert {(r.k, r.v) for r in current(spark, str(target), ["k"], "version").collect()} == {("a", 20), ("b", 7), ("c", 1)}


def test_windowed_metrics(spark):
    rows = [("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:20:00", "x", 3.0), ("2024-01-01 01:20:00", "x", 2.0)]
    df = spark.createDataFrame(rows, "ts string, g string, v double").withColumn("ts", F.to_timestamp("ts"))
    out = windowed_metrics(df, "ts", ["g"], "v").orderBy("start").collect()
    assert [(r.n, r.r_mean, r.r32) for r in out] == [(2, 2.0, 2.8), (1, 2.0, 2.0)]


def test_bubbles_tables(spark, tmp_path):
    new, old, empty = tmp_path / "new.csv", tmp_path / "old.csv", tmp_path / "empty.csv"
    new.write_text("frame,run,train,frame_idx,reviewed,bubble_id,x,edge_truncated,fit_kind,in_analysis,r_eq_um\nr5_tid0_001,r005,0,1,True,0,1.5,False,mask,True,7.25\n")
    old.write_text("frame,train,frame_idx,bubble_id,x\nr6_tid1_001,1,1,3,\n")
    empty.write_text("")
    a, b = results.read_bubbles_csv(spark, str(new)).first(), results.read_bubbles_csv(spark, str(old)).first()
    assert (a.run, a.reviewed, a.x, a.edge_truncated, a.fit_kind, a.r_eq_um) == ("r005", True, 1.5, False, "mask", 7.25) and (b.run, b.bubble_id, b.x) == ("r006", 3, None)
    assert results.read_bubbles_csv(spark, str(empty)).count() == 0


def test_folders_and_sets(spark, tmp_path):
    for name, text in (("r5/bubbles.csv", "frame\n"), ("r7_set/frames.csv", "frame,run\nr12_tid0_001,r012\nr5_tid3_001,r005\nr5_tid4_001,r005\n"), ("r8_set/shapes/r8_tid0_001.json", "{}"), ("_sets/bubbles.csv", "frame\n"), ("notes/a.csv", "x\n"), ("r7_set/bubbles.csv", "frame\n"), ("r5/deep/bubbles.csv", "frame\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {(r.folder, r.has_table, r.has_shapes) for r in results.result_folders(spark, str(tmp_path)).collect()} == {("r5", True, False), ("r7_set", True, False), ("r8_set", False, True)}
    assert results.result_folders(spark, str(tmp_path), ["r5"]).count() == 1
    assert {r.set: r.runs for r in results.discover_sets(spark, str(tmp_path)).collect()} == {"r7_set": ["r005", "r012"], "r8_set": ["r008"]}


def test_logs_settings_and_findings(spark, tmp_path):
    for k in range(2):
        results.log_run(spark, f"{tmp_path}/log", "r5", {"model": f"m{k}"}, [("r5", k)])
    row = shapes.latest_run_info(spark.read.parquet(f"{tmp_path}/log"), ["folder"]).first()
    assert json.loads(row["info"]) == {"model": "m1"} and row.selections == [["('r5', 0)"], ["('r5', 1)"]]
    results.write_settings(spark, {"a": 1}, f"{tmp_path}/settings")
    assert json.loads(spark.read.text(f"{tmp_path}/settings").first()[0]) == {"a": 1}
    text = results.findings_text([("Data", "3 runs"), ("Data", "word " * 30), ("Steps", "none")], "TITLE").split("\n")
    assert text[0] == text[-1] == "=" * len(text[1]) and text[1].startswith("| TITLE") and sum("[Data]" in x for x in text) == 1 and len(text) == 11
    results.write_findings(spark, [("Data", "3 runs")], f"{tmp_path}/findings", "T")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/findings").collect()] == results.findings_text([("Data", "3 runs")], "T").split("\n")


def test_analyses(spark):
    from grainflow.plans.analyses import RunComparison, SetTimeline

    frames = spark.createDataFrame([(f"r{run}", t, f"r{run}_{t}", t != 9, 250, 400) for run in (1, 2) for t in range(10)], "run string, train long, frame string, reviewed boolean, image_height_px int, image_width_px int")
    rows = [(f"r{run}", t, f"r{run}_{t}", float(3 + (k * 7 + t) % 11), 30.0, float(k), float(k), 4.0, 3.0, False, k % 9 > 0) for run in (1, 2) for t in range(10) for k in range(60 - 5 * t if run == 1 else 40)]
    bubbles = spark.createDataFrame(rows, "run string, train long, frame string, r_eq_um double, area_um2 double, x double, y double, major_axis double, minor_axis double, edge_truncated boolean, in_analysis boolean")
    out = RunComparison(least=20, exclude=spark.createDataFrame([("r2", 0)], "run string, train long")).tables(bubbles, frames)
    per_frame = out["frame_metrics"]
    assert {(r.run, r.train) for r in per_frame.collect()} == {("r1", t) for t in range(8)} | {("r2", t) for t in range(1, 9)} and out["sparse"].count() == 1
    assert out["steps"].filter("d IS NULL OR p IS NULL").count() == 0 and out["steps"].count() == 14
    assert out["trends"].count() == 21 and out["variance"].count() > 0 and out["outliers"].count() == 14 and all(df.count() >= 0 for df in out.values())
    ranges = spark.createDataFrame([(1, "r1", 0, "r1", 7), (2, "r1", 0, "r9", 1)], "range_id int, start_run string, start_train long, end_run string, end_train long")
    times = SetTimeline(15.0, 60.0).tables(per_frame.withColumn("set", F.lit("a")), ranges)
    decays = {r.range_id: r for r in times["decays"].collect()}
    assert decays[1].n_points == 8 and decays[1].tau > 0 and decays[2].note == "no frame for r9 t1" and times["lines"].count() == 2 and times["jumps"].count() == 3 and times["trend"].count() == 1
    assert times["equal_decays"].first().n == 1
    wide = RunComparison(least=20, image=(250, 400)).tables(bubbles.withColumns({"bubble_id": F.col("x"), "semi_major": F.lit(3.0), "semi_minor": F.lit(2.0), "angle_deg": F.lit(0.0)}), frames)
    assert wide["frame_metrics"].filter("coverage > 0 AND clark_evans > 0").count() == wide["frame_metrics"].count() and wide["steps"].filter("coverage_change IS NULL").count() == 0


def test_aligned_runs_and_train_frames(spark):
    from grainflow.plans.analyses import AlignedRuns, TrainFrames

    counts = {"a": [10, 10, 30, 20], "b": [5, 4, 4, 3]}
    per_train = spark.createDataFrame([(r, t, n, 5.0 + t, 100.0 * n) for r, ns in counts.items() for t, n in enumerate(ns)], "run string, train int, n int, r_mean double, volume double")
    out = AlignedRuns().tables(per_train, layers=spark.createDataFrame([("a", 3), ("b", 3)], "run string, train int"))
    assert {r.run: r.event for r in out["events"].collect()} == {"a": 2, "b": None}
    assert [(r.x, r.n_rel) for r in out["aligned"].orderBy("x").collect()] == [(-2, 10 / 30), (-1, 10 / 30), (0, 1.0), (1, 20 / 30)]
    differ = out["layers_differ"].first()
    assert differ.n1 == 2 and differ.u == 12 and out["before_after"].count() > 0 and out["drifts"].count() == 2
    frames = spark.createDataFrame([("r1", 0, f"f{k}", k, 250, 400) for k in range(12)], "run string, train int, frame string, frame_idx int, image_height_px int, image_width_px int")
    rows = [("r1", 0, f"f{k}", 5.0 + k + j, 30.0, 10.0 * j + k, 7.0, 4.0, 3.0, False) for k in range(12) for j in range(4)]
    bubbles = spark.createDataFrame(rows, "run string, train int, frame string, r_eq_um double, area_um2 double, x double, y double, major_axis double, minor_axis double, edge_truncated boolean")
    out = TrainFrames(0.886, snapshots=4).tables(bubbles, frames)
    m = {r.frame_idx: r for r in out["frame_metrics"].collect()}
    assert m[3].t == pytest.approx(3 * 0.886) and m[3].r_mean_smooth == pytest.approx(9.5) and m[3].r_mean_relative == pytest.approx(9.5 / 6.5)
    assert sorted(r.frame_idx for r in out["snapshots"].collect()) == [0, 4, 7, 11] and out["cdfs"].count() == 16
    assert {r.frame: (r.from_0, r.from_10) for r in out["size_classes"].collect()}["f3"] == (2, 2) and out["drift"].first().net == pytest.approx(11 * 3.2)
    assert all(df.count() > 0 for name, df in out.items() if name != "scaled") and out["scaled"].count() >= 0


def test_times(spark):
    from grainflow.operators.sequence import with_time

    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "run string, train int")
    read = lambda out: {(r.run, r.train): r.t for r in out.collect()}
    assert read(with_time(df)) == {("a", 1): 1.0, ("a", 2): 2.0, ("b", 1): 1.0}
    assert read(with_time(df, spark.createDataFrame([(1, 7.5)], "train int, t double"))) == {("a", 1): 7.5, ("a", 2): None, ("b", 1): 7.5}
    per_run = spark.createDataFrame([("a", 1, 3), ("b", 1, 4)], "run string, train int, t int")
    assert read(with_time(df, per_run)) == {("a", 1): 3.0, ("a", 2): None, ("b", 1): 4.0}
    with pytest.raises(Exception, match="no time for a 2"):
        with_time(df, per_run, strict=True).collect()
