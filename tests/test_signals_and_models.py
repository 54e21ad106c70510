from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.functions import text as tx
from trailmill.operators import boxes as bx
from trailmill.operators import dense
from trailmill.operators import relational as rel
from trailmill.operators import scoring as sc
from trailmill.plans import annotate, models
from trailmill.sources import arrays
from trailmill.sources import datasets as ds


def test_closure_signals():
    rng = np.random.default_rng(4)
    tips, wrist = rng.normal(size=(12, 5, 3)), rng.normal(size=(12, 3))
    seen = np.arange(12) % 4 > 0
    got = dense.closure_signals(tips, wrist, seen)
    scale = np.percentile([np.linalg.norm(tips[t, i] - wrist[t]) for t in range(12) if seen[t] for i in range(5)], 95)
    for t in np.flatnonzero(seen):
        apart = [np.linalg.norm(tips[t, i] - tips[t, 0]) / scale for i in range(1, 5)]
        assert np.isclose(got["thumb_index"][t], apart[0]) and np.isclose(got["thumb_min"][t], min(apart)) and np.isclose(got["thumb_mean"][t], np.mean(apart))
        assert np.isclose(got["curl"][t], np.mean([np.linalg.norm(tips[t, i] - wrist[t]) for i in range(1, 5)]) / scale)
        a = tips[t, 1:] - tips[t, 1:].mean(axis=0)
        w, v = np.linalg.eigh(a.T @ a)
        assert np.isclose(got["opposition"][t], abs((tips[t, 0] - tips[t, 1:].mean(axis=0)) @ v[:, 0]) / scale)
    assert all(np.isnan(v[~seen]).all() for v in got.values())
    gripper = dense.hand_gripper(got["combo"])
    assert gripper.shape == (12,) and np.isfinite(gripper).all() and gripper.min() >= 0 and gripper.max() <= 1
    assert (dense.hand_gripper(np.full(5, np.nan)) == 0).all()


def test_grid_overlap_and_masks():
    inside = dense.grid_overlap([[10, 10], [12, 10]], [[10, 10], [90, 90]])
    assert inside == 0.5 and dense.grid_overlap([], [[1, 1]]) == 0.0 and dense.grid_overlap([[5, 5]], [[5, 5]]) == 1.0
    a, b = np.eye(3, dtype=int), np.ones((3, 3), int)
    assert dense.united_masks([a, b]).all() and dense.united_masks([a, 5 * a], binary=False).max() == 5


def test_oriented_extents():
    rng = np.random.default_rng(5)
    points = rng.uniform([-4, -2, -1], [4, 2, 1], (4_000, 3))
    assert np.allclose(dense.oriented_extents(points), [3.2, 1.6, 0.8], atol=0.1)


def test_box_columns(spark):
    df = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0, [1.0, 2.0, 3.0], [4.0, 6.0], [100.0, 200.0])], "x1 double, y1 double, x2 double, y2 double, v array<double>, f array<double>, p array<double>")
    r = df.select(*bx.normalised(bx.corners(), F.lit(100), F.lit(200)), bx.fixed_row(F.col("v"), 2).alias("two"), bx.fixed_row(F.col("v"), 4).alias("four"), bx.scaled_intrinsics(F.col("f"), F.col("p"), F.lit(0.5), F.lit(2.0)).alias("k")).first()
    assert list(r[:4]) == [100, 100, 300, 200] and r.two == [1.0, 2.0] and np.isnan(r.four).all()
    assert r.k.focal_length == [2.0, 12.0] and r.k.principal_point == [50.0, 400.0]


def test_policies_and_spheres(spark):
    df = spark.createDataFrame([(1, 3, 0.9, 1), (1, 1, 0.2, 4), (1, 2, 0.5, 5)], "g int, t int, overlap double, count int")
    value = lambda p: sc.overlap_policy(df, ["g"], p).first().overlap
    assert value("first") == 0.2 and value("max") == 0.9 and value("top_mean") == 0.9 and np.isclose(value("mean"), (0.9 + 0.8 + 2.5) / 10)
    with pytest.raises(ValueError):
        value("odd")
    one = spark.createDataFrame([(1, 0, 5.0, 5.0, 1.0, 2.0, 3.0)], "g int, pt int, u double, v double, x double, y double, z double")
    assert sc.gripper_spheres(one, ["g"], (0.0, 0.0)).first().radius == 0.05


def test_samples(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)], "g string, i int")
    parts = [{r.i for r in rel.node_share(df.repartition(3), ["i"], 3, k, "g").collect()} for k in range(3)]
    assert parts == [{0, 3, 6}, {1, 4, 7}, {2, 5, 8}]
    once = [r.i for r in rel.shuffled(df, ["i"], 4).collect()]
    assert once == [r.i for r in rel.shuffled(df.repartition(5), ["i"], 4).collect()] and len(once) == 4
    assert once != [r.i for r in rel.shuffled(df, ["i"], 4, seed=1).collect()]


def test_sources(spark, tmp_path):
    assert ds.mixture(["a", {"name": "b"}, "a"]) == ["a", "b"]
    built = []
    build = lambda: built.append(1) or spark.range(3)
    for _ in range(2):
        assert ds.cached_index(spark, str(tmp_path), "x", ["b", "a"], build).count() == 3
    assert ds.cached_index(spark, str(tmp_path), "x", ["a"], build).count() == 3 and len(built) == 2
    parts = {"x": spark.createDataFrame([("1/2", 5)], "trajectory_id string, a int"), "y": spark.createDataFrame([("1/2", 6)], "trajectory_id string, b int")}
    assert {tuple(r) for r in ds.united(parts).select("trajectory_id", "a", "b").collect()} == {("x/1/2", 5, None), ("y/1/2", None, 6)}
    seg = spark.createDataFrame([(1, [(0, "go", 10, 25, 1.5), (1, " ", 25, 60, 3.5), (2, "x", 60, 61, 0.1)])], "ep int, instruction_segments array<struct<subtask_index:int,instruction:string,start_frame:int,end_frame:int,duration_seconds:double>>")
    r = ds.clip_segments(seg, 1.0, 10.0, 4, 1.2, 10.0).collect()
    assert [(x.instruction, x.window_start, x.window_end, x.clip_start, x.clip_end) for x in r] == [("go", 0, 37, 2, 7)]


def test_views_and_nouns(spark):
    df = spark.createDataFrame([("Grab and lift the big Box with care",), ("insert plug on board",), ("hello",), (None,)], "s string")
    assert [r.n for r in df.select(tx.object_noun(F.col("s")).alias("n")).collect()] == ["big box", "plug", None, None]
    have = lambda *v: F.array(*(F.lit(x) for x in v)).cast("array<string>")
    r = spark.range(1).select(tx.chosen_views(have("z"), have("a", "b")).alias("a"), tx.chosen_views(have("b", "b", "a", "c"), have("a", "b", "c")).alias("b")).first()
    assert r.a == ["a"] and r.b == ["b", "a"]


def test_detector_stage_is_the_model(spark):
    images = [(i, bytes([i] * 9)) for i in range(10)]
    rows = models.detections(spark.createDataFrame(images, "key int, image binary").repartition(3), ["cup", "arm"], 0.2, batch=3).collect()
    want = models.BoxDetector().detect([b for _, b in images], ["cup", "arm"], 0.2)
    assert sorted(tuple(r) for r in rows) == sorted((i, *box) for (i, _), found in zip(images, want) for box in found)


def test_stand_ins():
    mask = models.BoxSegmenter().segment(b"", [(1, 2, 3, 4)])[0]
    assert dense.mask_box(mask) == (1, 2, 3, 4)
    tracks, seen = models.StillTracker().track([b""] * 3, [(1, 2), (3, 4)])
    assert tracks.shape == (3, 2, 2) and seen.all()
    cloud = models.FlatDepth().lift([b""], None)[0]
    assert models.lifted([[5.4, 6.6], [-3, 900]], cloud).tolist() == [[5, 7, 1], [0, 47, 1]]
    assert models.WordVerifier().verify("cup cup", None) == "**verdict: yes**"


def test_bundles(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], "d")], "i int, v array<double>, dataset string")
    bundled = df.select("i", "dataset", F.create_map(F.lit("centroid_traces"), arrays.tensor("centroid_traces", F.col("v"), [2, 2])).alias("m"))
    arrays.write_bundles(bundled, str(tmp_path / "b"))
    entry = spark.read.parquet(str(tmp_path / "b")).first().m["centroid_traces"]
    assert entry.dtype == "float16" and arrays.unpack(entry.asDict()).tolist() == [[1, 2], [3, 4]]
    back = arrays.bundle_of_text(arrays.bundle_text(bundled, "m"), "blob").first().arrays
    assert arrays.unpack(back["centroid_traces"].asDict()).tolist() == [[1, 2], [3, 4]]


def test_whole_plan(spark):
    frames = [("a", t, float(v)) for t, v in enumerate([1.0] * 30 + [0.0] * 30 + [1.0] * 30)]
    from trailmill.operators.phases import detect_phases

    windows = annotate.windows_of(detect_phases(spark.createDataFrame(frames, "traj string, t int, v double"), "traj", "t", "v"), "traj")
    found = spark.createDataFrame([("a", 0, 0, 0.0, 0.0, 10.0, 10.0, 0.9), ("a", 0, 1, 0.5, 0.0, 10.5, 10.0, 0.8), ("a", 0, 2, 50.0, 50.0, 70.0, 60.0, 0.5), ("a", 0, 3, 0.0, 0.0, 199.0, 119.0, 1.0)], "traj string, subtask int, idx int, x1 double, y1 double, x2 double, y2 double, conf double")
    chosen = annotate.candidates(found, ["traj", "subtask"], 200, 120)
    assert {(r.idx, r.cand) for r in chosen.collect()} == {(0, 1), (2, 0)}
    signals = spark.createDataFrame([("a", 0, 0, 5.0, 1.0, 0.0, 0.1), ("a", 0, 1, 1.0, 0.0, 1.0, 0.0)], "traj string, subtask int, cand int, snr double, sphere double, overlap double, depth_gap double")
    rows = annotate.annotated(windows, chosen, signals, "traj", F.lit("set"), F.lit("Pick"))
    line = json.loads(rows.first().line)
    assert rows.count() == 1 and line["selection"]["selected_candidate_index"] == 0 and line["window"] == {"start_frame": 0, "end_frame_exclusive": 90}
