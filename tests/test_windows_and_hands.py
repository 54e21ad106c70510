from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.operators import hands, windows
from trailmill.plans import annotate
from trailmill.plans import publication as pub
from trailmill.plans import published
from trailmill.sources import annotations as an

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0, w) * max(0, h)
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return inter / (area(a) + area(b) - inter)


def loop_phases(own, shared, fps=10.0):
    """Contact phases of one trajectory, frame by frame."""
    boxes = [o or s for o, s in zip(own, shared)]
    held = [b is not None for b in boxes]
    n, gap, least = len(boxes), max(1, round(0.25 * fps)), max(1, round(0.3 * fps))
    for value in (False, True):
        start = 0
        for i in range(1, n + 1):
            if i == n or held[i] != held[start]:
                if held[start] == value and i - start < gap:
                    held[start:i] = [not value] * (i - start)
                start = i
                # Runs are those of the signal as it was, so what was just filled is not joined.
    out, i = [], 0
    while i < n:
        if not held[i]:
            i += 1
            continue
        j = i
        while j < n and held[j]:
            j += 1
        cuts, before = [i], None
        for t in range(i, j):
            if boxes[t]:
                if before and iou(before, boxes[t]) < 0.1:
                    cuts.append(t)
                before = boxes[t]
        for a, b in zip(cuts, [*cuts[1:], j]):
            known = [boxes[t] for t in range(a, b) if boxes[t]]
            if b - a >= least and known:
                out.append((a, b, known[0], known[-1], round(len(known) / (b - a), 6)))
        i = j
    return out


def test_hand_phases_against_a_loop(spark):
    rng = random.Random(17)
    rows, want = [], {}
    for k in range(25):
        n, own, shared, at = rng.randint(1, 90), [], [], 0.0
        while len(own) < n:
            kind, length = rng.choice(["own", "shared", "none", "jump"]), rng.randint(1, 14)
            at += 60 if kind == "jump" else 0
            for _ in range(length):
                box = (at, 0.0, at + 20, 20.0)
                own.append(box if kind in ("own", "jump") else None)
                shared.append(box if kind == "shared" else None)
        own, shared = own[:n], shared[:n]
        rows += [(k, t, own[t], shared[t]) for t in range(n)]
        want[k] = loop_phases(own, shared)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"traj int, t int, own {BOX}, shared {BOX}")
    got = {k: [] for k in want}
    for r in hands.interactions(df, ["traj"], "own", "shared", 10.0).collect():
        got[r.traj].append((r.start_frame, r.end_frame, tuple(r.first_box), tuple(r.last_box), round(r.coverage, 6)))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_quality_and_roles(spark):
    b = lambda x: (float(x), 0.0, float(x) + 10, 10.0)
    rows = [("left", 5, 20, b(0), 1.0), ("left", 21, 30, b(0), 0.5), ("right", 10, 15, b(50), 1.0), ("right", 25, 40, b(1), 1.0), ("both", 60, 70, b(0), 1.0)]
    df = spark.createDataFrame([(1, *r) for r in rows], f"traj int, hand string, start_frame int, end_frame int, first_box {BOX}, coverage double").withColumn("hand_iou", F.lit(None).cast("double"))
    judged = {(r.hand, r.start_frame): (r.open_before, r.open_after, r.is_clean) for r in hands.quality(df.withColumn("hand_iou", F.lit(0.2)), ["traj", "hand"], F.lit(100), 10.0).collect()}
    assert judged["left", 5] == (5, 1, True) and judged["left", 21] == (1, 70, False) and judged["both", 60] == (60, 30, True)
    assert not any(r.is_clean for r in hands.quality(df, ["traj", "hand"], F.lit(100), 10.0).collect())
    roles = {(r.hand, r.start_frame): r.role for r in hands.paired(df, ["traj"]).collect()}
    assert roles == {("left", 5): "two_object", ("left", 21): "single", ("right", 10): "two_object", ("right", 25): "single", ("both", 60): "shared"}


def test_hand_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, -1.0, -1.0, -1.0, -1.0], [0.0, 0.0], [[0.0, 0.0]] * 4 + [[2.0, 4.0]] + [[0.0, 0.0]] * 3 + [[4.0, 8.0]])], "info array<double>, block array<double>, points array<array<double>>")
    r = df.select(hands.box_or_null(F.col("info"), 1).alias("a"), hands.box_or_null(F.col("info"), 5).alias("b"), hands.tracked(F.col("block")).alias("t"), hands.grasp_centre(F.col("points")).alias("c")).first()
    assert tuple(r.a) == (1, 2, 3, 4) and r.b is None and r.t is False and r.c == [3.0, 6.0]


def test_storyboard_and_mode(spark):
    from trailmill.operators.sequences import episodes

    phases = [(0, 10, "grasp"), (11, 20, "interact"), (21, 25, "release"), (26, 35, "grasp"), (36, 45, "interact"), (46, 50, "release")]
    df = spark.createDataFrame([("a", *p) for p in phases] + [("b", *p) for p in phases[:3]], "traj string, start_frame int, end_frame int, phase string")
    frames = {(r.traj, r.episode): r.frame for r in windows.storyboard(episodes(df, ["traj"]), ["traj"]).collect()}
    assert frames == {("a", 0): 15, ("a", 1): 40, ("b", 0): 15}
    assert {r.traj: r.mode for r in windows.parsing_mode(df, ["traj"]).collect()} == {"a": "semantic", "b": "text"}


def test_detection_keyframe(spark):
    kind = "array<struct<start_frame:int,end_frame:int,phase:string>>"
    df = spark.createDataFrame([([(30, 50, "grasp"), (51, 98, "interact")],), ([(30, 50, "interact")],)], f"p {kind}")
    got = [r.k for r in df.select(windows.keyframes(F.col("p"), F.lit(0), F.lit(99), F.lit(100)).alias("k")).collect()]
    assert got == [[0, 25, 50, 97], [0, 0, 49]]
    shifted = df.select(windows.keyframes(F.col("p"), F.lit(10), F.lit(99), F.lit(89)).alias("k")).first().k
    assert shifted[1] == 20


@pytest.mark.parametrize("n,last", [(1, 0), (2, 9), (5, 9), (8, 3), (7, 100), (1, 7)])
def test_linspace(spark, n, last):
    got = spark.range(1).select(windows.linspace(F.lit(n), F.lit(last)).alias("x")).first().x
    assert got == list(dict.fromkeys(np.linspace(0, last, n, dtype=int).tolist()))


def test_budget_keeps_what_is_required(spark):
    df = spark.createDataFrame([([5, 1], list(range(20)), "a"), ([1, 2, 3, 4], [7, 8], "b"), ([], [1, 2], "c")], "need array<int>, opt array<int>, k string")
    got = {r.k: r.x for r in df.select("k", windows.within_budget(F.col("need"), F.col("opt"), 4).alias("x")).collect()}
    assert got == {"a": [0, 1, 5, 19], "b": [1, 2, 3, 4], "c": [1, 2]}


def test_published_rows_need_their_source(spark):
    schema = "dataset_id string, trajectory_id string, subtask_index int, camera_view string, start_frame int, end_frame int, instruction string, selection struct<score:double>"
    rows = [("d", "t/1", 0, "top", 3, 9, "Pick it", (1.0,)), ("d", "t/1", 0, "side", 3, 9, None, None)]
    got = pub.published_rows(spark.createDataFrame(rows, schema)).collect()
    assert len({r.annotation_id for r in got}) == 2 and all(r.annotation_id.startswith("sha256:") for r in got)
    assert '"instruction"' not in got[1].line and '"selection"' not in got[1].line
    kept = an.reliable(an.published(an.parsed(spark.createDataFrame(got), "line"), strict=True), 0.95)
    assert kept.count() == 1
    for bad in (("d", "", 0, "x", 1, 2, "i", None), (None, "t", 0, "x", 1, 2, "i", None)):
        with pytest.raises(Exception, match="lacks"):
            pub.published_rows(spark.createDataFrame([bad], schema)).collect()


def test_rebased_paths(spark):
    lines = ['{"arrays":{"storage":{"path":"arts/shard.h5","group":"a"}}}', '{"arrays":{"storage":{"path":"/abs/x.h5"}}}', '{"selection":{"score":1}}']
    got = [r.line for r in an.rebased(spark.createDataFrame([(x,) for x in lines], "line string"), "line", "../in/").collect()]
    assert got == [lines[0].replace("arts/", "../in/arts/"), *lines[1:]]


def test_records_are_shuffled_once(spark):
    """Where all subtasks are one number, records are grouped and joined in one place."""
    keys = "cast(id as string) as trajectory_id", "0 as subtask_index"
    annotations = spark.range(9).selectExpr("'d' as dataset_id", *keys, "cast(null as string) as camera_view", "0 as start_frame", "9 as end_frame", "'x' as instruction")
    objects = spark.range(9).selectExpr(
        *keys, "'left' as arm", "'cup' as label", "cast(null as string) as instance_id", "cast(null as string) as relation_to_previous", "1L as detection_frame", "array(1D) as initial_box", "0.5D as initial_score",
        "cast(null as array<double>) as target_box", "cast(null as double) as target_score", "true as verified", "cast(null as map<bigint,array<double>>) as intermediate", "0L as selected", "struct('m' as method) as selection",
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = published.assembled(annotations, objects)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4
        assert out.count() == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_arms_candidates_bring_their_signals(spark):
    """Winners by arm without a join of the candidates with themselves."""
    windows = spark.createDataFrame([(1, 0, 0, 9)], "traj bigint, subtask int, start_frame bigint, end_frame bigint")
    rows = [(1, 0, arm, k, 0.0, 0.0, 5.0, 5.0, 0.5, "cup", float(k), 1.0, 0.0, 0.0) for arm in ("left", "right") for k in range(3)]
    found = spark.createDataFrame(rows, "traj bigint, subtask int, arm string, cand bigint, x1 double, y1 double, x2 double, y2 double, conf double, label string, snr double, sphere double, overlap double, depth_gap double")
    (line,) = annotate.annotated_arms(windows, found, None, "traj", F.lit("d"), F.lit("Pick it")).collect()
    assert [(a["arm"], a["selection"]["selected_candidate_index"]) for a in json.loads(line.line)["arms"]] == [("left", 2), ("right", 2)]


def _whole(spark, subtask):
    """Parts of nine annotations, partitioned by trajectory; the last has an annotation only."""
    ids = spark.range(9).repartition("id")
    some = ids.where("id < 8")
    keys = "id as trajectory_id", f"{subtask} as subtask_index"
    annotations = ids.selectExpr("'d' as dataset_id", *keys, "cast(null as string) as camera_view", "10L as start_frame", "50L as end_frame", "'x' as instruction")
    objects = some.selectExpr("id", "explode(if(id % 2 = 0, array(cast(null as string)), array('right', 'left'))) as arm").selectExpr(
        *keys, "arm", "'cup' as label", "cast(null as string) as instance_id", "cast(null as string) as relation_to_previous", "1L as detection_frame", "array(1D) as initial_box", "0.5D as initial_score",
        "cast(null as array<double>) as target_box", "cast(null as double) as target_score", "true as verified", "map(7L, array(1D), 3L, array(2D), 5L, null) as intermediate", "1L as selected", "struct('m' as method) as selection",
    )
    phases = some.selectExpr("id", "inline(array(('interact', 20L, 30L), ('grasp', 10L, 19L))) as (phase, start_frame, end_frame)").select(*map(F.expr, keys), "phase", "start_frame", "end_frame")
    marks = "array(('release', 40L), ('release', 40L), ('interact', 30L), ('grasp', 30L), ('detection', 1L))"
    keyframes = some.selectExpr("id", f"inline({marks}) as (name, frame)").selectExpr(*keys, "name", "frame")
    lines = some.selectExpr("id", "explode(if(id % 2 = 0, array(cast(null as string)), array('left', 'right'))) as arm")
    found = "array(('initial', 2L, 0.5D), ('initial', 1L, 0.5D), ('initial', 0L, double('nan')), ('target', 3L, 0.1D))"
    candidates = lines.selectExpr("id", "arm", f"inline({found}) as (kind, cand, conf)").selectExpr(*keys, "arm", "kind", "cand", "array(conf) as box", "conf", "cand + 100 as source")
    points = "array((1L, 12L, 1D, 2D), (1L, 11L, 3D, 4D), (1L, 13L, cast(null as double), 4D), (0L, 11L, 9D, 9D))"
    traces = lines.selectExpr("id", "arm", f"inline({points}) as (cand, frame, x, y)").selectExpr(*keys, "arm", "cand", "frame", "x", "y")
    arrays = some.selectExpr(*keys, "'masks' as name", "concat('m/', id) as path", "'uint8' as dtype", "array(1, 2) as shape")
    return published.assembled(annotations, objects, phases, keyframes, candidates, traces, arrays)


@pytest.mark.parametrize("subtask", ["0", "cast(id % 2 as int)"])
def test_whole_rows(spark, subtask):
    rows = {r["source"]["trajectory_id"]: r for r in (json.loads(x.line) for x in _whole(spark, subtask).collect())}
    assert sorted(rows) == [str(i) for i in range(9)]
    assert not {"object", "arms", "arrays", "phases"} & {*rows["8"], *rows["8"]["task"]}
    one, two = rows["2"], rows["3"]
    assert [(p["type"], p["start_frame"], p["end_frame_inclusive"]) for p in one["task"]["phases"]] == [("grasp", 10, 19), ("grasp", 30, 30), ("interact", 20, 30), ("release", 40, 40)]
    assert one["arrays"] == {"masks": {"path": "m/2", "dtype": "uint8", "shape": [1, 2]}}
    assert "arms" not in one and "object" not in two and [a["arm"] for a in two["arms"]] == ["left", "right"]
    for r in (one, *two["arms"]):
        assert r["object"]["track"] == {"xy_pixels": [[3.0, 4.0], [1.0, 2.0]], "frame_indices": [11, 12]}
        assert [e["frame_index"] for e in r["object"]["intermediate"]] == [13, 17] and r["object"]["target"]["frame_index"] == 49
        found = r["baselines"]["detector"]
        assert (found["initial"]["tracked_candidate_index"], found["initial"]["source_detection_index"], found["target"]["candidate_index"]) == (1, 101, 3)


def test_parts_in_their_place_are_not_shuffled(spark):
    """Parts that come partitioned by trajectory are grouped and joined where they are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _whole(spark, "0")._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan and "ENSURE_REQUIREMENTS" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
