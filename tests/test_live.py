from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trailmill.operators.phases import calibrated, calibrations, detect_phases, gripper_phases
from trailmill.streaming import ingest, live

SCHEMA = "traj string, t int, at timestamp, v double, done boolean"


def replayed(signal, hysteresis=0.1):
    c = calibrated(np.asarray(signal, float), hysteresis=hysteresis)
    m = live.Machine(c.low, c.high, c.shortest, c.valid_from, c.flat, hysteresis)
    out, held = [], 0
    for v in signal:
        out += m.push(v)
        held = max(held, len(m.held))
    return out + m.close(), held


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.1, 0.45, 0.55, 0.6, 0.65, 0.75, 1.0]), st.integers(1, 30)), min_size=1, max_size=25), st.sampled_from([0.05, 0.1]))
def test_frame_by_frame_equals_the_whole_signal(parts, hysteresis):
    signal = [v for v, n in parts for _ in range(n)]
    got, held = replayed(signal, hysteresis)
    assert got == gripper_phases(np.array(signal), hysteresis=hysteresis) and held <= 2


def test_noise_equals_the_whole_signal():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 10, 11, 50, 400):
        for _ in range(60):
            signal = np.clip(np.repeat(rng.random(n), rng.integers(1, 12))[:n] + rng.normal(0, 0.05, n), 0, 1)
            assert replayed(signal)[0] == gripper_phases(signal)


def at(seconds):
    return f"2024-01-01 {seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"


def run(spark, tmp_path, batches, told=None, **more):
    """Streams the batches, one file each, with a restart halfway."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [batches[: len(batches) // 2], batches[len(batches) // 2 :]]
    for part in parts:
        for rows in part:
            spark.createDataFrame([(k, t, at(s), v, d) for k, t, s, v, d in rows], SCHEMA.replace("timestamp", "string")).selectExpr("traj", "t", "cast(at as timestamp) at", "v", "done").coalesce(1).write.mode("append").parquet(source)
        with live.rocksdb_state(spark):
            stream = ingest.frame_stream(spark, source, SCHEMA, files_per_batch=1)
            ingest.run_to_end(stream, out, str(tmp_path / "ck"), shape=lambda s: live.phases_as_they_close(s, "traj", "t", "at", "v", "done", told, **more))
    got = {}
    for r in spark.read.parquet(out).collect():
        got.setdefault(r.traj, []).append((r.start_frame, r.end_frame, r.phase))
    return {k: sorted(v) for k, v in got.items()}


def signals():
    rng = np.random.default_rng(6)
    return {k: np.repeat(rng.random(9), 7).round(3) for k in ("a", "b", "c")}


def test_batches_of_seven_with_a_restart_equal_the_table(spark, tmp_path):
    rows = {k: [(k, t, t, float(v), t == len(x) - 1) for t, v in enumerate(x)] for k, x in signals().items()}
    table = spark.createDataFrame([(k, t, float(v)) for k, x in signals().items() for t, v in enumerate(x)], "traj string, t int, v double")
    told = calibrations(table, "traj", "t", "v")
    batches = [sum((r[i : i + 7] for r in rows.values()), []) for i in range(0, 63, 7)]
    # Frames of neighbouring batches change places; the watermark waits for them.
    rng = random.Random(2)
    for one, two in zip(batches, batches[1:], strict=False):
        i, j = rng.randrange(len(one)), rng.randrange(len(two))
        one[i], two[j] = two[j], one[i]
    batches.append([("a", 5, 5, 0.0, False), ("b", 62, 62, 0.0, True)])  # repeats of frames of trajectories that have ended
    got = run(spark, tmp_path, batches, told)
    want = {}
    for r in detect_phases(table, "traj", "t", "v").collect():
        want.setdefault(r.traj, []).append((r.start_frame, r.end_frame, r.phase))
    assert got == {k: sorted(v) for k, v in want.items()}


def test_a_timer_ends_what_has_no_end_mark(spark, tmp_path):
    x = [1.0] * 12 + [0.0] * 15 + [1.0] * 20
    frames = [("a", t, t, v, False) for t, v in enumerate(x) if t != 20]  # one frame is lost
    other = lambda s: ("z", s, s, 0.5, False)  # noqa: E731  another trajectory moves the watermark on
    got = run(spark, tmp_path, [frames[:10], frames[30:], frames[10:30], [other(300)], [other(1_000)], [("a", 30, 30, 0.0, False)], [other(4_000)], [other(4_001)]], late="1 minute", idle="2 minutes")
    m = live.Machine()
    want = [p for _, _, _, v, _ in frames for p in m.push(v)] + m.close()
    assert got["a"] == sorted(want) and [p for _, _, p in got["a"]] == ["grasp", "interact", "release"]
