from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.operators import phases as ph
from trailmill.operators import sequences as seq


def frame_by_frame(signal, hysteresis=0.1, shortest=7):
    """An independent machine that looks at one frame at a time."""
    x = np.asarray(signal, float)
    n = len(x)
    lo, hi = x.min(), x.max()
    if hi - lo < 0.05 or (hi - lo < 0.1 and lo > 0.9):
        return [(0, n - 1, "interact")]
    x = (x - lo) / (hi - lo + 1e-8)
    enter, leave = 0.6 - hysteresis, 0.6 + hysteresis
    shortest = min(shortest, int(0.2 * n))

    def walk(need, rest, least):
        state, mark, streak, out, grips = "grasp", 0, 0, [], []
        for t in range(n):
            if state == "release":
                if t - mark >= rest or x[t] < enter:
                    if t > mark:
                        out.append([mark, t - 1, "release"])
                    state, mark, streak = "grasp", t, 0
                continue
            hit = x[t] < enter if state == "grasp" else x[t] >= leave
            streak = streak + 1 if hit else 0
            if not hit or streak < need:
                continue
            at = t - streak + 1
            streak = 0
            if state == "grasp":
                if least is not None and at - mark < least and out and out[-1][2] == "release":
                    first, last, _ = out[-1]
                    can = max(0, min(last - first + 1 - max(1, need // 2), last - first))
                    take = int(min(least - (at - mark), can))
                    out[-1][1] -= take
                    mark -= take
                if at > mark:
                    out.append([mark, at - 1, "grasp"])
                state = "interact"
            else:
                grips.append(at - mark)
                good = least is None or at - mark >= least
                if at > mark:
                    out.append([mark, at - 1, "interact" if good else "grasp_failure"])
                state = "release" if good else "grasp"
            mark = at
        tail = streak if state == "grasp" and x[-1] < enter and streak >= shortest_now // 2 else 0
        if state == "interact":
            grips.append(n - mark)
            if least is None or n - mark >= least:
                out.append([mark, n - 1, "interact"])
        elif tail:
            grips.append(tail)
            if n - tail > mark:
                out.append([mark, n - tail - 1, "grasp"])
            out.append([n - tail, n - 1, "interact"])
        elif state == "release":
            out.append([mark, n - 1, "release"])
        return out, grips

    shortest_now = shortest
    _, grips = walk(min(5, int(0.05 * n)), shortest // 2, None)
    k = max(1, len(grips))
    least = 0.5 * 0.07 * n / k
    if grips:
        least = max(least, 0.4 * float(np.median(grips)))
    least = min(max(4, least), 0.3 * n / k)
    if len(grips) == 1:
        least = grips[0] - 1
    shortest_now = min([shortest, *grips])
    out, _ = walk(shortest_now, shortest_now // 2, least)
    if not out:
        return [(0, n - 1, "interact")]
    if out[-1][2] == "release":
        out[-1][1] = n - 1
    if len(out) > 1 and out[-1][2] == "grasp" and out[-2][2] == "release":
        out[-2][1] = n - 1
        out.pop()
    return [tuple(p) for p in out]


def signals():
    rng = np.random.default_rng(3)
    yield np.full(50, 0.4)
    yield np.r_[np.ones(40), np.zeros(40), np.ones(40)]
    yield np.r_[np.ones(40), np.zeros(40)]
    yield np.r_[np.ones(5), np.zeros(3)]
    yield np.linspace(0.93, 1.0, 30)
    for k in range(400):
        n = int(rng.integers(2, 260))
        levels = rng.choice([0.0, 0.3, 0.5, 0.6, 0.65, 0.7, 1.0], size=n)
        hold = int(rng.integers(1, 40))
        x = np.repeat(levels, hold)[: int(rng.integers(2, 300))]
        yield x + (rng.normal(0, 0.08, len(x)) if k % 2 else 0)


def test_phases_against_frame_by_frame():
    for k, x in enumerate(signals()):
        for h in (0.1, 0.05):
            assert ph.gripper_phases(x, hysteresis=h) == frame_by_frame(x, h), k


def test_phases_table_does_not_depend_on_partitions(spark):
    rows = [(f"t{k}", i, float(v)) for k, x in enumerate(list(signals())[:20]) for i, v in enumerate(x)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "traj string, t int, v double").repartition(7)
    got = {}
    for r in ph.detect_phases(df, "traj", "t", "v").collect():
        got.setdefault(r.traj, []).append((r.start_frame, r.end_frame, r.phase))
    assert {k: sorted(v) for k, v in got.items()} == {f"t{k}": sorted(frame_by_frame(x)) for k, x in enumerate(list(signals())[:20])}


def test_skill_groups():
    step = lambda label, skill, a, b: {"label": label, "skill": skill, "start_frame": a, "end_frame": b}
    steps = [step("left", "Pick", 0, 5), step("left", "Move", 6, 9), step("any", "Carry", 9, 12), step("left", "Place", 13, 15), step("right", "Move", 16, 18), step("right", "Pick", 18, 20), step("none", "Move", 30, 31), step("none", "Move", 31, 33)]
    assert ph.grouped_steps(steps, ph.SkillRule()) == [0, 0, 0, 0, 1, 2, 3, 4]
    # The first skill decides whether a group has ended: a pick with a later place goes on.
    assert ph.grouped_steps([step("left", "Place", 0, 1), step("left", "Move", 1, 2)], ph.SkillRule()) == [0, 1]


def test_label_groups():
    step = lambda label, a, b: {"label": label, "start_frame": a, "end_frame": b}
    steps = [step("Grasp the cup with left", 0, 5), step("lift the cup", 5, 8), step("Place the cup", 8, 9), step("move on", 9, 10), step("right lift", 10, 12)]
    assert ph.grouped_steps(steps, ph.LabelRule()) == [0, 0, 0, 1, 1]


def test_merged_entries():
    e = lambda obj, rel=None, inst=None: {"object": obj, "object_instance": inst, "instance_relation_to_previous": rel, "grasp_phases": [obj]}
    out = ph.merged_entries([e("the red cup"), e("cups", "same_instance_retry"), e("bowl", "same_instance_retry"), e("bowl", "same_instance_continuation", "b2"), e("bowl", None)])
    assert [len(x["grasp_phases"]) for x in out] == [2, 2, 1] and out[1]["instance_relation_to_previous"] == "uncertain"
    assert ph.same_object(e("cup", inst="a"), e("cup", inst="b")) is False and ph.same_object(e(""), e("cup")) is False


def test_close_gaps(spark):
    mask = [0, 0, 1, 1, 0, 1, 1, 1, 0, 0, 0, 1, 0, 0, 0]
    df = spark.createDataFrame([(1, t, bool(v)) for t, v in enumerate(mask)], "traj int, t int, f boolean")
    got = [r.f for r in seq.close_gaps(df, ["traj"], "t", "f", 2).orderBy("t").collect()]
    assert got == [bool(v) for v in [0, 0, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]]


@pytest.mark.parametrize("width", [3, 5])
def test_edge_padded_mean(spark, width):
    rng = np.random.default_rng(1)
    parts = {k: rng.normal(size=n) for k, n in enumerate((1, 2, 3, 4, 9))}
    df = spark.createDataFrame([(k, t, float(v)) for k, x in parts.items() for t, v in enumerate(x)], "traj int, t int, v double")
    got = {k: [r.m for r in rows] for k in parts for rows in [seq.edge_padded_mean(df.where(F.col("traj") == k), ["traj"], "t", "v", "m", width).orderBy("t").collect()]}
    for k, x in parts.items():
        w = min(width, len(x))
        w -= 1 - w % 2
        padded = np.pad(x, w // 2, mode="edge")
        assert np.allclose(got[k], np.convolve(padded, np.ones(w) / w, "valid"))


def test_runs_of_nulls(spark):
    df = spark.createDataFrame([(1, 3, None), (1, 4, None), (1, 9, "a"), (1, 10, "a")], "traj int, t int, k string")
    assert sorted((r.start_frame, r.end_frame, r.k) for r in seq.runs(df, ["traj"], "t", "k").collect()) == [(3, 9, None), (9, 11, "a")]
