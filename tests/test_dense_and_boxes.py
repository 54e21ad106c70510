from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.operators import boxes as bx
from trailmill.operators import dense
from trailmill.plans import annotate, selector


def test_farthest_points():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 50, (60, 2)).astype(float)
    got = dense.farthest_points(points, 10)
    chosen = [0]
    while len(chosen) < 10:
        away = [min(((p - points[c]) ** 2).sum() for c in chosen) for p in points]
        chosen.append(int(np.argmax(away)))
    assert got.tolist() == chosen and dense.farthest_points(points, 99).tolist() == list(range(60))


def test_mask_points_start_on_the_boundary():
    mask = np.zeros((20, 20), bool)
    mask[3:15, 4:16] = True
    points = dense.mask_points(mask, 16)
    assert len(points) == 16 and all(mask[int(y), int(x)] for x, y in points)
    edge = [p for p in points[:8] if p[0] in (4, 15) or p[1] in (3, 14)]
    assert len(edge) == 8
    assert len(dense.mask_points(mask[:4], 500)) == 12


def test_dilation_and_components():
    rng = np.random.default_rng(1)
    for _ in range(10):
        mask = rng.random((14, 17)) < 0.3
        for r in (0, 1, 2, 4):
            want = np.zeros_like(mask)
            for y, x in zip(*np.nonzero(mask)):
                for v in range(14):
                    for u in range(17):
                        want[v, u] |= (v - y) ** 2 + (u - x) ** 2 <= r * r
            assert (dense.dilated(mask, r) == want).all()
        labels, n = dense.labelled(mask)
        seen, count = np.zeros(mask.shape, int), 0
        for y in range(14):
            for x in range(17):
                if mask[y, x] and not seen[y, x]:
                    count += 1
                    todo = [(y, x)]
                    while todo:
                        a, b = todo.pop()
                        if 0 <= a < 14 and 0 <= b < 17 and mask[a, b] and not seen[a, b]:
                            seen[a, b] = count
                            todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert n == count and (labels == seen).all()


def test_masks():
    mask = np.zeros((5, 8), np.uint8)
    mask[1:3, 2:6] = 1
    assert dense.mask_box(mask) == (2, 1, 5, 2) and dense.mask_box(mask * 0) is None
    assert dense.share_inside([[2, 1], [0, 0], [100, 1], [np.nan, 1]], mask) == 0.5 and dense.share_inside([], mask) == 0.0
    back = dense.restored_mask(np.ones((3, 3), np.uint8), (8, 10), (1, 1, 4, 4), (0.5, 0.5))
    assert back.shape == (8, 10) and back.sum() == 36 and back[2, 2] == 1 and back[1, 1] == 0
    assert (dense.restored_mask(mask, (5, 8), None, (1, 1)) == mask).all()
    with pytest.raises(ValueError):
        dense.restored_mask(mask, (50, 80), (9, 9, 9, 9), (0.5, 0.5))
    grid = dense.rasterised(np.array([[0.0, 0.0], [10.0, 5.0]]), (0, 0, 10, 10), 11)
    assert grid[0, 0] and grid[5, 10] and grid.sum() == 2


def test_tracked_box():
    rng = np.random.default_rng(2)
    box = np.array([40.0, 50.0, 80.0, 90.0])
    before = rng.uniform([40, 50], [80, 90], (40, 2))
    after = before + [12, -7]
    after[:2] = [[200, 200], [10, 230]]
    moved, way = dense.tracked_box(box, before, after, np.ones(40, bool), (240, 320))
    assert way == "similarity" and np.allclose(moved, box + [12, -7, 12, -7], atol=1)
    assert dense.tracked_box(box, before, after, np.zeros(40, bool), (240, 320))[0] is None
    moved, _ = dense.tracked_box(box, before, before + [235, 0], np.ones(40, bool), (240, 320))
    assert moved is None or moved[2] <= 319


def test_tracked_box_draws_as_round_by_round():
    """The rounds together find what they find one by one, the first of equals, and take far less than a millisecond each."""
    import time

    def one_by_one(a, b, limit, rounds):
        x, y = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
        rng, best = np.random.default_rng(0), np.zeros(len(a), bool)
        for _ in range(rounds):
            i, j = rng.choice(len(a), 2, replace=False)
            if x[i] != x[j]:
                near = np.abs((y[i] - y[j]) / (x[i] - x[j]) * (x - x[i]) + y[i] - y) <= limit
                best = near if near.sum() > best.sum() else best
        return best

    rng = np.random.default_rng(7)
    for k in range(40):
        n = int(rng.integers(2, 40))
        a = rng.integers(0, 30 if k % 4 else 2, (n, 2)).astype(float)
        b = a + [3, 1] + rng.normal(0, 2, (n, 2)) * (rng.random((n, 1)) < 0.4)
        assert (dense._agreeing(a, b, 2.0, 200) == one_by_one(a, b, 2.0, 200)).all()
    a = rng.integers(0, 30, (16, 2)).astype(float)
    began = time.monotonic()
    for _ in range(300):
        dense.tracked_box([0, 0, 30, 30], a, a + 2, np.ones(16, bool), (200, 200))
    assert time.monotonic() - began < 0.5


def test_array_archives():
    arrays = {"centroid_traces": np.linspace(0, 1, 12, dtype=np.float32).reshape(2, 3, 2), "masks": np.eye(3, dtype=np.uint8), "none": None, "empty": np.zeros(0)}
    back = dense.unpacked_arrays(dense.packed_arrays(arrays))
    assert set(back) == {"centroid_traces", "masks"} and back["centroid_traces"].dtype == np.float16 and (back["masks"] == np.eye(3)).all()
    assert dense.packed_arrays({"a": None}) is None and dense.unpacked_arrays(None) == {}


def test_suppression_against_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(40):
        for i in range(int(rng.integers(1, 14))):
            x, y = rng.uniform(0, 60, 2)
            rows.append((g, i, float(x), float(y), float(x + rng.uniform(5, 30)), float(y + rng.uniform(5, 30)), float(rng.choice([0.5, 0.7, rng.random()]))))
    df = spark.createDataFrame(rows, "grp int, idx int, x1 double, y1 double, x2 double, y2 double, conf double")

    def overlap(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        inter = max(0, w) * max(0, h)
        area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
        return inter / (area(a) + area(b) - inter)

    want = set()
    for g in range(40):
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[6], r[1])):
            if all(overlap(k, r) <= 0.4 for k in kept):
                kept.append(r)
        want |= {(g, r[1]) for r in kept}
    for parts in (1, 5):
        assert {(r.grp, r.idx) for r in bx.suppressed(df.repartition(parts), ["grp"], 0.4).collect()} == want


def test_strongest_kept_in_rounds(spark):
    """Large groups, one without a key: heads of 7 need many rounds, of 880 none; both as the fold over all boxes."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(1_500):
        x, y, g = *rng.uniform(0, 60 if k % 5 else 4, 2), (1, 1, 1, None, 2)[k % 5]
        rows.append((g, k, float(x), float(y), float(x + rng.uniform(8, 40)), float(y + rng.uniform(8, 40)), float(rng.choice([0.5, rng.random()]))))
    df = spark.createDataFrame(rows, "grp int, idx int, x1 double, y1 double, x2 double, y2 double, conf double")
    want = sorted((tuple(r) for r in bx.strongest(bx.suppressed(df, ["grp"], 0.4), ["grp"], 12).collect()), key=repr)
    for head in (7, 880):
        assert sorted((tuple(r) for r in bx.strongest_kept(df, ["grp"], 0.4, 12, head).collect()), key=repr) == want
    assert len(want) == 36


def test_candidates_of_a_crowded_image(spark):
    """30,000 detections of one image: the fold over all of them took minutes."""
    import time

    n = F.col("id")
    df = spark.range(30_000).select(F.lit(1).alias("g"), n.alias("idx"), (n % 97).cast("double").alias("x1"), (n % 61).cast("double").alias("y1"), (n % 97 + 5 + n % 50).cast("double").alias("x2"), (n % 61 + 5 + n % 40).cast("double").alias("y2"), (n * 7919 % 30_011 / 30_011).alias("conf"))
    began = time.monotonic()
    assert annotate.candidates(df, ["g"], 200, 120).count() == 22
    assert time.monotonic() - began < 40


def test_penalty_of_crowds_is_that_of_all_pairs(spark):
    """2,400 boxes in two groups, of few and of many points, with still, unknown and equal movements: the worst loss over all
    pairs, to the last bit. An array of a group can't be looked through for each of its members at this size."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(2_400):
        x, y = rng.uniform(0, 80, 2)
        moved = None if k % 211 == 0 else 0.0 if k % 9 == 0 else float(rng.choice([0.25, rng.uniform(0.01, 1)]))
        rows.append((k % 2, k, float(x), float(y), float(x + rng.uniform(1, 30)), float(y + rng.uniform(1, 30)), k % 3, int(rng.integers(0, 9) if k % 2 else rng.integers(0, 3)), moved))
    df = spark.createDataFrame(rows, "g int, idx int, x1 double, y1 double, x2 double, y2 double, target int, points int, movement double")
    got = {(r.idx, r.target): r.penalty for r in bx.nested_penalty_of_crowds(df, ["g"], df, size=32, shares=3).collect()}

    def like(a, b):
        known = [v for v in (a, b) if v is not None]
        return 1.0 if not known or max(known) <= 0 else min(known) / max(known)

    want = {(r[1], r[6]): 0.0 for r in rows}
    for i in (r for r in rows if r[7] >= 1):
        own = (i[4] - i[2]) * (i[5] - i[3])
        for j in rows:
            if i[0] == j[0] and i[1] != j[1] and i[6] == j[6] and j[7] >= 1 and (j[4] - j[2]) * (j[5] - j[3]) > own:
                common = max(0.0, min(i[4], j[4]) - max(i[2], j[2])) * max(0.0, min(i[5], j[5]) - max(i[3], j[3]))
                points, movement = like(i[7], j[7]), like(i[8], j[8])
                if common / own > 0.3 and points > 0.5 and movement > 0.5:
                    want[i[1], i[6]] = max(want[i[1], i[6]], 0.15 * (points + movement) / 2)
    assert got == want and sum(v > 0 for v in want.values()) > 500


def test_selector_of_crowds_does_not_go_through_arrays(spark):
    """12,000 starts of one trajectory: quadratic in an array, this took minutes."""
    import time

    n = 12_000
    points = spark.range(n).selectExpr("1 as traj", "id as start", "explode(sequence(0, 3)) as t", "1 as pt").selectExpr("*", "cast(start % 997 + t * (1 + start % 13) as double) as x", "cast(start % 89 + t as double) as y", "true as visible")
    starts = spark.range(n).selectExpr("1 as traj", "id as start", "cast(id % 997 - 20 as double) as x1", "cast(id % 89 - 20 as double) as y1", "cast(id % 997 + 20 + id % 50 as double) as x2", "cast(id % 89 + 20 as double) as y2")
    targets = spark.createDataFrame([(1, 0, 0.0, 0.0, 900.0, 900.0, 0.5)], "traj int, target int, x1 double, y1 double, x2 double, y2 double, conf double")
    began = time.monotonic()
    assert len(selector.selected_pairs(points, starts, targets, ["traj"], F.col("t") > 1, (1000.0, 1000.0), 10.0).collect()) == 1
    assert time.monotonic() - began < 60
