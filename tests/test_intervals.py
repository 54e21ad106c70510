from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.operators import intervals

SCHEMA = "traj string, start_frame long, end_frame long, id long"


def made(rng, n, kinds=("a", "b", None)):
    out = []
    for k in range(n):
        start = rng.randrange(-300, 300)
        out.append((rng.choice(kinds), start, start + rng.choice([-3, 0, 1, 2, 3, 4, 7, 8, 9, 33, 64, 65, 400]), k))
    return [*out, ("a", None, 5, n), ("a", 5, None, n + 1), ("a", 1, 5, n + 2), ("a", 1, 5, n + 2)]


@pytest.mark.parametrize("least", [1, 3])
def test_pairs_equal_all_pairs(spark, least):
    rng = random.Random(least)
    a, b = made(rng, 150), made(rng, 120)
    got = intervals.pairs(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA).withColumnRenamed("id", "other"), ["traj"], least=least)
    assert got.columns == ["traj", "l_start_frame", "l_end_frame", "l_id", "r_start_frame", "r_end_frame", "r_other", "overlap"]
    want = [(t, s, e, i, s2, e2, j, min(e, e2) - max(s, s2)) for t, s, e, i in a for t2, s2, e2, j in b if t is not None and t == t2 and None not in (s, e, s2, e2) and e - s >= least and e2 - s2 >= least and min(e, e2) - max(s, s2) >= least]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_points_in_intervals_and_seconds(spark):
    rng = random.Random(9)
    spans = made(rng, 100)
    points = [(rng.choice(["a", "b", None]), rng.uniform(-310, 700)) for _ in range(200)]
    got = intervals.covering(spark.createDataFrame(points, "traj string, at double"), spark.createDataFrame(spans, SCHEMA), ["traj"], "at")
    want = [(t, p, s, e, i) for t, p in points for t2, s, e, i in spans if t is not None and t == t2 and None not in (s, e) and s <= p < e]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    times = spark.createDataFrame([("x", 0.25, 0.75), ("x", 0.7, 3.9), ("x", 3.9, 4.0)], "traj string, start_frame double, end_frame double")
    close = intervals.pairs(times, times, ["traj"], least=0.01).where("l_start_frame < r_start_frame").collect()
    assert [(r.l_start_frame, r.r_start_frame) for r in close] == [(0.25, 0.7)]


def test_nothing_to_share_is_refused(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        intervals.pairs(df, df, ["traj"], least=0)
    assert intervals.pairs(df, df, ["traj"]).collect() == [] and intervals.covering(df.select("traj", F.col("id").alias("at")), df, ["traj"], "at").collect() == []


def test_one_trajectory_with_many_intervals(spark):
    """All pairs of these would be 1.6 x 10^9; rows that meet in a bin are few times those that overlap."""
    rng = np.random.default_rng(1)
    start = rng.integers(0, 400_000, 40_000)
    length = np.where(rng.random(40_000) < 0.0002, 200_000, rng.integers(1, 30, 40_000))
    df = spark.createDataFrame(list(zip(["x"] * 40_000, start.tolist(), (start + length).tolist(), range(40_000), strict=True)), SCHEMA).repartition(8).cache()
    begins, ends = np.sort(start), np.sort(start + length)
    want = int((np.searchsorted(begins, start + length, "left") - np.searchsorted(ends, start, "right")).sum())
    assert intervals.pairs(df, df, ["traj"]).count() == want
    bins = intervals._bins(df, F.col("start_frame"), F.col("end_frame"), F.array(intervals.level_of(F.col("start_frame"), F.col("end_frame"))))
    assert bins.count() <= 2 * 40_000
    met = bins.groupBy("traj", "bin__").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert met < 8 * want
