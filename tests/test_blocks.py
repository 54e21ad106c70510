from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trailmill.operators import blocks, sequences


@pytest.fixture(scope="module")
def frames(spark):
    rng, rows = random.Random(4), []
    for traj in range(7):
        t, key, on, v = rng.choice([0, 1000]), None, False, None
        for _ in range(rng.choice([1, 2, 5, 60, 150])):
            t += rng.choice([1, 1, 1, 1, 40])  # gaps of whole blocks
            key = key if rng.random() < 0.7 else rng.choice(["a", "b", None])
            on = on if rng.random() < 0.7 else rng.choice([True, False])
            v = rng.choice([None, None, rng.random()])
            rows.append((traj, t, key, on, v))
    return spark.createDataFrame(rows, "traj int, t long, key string, on_ boolean, v double").cache()


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("size", [1, 8, 1 << 16])
def test_blocks_of_any_size_equal_windows(frames, size):
    by, t = ["traj"], "t"
    same(blocks.runs(frames, by, t, "key", size), sequences.runs(frames, by, t, "key"))
    same(blocks.true_runs(frames, by, t, "on_", size), sequences.true_runs(frames, by, t, "on_"))
    for shortest in (2, 4):
        same(blocks.close_gaps(frames, by, t, "on_", shortest, size), sequences.close_gaps(frames, by, t, "on_", shortest))
    same(blocks.interpolated(frames, by, t, "v", size), sequences.interpolated(frames, by, t, "v"))
    same(blocks.previous_known(frames, by, t, "v", "p", size), sequences.previous_known(frames, by, t, "v", "p"))
    scaled = sequences.scaled(frames, by, "v", "z")
    same(blocks.scaled(frames, by, t, "v", "z", size), scaled)
    same(blocks.latch(scaled, by, t, "z", 0.4, 0.6, size=size), sequences.latch(scaled, by, t, "z", 0.4, 0.6))


def test_a_very_long_trajectory_is_dealt_by_blocks(spark):
    n, size = 1_000_000, 1 << 15
    long = spark.range(n).select(F.lit("x").alias("traj"), F.col("id").alias("t"), (F.col("id") % 100_000 < 99_998).alias("on_"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        closed = blocks.close_gaps(long, ["traj"], "t", "on_", 3, size)
        most = closed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most <= 3 * size  # a partition by hash may have a few blocks
        assert [tuple(r) for r in blocks.runs(closed, ["traj"], "t", "on_", size).collect()] == [("x", True, 0, n, n)]
        found = sorted(map(tuple, blocks.true_runs(long, ["traj"], "t", "on_", size).collect()))
        assert found == [("x", k * 100_000, k * 100_000 + 99_998, 99_998) for k in range(10)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rows_without_a_trajectory_or_place_go(spark):
    df = spark.createDataFrame([(None, 1, "a"), ("x", None, "a"), ("x", 1, "a")], "traj string, t long, key string")
    assert list(map(tuple, blocks.runs(df, ["traj"], "t", "key").collect())) == [("x", "a", 1, 2, 1)]
    assert blocks.runs(df.limit(0), ["traj"], "t", "key").collect() == []
