from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trailmill.operators import selection


def made(n=3_000):
    rng = random.Random(3)
    draw = [lambda: rng.random(), lambda: rng.gauss(0, 1) * 10 ** rng.randint(-300, 300), lambda: float(rng.randrange(4)), lambda: -1.5, lambda: rng.choice([1.7e308, -1.7e308, 5e-324, 0.0, -0.0])]
    groups = ["u", "wide", "ties", "one", "ends", None]
    rows = [(g, draw[k % 5]()) for k, g in enumerate(groups) for _ in range(n + k % 2)]
    return [*rows, ("u", None), ("few", 3.0), ("few", 1.0), ("none", None)]


@pytest.mark.parametrize("buckets,few", [(64, 9), (1_024, 4_096)])
def test_medians_are_those_of_the_aggregate(spark, buckets, few):
    rows = made(60 if few < 100 else 2_000)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.n, r.median) for r in selection.medians(df, ["g"], "v", buckets, few).collect()}
    want = {r.g: (r.n, r.m) for r in df.where("v is not null").groupBy("g").agg(F.count("*").alias("n"), F.median("v").alias("m")).collect()}
    assert got == want


def test_one_group_of_all_rows(spark):
    df = spark.range(300_000).select(F.lit(1).alias("g"), (F.xxhash64("id") % 100_003).cast("double").alias("v"))
    want = df.agg(F.median("v")).first()[0]
    r = selection.deviations(df, ["g"], "v", few=512).first()
    assert r.median == want and r.n == 300_000
    assert r.deviation == df.agg(F.median(F.abs(F.col("v") - want))).first()[0]
    assert selection.medians(df, [], "v", few=512).first().median == want


def test_ranks_and_odd_values(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 3, 1, 3)] + [("a", float("nan")), ("a", float("inf")), ("b", None)], "g string, v double")
    wanted = spark.createDataFrame([("a", k) for k in range(6)] + [("b", 0), ("c", 0)], "g string, rank long")
    got = sorted((r.g, r["rank"], r.value) for r in selection.at_ranks(df, ["g"], "v", wanted, 4, 1).collect())
    assert got == [("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 3.0), ("a", 3, 5.0)]
    assert selection.medians(df.limit(0), ["g"], "v").collect() == []
