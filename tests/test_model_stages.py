from __future__ import annotations

import os

from pyspark.sql import functions as F

from trailmill.operators import dense_stages as ds
from trailmill.plans import model_stages as ms


def test_a_worker_holds_few_answers(spark):
    """2,000 answers of 200,000 bytes come from one batch of rows; the worker grows by far less than all of them."""

    def call(_, k):
        with open("/proc/self/statm") as f:
            return {"held": int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE"), "k": k, "data": bytes(200_000)}

    rows = spark.range(2_000).coalesce(1)
    got = rows.select("id", ms.stage(lambda: None, call, "struct<held:bigint,k:bigint,data:binary>", F.col("id")).alias("a"))
    n, right, low, high = got.agg(F.count("*"), F.bool_and((F.col("a.k") == F.col("id")) & (F.length("a.data") == 200_000)), F.min("a.held"), F.max("a.held")).head()
    assert n == 2_000 and right
    assert high - low < 150_000_000


def test_stage_without_rows_and_with_nulls(spark):
    df = spark.createDataFrame([(k, None if k % 3 else k) for k in range(50)], "id int, v int")
    for flight in (1, 4):
        got = df.select("id", ms.stage(lambda: 2, lambda m, v: m * v, "int", F.col("v"), in_flight=flight).alias("a"))
        assert {(r.id, r.a) for r in got.collect()} == {(k, None if k % 3 else 2 * k) for k in range(50)}
        assert got.where("id < 0").count() == 0 and df.where("v < 0").select(ms.stage(lambda: 2, lambda m, v: v, "int", F.col("v"), in_flight=flight)).collect() == []


def test_masks_of_boxes_are_counted(spark):
    rows = spark.createDataFrame([(1, b"", [[0.0, 0.0, 1.0, 2.0], [90.0, 0.0, 95.0, 3.0]], [0.5, 0.75]), (2, b"", [], []), (3, None, [[0.0] * 4], [0.5])], "k int, image binary, boxes array<array<double>>, confidences array<double>")
    got = {r.k: r for r in ms.segmented(rows).collect()}
    assert got[1].confidences == [0.5, 0.0] and [bytes(m.data).count(1) for m in got[1].masks] == [6, 0]
    assert got[2].masks == [] and got[3].masks is None
    one = ms.segmented(rows).select("k", F.explode_outer("masks").alias("m")).select("k", ds.n_set(F.col("m")).alias("n"))
    assert sorted(((r.k, r.n) for r in one.collect()), key=repr) == [(1, 0), (1, 6), (2, None), (3, None)]
