from __future__ import annotations

import random

import duckdb
import pytest
from duck import SF_DIR, needs_tables
from pyspark.sql import functions as F

from trailmill import catalog
from trailmill.operators import ranks


def rows(n=400):
    rng = random.Random(1)
    return [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, rng.randrange(30)]), k) for k in range(n)]


@pytest.mark.parametrize("parts", [1, 7])
def test_places_equal_row_numbers(spark, parts):
    df = spark.createDataFrame(rows(), "grp string, v long, id long").repartition(parts)
    got = ranks.numbered(df, [F.col("v").desc_nulls_last(), "id"], ["grp"], total="n").collect()
    want = {}
    for g in ("a", "b", None):
        own = sorted((r for r in rows() if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want |= {r[2]: (k, len(own)) for k, r in enumerate(own)}
    assert {r.id: (r.place, r.n) for r in got} == want
    everything = ranks.numbered(df, ["id"], name="at").collect()
    assert [(r.id, r["at"]) for r in sorted(everything, key=lambda r: r.id)] == [(k, k) for k in range(400)]


def test_ties_and_repeats_have_places_of_their_own(spark):
    df = spark.createDataFrame([("x", 1)] * 50 + [("y", 1)], "grp string, v int")
    assert sorted(r.place for r in ranks.numbered(df, ["v"]).collect()) == list(range(51))
    assert ranks.numbered(df.limit(0), ["v"], ["grp"]).collect() == []
    shares = [sorted(r.v for r in ranks.node_share(spark.range(10).select(F.col("id").alias("v")), ["v"], 3, k).collect()) for k in range(3)]
    assert shares == [[0, 3, 6, 9], [1, 4, 7], [2, 5, 8]]


def test_running_sums(spark):
    df = spark.createDataFrame(rows(), "grp string, v long, id long").repartition(5)
    got = {r.id: r.before for r in ranks.running(df.select("grp", "id", F.coalesce("v", F.lit(0)).alias("v")), ["id"], "v", ["grp"]).collect()}
    want, sums = {}, {}
    for g, v, k in rows():
        want[k] = sums.get(g, 0)
        sums[g] = want[k] + (v or 0)
    assert got == want
    assert [r.before for r in sorted(ranks.running(spark.range(5).withColumnRenamed("id", "v"), ["v"], "v").collect())] == [0, 0, 1, 3, 6]


def test_natural_order(spark):
    paths = ["a2/b", "a10/b", "A1/b", "a010/a", "a/1", "b00", "b0", "a10/B2", "a10/b10", "9", "10", "x" + "1" * 25]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r.path for r in sorted(ranks.numbered(df, [ranks.natural("path")]).collect(), key=lambda r: r.place)]
    import re

    def key(p):
        return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", p.lower())]

    assert [key(p) for p in got] == sorted(key(p) for p in paths)


def test_draws_are_those_of_the_seeded_generator(spark):
    df = spark.createDataFrame(rows(), "grp string, v long, id long")
    got = sorted((r.drawn_group, r.drawn, r.id) for r in ranks.drawn(df, "grp", ["id"], {"a": 30, "b": 10_000, "none": 3}, 7).collect())
    rng, want = random.Random(7), []
    for k, g in enumerate("ab"):
        own = [r[2] for r in rows() if r[0] == g]
        want += [(k, i, x) for i, x in enumerate(rng.sample(own, min({"a": 30, "b": 10_000}[g], len(own))))]
    assert got == want


@needs_tables
def test_the_draw_of_the_tables(spark):
    docs = duckdb.sql(f"select lang, doc_id from '{SF_DIR}/documents.parquet' where lang is not null order by 1, 2").fetchall()
    rng, want = random.Random(42), []
    for k, g in enumerate(sorted({d[0] for d in docs})):
        own = [d[1] for d in docs if d[0] == g]
        want += [(g, x, k, i) for i, x in enumerate(rng.sample(own, min(20, len(own))))]
    assert sorted(map(tuple, catalog.queries()["q_seeded_draw"](spark, SF_DIR).collect())) == sorted(want)
