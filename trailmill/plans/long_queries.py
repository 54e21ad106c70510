"""Queries over one order of all rows: trajectories as long as a table, places among all keys, and what is drawn by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, intervals, ranks, selection
from .registry import query, table

#: Events of a block: all events are one trajectory here.
SIZE = 1_024


def timeline(spark, sf_dir):
    """All events as one trajectory."""
    return table(spark, sf_dir, "events").select(F.lit(0).alias("traj"), F.col("event_id").alias("t"), F.col("value").alias("signal"), F.col("event_type").alias("label"))


@query(
    "q_timeline_runs",
    """WITH c AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (ORDER BY t) THEN 1 ELSE 0 END AS ch FROM v_timeline), i AS (SELECT *, sum(ch) OVER (ORDER BY t) AS isl FROM c),
 g AS (SELECT isl, min(label) AS label, min(t) AS start_frame, max(t) AS last, count(*) AS n FROM i GROUP BY isl) SELECT 0 AS traj, label, start_frame, coalesce(lead(start_frame) OVER (ORDER BY start_frame), last + 1) AS end_frame, n FROM g""",
)
def timeline_runs(spark, sf_dir):
    return blocks.runs(timeline(spark, sf_dir), ["traj"], "t", "label", SIZE)


@query(
    "q_timeline_gaps",
    """WITH f AS (SELECT t, signal > 50 AS on1 FROM v_timeline), c1 AS (SELECT *, CASE WHEN on1 <> lag(on1) OVER (ORDER BY t) THEN 1 ELSE 0 END AS ch FROM f),
 i1 AS (SELECT *, sum(ch) OVER (ORDER BY t) AS isl FROM c1), n1 AS (SELECT t, CASE WHEN NOT on1 AND count(*) OVER (PARTITION BY isl) < 3 THEN TRUE ELSE on1 END AS on2 FROM i1),
 c2 AS (SELECT *, CASE WHEN on2 <> lag(on2) OVER (ORDER BY t) THEN 1 ELSE 0 END AS ch FROM n1), i2 AS (SELECT *, sum(ch) OVER (ORDER BY t) AS isl FROM c2)
 SELECT t, CASE WHEN on2 AND count(*) OVER (PARTITION BY isl) < 3 THEN FALSE ELSE on2 END AS on_ FROM i2""",
)
def timeline_gaps(spark, sf_dir):
    return blocks.close_gaps(timeline(spark, sf_dir).select("traj", "t", (F.col("signal") > 50).alias("on_")), ["traj"], "t", "on_", 3, SIZE).select("t", "on_")


@query(
    "q_timeline_interpolated",
    """WITH f AS (SELECT t, CASE WHEN t % 7 = 0 THEN signal END AS v, CASE WHEN t % 7 = 0 THEN t END AS k FROM v_timeline),
 n AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(k IGNORE NULLS) OVER b AS t0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(k IGNORE NULLS) OVER a AS t1 FROM f
 WINDOW b AS (ORDER BY t ROWS UNBOUNDED PRECEDING), a AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT t, coalesce(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, v0, v1) AS v FROM n""",
)
def timeline_interpolated(spark, sf_dir):
    sparse = timeline(spark, sf_dir).select("traj", "t", F.when(F.col("t") % 7 == 0, F.col("signal")).alias("v"))
    return blocks.interpolated(sparse, ["traj"], "t", "v", SIZE).select("t", "v")


@query(
    "q_timeline_grips",
    """WITH s AS (SELECT t, (signal - min(signal) OVER ()) / (max(signal) OVER () - min(signal) OVER ()) AS z FROM v_timeline),
 l AS (SELECT t, coalesce(last_value(CASE WHEN z < 0.2 THEN 'interact' WHEN z >= 0.8 THEN 'grasp' END IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), 'grasp') AS state FROM s),
 c AS (SELECT *, CASE WHEN state <> lag(state) OVER (ORDER BY t) THEN 1 ELSE 0 END AS ch FROM l), i AS (SELECT *, sum(ch) OVER (ORDER BY t) AS isl FROM c),
 g AS (SELECT isl, min(state) AS state, min(t) AS start_frame, max(t) + 1 AS end_frame, count(*) AS n FROM i GROUP BY isl) SELECT start_frame, end_frame, n FROM g WHERE state = 'interact'""",
)
def timeline_grips(spark, sf_dir):
    """Gripper stretches: range, latch and runs, each a scan over blocks."""
    unit = blocks.scaled(timeline(spark, sf_dir), ["traj"], "t", "signal", "z", SIZE)
    held = blocks.latch(unit.select("traj", "t", "z"), ["traj"], "t", "z", 0.2, 0.8, size=SIZE)
    return blocks.runs(held, ["traj"], "t", "state", SIZE).where("state = 'interact'").select("start_frame", "end_frame", "n")


@query(
    "q_timeline_medians",
    """WITH m AS (SELECT label, count(*) AS n, median(signal) AS m FROM v_timeline GROUP BY label UNION ALL SELECT 'all', count(*), median(signal) FROM v_timeline),
 d AS (SELECT m.label, m.n, m.m, median(abs(v.signal - m.m)) AS d FROM m JOIN v_timeline v ON v.label = m.label OR m.label = 'all' GROUP BY m.label, m.n, m.m) SELECT label, n, round(m, 6) AS median, round(d, 6) AS deviation FROM d""",
)
def timeline_medians(spark, sf_dir):
    """Median and median distance from it, of each label and of all frames, by counts in buckets."""
    frames = timeline(spark, sf_dir).select("label", "signal")
    both = frames.unionByName(frames.withColumn("label", F.lit("all")))
    found = selection.deviations(both, ["label"], "signal", few=256)
    return found.select("label", "n", F.round("median", 6).alias("median"), F.round("deviation", 6).alias("deviation"))


SPANS = "a AS (SELECT event_id AS id, event_id AS s, event_id + CASE WHEN event_id % 997 = 0 THEN 2000 ELSE 1 + event_id % 11 END AS e, event_type AS label FROM events)"


@query(
    "q_timeline_overlap",
    f"""WITH {SPANS} SELECT l.id AS l_id, r.id AS r_id, least(l.e, r.e) - greatest(l.s, r.s) AS overlap FROM a l JOIN a r ON l.s < r.e AND r.s < l.e WHERE l.label = 'click' AND r.label = 'view'""",
)
def timeline_overlap(spark, sf_dir):
    """Overlapping spans of one trajectory that has them all, short and long."""
    k = F.col("event_id")
    longer = F.when(k % 997 == 0, F.lit(2000)).otherwise(1 + k % 11)
    spans = table(spark, sf_dir, "events").select(F.lit(0).alias("traj"), k.alias("id"), k.alias("start_frame"), (k + longer).alias("end_frame"), F.col("event_type").alias("label"))
    met = intervals.pairs(spans.where("label = 'click'"), spans.where("label = 'view'"), ["traj"])
    return met.select("l_id", "r_id", "overlap")


@query(
    "q_natural_sort_place",
    """WITH p AS (SELECT o_orderkey % 12 AS a, o_orderkey % 7 AS b, o_orderkey AS c FROM orders) SELECT 'Ep' || a || '/part' || b || '/' || c AS path, row_number() OVER (ORDER BY a, b, c) - 1 AS place FROM p""",
)
def natural_sort_place(spark, sf_dir):
    """Places of all paths in one natural order."""
    k = F.col("o_orderkey")
    paths = table(spark, sf_dir, "orders").select(F.concat(F.lit("Ep"), k % 12, F.lit("/part"), k % 7, F.lit("/"), k).alias("path"))
    return ranks.numbered(paths, [ranks.natural("path")])


@query("q_node_share_all", "WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) SELECT o_orderkey FROM k WHERE p % 4 = 1")
def node_share_all(spark, sf_dir):
    """What the second of four nodes works on: every fourth of all keys in order."""
    return ranks.node_share(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 4, 1)


@query(
    "q_places_in_groups",
    "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM documents",
)
def places_in_groups(spark, sf_dir):
    """Places by length within each source, however large."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return ranks.numbered(docs, [F.col("n_chars").desc(), "doc_id"], ["source"], total="n").drop("n_chars")


@query("q_seeded_draw")
def seeded_draw(spark, sf_dir):
    """20 documents of each language, as Python's generator with seed 42 draws them from the languages' sorted ids."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id")
    langs = [r[0] for r in docs.where("lang is not null").select("lang").distinct().collect()]
    return ranks.drawn(docs, "lang", ["doc_id"], dict.fromkeys(langs, 20))
