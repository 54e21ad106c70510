"""Queries of the sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals
from ..operators import relational as rel
from ..operators import sequences as seq
from .registry import frames, query, spans, spans_sql, table


@query(
    "q_label_runs",
    """WITH c AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY traj ORDER BY t) AND t > 0 THEN 1 ELSE 0 END AS ch FROM v_frames),
 i AS (SELECT *, sum(ch) OVER (PARTITION BY traj ORDER BY t) AS isl FROM c),
 g AS (SELECT traj, isl, min(label) AS label, min(t) AS start_frame, max(t) AS last, count(*) AS n FROM i GROUP BY traj, isl)
 SELECT traj, label, start_frame, coalesce(lead(start_frame) OVER (PARTITION BY traj ORDER BY start_frame), last + 1) AS end_frame, n FROM g""",
)
def label_runs(spark, sf_dir):
    return seq.runs(frames(spark, sf_dir), ["traj"], "t", "label")


@query(
    "q_action_spans",
    """SELECT o_custkey, CAST(l_linenumber AS BIGINT) AS action, min(l_orderkey) AS start_frame, max(l_orderkey) + 1 AS end_frame, arg_min(o_orderstatus, l_orderkey) AS o_orderstatus
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber - 2 >= 0 GROUP BY o_custkey, l_linenumber""",
)
def action_spans(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 2).alias("action"))
    rows = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    spans = seq.action_spans(rows, ["o_custkey"], "action", "l_orderkey", ["o_orderstatus"])
    return spans.withColumn("action", (F.col("action") + 2).cast("bigint"))


NORMAL = "s AS (SELECT *, (signal - min(signal) OVER (PARTITION BY traj)) / nullif(max(signal) OVER (PARTITION BY traj) - min(signal) OVER (PARTITION BY traj), 0) AS z FROM v_frames)"


@query("q_gripper_normalise", f"WITH {NORMAL} SELECT traj, t, round(z, 4) AS z FROM s")
def gripper_normalise(spark, sf_dir):
    return seq.scaled(frames(spark, sf_dir), ["traj"], "signal", "z").select("traj", "t", F.round("z", 4).alias("z"))


LATCH = f"""{NORMAL}, l AS (SELECT *, coalesce(last_value(CASE WHEN z < 0.4 THEN 'interact' WHEN z >= 0.6 THEN 'grasp' END IGNORE NULLS)
 OVER (PARTITION BY traj ORDER BY t ROWS UNBOUNDED PRECEDING), 'grasp') AS state FROM s),
 c AS (SELECT *, CASE WHEN state <> lag(state) OVER (PARTITION BY traj ORDER BY t) THEN 1 ELSE 0 END AS ch FROM l),
 i AS (SELECT *, sum(ch) OVER (PARTITION BY traj ORDER BY t) AS isl FROM c),
 g AS (SELECT traj, isl, min(state) AS state, min(t) AS start_frame, max(t) + 1 AS end_frame, count(*) AS n FROM i GROUP BY traj, isl)"""


@query(
    "q_hysteresis_stats",
    f"""WITH {LATCH} SELECT round((SELECT avg(z) FROM s WHERE z < 0.5), 4) AS mean_closed, round((SELECT avg(z) FROM s WHERE z >= 0.5), 4) AS mean_open,
 round((SELECT stddev_pop(z) FROM s WHERE z < 0.5), 4) AS std_closed, round((SELECT min(z) FROM s), 4) AS min_closed,
 round(avg(n), 4) AS avg_interact_frames, round(stddev_pop(n), 4) AS std_interact_frames, count(*) AS num_interact FROM g WHERE state = 'interact'""",
)
def hysteresis_stats(spark, sf_dir):
    """Statistics of closed and open values, and of the stretches that the undebounced latch finds."""
    normal = seq.scaled(frames(spark, sf_dir), ["traj"], "signal", "z").where("z is not null")
    z = F.col("z")
    closed, opened = F.when(z < 0.5, z), F.when(z >= 0.5, z)
    spans = seq.runs(seq.latch(normal, ["traj"], "t", "z", 0.4, 0.6), ["traj"], "t", "state").where("state = 'interact'")
    both = normal.select("z", F.lit(None).cast("bigint").alias("n")).unionByName(spans.select(F.lit(None).cast("double").alias("z"), "n"))
    r = lambda c, name: F.round(c, 4).alias(name)
    return both.agg(
        r(F.avg(closed), "mean_closed"), r(F.avg(opened), "mean_open"), r(F.stddev_pop(closed), "std_closed"), r(F.min("z"), "min_closed"),
        r(F.avg("n"), "avg_interact_frames"), r(F.stddev_pop("n"), "std_interact_frames"), F.count("n").alias("num_interact"),
    )


@query(
    "q_phase_offset",
    f"""WITH {LATCH}, p AS (SELECT traj, state AS phase, start_frame, end_frame - 1 AS end_frame FROM g), n AS (SELECT *, lead(start_frame) OVER w AS ns, lead(end_frame) OVER w AS ne FROM p WINDOW w AS (PARTITION BY traj ORDER BY start_frame))
 SELECT traj, phase, start_frame, CAST(coalesce(least(end_frame + floor((ne - ns) * 0.3), ne), end_frame) AS BIGINT) AS end_frame FROM n""",
)
def phase_offset(spark, sf_dir):
    out = seq.phase_offset(_phases(spark, sf_dir), ["traj"])
    return out.select("traj", "phase", "start_frame", F.col("end_frame").cast("bigint").alias("end_frame"))


def _phases(spark, sf_dir):
    """Phases of the latch, ends inclusive."""
    normal = seq.scaled(frames(spark, sf_dir), ["traj"], "signal", "z").where("z is not null")
    runs = seq.runs(seq.latch(normal, ["traj"], "t", "z", 0.4, 0.6), ["traj"], "t", "state")
    return runs.select("traj", F.col("state").alias("phase"), "start_frame", (F.col("end_frame") - 1).alias("end_frame"))


@query("q_phase_sequence_key", f"WITH {LATCH} SELECT traj, string_agg(state, '_' ORDER BY start_frame) AS phase_key FROM g GROUP BY traj")
def phase_sequence_key(spark, sf_dir):
    return seq.sequence_key(_phases(spark, sf_dir), ["traj"])


@query(
    "q_episode_split",
    f"""WITH {LATCH}, e AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY traj ORDER BY start_frame) = 'interact' THEN 1 ELSE 0 END AS c FROM g)
 SELECT traj, state AS phase, start_frame, CAST(sum(c) OVER (PARTITION BY traj ORDER BY start_frame) AS BIGINT) AS episode FROM e""",
)
def episode_split(spark, sf_dir):
    return seq.episodes(_phases(spark, sf_dir), ["traj"], closing="interact").select("traj", "phase", "start_frame", F.col("episode").cast("bigint").alias("episode"))


@query(
    "q_gap_closing",
    """WITH f AS (SELECT traj, t, signal > 50 AS on1 FROM v_frames), c1 AS (SELECT *, CASE WHEN on1 <> lag(on1) OVER (PARTITION BY traj ORDER BY t) THEN 1 ELSE 0 END AS ch FROM f),
 i1 AS (SELECT *, sum(ch) OVER (PARTITION BY traj ORDER BY t) AS isl FROM c1), n1 AS (SELECT traj, t, CASE WHEN NOT on1 AND count(*) OVER (PARTITION BY traj, isl) < 3 THEN TRUE ELSE on1 END AS on2 FROM i1),
 c2 AS (SELECT *, CASE WHEN on2 <> lag(on2) OVER (PARTITION BY traj ORDER BY t) THEN 1 ELSE 0 END AS ch FROM n1), i2 AS (SELECT *, sum(ch) OVER (PARTITION BY traj ORDER BY t) AS isl FROM c2)
 SELECT traj, t, CASE WHEN on2 AND count(*) OVER (PARTITION BY traj, isl) < 3 THEN FALSE ELSE on2 END AS on_ FROM i2""",
)
def gap_closing(spark, sf_dir):
    return seq.close_gaps(frames(spark, sf_dir).select("traj", "t", (F.col("signal") > 50).alias("on_")), ["traj"], "t", "on_", 3)


@query(
    "q_true_runs",
    """WITH c AS (SELECT traj, t, signal > 60 AS f, CASE WHEN (signal > 60) <> lag(signal > 60) OVER (PARTITION BY traj ORDER BY t) THEN 1 ELSE 0 END AS ch FROM v_frames),
 i AS (SELECT *, sum(ch) OVER (PARTITION BY traj ORDER BY t) AS isl FROM c) SELECT traj, min(t) AS start_frame, max(t) + 1 AS end_frame, count(*) AS n FROM i GROUP BY traj, isl, f HAVING f""",
)
def true_runs(spark, sf_dir):
    return seq.true_runs(frames(spark, sf_dir).withColumn("f", F.col("signal") > 60), ["traj"], "t", "f").select("traj", "start_frame", "end_frame", "n")


@query(
    "q_interp_gaps",
    """WITH f AS (SELECT traj, t, CASE WHEN event_id % 3 = 0 THEN signal END AS v, CASE WHEN event_id % 3 = 0 THEN t END AS k FROM v_frames),
 n AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(k IGNORE NULLS) OVER b AS t0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(k IGNORE NULLS) OVER a AS t1 FROM f
 WINDOW b AS (PARTITION BY traj ORDER BY t ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY traj ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT traj, t, coalesce(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, v0, v1) AS v FROM n""",
)
def interp_gaps(spark, sf_dir):
    sparse = frames(spark, sf_dir).select("traj", "t", F.when(F.col("event_id") % 3 == 0, F.col("signal")).alias("v"))
    return seq.interpolated(sparse, ["traj"], "t", "v")


@query("q_stride_decimate", "SELECT traj, t, event_id FROM v_frames WHERE t % 5 = 0")
def stride_decimate(spark, sf_dir):
    return seq.decimated(frames(spark, sf_dir), ["traj"], "t", 5).select("traj", "t", "event_id")


@query(
    "q_prev_nonempty",
    """SELECT traj, t, last_value(CASE WHEN label <> 'view' THEN label END IGNORE NULLS) OVER (PARTITION BY traj ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM v_frames""",
)
def prev_nonempty(spark, sf_dir):
    marked = frames(spark, sf_dir).select("traj", "t", F.when(F.col("label") != "view", F.col("label")).alias("v"))
    return seq.previous_known(marked, ["traj"], "t", "v", "prev").drop("v")


@query(
    "q_velocity_features",
    "SELECT traj, t, round(coalesce(signal - lag(signal) OVER (PARTITION BY traj ORDER BY t), 0.0), 4) AS velocity FROM v_frames",
)
def velocity_features(spark, sf_dir):
    return seq.difference(frames(spark, sf_dir), ["traj"], "t", "signal", "v").select("traj", "t", F.round("v", 4).alias("velocity"))


@query(
    "q_rolling_velocity",
    """SELECT traj, t, round(CASE WHEN count(*) OVER (PARTITION BY traj) >= 3 THEN sum(signal) OVER (PARTITION BY traj ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 ELSE signal END, 4) AS v FROM v_frames""",
)
def rolling_velocity(spark, sf_dir):
    return seq.rolling_mean(frames(spark, sf_dir), ["traj"], "t", "signal", "m").select("traj", "t", F.round("m", 4).alias("v"))


@query(
    "q_smooth_segments",
    """WITH n AS (SELECT traj, t, signal, count(*) OVER w AS n FROM v_frames WINDOW w AS (PARTITION BY traj)), k AS (SELECT unnest([-2,-1,0,1,2]) AS k),
 j AS (SELECT a.traj, a.t, a.n, CAST(floor((least(a.n, 5) - 1) / 2) AS BIGINT) AS h, k FROM n a, k),
 p AS (SELECT j.*, greatest(0, least(n - 1, t + k)) AS src FROM j WHERE abs(k) <= h)
 SELECT p.traj, p.t, round(sum(f.signal) / (2 * max(h) + 1), 4) AS v FROM p JOIN v_frames f ON f.traj = p.traj AND f.t = p.src GROUP BY p.traj, p.t""",
)
def smooth_segments(spark, sf_dir):
    return seq.edge_padded_mean(frames(spark, sf_dir), ["traj"], "t", "signal", "m", 5).select("traj", "t", F.round("m", 4).alias("v"))


SPANS = f"""a AS (SELECT traj, label, CAST(t AS BIGINT) AS start_frame, CAST(t + event_id % 13 + 1 AS BIGINT) AS end_frame FROM {spans_sql(10)})"""


def _spans(spark, sf_dir):
    f = spans(spark, sf_dir, 10)
    return f.select("traj", "label", F.col("t").alias("start_frame"), (F.col("t") + F.col("event_id") % 13 + 1).alias("end_frame"))


@query(
    "q_interval_overlap",
    f"""WITH {SPANS} SELECT l.traj, l.start_frame AS l_start, r.start_frame AS r_start, least(l.end_frame, r.end_frame) - greatest(l.start_frame, r.start_frame) AS overlap
 FROM a l JOIN a r ON l.traj = r.traj WHERE l.label = 'click' AND r.label = 'view' AND least(l.end_frame, r.end_frame) - greatest(l.start_frame, r.start_frame) >= 1""",
)
def interval_overlap(spark, sf_dir):
    a = _spans(spark, sf_dir)
    out = rel.overlapping(a.where("label = 'click'"), a.where("label = 'view'"), ["traj"])
    return out.select("traj", F.col("l_start_frame").alias("l_start"), F.col("r_start_frame").alias("r_start"), "overlap")


@query(
    "q_clip_overlap",
    f"""WITH {SPANS}, w AS (SELECT traj, CAST(15 AS BIGINT) AS ws, CAST(40 AS BIGINT) AS we FROM (SELECT DISTINCT traj FROM v_frames))
 SELECT a.traj, label, greatest(start_frame, ws) AS start_frame, least(end_frame, we) AS end_frame FROM a JOIN w ON a.traj = w.traj WHERE start_frame < we AND ws < end_frame""",
)
def clip_overlap(spark, sf_dir):
    windows = frames(spark, sf_dir).select("traj").distinct().select("traj", F.lit(15).cast("bigint").alias("start_frame"), F.lit(40).cast("bigint").alias("end_frame"))
    return rel.clipped(_spans(spark, sf_dir), windows, ["traj"]).select("traj", "label", "start_frame", "end_frame")


@query(
    "q_nearest_frame",
    """WITH q AS (SELECT traj, t AS at FROM v_frames WHERE label = 'click'), k AS (SELECT traj, t FROM v_frames WHERE label <> 'click')
 SELECT q.traj, q.at, arg_min(k.t, abs(k.t - q.at) * 100000 + k.t) AS nearest FROM q JOIN k ON q.traj = k.traj GROUP BY q.traj, q.at""",
)
def nearest_frame(spark, sf_dir):
    f = frames(spark, sf_dir)
    wanted, timeline = f.where("label = 'click'").select("traj", F.col("t").alias("at")), f.where("label <> 'click'").select("traj", "t")
    return rel.nearest(wanted, timeline, ["traj"], "at", "t").where("nearest is not null").select("traj", "at", "nearest")


@query(
    "q_positional_zip",
    """WITH l AS (SELECT traj, t AS lt, row_number() OVER (PARTITION BY traj ORDER BY t) AS p FROM v_frames WHERE label = 'click'),
 r AS (SELECT traj, t AS rt, row_number() OVER (PARTITION BY traj ORDER BY t) AS p FROM v_frames WHERE label = 'view') SELECT l.traj, lt, rt FROM l JOIN r ON l.traj = r.traj AND l.p = r.p""",
)
def positional_zip(spark, sf_dir):
    f = frames(spark, sf_dir)
    left, right = (f.where(f"label = '{v}'").select("traj", F.col("t").alias(n)) for v, n in (("click", "lt"), ("view", "rt")))
    return rel.zipped(left, right, ["traj"], [F.col("lt")], [F.col("rt")]).select("traj", "lt", "rt")


@query(
    "q_subsample_linspace",
    """WITH n AS (SELECT traj, count(*) AS n FROM v_frames GROUP BY traj), s AS (SELECT traj, n, unnest(range(16)) AS i FROM n)
 SELECT DISTINCT traj, CAST(floor(i * CAST(n - 1 AS DOUBLE) / 15) AS BIGINT) AS t FROM s""",
)
def subsample_linspace(spark, sf_dir):
    """16 frames spread evenly over each trajectory, fewer where they coincide."""
    n = frames(spark, sf_dir).groupBy("traj").agg(F.count("*").alias("n"))
    places = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.floor(i * (F.col("n") - 1).cast("double") / 15))
    return n.select("traj", F.explode(F.array_distinct(places)).alias("t"))


@query(
    "q_longtask_rank",
    "SELECT traj, event_id, CAST(row_number() OVER (PARTITION BY traj, label ORDER BY t) - 1 AS BIGINT) AS step, count(*) OVER (PARTITION BY traj, label) AS len FROM v_frames",
)
def longtask_rank(spark, sf_dir):
    ranked = seq.ranked_steps(frames(spark, sf_dir), ["traj", "label"], "t")
    return ranked.select("traj", "event_id", F.col("longtask_index").alias("step"), F.col("longtask_len").alias("len"))


@query(
    "q_frame_window_join",
    f"WITH {SPANS} SELECT a.traj, start_frame, count(*) AS n, avg(floor(signal * 100 + 0.5)) AS mean_signal FROM a JOIN v_frames f ON f.traj = a.traj AND f.t >= start_frame AND f.t < end_frame GROUP BY a.traj, start_frame",
)
def frame_window_join(spark, sf_dir):
    f = frames(spark, sf_dir).select("traj", "t", F.floor(F.col("signal") * 100 + 0.5).cast("double").alias("signal"))
    met = intervals.covering(f, _spans(spark, sf_dir), ["traj"], "t")
    return met.groupBy("traj", "start_frame").agg(F.count("*").alias("n"), F.avg("signal").alias("mean_signal"))
