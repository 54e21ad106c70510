"""Queries of motion, scores and picks. The flagship is here."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import scoring as sc
from .registry import boxes, query, tracks

MOTION = """d AS (SELECT cand, traj, t, pt, sqrt(pow(x - lag(x) OVER (PARTITION BY cand, pt ORDER BY t), 2) + pow(y - lag(y) OVER (PARTITION BY cand, pt ORDER BY t), 2)) AS m FROM v_tracks),
 f AS (SELECT traj, cand, t, avg(m) * 10 AS motion FROM d WHERE m IS NOT NULL GROUP BY traj, cand, t)"""
STATS = f"""{MOTION}, p AS (SELECT traj, cand, count(*) FILTER (t BETWEEN 5 AND 9) AS n_interact, count(*) FILTER (t IN (1,2,3,4,10,11,12,13,14)) AS n_rest,
 avg(motion) FILTER (t BETWEEN 5 AND 9) AS im, avg(motion) FILTER (t IN (1,2,3,4,10,11,12,13,14)) AS rm, stddev_pop(motion) FILTER (t BETWEEN 5 AND 9) AS isd FROM f GROUP BY traj, cand)"""


def _interacting():
    return F.col("t").between(5, 9)


def _resting():
    return F.col("t").isin(1, 2, 3, 4, 10, 11, 12, 13, 14)


def _stats(spark, sf_dir):
    motion = sc.frame_motion(tracks(spark, sf_dir), ["traj", "cand"], 10.0)
    return sc.phase_motion(motion, ["traj", "cand"], _interacting(), _resting())


@query("q_phase_motion_snr", f"WITH {STATS} SELECT traj, cand, n_interact, n_rest, round(im, 4) AS interact_mean, round(isd, 4) AS interact_std, round(rm, 4) AS rest_mean, round(pow(im, 0.6) / pow(rm + 1, 0.2), 4) AS snr FROM p")
def phase_motion_snr(spark, sf_dir):
    """Motion of every candidate while interacting and while not, and their ratio."""
    s = _stats(spark, sf_dir)
    r = lambda c: F.round(c, 4)
    return s.select(F.col("traj"), "cand", "n_interact", "n_rest", r("interact_mean").alias("interact_mean"), r("interact_std").alias("interact_std"), r("rest_mean").alias("rest_mean"), r(sc.signal_to_noise()).alias("snr"))


@query("q_replay_snr", f"WITH {STATS} SELECT traj, cand, round(pow(im, 2.0) / pow(rm + 1, 1.6), 4) AS snr FROM p")
def replay_snr(spark, sf_dir):
    return _stats(spark, sf_dir).select("traj", "cand", F.round(sc.signal_to_noise(2.0, 1.6, 1.0), 4).alias("snr"))


@query(
    "q_replay_statistics",
    """WITH v AS (SELECT cand, traj, t, pt, CASE WHEN pt = 0 AND cand % 4 = 0 OR cand % 9 = 0 THEN -1.0 ELSE x END AS x, CASE WHEN pt = 0 AND cand % 4 = 0 OR cand % 9 = 0 THEN -1.0 ELSE y END AS y FROM v_tracks), a AS (SELECT * FROM v WHERE NOT (pt = 0 AND cand % 4 = 0 OR cand % 9 = 0)),
 d AS (SELECT cand, t, pt, sqrt(pow(x - lag(x) OVER (PARTITION BY cand, pt ORDER BY t), 2) + pow(y - lag(y) OVER (PARTITION BY cand, pt ORDER BY t), 2)) AS m FROM a), f AS (SELECT cand, t, avg(m) AS me, median(m) AS md FROM d WHERE m IS NOT NULL GROUP BY cand, t),
 g AS (SELECT cand, count(*) AS n_total, avg(me * 10) AS mean_movement, avg(md * 10) AS median_movement, sum(me) AS total_movement, count(*) FILTER (t BETWEEN 5 AND 9) AS ni, avg(me * 10) FILTER (t BETWEEN 5 AND 9) AS im, avg(me * 10) FILTER (t NOT BETWEEN 5 AND 9) AS rm FROM f GROUP BY cand), p AS (SELECT cand, count(DISTINCT pt) AS np FROM a GROUP BY cand)
 SELECT c.cand, coalesce(n_total, 0) AS n_total, CASE WHEN n_total IS NULL THEN 0 ELSE np END AS n_valid_points, round(coalesce(total_movement, -1), 4) AS total_movement, round(coalesce(median_movement, -1), 4) AS median_movement, round(CASE WHEN c.cand % 2 = 0 AND median_movement IS NOT NULL THEN median_movement / 5 ELSE -1 END, 4) AS norm_movement,
 CASE WHEN n_total IS NULL THEN 0 WHEN c.cand % 5 = 0 THEN n_total ELSE ni END AS interact_frames, n_total IS NULL OR c.cand % 5 = 0 AS phase_fallback, round(CASE WHEN n_total IS NULL THEN -1 WHEN c.cand % 5 = 0 THEN mean_movement ELSE pow(im, 0.6) / pow(rm + 1, 0.2) END, 4) AS snr FROM (SELECT DISTINCT cand FROM v) c LEFT JOIN g ON g.cand = c.cand LEFT JOIN p ON p.cand = c.cand""",
)
def replay_statistics(spark, sf_dir):
    """Some points and some candidates are never seen, some trajectories have one phase, every other has a box."""
    gone = (F.col("pt") == 0) & (F.col("cand") % 4 == 0) | (F.col("cand") % 9 == 0)
    rows = tracks(spark, sf_dir).withColumns({c: F.when(gone, -1.0).otherwise(F.col(c)) for c in ("x", "y")})
    some = tracks(spark, sf_dir).select("cand").distinct().where("cand % 2 = 0")
    diagonal = some.select("cand", F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(3.0).alias("x2"), F.lit(4.0).alias("y2"))
    out = sc.replay_statistics(rows, ["cand"], 10.0, _interacting(), ~_interacting(), diagonal, F.col("cand") % 5 == 0)
    shown = lambda c, name: F.round(F.when(F.col(c) == float("-inf"), -1.0).otherwise(F.col(c)), 4).alias(name)
    return out.select("cand", "n_total", "n_valid_points", shown("total_movement", "total_movement"), shown("median_movement", "median_movement"), shown("norm_movement", "norm_movement"), "interact_frames", "phase_fallback", shown("phase_snr_raw", "snr"))


@query("q_point_motion", f"WITH {MOTION} SELECT cand, pt, round(avg(m) * 10, 4) AS motion FROM d WHERE m IS NOT NULL GROUP BY cand, pt")
def point_motion(spark, sf_dir):
    return sc.displacement(tracks(spark, sf_dir), ["cand"]).groupBy("cand", "pt").agg(F.round(F.avg("moved") * 10, 4).alias("motion"))


@query("q_median_velocity", "WITH d AS (SELECT cand, t, sqrt(pow(x - lag(x) OVER (PARTITION BY cand, pt ORDER BY t), 2) + pow(y - lag(y) OVER (PARTITION BY cand, pt ORDER BY t), 2)) AS m FROM v_tracks) SELECT cand, t, round(median(m) * 10, 4) AS motion FROM d WHERE m IS NOT NULL GROUP BY cand, t")
def median_velocity(spark, sf_dir):
    return sc.frame_motion(tracks(spark, sf_dir), ["cand"], 10.0, "median").withColumn("motion", F.round("motion", 4))


@query("q_scene_baseline", f"WITH {MOTION}, c AS (SELECT traj, cand, avg(motion) AS v FROM f GROUP BY traj, cand) SELECT traj, round(CASE WHEN count(*) >= 3 THEN median(v) ELSE 0.0 END, 4) AS baseline FROM c GROUP BY traj")
def scene_baseline(spark, sf_dir):
    per = sc.frame_motion(tracks(spark, sf_dir), ["traj", "cand"], 10.0).groupBy("traj", "cand").agg(F.avg("motion").alias("v"))
    return per.groupBy("traj").agg(F.round(F.when(F.count("*") >= 3, F.median("v")).otherwise(0.0), 4).alias("baseline"))


@query(
    "q_movement_gate",
    f"WITH {MOTION}, c AS (SELECT traj, cand, avg(motion) AS v FROM f GROUP BY traj, cand), b AS (SELECT *, median(v) OVER (PARTITION BY traj) AS base FROM c) SELECT traj, cand, round(least(ln(1 + 100 * greatest(v - base, 0.0)) / 5, 1.0), 4) AS score FROM b",
)
def movement_gate(spark, sf_dir):
    per = sc.frame_motion(tracks(spark, sf_dir), ["traj", "cand"], 10.0).groupBy("traj", "cand").agg(F.avg("motion").alias("v"))
    base = F.median("v").over(Window.partitionBy("traj"))
    return per.withColumn("base", base).select("traj", "cand", F.round(sc.movement_score(F.col("v"), F.col("base")), 4).alias("score"))


@query("q_minmax_group", "SELECT grp, idx, round(CASE WHEN max(conf) OVER w > min(conf) OVER w THEN (conf - min(conf) OVER w) / (max(conf) OVER w - min(conf) OVER w) ELSE 1.0 END, 4) AS unit FROM v_boxes WINDOW w AS (PARTITION BY grp)")
def minmax_group(spark, sf_dir):
    return boxes(spark, sf_dir).select("grp", "idx", F.round(sc.unit_range("conf", ["grp"]), 4).alias("unit"))


@query("q_dominant_gate", "WITH n AS (SELECT grp, idx, conf, sum(CASE WHEN conf > 0.5 THEN 1 ELSE 0 END) OVER w AS h, sum(CASE WHEN conf > 0.25 THEN 1 ELSE 0 END) OVER w AS l FROM v_boxes WINDOW w AS (PARTITION BY grp)) SELECT grp, idx, h = 1 AND l = 1 AND conf > 0.5 AS dominant FROM n")
def dominant_gate(spark, sf_dir):
    return sc.single_dominant(boxes(spark, sf_dir), ["grp"]).select("grp", "idx", "dominant")


#: Depths in cents: whole numbers, whose sums are the same in any order.
CENTS = "floor(conf * 10500000 + 0.5)"


def _cents():
    return F.floor(F.col("conf") * 10500000 + 0.5).cast("double")


PENALTY = """q AS (SELECT grp, idx, conf, x1, y1, (x1 % 10) / 9.0 AS ov, CASE WHEN y1 % 5 = 0 THEN NULL ELSE (y1 % 30) / 100.0 END AS dz FROM v_boxes),
 r AS (SELECT *, CASE WHEN dz IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, (dz - 0.05) / 0.2)) END AS rel, greatest(0.0, least(1.0, (ov - 0.3) / 0.7)) AS ex FROM q),
 pen AS (SELECT *, 1.45 * ex * ex * (1 - 0.85 * rel) + CASE WHEN ov > 0.98 THEN 0.2 * (1 - rel) ELSE 0.0 END AS penalty FROM r)"""


def _penalised(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumns({"ov": (F.col("x1") % 10) / 9.0, "dz": F.when(F.col("y1") % 5 != 0, (F.col("y1") % 30) / 100.0)})
    return b.withColumn("penalty", sc.overlap_penalty(F.col("ov"), F.col("dz")))


@query("q_quad_penalty", f"WITH {PENALTY} SELECT grp, idx, round(penalty, 4) AS penalty FROM pen")
def quad_penalty(spark, sf_dir):
    return _penalised(spark, sf_dir).select("grp", "idx", F.round("penalty", 4).alias("penalty"))


@query(
    "q_adaptive_score_winner",
    f"""WITH {PENALTY}, n AS (SELECT *, CASE WHEN max(x1) OVER w > min(x1) OVER w THEN (x1 - min(x1) OVER w) / (max(x1) OVER w - min(x1) OVER w) ELSE 1.0 END AS sn, (y1 % 11) / 10.0 AS sph FROM pen WINDOW w AS (PARTITION BY grp)),
 s AS (SELECT *, 0.5 * sn + (0.75 - 0.15 * sph) * conf + 0.3 * sph - penalty AS score FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, idx) AS p FROM s) SELECT grp, idx, round(score, 4) AS score FROM k WHERE p = 1""",
)
def adaptive_score_winner(spark, sf_dir):
    b = _penalised(spark, sf_dir).withColumns({"sn": sc.unit_range("x1", ["grp"]), "sph": (F.col("y1") % 11) / 10.0})
    b = b.withColumn("score", sc.adaptive_score(F.col("sn"), F.col("sph"), F.col("conf"), F.col("penalty")))
    return sc.winner(b, ["grp"], "score", "idx").select("grp", "idx", F.round("score", 4).alias("score"))


@query(
    "q_density_target",
    """WITH a AS (SELECT grp, idx, (x2 - x1) * (y2 - y1) AS area, CAST(x1 % 6 AS BIGINT) AS points FROM v_boxes), m AS (SELECT *, max(area) OVER (PARTITION BY grp) AS ma, first_value(area) OVER (PARTITION BY grp ORDER BY idx) AS sa FROM a),
 d AS (SELECT grp, idx, points / sqrt(area / ma) AS density FROM m WHERE area >= 0.5 * sa AND points > 0), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY density DESC, idx) AS p FROM d) SELECT grp, idx, round(density, 4) AS density FROM k WHERE p = 1""",
)
def density_target(spark, sf_dir):
    b = boxes(spark, sf_dir).select("grp", "idx", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"), (F.col("x1") % 6).cast("bigint").alias("points"))
    b = b.withColumn("start_area", F.first("area").over(Window.partitionBy("grp").orderBy("idx")))
    return sc.density_target(b, ["grp"]).select("grp", "idx", F.round("density", 4).alias("density"))


@query(
    "q_tie_break_winner",
    """WITH a AS (SELECT grp, idx, conf, (x2 - x1) * (y2 - y1) AS area, CAST(x1 % 6 AS BIGINT) AS points, (y1 % 20) / 20.0 AS score FROM v_boxes),
 m AS (SELECT *, max(area) OVER w AS ma, greatest(max(points) OVER w, 1) AS mp, max(score) OVER w AS ms FROM a WINDOW w AS (PARTITION BY grp)),
 c AS (SELECT grp, idx, score + 0.1 * (1 - area / ma) + 0.08 * conf + 0.05 * least(points / (area / ma) / mp, 1.0) AS combined FROM m WHERE score >= ms * 0.7),
 k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY combined DESC, idx) AS p FROM c) SELECT grp, idx AS number, round(combined, 4) AS combined FROM k WHERE p = 1""",
)
def tie_break_winner(spark, sf_dir):
    b = boxes(spark, sf_dir).select("grp", F.col("idx").alias("number"), "conf", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"), (F.col("x1") % 6).cast("bigint").alias("points"), ((F.col("y1") % 20) / 20.0).alias("score"))
    return sc.tie_break(b, ["grp"]).select("grp", "number", F.round("combined", 4).alias("combined"))


@query(
    "q_detector_baseline",
    """WITH s AS (SELECT grp, idx, CASE WHEN x1 % 3 = 0 THEN NULL ELSE conf END AS score FROM v_boxes), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY (score IS NOT NULL) DESC, score DESC NULLS LAST, idx) AS p FROM s) SELECT grp, idx, score FROM k WHERE p = 1""",
)
def detector_baseline(spark, sf_dir):
    b = boxes(spark, sf_dir).select("grp", "idx", F.when(F.col("x1") % 3 != 0, F.col("conf")).alias("score"))
    return sc.detector_baseline(b, ["grp"], "score", "idx")


@query(
    "q_gripper_pick",
    """WITH s AS (SELECT grp, idx, 0.7 * conf + 0.3 * sqrt(least((x2 - x1) * (y2 - y1) / 800.0, 1.0)) AS sc FROM v_boxes), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY sc DESC, idx) AS p FROM s) SELECT grp, idx, sc AS pick_score FROM k WHERE p = 1""",
)
def gripper_pick(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return sc.gripper_pick(b, ["grp"], 800.0).select("grp", "idx", "pick_score")


@query(
    "q_continuous_penalty",
    f"""WITH {MOTION}, m AS (SELECT traj, cand, sum(CASE WHEN t BETWEEN 5 AND 9 THEN motion ELSE 0 END) AS i, sum(CASE WHEN t BETWEEN 5 AND 9 THEN 0 ELSE motion END) AS r FROM f GROUP BY traj, cand)
 SELECT traj, cand, round(1 - CASE WHEN i + r <= 0.001 THEN 0.0 WHEN r <= 0.001 THEN 1.0 ELSE greatest(0.0, least(1.0, i / r - 1)) END, 4) AS penalty FROM m""",
)
def continuous_penalty(spark, sf_dir):
    motion = sc.frame_motion(tracks(spark, sf_dir), ["traj", "cand"], 10.0)
    inside = F.when(_interacting(), F.col("motion")).otherwise(0.0)
    sums = motion.groupBy("traj", "cand").agg(F.sum(inside).alias("interact_sum"), F.sum(F.col("motion") - inside).alias("rest_sum"))
    return sc.continuous_penalty(sums, ["traj", "cand"]).withColumn("penalty", F.round("penalty", 4))


@query(
    "q_mad_trim",
    """WITH m AS (SELECT grp, idx, conf, median(conf) OVER (PARTITION BY grp) AS mid, count(*) OVER (PARTITION BY grp) AS n FROM v_boxes), d AS (SELECT *, median(abs(conf - mid)) OVER (PARTITION BY grp) AS mad FROM m)
 SELECT grp, idx, conf AS z FROM d WHERE n < 3 OR mad <= 1e-9 OR abs(conf - mid) <= 2 * mad""",
)
def mad_trim(spark, sf_dir):
    points = boxes(spark, sf_dir).select("grp", "idx", F.col("conf").alias("z"))
    return sc.depth_trimmed(points, ["grp"])


@query(
    "q_tip_centroid",
    f"""WITH c AS (SELECT *, {CENTS} AS z FROM v_boxes), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY z, x1, y1, idx) AS p FROM c) SELECT grp, avg(x1) AS cx, avg(y1) AS cy, avg(z) AS cz FROM k WHERE p <= 3 GROUP BY grp""",
)
def tip_centroid(spark, sf_dir):
    points = boxes(spark, sf_dir).select("grp", F.col("x1").alias("x"), F.col("y1").alias("y"), _cents().alias("z"), F.col("idx").alias("pt"))
    return sc.tip_centroids(points, ["grp"], 3).select("grp", "cx", "cy", "cz")


@query(
    "q_sphere_fraction",
    """WITH p AS (SELECT grp, idx % 4 AS t, x1 AS x, y1 AS y, conf * 50 AS z FROM v_boxes), s AS (SELECT grp, t, min(x) + 10 AS sx, max(y) - 5 AS sy, 12 + 3 * t AS radius FROM p GROUP BY grp, t),
 i AS (SELECT grp, p.t, CASE WHEN sqrt(pow(x - sx, 2) + pow(y - sy, 2) + pow(z - 20, 2)) <= 1.75 * radius THEN 1.0 ELSE 0.0 END AS i FROM p JOIN s USING (grp, t)),
 f AS (SELECT grp, t, avg(i) AS fr FROM i GROUP BY grp, t) SELECT grp, round(avg(fr), 4) AS mean_fraction, round(max(fr), 4) AS max_fraction FROM f GROUP BY grp""",
)
def sphere_fraction(spark, sf_dir):
    """Every group has spheres of its own, one a frame."""
    points = boxes(spark, sf_dir).select("grp", (F.col("idx") % 4).alias("t"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("conf") * 50).alias("z"))
    spheres = points.groupBy("grp", "t").agg((F.min("x") + 10).alias("sx"), (F.max("y") - 5).alias("sy")).select("grp", "t", "sx", "sy", F.lit(20.0).alias("sz"), (12.0 + 3 * F.col("t")).alias("radius"))
    per = sc.sphere_fraction(points, spheres, ["grp"], multiple=1.75)
    return per.groupBy("grp").agg(F.round(F.avg("fraction"), 4).alias("mean_fraction"), F.round(F.max("fraction"), 4).alias("max_fraction"))


@query(
    "q_top_mean_overlap",
    f"""WITH c AS (SELECT *, {CENTS} AS z FROM v_boxes), k AS (SELECT grp, z, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY z DESC, idx) AS p FROM c) SELECT grp, avg(z) AS peak FROM k WHERE p <= least(n, greatest(3, ceil(n * 0.1))) GROUP BY grp""",
)
def top_mean_overlap(spark, sf_dir):
    return sc.top_mean(boxes(spark, sf_dir).withColumn("z", _cents()), ["grp"], "z", "idx")


@query(
    "q_depth_gap",
    f"""WITH c AS (SELECT *, {CENTS} AS z FROM v_boxes), a AS (SELECT grp, idx // 2 AS t, avg(z) AS z FROM c WHERE idx % 2 = 0 GROUP BY grp, idx // 2), b AS (SELECT grp, idx // 2 AS t, avg(z) AS z FROM c WHERE idx % 2 = 1 GROUP BY grp, idx // 2) SELECT a.grp, median(abs(a.z - b.z)) AS dz FROM a JOIN b ON a.grp = b.grp AND a.t = b.t GROUP BY a.grp""",
)
def depth_gap(spark, sf_dir):
    """Median depth between two traces over the frames that both have."""
    traces = boxes(spark, sf_dir).select("grp", F.floor(F.col("idx") / 2).alias("t"), (F.col("idx") % 2).alias("side"), _cents().alias("z"))
    return sc.depth_gap(traces, ["grp"], "side", 0, 1)
