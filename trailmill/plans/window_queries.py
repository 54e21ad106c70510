"""Queries of hands, windows, keyframes, composites and publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hands, phases, relational, windows
from ..operators import scoring as sc
from ..operators import sequences as seq
from ..sources import datasets
from . import publication as pub
from . import selector
from .registry import boxes, frames, query, spans, spans_sql, table, tracks


def _slots(spark, sf_dir):
    """Frames with a box in the hand's own slot, in the shared one, or none."""
    x = (F.col("event_id") % 40 + 1).cast("double")
    box = F.struct(x.alias("x1"), F.lit(1.0).alias("y1"), (x + 30).alias("x2"), F.lit(31.0).alias("y2"))
    f = frames(spark, sf_dir).select("traj", "t", "event_id", "signal")
    return f.select("traj", "t", F.when(F.col("signal") > 40, box).alias("own"), F.when(F.col("signal") < 15, box).alias("shared"))


@query(
    "q_hand_phases",
    """WITH f AS (SELECT traj, t, CAST(event_id % 40 + 1 AS DOUBLE) AS x, signal > 40 OR signal < 15 AS b FROM v_frames), c1 AS (SELECT *, CASE WHEN b <> lag(b) OVER w THEN 1 ELSE 0 END AS ch FROM f WINDOW w AS (PARTITION BY traj ORDER BY t)), i1 AS (SELECT *, sum(ch) OVER (PARTITION BY traj ORDER BY t) AS k FROM c1),
 b2 AS (SELECT traj, t, x, b, b OR count(*) OVER (PARTITION BY traj, k) < 2 AS h FROM i1), c2 AS (SELECT *, CASE WHEN h <> lag(h) OVER w THEN 1 ELSE 0 END AS ch FROM b2 WINDOW w AS (PARTITION BY traj ORDER BY t)), i2 AS (SELECT *, sum(ch) OVER (PARTITION BY traj ORDER BY t) AS k FROM c2),
 b3 AS (SELECT traj, t, x, b, h AND count(*) OVER (PARTITION BY traj, k) >= 2 AS h FROM i2), c3 AS (SELECT *, CASE WHEN h <> lag(h) OVER w THEN 1 ELSE 0 END AS ch FROM b3 WINDOW w AS (PARTITION BY traj ORDER BY t)), i3 AS (SELECT *, sum(ch) OVER (PARTITION BY traj ORDER BY t) AS k FROM c3),
 r AS (SELECT *, min(t) OVER (PARTITION BY traj, k) AS s, max(t) OVER (PARTITION BY traj, k) + 1 AS e FROM i3 WHERE h), l AS (SELECT *, last_value(CASE WHEN b THEN x END IGNORE NULLS) OVER (PARTITION BY traj, s ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS px FROM r),
 j AS (SELECT *, sum(CASE WHEN b AND px IS NOT NULL AND greatest(0, 30 - abs(x - px)) * 30 / (1800 - greatest(0, 30 - abs(x - px)) * 30) < 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY traj, s ORDER BY t) AS piece FROM l),
 g AS (SELECT traj, s, e, piece, min(t) AS first_t, count(*) FILTER (b) AS n_box FROM j GROUP BY traj, s, e, piece), w AS (SELECT traj, CASE WHEN row_number() OVER v = 1 THEN s ELSE first_t END AS a, coalesce(lead(first_t) OVER v, e) AS z, n_box FROM g WINDOW v AS (PARTITION BY traj, s ORDER BY piece)),
 p AS (SELECT * FROM w WHERE z - a >= 3 AND n_box > 0), q AS (SELECT traj, a, z, n_box / (z - a) AS coverage, a - coalesce(lag(z) OVER v, 0) AS ob, coalesce(lead(a) OVER v, 100) - z AS oa FROM p WINDOW v AS (PARTITION BY traj ORDER BY a))
 SELECT traj, a AS start_frame, z AS end_frame, coverage, ob AS open_before, oa AS open_after, ob >= 3 AND coverage >= 0.6 AS is_clean FROM q""",
)
def hand_phases(spark, sf_dir):
    """Contact phases with their quality; held against a plain loop in the tests too."""
    found = hands.interactions(_slots(spark, sf_dir), ["traj"], "own", "shared", 10.0)
    judged = hands.quality(found.withColumn("hand_iou", F.lit(0.1)), ["traj"], F.lit(100), 10.0)
    return judged.select("traj", "start_frame", "end_frame", "coverage", "open_before", "open_after", "is_clean")


PHASES = f"""p AS (SELECT traj, t // 10 AS k, CAST(t AS BIGINT) AS start_frame, CAST(t + 4 + event_id % 9 AS BIGINT) AS end_frame, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS hand, CAST(event_id % 50 AS DOUBLE) AS x FROM {spans_sql(5)})"""


def _hand_spans(spark, sf_dir):
    x = (F.col("event_id") % 50).cast("double")
    box = F.struct(x.alias("x1"), F.lit(0.0).alias("y1"), (x + 20).alias("x2"), F.lit(20.0).alias("y2"))
    return spans(spark, sf_dir, 5).select("traj", F.col("t").alias("start_frame"), (F.col("t") + 4 + F.col("event_id") % 9).alias("end_frame"), F.when(F.col("event_id") % 2 == 0, "left").otherwise("right").alias("hand"), box.alias("first_box"))


@query(
    "q_bimanual_roles",
    f"""WITH {PHASES}, m AS (SELECT l.traj, l.start_frame AS ls, r.start_frame AS rs FROM p l JOIN p r ON l.traj = r.traj AND l.hand = 'left' AND r.hand = 'right'
 WHERE least(l.end_frame, r.end_frame) - greatest(l.start_frame, r.start_frame) >= 1 AND greatest(0.0, 20 - abs(l.x - r.x)) / (40 - greatest(0.0, 20 - abs(l.x - r.x))) <= 0.3),
 b AS (SELECT traj, 'left' AS hand, ls AS s FROM m UNION SELECT traj, 'right', rs FROM m)
 SELECT p.traj, p.start_frame, p.hand, CASE WHEN b.s IS NULL THEN 'single' ELSE 'two_object' END AS role FROM p LEFT JOIN b ON b.traj = p.traj AND b.hand = p.hand AND b.s = p.start_frame""",
)
def bimanual_roles(spark, sf_dir):
    return hands.paired(_hand_spans(spark, sf_dir), ["traj"]).select("traj", "start_frame", "hand", "role")


@query("q_phase_rescale", f"WITH {PHASES} SELECT traj, start_frame // 3 AS start_frame, CAST(least(ceil(end_frame / 3.0), 20) AS BIGINT) AS end_frame FROM p WHERE least(ceil(end_frame / 3.0), 20) > least(start_frame // 3, 20)")
def phase_rescale(spark, sf_dir):
    out = hands.rescaled(_hand_spans(spark, sf_dir), 3, F.lit(20))
    return out.select("traj", F.col("start_frame").cast("bigint").alias("start_frame"), F.col("end_frame").cast("bigint").alias("end_frame"))


@query("q_gripper_from_phases", f"WITH {PHASES} SELECT f.traj, f.t, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.traj = f.traj AND p.hand = 'left' AND f.t >= p.start_frame AND f.t < p.end_frame) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS gripper FROM v_frames f")
def gripper_from_phases(spark, sf_dir):
    held = _hand_spans(spark, sf_dir).where("hand = 'left'")
    return hands.gripper_from_phases(frames(spark, sf_dir).select("traj", "t"), held, ["traj"])


EPISODES = f"""e AS (SELECT traj, t // 12 AS episode, t AS start_frame, t + 3 AS end_frame, CASE WHEN t % 12 = 0 THEN 'grasp' WHEN t % 12 = 4 AND event_id % 3 > 0 THEN 'interact' ELSE 'release' END AS phase FROM {spans_sql(4)})"""


def _episodes(spark, sf_dir):
    t = F.col("t")
    phase = F.when(t % 12 == 0, "grasp").when((t % 12 == 4) & (F.col("event_id") % 3 > 0), "interact").otherwise("release")
    return spans(spark, sf_dir, 4).select("traj", F.floor(t / 12).alias("episode"), t.alias("start_frame"), (t + 3).alias("end_frame"), phase.alias("phase"))


@query(
    "q_storyboard",
    f"WITH {EPISODES}, g AS (SELECT traj, episode, min(start_frame) FILTER (phase = 'interact') AS i, min(start_frame) AS s, max(end_frame) AS z FROM e GROUP BY traj, episode) SELECT traj, episode, coalesce(i + i + 3, s + z) // 2 AS frame FROM g",
)
def storyboard(spark, sf_dir):
    return windows.storyboard(_episodes(spark, sf_dir), ["traj"])


@query("q_parsing_mode", f"WITH {EPISODES} SELECT traj, CASE WHEN count(*) FILTER (phase = 'release') > 1 THEN 'semantic' ELSE 'text' END AS mode FROM e GROUP BY traj")
def parsing_mode(spark, sf_dir):
    return windows.parsing_mode(_episodes(spark, sf_dir), ["traj"])


@query(
    "q_phase_masks",
    f"""WITH {EPISODES}, n AS (SELECT traj, count(*) AS n FROM v_frames GROUP BY traj), s AS (SELECT e.traj, round_even(start_frame * (n / 120.0), 0) AS a, round_even(end_frame * (n / 120.0), 0) + 1 AS b FROM e JOIN n ON n.traj = e.traj WHERE phase = 'interact')
 , i AS (SELECT f.traj, f.t, n.n, EXISTS (SELECT 1 FROM s WHERE s.traj = f.traj AND f.t >= s.a AND f.t < s.b) AS inside FROM v_frames f JOIN n ON n.traj = f.traj)
 SELECT traj, t, inside AS interacting, NOT inside AND t >= least(3, n // 10) AND t < n - least(3, n // 10) AS resting FROM i""",
)
def phase_masks(spark, sf_dir):
    f = frames(spark, sf_dir).select("traj", "t")
    n = f.groupBy("traj").agg(F.count("*").alias("n"))
    episodes = _episodes(spark, sf_dir).join(n, "traj")
    held = episodes.where("phase = 'interact'").select("traj", F.rint(F.col("start_frame") * (F.col("n") / 120.0)).alias("start_frame"), F.rint(F.col("end_frame") * (F.col("n") / 120.0)).alias("end_frame"), "phase")
    # Ends are on the timeline already, so that one scale serves all trajectories.
    timeline = f.join(n, "traj")
    out = windows.frame_masks(f, held, ["traj"], F.lit(1_000_000), F.lit(1_000_000))
    margin = F.least(F.lit(3), F.floor(F.col("n") / 10))
    out = out.join(timeline, ["traj", "t"])
    return out.select("traj", "t", "interacting", (~F.col("interacting") & (F.col("t") >= margin) & (F.col("t") < F.col("n") - margin)).alias("resting"))


@query(
    "q_subtask_windows",
    f"""WITH s AS (SELECT traj, t // 20 AS subtask, t AS g0, t + 5 AS g1, t + 6 AS i0, t + 12 + event_id % 6 AS i1, event_id % 4 AS kind FROM {spans_sql(20)}),
 w AS (SELECT *, CASE WHEN kind = 0 THEN 0 ELSE g0 END AS s0, CASE WHEN kind = 0 THEN 99 WHEN kind = 1 THEN g1 ELSE i1 END AS e0, CASE WHEN kind = 0 THEN NULL WHEN kind = 1 THEN g1 ELSE i1 END AS ke FROM s),
 b AS (SELECT *, last_value(ke IGNORE NULLS) OVER (PARTITION BY traj ORDER BY subtask ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf, lead(subtask) OVER (PARTITION BY traj ORDER BY subtask) IS NULL AS lst FROM w),
 m AS (SELECT *, CASE WHEN bf IS NULL OR kind = 0 THEN s0 WHEN kind > 1 THEN bf + CAST(floor((g1 - bf) * 3 / 4.0) AS BIGINT) ELSE bf + least(15, CAST(floor((e0 - s0) / 4.0) AS BIGINT)) END AS ms, CASE WHEN lst THEN 99 ELSE e0 END AS me FROM b),
 f AS (SELECT *, greatest(0, least(ms, 99)) AS sf FROM m) SELECT traj, subtask, CAST(sf AS BIGINT) AS start_frame, CAST(greatest(sf + 1, least(me, 99)) AS BIGINT) AS end_frame FROM f""",
)
def subtask_windows(spark, sf_dir):
    t, kind = F.col("t"), F.col("event_id") % 4
    grasp = F.struct(t.alias("start_frame"), (t + 5).alias("end_frame"), F.lit("grasp").alias("phase"))
    interact = F.struct((t + 6).alias("start_frame"), (t + 12 + F.col("event_id") % 6).alias("end_frame"), F.lit("interact").alias("phase"))
    both = F.array(grasp, interact)
    listed = F.slice(both, 1, F.when(kind == 0, 0).when(kind == 1, 1).otherwise(2))
    subtasks = spans(spark, sf_dir, 20).select("traj", F.floor(t / 20).alias("subtask"), listed.alias("phases"))
    out = windows.subtask_windows(subtasks, ["traj"], F.lit(100))
    return out.select("traj", "subtask", F.col("start_frame").cast("bigint").alias("start_frame"), F.col("end_frame").cast("bigint").alias("end_frame"))


@query("q_keyframes", f"SELECT traj, t, '0,' || CAST(floor((t + t + 5) / 2) - t AS BIGINT) || ',5,' || (11 + event_id % 6) AS keyframes FROM {spans_sql(20)} k")
def keyframes(spark, sf_dir):
    t = F.col("t")
    listed = F.array(F.struct(t.alias("start_frame"), (t + 5).alias("end_frame"), F.lit("grasp").alias("phase")), F.struct((t + 6).alias("start_frame"), (t + 12 + F.col("event_id") % 6).alias("end_frame"), F.lit("interact").alias("phase")))
    frames_at = windows.keyframes(listed, t, t + 30, F.lit(31))
    return spans(spark, sf_dir, 20).select("traj", "t", F.array_join(frames_at.cast("array<string>"), ",").alias("keyframes"))


@query(
    "q_keyframe_budget",
    """WITH o AS (SELECT traj, list(t ORDER BY t) FILTER (t % 7 = 0) AS need, list(t ORDER BY t) FILTER (t % 7 <> 0) AS opt FROM v_frames GROUP BY traj), c AS (SELECT *, greatest(12 - len(need), 0) AS room FROM o)
 SELECT traj, CAST(CASE WHEN len(opt) <= room THEN len(need) + len(opt) ELSE len(need) + room END AS BIGINT) AS n, CAST(list_sum(need) + CASE WHEN len(opt) <= room THEN list_sum(opt) WHEN room = 0 THEN 0 ELSE list_sum(list_transform(range(room), lambda i: opt[1 + CAST(floor(CASE WHEN room > 1 THEN i * CAST(len(opt) - 1 AS DOUBLE) / (room - 1) ELSE 0 END) AS BIGINT)])) END AS BIGINT) AS total FROM c""",
)
def keyframe_budget(spark, sf_dir):
    t = F.col("t")
    grouped = frames(spark, sf_dir).groupBy("traj").agg(F.collect_list(F.when(t % 7 == 0, t)).alias("need"), F.collect_list(F.when(t % 7 != 0, t)).alias("opt"))
    kept = windows.within_budget(F.col("need"), F.col("opt"), 12)
    return grouped.select("traj", F.size(kept).cast("bigint").alias("n"), F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("q_video_frame", "SELECT traj, t, CAST(greatest(least(round_even((t / 7.0 + 0.25) * 10, 0), 60), 0) AS BIGINT) AS frame FROM v_frames")
def video_frame(spark, sf_dir):
    at = datasets.video_frame(F.col("t") / 7.0, F.lit(0.25), F.lit(10), F.lit(61))
    return frames(spark, sf_dir).select("traj", "t", at.alias("frame"))


@query(
    "q_keyframe_lookup",
    """WITH k AS (SELECT traj, t AS idx, t % 9 AS end_frame, label AS kind FROM v_frames), w AS (SELECT traj, t AS at, t % 9 AS end_frame, CASE WHEN event_id % 2 = 0 THEN label ELSE 'none' END AS kind FROM v_frames)
 SELECT w.traj, w.at, coalesce((SELECT min(idx) FROM k WHERE k.traj = w.traj AND k.end_frame = w.end_frame AND k.kind = w.kind), (SELECT min(idx) FROM k WHERE k.traj = w.traj AND k.end_frame = w.end_frame)) AS keyframe FROM w""",
)
def keyframe_lookup(spark, sf_dir):
    f, t = frames(spark, sf_dir), F.col("t")
    known = f.select("traj", t.alias("idx"), (t % 9).alias("end_frame"), F.col("label").alias("kind"))
    wanted = f.select("traj", t.alias("at"), (t % 9).alias("end_frame"), F.when(F.col("event_id") % 2 == 0, F.col("label")).otherwise("none").alias("kind"))
    return relational.exact_or_same_end(wanted, known, ["traj"]).select("traj", "at", "keyframe")


@query("q_box_tolerance", "SELECT i.grp, i.idx AS a, min(j.idx) AS b FROM v_boxes i JOIN v_boxes j ON i.grp = j.grp AND abs(i.x1 - j.x1) <= 1 + 1e-5 * abs(j.x1) AND abs(i.y1 - j.y1) <= 1 + 1e-5 * abs(j.y1) GROUP BY i.grp, i.idx")
def box_tolerance(spark, sf_dir):
    """The first box of a group whose corner is the same but for a pixel."""
    b = boxes(spark, sf_dir)
    left, right = (b.select("grp", F.col("idx").alias(n), F.array("x1", "y1").alias(f"{n}_at")) for n in ("a", "b"))
    return left.join(right, "grp").where(windows.close_to(F.col("a_at"), F.col("b_at"), 1.0)).groupBy("grp", "a").agg(F.min("b").alias("b"))


PAIRS = """p AS (SELECT i.grp, i.idx AS start, j.idx AS target, CAST((i.x1 + j.y1) % 6 AS BIGINT) AS points, i.conf / 10 AS movement, i.conf AS own, (j.y1 % 10) / 10.0 AS temporal, (i.y1 % 10) / 10.0 AS inter FROM v_boxes i JOIN v_boxes j ON i.grp = j.grp)"""


def _pairs(spark, sf_dir):
    b = boxes(spark, sf_dir)
    i = b.select("grp", F.col("idx").alias("start"), F.col("x1").alias("ix"), F.col("y1").alias("iy"), F.col("conf").alias("ic"))
    j = b.select("grp", F.col("idx").alias("target"), F.col("y1").alias("jy"))
    return i.join(j, "grp").select(
        "grp", "start", "target", ((F.col("ix") + F.col("jy")) % 6).cast("bigint").alias("points"), (F.col("ic") / 10).alias("movement"), F.col("ic").alias("own_movement"),
        ((F.col("jy") % 10) / 10.0).alias("temporal"), ((F.col("iy") % 10) / 10.0).alias("intermediate"), F.lit(0.1).alias("nested"), F.lit(0.2).alias("continuous"),
    )


@query(
    "q_preliminary_selector",
    f"""WITH {PAIRS}, s AS (SELECT grp, CASE WHEN count(own) >= 3 THEN median(own) ELSE 0.0 END AS base FROM (SELECT DISTINCT grp, start, own FROM p) GROUP BY grp),
 c AS (SELECT p.*, base, greatest(max(points) OVER (PARTITION BY p.grp), 1) AS most, least(1.0, CASE WHEN base <= 0 THEN own / 0.01 ELSE greatest(0.0, own / base - 1) END) AS gate, least(ln(1 + 100 * greatest(movement - base, 0.0)) / 5, 1.0) AS mv FROM p JOIN s ON s.grp = p.grp),
 r AS (SELECT grp, start, target, CASE WHEN movement < 0.005 OR points < 1 THEN 0.0 ELSE (0.35 * points / most * gate + 0.35 * mv + 0.15 * temporal + 0.15 * inter) * CASE WHEN points > 2 AND movement > 0.01 AND temporal > 0.5 THEN 1.3 ELSE 1.0 END END * 0.9 * 0.8 AS score FROM c)
 SELECT grp, start, target, round(score, 4) AS score FROM r""",
)
def preliminary_selector(spark, sf_dir):
    return pub.preliminary_score(_pairs(spark, sf_dir), ["grp"]).select("grp", "start", "target", F.round("score", 4).alias("score"))


@query(
    "q_selected_pairs",
    """WITH p AS (SELECT traj, cand, pt, t, floor((x + 1) * 500) AS x, floor((y + 1) * 500) AS y, NOT (pt = 1 AND cand % 7 = 0) AS visible FROM v_tracks), st AS (SELECT traj, cand, min(x) - 30 AS x1, min(y) - 30 AS y1, max(x) + 30 + cand % 5 * 40 AS x2, max(y) + 30 + cand % 5 * 40 AS y2 FROM p WHERE t = 0 GROUP BY traj, cand),
 ta AS (SELECT traj, k AS target, 300.0 + 100 * k AS x1, 350.0 + 20 * k AS y1, 480.0 + 130 * k AS x2, 600.0 AS y2, 0.5 + 0.1 * k AS conf FROM (SELECT DISTINCT traj FROM p), (SELECT unnest(range(3)) AS k)), al AS (SELECT * FROM p WHERE visible),
 dn AS (SELECT traj, cand, pt, t, sqrt(pow(x / 1000.0 - lag(x / 1000.0) OVER w, 2) + pow(y / 1000.0 - lag(y / 1000.0) OVER w, 2)) AS m, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS px FROM al WINDOW w AS (PARTITION BY traj, cand, pt ORDER BY t)), d AS (SELECT * FROM dn WHERE m IS NOT NULL),
 pp AS (SELECT traj, cand, pt, avg(m) AS me, sum(m) FILTER (t BETWEEN 5 AND 9) AS si, count(*) FILTER (t BETWEEN 5 AND 9) AS ni, sum(m) FILTER (t NOT BETWEEN 5 AND 9) AS so, count(*) FILTER (t NOT BETWEEN 5 AND 9) AS no FROM d GROUP BY traj, cand, pt), la AS (SELECT traj, cand, pt, x, y FROM al WHERE t = 15),
 ar AS (SELECT la.traj, la.cand, target, count(*) AS points, avg(me) AS movement, sum(si) / sum(ni) AS mi, sum(so) / sum(no) AS mo FROM la JOIN pp USING (traj, cand, pt) JOIN ta ON ta.traj = la.traj AND x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2 GROUP BY la.traj, la.cand, target),
 v AS (SELECT traj, cand, t, median(px) * 10 AS mo FROM d GROUP BY traj, cand, t), sm AS (SELECT traj, cand, sum(mo) OVER (PARTITION BY traj, cand ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS s FROM v), sp AS (SELECT traj, cand, avg(s) AS own FROM sm GROUP BY traj, cand),
 e AS (SELECT st.traj, st.cand, ta.target, coalesce(points, 0) AS points, coalesce(movement, 0.0) AS movement, coalesce(CASE WHEN mi + mo > 0.001 THEN mi / (mi + mo) ELSE 0.0 END, 0.0) AS temporal, own FROM st JOIN ta ON ta.traj = st.traj LEFT JOIN ar ON ar.traj = st.traj AND ar.cand = st.cand AND ar.target = ta.target LEFT JOIN sp ON sp.traj = st.traj AND sp.cand = st.cand),
 nx AS (SELECT i.traj, i.cand, greatest(0.0, least(i.x2, j.x2) - greatest(i.x1, j.x1)) * greatest(0.0, least(i.y2, j.y2) - greatest(i.y1, j.y1)) / ((i.x2 - i.x1) * (i.y2 - i.y1)) AS ratio, j.cand AS outer_cand FROM st i JOIN st j ON i.traj = j.traj AND i.cand <> j.cand WHERE (j.x2 - j.x1) * (j.y2 - j.y1) > (i.x2 - i.x1) * (i.y2 - i.y1)),
 ne AS (SELECT a.traj, a.cand, a.target, max(0.15 * (least(a.points, b.points) / greatest(a.points, b.points) + CASE WHEN greatest(a.movement, b.movement) > 0 THEN least(a.movement, b.movement) / greatest(a.movement, b.movement) ELSE 1.0 END) / 2) AS pen FROM nx JOIN e a ON a.traj = nx.traj AND a.cand = nx.cand JOIN e b ON b.traj = nx.traj AND b.cand = nx.outer_cand AND b.target = a.target
  WHERE ratio > 0.3 AND a.points >= 1 AND b.points >= 1 AND least(a.points, b.points) / greatest(a.points, b.points) > 0.5 AND CASE WHEN greatest(a.movement, b.movement) > 0 THEN least(a.movement, b.movement) / greatest(a.movement, b.movement) ELSE 1.0 END > 0.5 GROUP BY a.traj, a.cand, a.target),
 bs AS (SELECT traj, CASE WHEN count(own) >= 3 THEN median(own) ELSE 0.0 END AS base FROM (SELECT DISTINCT traj, cand, own FROM e) GROUP BY traj), c AS (SELECT e.*, coalesce(pen, 0.0) AS pen, base, greatest(max(points) OVER (PARTITION BY e.traj), 1) AS most FROM e JOIN bs ON bs.traj = e.traj LEFT JOIN ne ON ne.traj = e.traj AND ne.cand = e.cand AND ne.target = e.target),
 g AS (SELECT *, CASE WHEN own > 0 THEN least(1.0, CASE WHEN base <= 0 THEN own / 0.01 ELSE greatest(0.0, own / base - 1) END) ELSE 0.0 END AS gate FROM c),
 s AS (SELECT *, CASE WHEN movement < 0.0005 OR points < 1 THEN 0.0 ELSE (0.35 / 0.85 * points / most * gate + 0.35 / 0.85 * least(ln(1 + 100 * greatest(movement - base, 0.0)) / 5, 1.0) + 0.15 / 0.85 * temporal) * CASE WHEN points > 2 AND movement > 0.001 AND temporal > 0.5 THEN 1.3 ELSE 1.0 END END * (1 - pen) AS score FROM g),
 z AS (SELECT s.*, conf, (x2 - x1) * (y2 - y1) AS area, max(score) OVER (PARTITION BY s.traj) AS top, max((x2 - x1) * (y2 - y1)) OVER (PARTITION BY s.traj) AS largest FROM s JOIN ta ON ta.traj = s.traj AND ta.target = s.target),
 k AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY score + 0.1 * (1 - area / largest) + 0.08 * conf + 0.05 * least(points / (area / largest) / most, 1.0) DESC, cand, target) AS p FROM z WHERE top > 0 AND score >= top * 0.7)
 SELECT traj, cand AS start, target, CAST(points AS BIGINT) AS points, CASE WHEN movement < 0.001 THEN 'best_match_insufficient_movement' WHEN points < 2 THEN 'best_match_insufficient_points' END AS reason FROM k WHERE p = 1""",
)
def selected_pairs(spark, sf_dir):
    """From tracks to the best pair of start and target, on images of a thousand pixels; some points are never seen."""
    pixel = lambda c: F.floor((F.col(c) + 1) * 500).cast("double").alias(c)
    points = tracks(spark, sf_dir).select("traj", F.col("cand").alias("start"), "pt", "t", pixel("x"), pixel("y"), (~((F.col("pt") == 1) & (F.col("cand") % 7 == 0))).alias("visible"))
    grow = F.col("start") % 5 * 40
    starts = points.where("t = 0").groupBy("traj", "start").agg((F.min("x") - 30).alias("x1"), (F.min("y") - 30).alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    starts = starts.withColumns({"x2": F.col("x2") + 30 + grow, "y2": F.col("y2") + 30 + grow})
    box = lambda k: F.struct(F.lit(k).alias("target"), F.lit(300.0 + 100 * k).alias("x1"), F.lit(350.0 + 20 * k).alias("y1"), F.lit(480.0 + 130 * k).alias("x2"), F.lit(600.0).alias("y2"), F.lit(0.5 + 0.1 * k).alias("conf"))
    targets = points.select("traj").distinct().select("traj", F.explode(F.array(*map(box, range(3)))).alias("b")).select("traj", F.col("b.target").cast("bigint").alias("target"), "b.x1", "b.y1", "b.x2", "b.y2", "b.conf")
    out = selector.selected_pairs(points, starts, targets, ["traj"], F.col("t").between(5, 9), (1000.0, 1000.0), 10.0)
    return out.select("traj", "start", "target", "points", "reason")


@query(
    "q_confidence",
    """SELECT grp, idx, round((0.25 * conf + CASE WHEN idx % 4 = 0 THEN 0 ELSE 0.75 * (y1 / 61) END) * CASE idx % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 ELSE 0.2 END, 4) AS confidence FROM v_boxes""",
)
def confidence(spark, sf_dir):
    reason = F.when(F.col("idx") % 3 == 1, pub.MILD_REJECTIONS[0]).when(F.col("idx") % 3 == 2, "no_match")
    tracking = F.when(F.col("idx") % 4 != 0, F.col("y1") / 61)
    return boxes(spark, sf_dir).select("grp", "idx", pub.confidence(F.col("conf"), tracking, reason).alias("confidence"))


@query(
    "q_lightweight_features",
    """WITH q AS (SELECT grp, idx AS cand, x1 AS snr, y1 AS sphere, conf, (x1 % 10) / 9.0 AS ov, (y1 % 30) / 100.0 AS dz FROM v_boxes), n AS (SELECT *, CASE WHEN max(snr) OVER w > min(snr) OVER w THEN (snr - min(snr) OVER w) / (max(snr) OVER w - min(snr) OVER w) ELSE 1.0 END AS sn,
 CASE WHEN max(sphere) OVER w > min(sphere) OVER w THEN (sphere - min(sphere) OVER w) / (max(sphere) OVER w - min(sphere) OVER w) ELSE 1.0 END AS sp, greatest(0.0, least(1.0, (dz - 0.05) / 0.2)) AS rel, greatest(0.0, least(1.0, (ov - 0.3) / 0.7)) AS ex FROM q WINDOW w AS (PARTITION BY grp)),
 s AS (SELECT grp, cand, 0.5 * sn + (0.75 - 0.15 * sp) * conf + 0.3 * sp - (1.45 * ex * ex * (1 - 0.85 * rel) + CASE WHEN ov > 0.98 THEN 0.2 * (1 - rel) ELSE 0.0 END) AS score FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, cand) AS p FROM s) SELECT grp, cand, round(score, 4) AS score FROM k WHERE p = 1""",
)
def lightweight_features(spark, sf_dir):
    signals = boxes(spark, sf_dir).select("grp", F.col("idx").alias("cand"), F.col("x1").alias("snr"), F.col("y1").alias("sphere"), "conf", ((F.col("x1") % 10) / 9.0).alias("overlap"), ((F.col("y1") % 30) / 100.0).alias("depth_gap"))
    return sc.winner(pub.features(signals, ["grp"]), ["grp"], "score").select("grp", "cand", F.round("score", 4).alias("score"))


@query("q_depth_rescue", "SELECT grp, idx, (x1 % 10) / 9.0 < 0.3 OR (y1 % 5 > 0 AND (y1 % 30) / 100.0 > 0.08) AS keep FROM v_boxes")
def depth_rescue(spark, sf_dir):
    distance = F.when(F.col("y1") % 5 > 0, (F.col("y1") % 30) / 100.0)
    return boxes(spark, sf_dir).select("grp", "idx", pub.depth_rescued((F.col("x1") % 10) / 9.0, distance).alias("keep"))


@query("q_selection_override", "SELECT grp, idx, round(CASE WHEN idx % 2 = 0 THEN 2.5 ELSE conf END, 6) AS score, CASE WHEN idx % 2 = 0 THEN 'override' ELSE 'pick' END AS method FROM v_boxes")
def selection_override(spark, sf_dir):
    kind = "struct<method:string,score:double,index:bigint,reason:string>"
    override = F.when(F.col("idx") % 2 == 0, F.struct(F.lit("override").alias("method"), F.lit(2.5).alias("score"), F.lit(0).cast("bigint").alias("index"), F.lit(None).cast("string").alias("reason"))).cast(kind)
    pick = F.struct(F.lit("pick").alias("method"), F.lit(None).cast("double").alias("score"), F.lit(0).cast("bigint").alias("index"), F.lit(None).cast("string").alias("reason")).cast(kind)
    chosen = pub.selection(override, pick, F.array("conf"))
    return boxes(spark, sf_dir).select("grp", "idx", chosen["score"].alias("score"), chosen["method"].alias("method"))


@query("q_source_episode", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 100 ELSE o_custkey END AS episode FROM orders")
def source_episode(spark, sf_dir):
    path = F.concat(F.lit("task/ep"), (F.col("o_orderkey") % 100).cast("string"), F.lit("/sub"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", pub.source_episode(path, F.lit(None).cast("bigint"), F.col("o_orderkey") % 2 == 0).alias("episode"))


@query(
    "q_published_annotations",
    """SELECT o_orderkey, 'sha256:' || sha256('{"camera_view":null,"dataset_id":"orders","end_frame_exclusive":9,"start_frame":0,"subtask_index":1,"trajectory_id":"' || o_orderkey || '"}') AS annotation_id, o_orderpriority AS instruction FROM orders""",
)
def published_annotations(spark, sf_dir):
    """Published rows with their identities, read back from their lines."""
    rows = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("dataset_id"), F.col("o_orderkey").cast("string").alias("trajectory_id"), F.lit(1).alias("subtask_index"), F.lit(None).cast("string").alias("camera_view"),
        F.lit(0).alias("start_frame"), F.lit(9).alias("end_frame"), F.col("o_orderpriority").alias("instruction"), F.struct(F.col("o_totalprice").alias("score")).alias("selection"),
    )
    get = lambda p: F.get_json_object("line", p)
    return pub.published_rows(rows).select(get("$.source.trajectory_id").cast("bigint").alias("o_orderkey"), get("$.annotation_id").alias("annotation_id"), get("$.task.instruction").alias("instruction"))


@query("q_track_coverage", "SELECT cand, pt, count(*) FILTER (x >= 0) AS n_valid, min(t) FILTER (x >= 0) AS first_t, max(t) FILTER (x >= 0) AS last_t FROM v_tracks GROUP BY cand, pt HAVING NOT bool_and(x < -0.3)")
def track_coverage(spark, sf_dir):
    """How much of a track is valid, without points that are never seen."""
    ok = F.when(F.col("x") >= 0, F.col("t"))
    grouped = tracks(spark, sf_dir).groupBy("cand", "pt").agg(F.count(ok).alias("n_valid"), F.min(ok).alias("first_t"), F.max(ok).alias("last_t"), F.bool_and(F.col("x") < -0.3).alias("never"))
    return grouped.where("not never").drop("never")


@query(
    "q_robot_following",
    """WITH c AS (SELECT cand, t, avg(x) AS cx, avg(y) AS cy FROM v_tracks GROUP BY cand, t), d AS (SELECT v.cand, v.pt, v.t, sqrt(pow(v.x - cx, 2) + pow(v.y - cy, 2)) AS d FROM v_tracks v JOIN c ON c.cand = v.cand AND c.t = v.t) SELECT cand, pt, avg(CASE WHEN d < 0.1 THEN 1.0 ELSE 0.0 END) AS share FROM d GROUP BY cand, pt HAVING avg(CASE WHEN d < 0.1 THEN 1.0 ELSE 0.0 END) > 0.3""",
)
def robot_following(spark, sf_dir):
    """Points that stay near the centre of their group in most frames."""
    t = tracks(spark, sf_dir)
    near = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) < 0.1
    return t.join(sc.centroids(t, ["cand", "t"]).drop("n"), ["cand", "t"]).groupBy("cand", "pt").agg(F.avg(near.cast("double")).alias("share")).where("share > 0.3")


@query("q_phase_rows_missing", f"WITH {EPISODES} SELECT f.traj, f.t FROM v_frames f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.traj = f.traj AND e.end_frame = f.t AND e.phase = 'release')")
def phase_rows_missing(spark, sf_dir):
    """Keyframes that no phase ends at."""
    f = frames(spark, sf_dir).select("traj", "t")
    ends = _episodes(spark, sf_dir).where("phase = 'release'").select("traj", F.col("end_frame").alias("t"))
    return f.join(ends, ["traj", "t"], "left_anti")


@query("q_sampling_rule", "SELECT traj, t FROM v_frames WHERE t = 0 OR (t + 1) % 25 = 0")
def sampling_rule(spark, sf_dir):
    """Which frames a debug sink keeps: the first and every 25th."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("traj").orderBy("t"))
    return frames(spark, sf_dir).withColumn("n", place).where("n = 1 or n % 25 = 0").select("traj", "t")


@query(
    "q_step_phases_merged",
    f"""WITH e AS (SELECT traj, t, label AS object, event_id % 3 < 2 AS claims FROM {spans_sql(4)}), n AS (SELECT *, lag(object) OVER (PARTITION BY traj ORDER BY t) AS before FROM e),
 m AS (SELECT *, claims AND before IS NOT NULL AND object = before AS joins FROM n), g AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY traj ORDER BY t) AS k FROM m)
 SELECT traj, CAST(k - 1 AS BIGINT) AS entry, arg_min(object, t) AS object, count(*) AS n_phases, arg_min(CASE WHEN claims AND before IS NOT NULL THEN 'uncertain' WHEN claims THEN 'same_instance_retry' ELSE 'new_instance' END, t) AS relation FROM g GROUP BY traj, k""",
)
def step_phases_merged(spark, sf_dir):
    """Entries of consecutive episodes; those that retry the same object are one."""
    relation = F.when(F.col("event_id") % 3 < 2, "same_instance_retry").otherwise("new_instance")
    entries = spans(spark, sf_dir, 4).select("traj", "t", F.col("label").alias("object"), F.lit("unknown").alias("object_instance"), relation.alias("relation"), F.array(F.col("t")).alias("grasp_phases"))
    merged = phases.merge_entries(entries, "traj", "t")
    return merged.select("traj", "entry", "object", F.size("grasp_phases").cast("bigint").alias("n_phases"), "relation")
