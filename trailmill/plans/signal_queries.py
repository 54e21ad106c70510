"""Queries of overlap policies, spheres, picks, labels, keys, views and source mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import boxes as bx
from ..operators import relational as rel
from ..operators import scoring as sc
from ..operators import sequences as seq
from . import models
from .registry import boxes, frames, query, table, tracks


def _overlaps(spark, sf_dir):
    return boxes(spark, sf_dir).select("grp", F.col("idx").alias("t"), F.col("conf").alias("overlap"), (F.col("x1") % 5 + 1).alias("count"))


@query("q_overlap_first", "SELECT grp, arg_min(conf, idx) AS overlap FROM v_boxes GROUP BY grp")
def overlap_first(spark, sf_dir):
    return sc.overlap_policy(_overlaps(spark, sf_dir), ["grp"], "first")


@query("q_overlap_mean", "SELECT grp, round(sum(conf * (x1 % 5 + 1)) / sum(x1 % 5 + 1), 6) AS overlap FROM v_boxes GROUP BY grp")
def overlap_mean(spark, sf_dir):
    return sc.overlap_policy(_overlaps(spark, sf_dir), ["grp"], "mean").withColumn("overlap", F.round("overlap", 6))


@query("q_overlap_top_mean", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY conf DESC, idx) AS p, count(*) OVER (PARTITION BY grp) AS n FROM v_boxes) SELECT grp, round(sum(conf * (x1 % 5 + 1)) / sum(x1 % 5 + 1), 6) AS overlap FROM k WHERE p <= greatest(1, ceil(n * 0.1)) GROUP BY grp")
def overlap_top_mean(spark, sf_dir):
    return sc.overlap_policy(_overlaps(spark, sf_dir), ["grp"], "top_mean").withColumn("overlap", F.round("overlap", 6))


@query("q_overlap_quantile", "SELECT grp, quantile_cont(floor(conf * 10500000 + 0.5), 0.75) AS overlap FROM v_boxes GROUP BY grp")
def overlap_quantile(spark, sf_dir):
    """The upper quartile of whole numbers, which every engine interpolates alike."""
    whole = _overlaps(spark, sf_dir).withColumn("overlap", F.floor(F.col("overlap") * 10500000 + 0.5).cast("double"))
    return sc.overlap_policy(whole, ["grp"], "quantile", quantile=0.75)


@query("q_overlap_max", "SELECT grp, coalesce(max(conf) FILTER (idx % 3 > 0), 0.0) AS overlap FROM v_boxes GROUP BY grp")
def overlap_max(spark, sf_dir):
    """Frames without points don't count; a candidate that has no others overlaps by 0."""
    rows = _overlaps(spark, sf_dir).withColumn("count", F.when(F.col("t") % 3 > 0, F.col("count")).otherwise(0))
    return sc.overlap_policy(rows, ["grp"], "max")


@query(
    "q_gripper_spheres",
    """WITH p AS (SELECT grp, idx AS pt, x1 AS u, y1 AS v, x1 AS x, y1 AS y, conf * 20 AS z FROM v_boxes), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY sqrt(pow(u - 50, 2) + pow(v - 30, 2)), pt) AS r FROM p), c AS (SELECT * FROM k WHERE r = 1),
 d AS (SELECT p.grp, sqrt(pow(p.x - c.x, 2) + pow(p.y - c.y, 2) + pow(p.z - c.z, 2)) AS away, row_number() OVER (PARTITION BY p.grp ORDER BY sqrt(pow(p.x - c.x, 2) + pow(p.y - c.y, 2) + pow(p.z - c.z, 2)), p.pt) AS n FROM p JOIN c ON c.grp = p.grp WHERE p.pt <> c.pt),
 m AS (SELECT grp, greatest(2 * median(away), 0.05) AS radius FROM d WHERE n <= 5 GROUP BY grp) SELECT c.grp, c.x AS sx, c.y AS sy, round(least(coalesce(m.radius, 0.05), 60.0), 4) AS radius FROM c LEFT JOIN m ON m.grp = c.grp""",
)
def gripper_spheres(spark, sf_dir):
    points = boxes(spark, sf_dir).select("grp", F.col("idx").alias("pt"), F.col("x1").alias("u"), F.col("y1").alias("v"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("conf") * 20).alias("z"))
    return sc.gripper_spheres(points, ["grp"], (50.0, 30.0), cap=F.lit(60.0)).select("grp", "sx", "sy", F.round("radius", 4).alias("radius"))


def _scores(spark, sf_dir):
    b = boxes(spark, sf_dir)
    i = b.select("grp", F.col("idx").alias("start"), F.col("x1").alias("a"))
    j = b.select("grp", F.col("idx").alias("target"), F.col("y1").alias("b"))
    return i.join(j, "grp").select("grp", "start", "target", ((F.col("a") * 7 + F.col("b") * 3) % 50).alias("score"))


SCORES = "s AS (SELECT i.grp, i.idx AS start, j.idx AS target, (i.x1 * 7 + j.y1 * 3) % 50 AS score FROM v_boxes i JOIN v_boxes j ON i.grp = j.grp)"


@query("q_fallback_pick", f"WITH {SCORES}, b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, start) AS p FROM (SELECT grp, start, max(score) AS score FROM s WHERE score > 45 GROUP BY grp, start)), c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY conf DESC, idx) AS p FROM v_boxes) SELECT c.grp, coalesce(b.start, c.idx) AS pick FROM c LEFT JOIN b ON b.grp = c.grp AND b.p = 1 WHERE c.p = 1")
def fallback_pick(spark, sf_dir):
    """Only good pairs count, so that some groups have none."""
    return sc.fallback_pick(_scores(spark, sf_dir).where("score > 45"), ["grp"], boxes(spark, sf_dir))


@query("q_top_pairs", f"WITH {SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, start, target) AS place FROM s) SELECT grp, start, target, place FROM k WHERE place <= 4")
def top_pairs(spark, sf_dir):
    return sc.top_pairs(_scores(spark, sf_dir), ["grp"], 4).select("grp", "start", "target", F.col("place").cast("bigint").alias("place"))


@query("q_best_robot", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY conf DESC, idx) AS p FROM v_boxes WHERE idx % 3 <> 2) SELECT grp, idx FROM k WHERE p = 1")
def best_robot(spark, sf_dir):
    return sc.best_robot(boxes(spark, sf_dir).withColumn("class_id", F.col("idx") % 3), ["grp"])[1].select("grp", "idx")


LABELS = ("Grasp the red cup from the table", "Pick up a plate, then wait", "Place the bowl into the sink", "Walk around", "put lid on pot.")


@query("q_object_noun", "SELECT p_partkey, ['red cup', 'a plate', 'bowl', NULL, 'lid'][p_partkey % 5 + 1] AS noun FROM part")
def object_noun(spark, sf_dir):
    label = F.array(*(F.lit(x) for x in LABELS))[(F.col("p_partkey") % 5).cast("int")]
    return table(spark, sf_dir, "part").select("p_partkey", tx.object_noun(label).alias("noun"))


@query("q_arm_side", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS arm FROM part")
def arm_side(spark, sf_dir):
    label = F.array(F.lit("LEFT arm"), F.lit("the right one"), F.lit("none"))[(F.col("p_partkey") % 3).cast("int")]
    return table(spark, sf_dir, "part").select("p_partkey", tx.arm_side(label).alias("arm"))


@query("q_instruction_join", "SELECT o_custkey, string_agg(regexp_replace(lower(o_orderpriority || '.'), '\\.+$', ''), ' then ' ORDER BY o_orderkey) AS instruction FROM orders GROUP BY o_custkey")
def instruction_join(spark, sf_dir):
    listed = F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat("o_orderpriority", F.lit(".")).alias("label"))))
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(listed.alias("l"))
    return grouped.select("o_custkey", tx.instruction(F.transform("l", lambda x: x["label"])).alias("instruction"))


@query("q_path_key", "SELECT o_orderkey, (o_orderkey // 1000) || '/' || o_orderkey AS key FROM orders")
def path_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.path_key(F.floor(F.col("o_orderkey") / 1000), F.col("o_orderkey")).alias("key"))


@query("q_view_choice", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'top,wrist' WHEN p_size % 3 = 1 THEN 'top' ELSE 'side' END AS views FROM part")
def view_choice(spark, sf_dir):
    requested = F.array(F.lit("top"), F.lit("top"), F.lit("wrist"), F.lit("back"))
    have = lambda *v: F.array(*(F.lit(x) for x in v))
    available = F.when(F.col("p_size") % 3 == 0, have("side", "wrist", "top")).when(F.col("p_size") % 3 == 1, have("side", "top")).otherwise(have("side"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.chosen_views(requested, available), ",").alias("views"))


@query("q_quoted_path", "SELECT p_partkey, replace(replace(p_name, '#', '%23'), ' ', '%20') || '%2F~' AS quoted FROM part")
def quoted_path(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.quoted(F.concat("p_name", F.lit("/~"))).alias("quoted"))


@query("q_source_mapping", "SELECT traj, string_agg(event_id, ',' ORDER BY t) AS frames, count(*) AS n FROM v_frames GROUP BY traj")
def source_mapping(spark, sf_dir):
    """Source frames of each trajectory in order."""
    listed = F.array_sort(F.collect_list(F.struct("t", "event_id")))
    grouped = frames(spark, sf_dir).groupBy("traj").agg(listed.alias("l"))
    return grouped.select("traj", F.array_join(F.transform("l", lambda x: x["event_id"].cast("string")), ",").alias("frames"), F.size("l").cast("bigint").alias("n"))


@query("q_centroid_original", "SELECT cand, t, round((avg(x) + 3) / 0.5, 4) AS ox, round((avg(y) + 7) / 0.25, 4) AS oy FROM v_tracks GROUP BY cand, t")
def centroid_original(spark, sf_dir):
    """Centroids in pixels of the original image: the crop's origin added, divided by the scale."""
    c = sc.centroids(tracks(spark, sf_dir), ["cand", "t"])
    return c.select("cand", "t", F.round((F.col("cx") + 3) / 0.5, 4).alias("ox"), F.round((F.col("cy") + 7) / 0.25, 4).alias("oy"))


@query("q_ragged_concat", "WITH n AS (SELECT grp, count(*) AS n FROM v_boxes GROUP BY grp), g AS (SELECT grp, n, grp // 50 AS cloud FROM n) SELECT cloud, grp, CAST(sum(n) OVER (PARTITION BY cloud ORDER BY grp) - n AS BIGINT) AS start, n FROM g")
def ragged_concat(spark, sf_dir):
    """Where each part of a concatenated cloud starts."""
    from pyspark.sql import Window

    n = boxes(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n")).withColumn("cloud", F.floor(F.col("grp") / 50))
    return n.select("cloud", "grp", (F.sum("n").over(Window.partitionBy("cloud").orderBy("grp")) - F.col("n")).alias("start"), "n")


@query("q_tool_reassign", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS grasped, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'shelf' END AS target FROM part")
def tool_reassign(spark, sf_dir):
    tasks = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" ").alias("tool_name_required"), F.col("p_type").alias("object"), F.lit("shelf").alias("target_location"))
    return models.reassigned_for_tool(tasks).select("p_partkey", "grasped", "target")


@query("q_resolved_target", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY (x1 % 4 = 0) DESC, conf DESC, idx DESC) AS p FROM v_boxes) SELECT grp, idx AS target, x1 % 4 = 0 AS verified FROM k WHERE p = 1")
def resolved_target(spark, sf_dir):
    rows = boxes(spark, sf_dir).select("grp", F.col("idx").alias("target"), "conf", (F.col("x1") % 4 == 0).alias("winner"))
    return models.resolved_target(rows, ["grp"])


@query(
    "q_detector_stage",
    "WITH c AS (SELECT page_id AS key, k AS class_id, ('0x' || substr(md5(coalesce(html, '') || n), 1, 8))::BIGINT AS code FROM pages, (SELECT unnest([0, 1]) AS k, unnest(['cup', 'robot']) AS n)) SELECT key, CAST(code % 200 AS DOUBLE) AS x1, CAST(code // 200 % 150 AS DOUBLE) AS y1, CAST(code % 200 + 40 AS DOUBLE) AS x2, CAST(code // 200 % 150 + 30 AS DOUBLE) AS y2, (code // 65536) / 65536.0::DOUBLE AS conf, CAST(class_id AS INTEGER) AS class_id FROM c WHERE (code // 65536) / 65536.0 >= 0.3",
)
def detector_stage(spark, sf_dir):
    """Images (here pages) through the detector's stand-in, in batches."""
    images = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("image"))
    return models.detections(images, ["cup", "robot"], 0.3)


@query("q_latest_cache_entry", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def latest_cache_entry(spark, sf_dir):
    cache = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return models.latest(cache, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


@query("q_gripper_invert", "SELECT traj, t, 1 - signal / 100 AS gripper FROM v_frames")
def gripper_invert(spark, sf_dir):
    from ..sources.datasets import transformed

    return frames(spark, sf_dir).select("traj", "t", transformed(F.col("signal") / 100, "invert", ["traj"]).alias("gripper"))


@query("q_label_segments", "WITH c AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY traj ORDER BY t) AND t > 0 THEN 1 ELSE 0 END AS ch FROM v_frames), i AS (SELECT *, sum(ch) OVER (PARTITION BY traj ORDER BY t) AS isl FROM c), g AS (SELECT traj, isl, min(label) AS label, min(t) AS start_frame, max(t) + 1 AS end_frame FROM i GROUP BY traj, isl) SELECT traj, label, start_frame, end_frame FROM g WHERE label <> 'view'")
def label_segments(spark, sf_dir):
    from ..sources.datasets import label_segments as segments

    named = frames(spark, sf_dir).select("traj", F.col("t").alias("frame_index"), "label")
    return segments(named, ["traj"], "label", ("view",)).select("traj", "label", "start_frame", "end_frame")


@query("q_closed_stretches", "WITH s AS (SELECT traj, t, signal < 50 AS f, CASE WHEN (signal < 50) <> lag(signal < 50) OVER (PARTITION BY traj ORDER BY t) THEN 1 ELSE 0 END AS ch FROM v_frames), i AS (SELECT *, sum(ch) OVER (PARTITION BY traj ORDER BY t) AS isl FROM s), g AS (SELECT traj, isl, count(*) AS n FROM i WHERE f GROUP BY traj, isl) SELECT traj, count(*) AS stretches, max(n) AS longest FROM g GROUP BY traj")
def closed_stretches(spark, sf_dir):
    runs = seq.true_runs(frames(spark, sf_dir).withColumn("f", F.col("signal") < 50), ["traj"], "t", "f")
    return runs.groupBy("traj").agg(F.count("*").alias("stretches"), F.max("n").alias("longest"))


@query("q_replay_score", "WITH q AS (SELECT grp, idx, CASE WHEN grp % 2 = 0 THEN 'non_movement_articulate' ELSE 'other' END AS g, x1, conf, conf > 0.8 AS dom, (y1 % 10) / 10.0 AS fr FROM v_boxes), n AS (SELECT *, CASE WHEN max(x1) OVER w > min(x1) OVER w THEN (x1 - min(x1) OVER w) / (max(x1) OVER w - min(x1) OVER w) ELSE 0.0 END AS sn FROM q WINDOW w AS (PARTITION BY grp)) SELECT grp, idx, CASE WHEN g = 'other' THEN 0.5 ELSE 0.0 END * sn + CASE WHEN g = 'other' THEN 0.5 ELSE 1.0 END * conf + 0.2 * CAST(dom AS DOUBLE) + CASE WHEN g = 'other' THEN 0.2 ELSE 0.35 END * fr AS score FROM n")
def replay_score(spark, sf_dir):
    rows = boxes(spark, sf_dir).select("grp", "idx", F.when(F.col("grp") % 2 == 0, "non_movement_articulate").otherwise("other").alias("group"), F.col("x1").alias("snr"), "conf", (F.col("conf") > 0.8).alias("dominant"), ((F.col("y1") % 10) / 10.0).alias("fraction"))
    return sc.replay_score(rows, ["grp"]).select("grp", "idx", "score")


@query("q_box_units", "SELECT grp, idx, CAST(floor(x1 * 1000 / 200) AS INTEGER) AS ux, CAST(floor(y2 * 1000 / 120) AS INTEGER) AS uy FROM v_boxes")
def box_units(spark, sf_dir):
    units = bx.normalised(bx.corners(), F.lit(200), F.lit(120))
    return boxes(spark, sf_dir).select("grp", "idx", units[0].alias("ux"), units[3].alias("uy"))


@query("q_node_share", "WITH k AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p FROM orders) SELECT o_custkey, o_orderkey FROM k WHERE p % 4 = 1")
def node_share(spark, sf_dir):
    return rel.node_share(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_orderkey"], 4, 1, "o_custkey")


@query("q_set_equality", "SELECT o_custkey, bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O') AND NOT bool_or(o_orderstatus NOT IN ('F', 'O')) AS same FROM orders GROUP BY o_custkey")
def set_equality(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return seen.select("o_custkey", rel.same_sets(F.col("s"), F.array(F.lit("F"), F.lit("O"))).alias("same"))


@query("q_fixed_rows", "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN round(CAST(embedding[7] AS DOUBLE), 4) END AS last FROM embeddings")
def fixed_rows(spark, sf_dir):
    """Poses of seven numbers; frames with too few get NaN, here null."""
    values = F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).otherwise(F.slice("embedding", 1, 3))
    last = F.element_at(bx.fixed_row(values, 7), 7)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.when(~F.isnan(last), F.round(last, 4)).alias("last"))


@query("q_body_motion", "SELECT p_partkey, p_partkey % 5 IN (0, 1, 3) AS body FROM part")
def body_motion(spark, sf_dir):
    labels = ("底盘前进@go on", "抓@Do nothing.", "抓杯@Grasp the cup", "放@Reset body to start", "halt")
    label = F.array(*(F.lit(x) for x in labels))[(F.col("p_partkey") % 5).cast("int")]
    return table(spark, sf_dir, "part").select("p_partkey", tx.is_body_motion(label).alias("body"))
