"""Queries of model stages, with pages as images and embeddings as points, through the deterministic stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dense_stages as ds
from . import model_stages as ms
from . import models
from .registry import boxes, query, table

CODE = """b AS (SELECT page_id AS key, n, ('0x' || substr(md5(coalesce(html, '') || n), 1, 8))::BIGINT AS code FROM pages, (SELECT unnest(['cup', 'left robot gripper', 'robot gripper', 'robot arm']) AS n)),
 d AS (SELECT key, n, code % 200 AS x, code // 200 % 150 AS y, (code // 65536) / 65536.0::DOUBLE AS conf FROM b)"""


def _images(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("image"), F.lit("cup").alias("label"), F.lit("left").alias("arm"))


@query("q_prompted_detection", f"WITH {CODE}, k AS (SELECT key, n, x, y, conf, row_number() OVER (PARTITION BY key ORDER BY CASE n WHEN 'left robot gripper' THEN 0 WHEN 'robot gripper' THEN 1 ELSE 2 END) AS p FROM d WHERE n <> 'cup' AND conf >= 0.6) SELECT key, n AS prompt, CAST(x AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y1, conf FROM k WHERE p = 1")
def prompted_detection(spark, sf_dir):
    """Grippers by the first prompt that finds one: of the arm's side, of any side, any arm."""
    asked = _images(spark, sf_dir).select("key", "image", ms.robot_prompts(F.col("arm")).alias("prompts"))
    return ms.prompted(asked, threshold=0.6).select("key", "prompt", "x1", "y1", "conf")


@query(
    "q_object_candidates",
    f"""WITH {CODE}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE n WHEN 'left robot gripper' THEN 0 WHEN 'robot gripper' THEN 1 ELSE 2 END) AS p FROM d WHERE n <> 'cup' AND conf >= 0.3), a AS (SELECT key, x, y, conf, FALSE AS is_robot FROM d WHERE n = 'cup' AND conf >= 0.3 UNION ALL SELECT key, x, y, conf, TRUE FROM r WHERE p = 1),
 o AS (SELECT i.*, EXISTS (SELECT 1 FROM a j WHERE j.key = i.key AND j.is_robot <> i.is_robot AND (j.conf > i.conf OR (j.conf = i.conf AND i.is_robot)) AND greatest(0, 40 - abs(i.x - j.x)) * greatest(0, 30 - abs(i.y - j.y)) / (2400.0 - greatest(0, 40 - abs(i.x - j.x)) * greatest(0, 30 - abs(i.y - j.y))) > 0.6) AS gone FROM a i)
 SELECT key, CAST(x AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y1, conf, is_robot FROM o WHERE NOT gone""",
)
def object_candidates(spark, sf_dir):
    """Objects and grippers of an image in one list, suppressed."""
    return ms.object_candidates(_images(spark, sf_dir), 240, 180).select("key", "x1", "y1", "conf", "is_robot")


@query("q_segmented_boxes", "SELECT grp, idx, CASE WHEN x1 > 63 OR y1 > 47 THEN 0.0 ELSE conf END AS conf, CAST(greatest(least(floor(x2), 63) - floor(x1) + 1, 0) * greatest(least(floor(y2), 47) - floor(y1) + 1, 0) AS BIGINT) AS n FROM v_boxes")
def segmented_boxes(spark, sf_dir):
    """Masks of boxes on a small image; a box beside the image has an empty mask and no confidence."""
    listed = boxes(spark, sf_dir).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("idx", "x1", "y1", "x2", "y2", "conf"))).alias("l"))
    rows = listed.select("grp", F.transform("l", lambda b: b["idx"]).alias("idx"), F.transform("l", lambda b: F.array(b["x1"], b["y1"], b["x2"], b["y2"])).alias("boxes"), F.transform("l", lambda b: b["conf"]).alias("confidences"), F.lit(b"").alias("image"))
    found = ms.segmented(rows).select("grp", F.explode(F.arrays_zip("idx", "masks", "confidences")).alias("m"))
    return found.select("grp", "m.idx", F.col("m.confidences").alias("conf"), ds.n_set(F.col("m.masks")).alias("n"))


@query("q_tracked_points", "SELECT vec_id, CAST(t AS INTEGER) AS frame, CAST(p AS INTEGER) AS point, CASE WHEN p < 3 THEN round(CAST(CAST(embedding[2 * p + 1] AS FLOAT) AS DOUBLE), 6) ELSE -1.0 END AS x, p < 3 AS seen FROM embeddings, (SELECT unnest(range(4)) AS t), (SELECT unnest(range(5)) AS p)")
def tracked_points(spark, sf_dir):
    """Three points over four frames, padded to five."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array_repeat(F.lit(b"image"), 4).alias("frames"), F.transform(F.slice("embedding", 1, 6), lambda v: v.cast("double")).alias("points"))
    return ms.tracked(rows, 5).select("vec_id", "frame", "point", F.round("x", 6).alias("x"), "seen")


@query("q_lifted_points", "SELECT vec_id, CAST(t AS INTEGER) AS t, CAST(least(round_even(abs(CAST(embedding[t + 1] AS DOUBLE)) * 400, 0), 63) AS DOUBLE) AS x, 1.0::DOUBLE AS z FROM embeddings, (SELECT unnest(range(3)) AS t)")
def lifted_points(spark, sf_dir):
    """One point a frame, lifted by the flat depth of the stand-in: the pixel it rounds to, inside of the image."""
    at = F.transform(F.slice("embedding", 1, 3), lambda v: F.array(F.abs(v.cast("double")) * 400, F.lit(7.0)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array_repeat(F.lit(b"image"), 3).alias("frames"), at.alias("points"))
    found = ms.lifted(rows).select("vec_id", F.posexplode("xyz").alias("t", "p"))
    return found.select("vec_id", "t", F.col("p")[0].alias("x"), F.col("p")[2].alias("z"))


@query("q_robot_masks", "SELECT o_custkey % 50 AS key, count(*) AS n FROM orders GROUP BY o_custkey % 50 HAVING count(*) <= 0 UNION ALL SELECT key, least(n, 16) FROM (SELECT o_custkey % 50 AS key, count(*) AS n FROM orders GROUP BY o_custkey % 50)")
def robot_masks(spark, sf_dir):
    """How many frames of each video get a mask of the robot: 16 at most, here."""
    videos = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("key")).agg(F.collect_list(F.lit(b"image")).alias("frames"))
    masks = ms.robot_masks(videos, most=16).where(ds.n_set(F.col("mask")) == 12 * 64)
    return masks.groupBy("key").agg(F.count("*").alias("n"))


@query("q_verified", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 1.0 ELSE 0.5 END AS verdict FROM part")
def verified(spark, sf_dir):
    """Two prompts, of which the stand-in affirms those that repeat a word; the lesser verdict counts."""
    prompt = lambda m: F.when(F.col("p_size") % m == 0, "is this this cup").otherwise("is this cup here")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit(b"image").alias("image"), prompt(2).alias("one"), prompt(3).alias("two"))
    return ms.verified(rows, ["one", "two"]).select("p_partkey", "verdict")


@query("q_token_score", "SELECT vec_id, CASE WHEN vec_id % 3 > 0 THEN list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding[3 : 2 + vec_id % 3], lambda v: floor(CAST(v AS DOUBLE) * 1024))), lambda a, b: a + b) / (vec_id % 3) END AS score FROM embeddings")
def token_score(spark, sf_dir):
    """Mean score of a span of up to two tokens."""
    scores = F.transform("embedding", lambda v: F.floor(v.cast("double") * 1024).cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", ms.token_score(scores, F.lit(2), (F.lit(2) + F.col("vec_id") % 3).cast("int")).alias("score"))


@query("q_prompts", "SELECT p_partkey, 'Is the box from (1, 2) to (30, 40) a ' || p_name || '? Close with **VERDICT: YES**, **VERDICT: NO** or **VERDICT: UNCERTAIN**.' AS highlighted, 'The 2 images show frames 3, ' || p_size || ' of: ' || p_name || '. For each name the object in the gripper and its relation to the one before: new_instance, same_instance_retry or same_instance_continuation.' AS storyboard FROM part")
def prompts(spark, sf_dir):
    box = tuple(F.lit(v) for v in (1, 2, 30, 40))
    return table(spark, sf_dir, "part").select("p_partkey", ms.highlighted_prompt(F.col("p_name"), box).alias("highlighted"), ms.storyboard_prompt(F.col("p_name"), F.array(F.lit(3), F.col("p_size").cast("int"))).alias("storyboard"))


@query("q_names_robot", "SELECT p_partkey, p_partkey % 4 < 3 AS robot FROM part")
def names_robot(spark, sf_dir):
    prompts = F.array(*(F.lit(x) for x in ("Robot hand", "a gripper.", "left ARM", "cup")))
    return table(spark, sf_dir, "part").select("p_partkey", ms.names_robot(prompts[(F.col("p_partkey") % 4).cast("int")]).alias("robot"))


@query("q_request_counts", "WITH a AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type), c AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size < 10) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct, count(c.p_brand) AS cached, count(*) - count(c.p_brand) AS sent FROM a LEFT JOIN c ON c.p_brand = a.p_brand AND c.p_type = a.p_type")
def request_counts(spark, sf_dir):
    """Requests of a stage whose cache knows those of small parts."""
    parts = table(spark, sf_dir, "part")
    return ms.request_counts(parts, parts.where("p_size < 10"), ["p_brand", "p_type"])


#: The stand-ins are what queries run; users give makers of their own.
STAND_INS = (models.BoxDetector, models.BoxSegmenter, models.StillTracker, models.FlatDepth, models.WordVerifier, ms.BandRobot)
