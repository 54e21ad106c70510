"""Queries of the published row, with orders as annotations and their lines as boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import published as pub
from .registry import boxes, query, table

#: Orders of every third customer have one arm without a name, others a left and a right one.
PARTS = """o AS (SELECT o_orderkey AS k, o_orderkey % 50 AS s, o_custkey % 3 = 0 AS single FROM orders), b AS (SELECT k, s, idx, x1, y1, conf, CASE WHEN single THEN '' WHEN idx % 3 = 0 THEN 'left' ELSE 'right' END AS arm FROM v_boxes JOIN o ON k = grp)"""


def _parts(spark, sf_dir):
    # Orders are dealt out once, by the key that lines are numbered by; all parts made of them stay in their place.
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 50).alias("start_frame"), (F.col("o_custkey") % 3 == 0).alias("single"), "o_orderpriority").repartition("k")
    keys = (F.col("k").alias("trajectory_id"), F.lit(0).alias("subtask_index"))
    annotations = orders.select(
        F.lit("orders").alias("dataset_id"), *keys, F.lit("top").alias("camera_view"), "start_frame", (F.col("start_frame") + 40).alias("end_frame"), F.col("o_orderpriority").alias("instruction"),
        F.lit(480).alias("height"), F.lit(640).alias("width"), F.lit(90).alias("num_frames"),
    )
    lines = boxes(spark, sf_dir).join(orders, F.col("grp") == F.col("k"))
    arm = F.when(~F.col("single"), F.when(F.col("idx") % 3 == 0, "left").otherwise("right")).alias("arm")
    box = F.array("x1", "y1", "x2", "y2")
    candidates = lines.select(*keys, arm, F.when(F.col("idx") % 2 == 0, "initial").otherwise("target").alias("kind"), F.col("idx").alias("cand"), box.alias("box"), "conf", (F.col("idx") + 100).alias("source"))
    traces = lines.select(*keys, arm, (F.col("idx") % 2).alias("cand"), (F.col("start_frame") + F.col("idx")).alias("frame"), F.col("x1").alias("x"), F.when(F.col("x1") > 20, F.col("y1")).alias("y"))
    arms = F.when(F.col("single"), F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit("left"), F.lit("right")))
    selection = F.struct(F.lit("lightweight").alias("method"), F.lit(0.5).alias("score"))
    objects = orders.withColumn("arm", F.explode(arms)).select(
        *keys, "arm", F.lit("cup").alias("label"), F.lit(None).cast("string").alias("instance_id"), F.lit(None).cast("string").alias("relation_to_previous"), F.lit(2).cast("bigint").alias("detection_frame"),
        F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("initial_box"), F.lit(0.25).alias("initial_score"), F.lit(None).cast("array<double>").alias("target_box"), F.lit(None).cast("double").alias("target_score"),
        F.lit(True).alias("verified"), F.create_map(F.lit(7).cast("bigint"), F.array(F.lit(1.0)), F.lit(3).cast("bigint"), F.array(F.lit(2.0))).alias("intermediate"), F.lit(0).cast("bigint").alias("selected"), selection.alias("selection"),
    )
    span = lambda name, a, b: F.struct(F.lit(name).alias("phase"), (F.col("start_frame") + a).alias("s"), (F.col("start_frame") + b).alias("e"))
    phases = orders.withColumn("p", F.explode(F.array(span("grasp", 0, 9), span("interact", 10, 30)))).select(*keys, "p.phase", F.col("p.s").alias("start_frame"), F.col("p.e").alias("end_frame"))
    marks = F.array(*(F.struct(F.lit(n).alias("name"), (F.col("start_frame") + at).alias("frame")) for n, at in (("detection", 2), ("interact", 30), ("release", 39), ("grasp", 12))))
    keyframes = orders.withColumn("m", F.explode(marks)).select(*keys, "m.name", "m.frame")
    arrays = orders.select(*keys, F.lit("object_masks").alias("name"), F.concat(F.lit("masks/"), F.col("k").cast("string")).alias("path"), F.lit("uint8").alias("dtype"), F.array(F.lit(4), F.lit(480), F.lit(640)).alias("shape"))
    return annotations, objects, phases, keyframes, candidates, traces, arrays


@query(
    "q_published_rows",
    f"""WITH {PARTS}, i AS (SELECT k, arm, arg_max(idx, conf * 1000 - idx / 1e6) FILTER (idx % 2 = 0) AS i, arg_max(idx, conf * 1000 - idx / 1e6) FILTER (idx % 2 = 1) AS t, count(*) FILTER (idx % 2 = 0 AND x1 > 20) AS n, min(s + idx) FILTER (idx % 2 = 0 AND x1 > 20) AS f FROM b GROUP BY k, arm)
 SELECT o.k, 'sha256:' || sha256('{{"camera_view":"top","dataset_id":"orders","end_frame_exclusive":' || (s + 40) || ',"start_frame":' || s || ',"subtask_index":0,"trajectory_id":"' || o.k || '"}}') AS annotation_id,
 'grasp,grasp,interact,release' AS phases, s || ',' || (s + 12) || ',' || (s + 10) || ',' || (s + 39) AS starts, CAST(CASE WHEN single THEN 0 ELSE 2 END AS BIGINT) AS n_arms, CASE WHEN single THEN 'cup' END AS own_label, CASE WHEN single THEN NULL ELSE 'right' END AS second_arm,
 CAST(CASE WHEN single THEN w.i ELSE l.i END AS BIGINT) AS initial_candidate, CAST(CASE WHEN (CASE WHEN single THEN w.i ELSE l.i END) IS NULL THEN NULL WHEN single THEN w.t ELSE l.t END AS BIGINT) AS target_candidate,
 CAST(CASE WHEN single THEN w.f ELSE l.f END AS BIGINT) AS first_track_frame, s + 39 AS target_frame, s + 3 AS first_between, 'masks/' || o.k AS masks, CAST(480 AS BIGINT) AS height
 FROM o LEFT JOIN i w ON w.k = o.k AND w.arm = '' LEFT JOIN i l ON l.k = o.k AND l.arm = 'left'""",
)
def published_rows(spark, sf_dir):
    """All parts in one line, read back: phases with those that keyframes add, arms, baselines, tracks, arrays."""
    lines = pub.assembled(*_parts(spark, sf_dir))
    frame = "array<struct<frame_index:bigint>>"
    body = (
        f"object:struct<label:string,target:struct<frame_index:bigint>,intermediate:{frame},track:struct<frame_indices:array<bigint>>>,"
        "baselines:struct<detector:struct<initial:struct<tracked_candidate_index:bigint>,target:struct<candidate_index:bigint>>>"
    )
    whole = (
        "source:struct<trajectory_id:string>,window:struct<image_size_hw:array<bigint>>,task:struct<phases:array<struct<type:string,start_frame:string>>>,"
        f"arrays:struct<object_masks:struct<path:string>>,{body},arms:array<struct<arm:string,{body}>>"
    )
    read = lines.select("annotation_id", F.from_json("line", f"struct<{whole}>").alias("j"))
    read = read.select("annotation_id", "j.*", F.get("j.arms", F.lit(0)).alias("first"))
    own = lambda p: F.coalesce(F.col(p), F.col(f"first.{p}"))
    at = lambda p: F.coalesce(F.get(p, F.lit(0)), F.get(f"first.{p}", F.lit(0)))
    return read.select(
        F.col("source.trajectory_id").cast("bigint").alias("k"), "annotation_id", F.array_join("task.phases.type", ",").alias("phases"), F.array_join("task.phases.start_frame", ",").alias("starts"),
        F.coalesce(F.array_size("arms"), F.lit(0)).cast("bigint").alias("n_arms"), F.col("object.label").alias("own_label"), F.get("arms", F.lit(1))["arm"].alias("second_arm"),
        own("baselines.detector.initial.tracked_candidate_index").alias("initial_candidate"), own("baselines.detector.target.candidate_index").alias("target_candidate"),
        at("object.track.frame_indices").alias("first_track_frame"), own("object.target.frame_index").alias("target_frame"),
        at("object.intermediate")["frame_index"].alias("first_between"), F.col("arrays.object_masks.path").alias("masks"), F.get("window.image_size_hw", F.lit(0)).alias("height"),
    )


@query(
    "q_augmented_tracks",
    f"""WITH {PARTS} SELECT k, idx, o_orderpriority AS instruction, idx / 39.0 AS progress FROM b JOIN orders ON o_orderkey = k""",
)
def augmented_tracks(spark, sf_dir):
    """Track rows with their annotation's instruction and their place in its window."""
    annotations, _, _, _, _, traces, _ = _parts(spark, sf_dir)
    out = pub.augmented_tracks(traces, annotations)
    first = annotations.select("trajectory_id", F.col("start_frame").alias("s"))
    out = out.join(first, "trajectory_id")
    return out.select(F.col("trajectory_id").cast("bigint").alias("k"), (F.col("frame") - F.col("s")).alias("idx"), "instruction", "progress")
