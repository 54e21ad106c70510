"""Queries of boxes and points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import boxes as bx
from ..operators import scoring as sc
from .registry import boxes, query, tracks

INTER = "greatest(0.0, least(i.x2, j.x2) - greatest(i.x1, j.x1)) * greatest(0.0, least(i.y2, j.y2) - greatest(i.y1, j.y1))"
AREA_I, AREA_J = "(i.x2 - i.x1) * (i.y2 - i.y1)", "(j.x2 - j.x1) * (j.y2 - j.y1)"


@query(
    "q_box_iou_pairs",
    f"SELECT i.grp, i.idx AS a, j.idx AS b, round({INTER} / ({AREA_I} + {AREA_J} - {INTER}), 4) AS iou FROM v_boxes i JOIN v_boxes j ON i.grp = j.grp WHERE i.idx < j.idx AND {INTER} > 0",
)
def box_iou_pairs(spark, sf_dir):
    i, j = bx.corners("i_"), bx.corners("j_")
    out = bx.pairs(boxes(spark, sf_dir), ["grp"]).where("i_idx < j_idx").where(bx.intersection(i, j) > 0)
    return out.select("grp", F.col("i_idx").alias("a"), F.col("j_idx").alias("b"), F.round(bx.iou(i, j), 4).alias("iou"))


@query(
    "q_containment",
    f"SELECT i.grp, i.idx AS \"inner\", j.idx AS \"outer\", round({INTER} / ({AREA_I}), 4) AS ratio FROM v_boxes i JOIN v_boxes j ON i.grp = j.grp WHERE i.idx <> j.idx AND {AREA_J} > {AREA_I} AND {INTER} / ({AREA_I}) > 0.3",
)
def containment(spark, sf_dir):
    return bx.contained(boxes(spark, sf_dir), ["grp"]).withColumn("ratio", F.round("ratio", 4))


@query("q_area_filter", "SELECT grp, idx FROM v_boxes WHERE (x2 - x1) * (y2 - y1) <= 0.8 * 2000 AND (x2 - x1) * (y2 - y1) > 0.15 * 2000")
def area_filter(spark, sf_dir):
    return bx.within_area(boxes(spark, sf_dir), 50, 40, 0.8, 0.15).select("grp", "idx")


@query("q_arm_side_filter", "SELECT grp, idx FROM v_boxes WHERE CASE WHEN grp % 2 = 0 THEN (x1 + x2) / 2 < 0.7 * 160 ELSE (x1 + x2) / 2 >= 160 - 0.7 * 160 END")
def arm_side_filter(spark, sf_dir):
    arm = F.when(F.col("grp") % 2 == 0, "left").otherwise("right")
    return bx.on_arm_side(boxes(spark, sf_dir), arm, 160).select("grp", "idx")


@query(
    "q_topk_boxes",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY conf DESC, idx) AS p FROM v_boxes) SELECT grp, idx, CAST(row_number() OVER (PARTITION BY grp ORDER BY conf, idx DESC) - 1 AS BIGINT) AS cand FROM k WHERE p <= 3""",
)
def topk_boxes(spark, sf_dir):
    return bx.strongest(boxes(spark, sf_dir), ["grp"], 3).select("grp", "idx", F.col("cand").cast("bigint").alias("cand"))


@query(
    "q_nms",
    """WITH RECURSIVE r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY conf DESC, idx) AS p FROM v_boxes),
 o AS MATERIALIZED (SELECT i.grp, i.p AS a, j.p AS b FROM r i JOIN r j ON i.grp = j.grp AND i.p < j.p WHERE %s / (%s + %s - %s) > 0.4),
 s AS (SELECT grp, p, CAST([p] AS BIGINT[]) AS kept FROM r WHERE p = 1
 UNION ALL SELECT r.grp, r.p, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.grp = r.grp AND o.b = r.p AND list_contains(s.kept, o.a)) THEN s.kept ELSE list_append(s.kept, r.p) END FROM s JOIN r ON r.grp = s.grp AND r.p = s.p + 1),
 f AS (SELECT grp, arg_max(kept, p) AS kept FROM s GROUP BY grp) SELECT r.grp, r.idx FROM r JOIN f ON r.grp = f.grp WHERE list_contains(f.kept, r.p)"""
    % (INTER, AREA_I, AREA_J, INTER),
)
def nms(spark, sf_dir):
    return bx.suppressed(boxes(spark, sf_dir), ["grp"], 0.4).select("grp", "idx")


@query(
    "q_crop_extent",
    """SELECT grp, CAST(floor(greatest(0.0, min(x1) - 20)) AS INTEGER) AS "left", CAST(floor(greatest(0.0, min(y1) - 36)) AS INTEGER) AS top, CAST(floor(least(200.0, max(x2) + 20)) AS INTEGER) AS "right", CAST(floor(least(120.0, max(y2) + 12)) AS INTEGER) AS bottom FROM v_boxes GROUP BY grp""",
)
def crop_extent(spark, sf_dir):
    return bx.crop_extent(boxes(spark, sf_dir), ["grp"], 200, 120)


@query("q_to_original", "SELECT grp, idx, round((x1 + 3) / 0.5, 4) AS x1, round((y1 + 7) / 0.5, 4) AS y1, round((x2 + 3) / 0.5, 4) AS x2, round((y2 + 7) / 0.5, 4) AS y2 FROM v_boxes")
def to_original(spark, sf_dir):
    out = bx.to_original(boxes(spark, sf_dir), F.lit(3.0), F.lit(7.0), F.lit(0.5))
    return out.select("grp", "idx", *(F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(
    "q_best_match",
    f"SELECT i.grp, i.idx, round(max(CASE WHEN {AREA_I} + {AREA_J} - {INTER} > 0 THEN {INTER} / ({AREA_I} + {AREA_J} - {INTER}) ELSE 0.0 END * j.conf), 4) AS best FROM v_boxes i JOIN v_boxes j ON i.grp = j.grp WHERE i.idx % 2 = 0 AND j.idx % 2 = 1 GROUP BY i.grp, i.idx",
)
def best_match(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return bx.best_match(b.where("idx % 2 = 0"), b.where("idx % 2 = 1"), ["grp"]).withColumn("best", F.round("best", 4))


@query(
    "q_nested_penalty",
    f"""WITH c AS (SELECT i.grp, i.idx AS a, j.idx AS b FROM v_boxes i JOIN v_boxes j ON i.grp = j.grp WHERE i.idx <> j.idx AND {AREA_J} > {AREA_I} AND {INTER} / ({AREA_I}) > 0.3),
 m AS (SELECT grp, idx, CAST(x1 % 7 AS BIGINT) AS points, conf AS movement FROM v_boxes), s AS (SELECT c.grp, c.a, least(p.points, q.points) / CAST(greatest(p.points, q.points) AS DOUBLE) AS lp, least(p.movement, q.movement) / greatest(p.movement, q.movement) AS lm
 FROM c JOIN m p ON p.grp = c.grp AND p.idx = c.a JOIN m q ON q.grp = c.grp AND q.idx = c.b WHERE p.points >= 1 AND q.points >= 1),
 w AS (SELECT grp, a, max(0.15 * (lp + lm) / 2) AS penalty FROM s WHERE lp > 0.5 AND lm > 0.5 GROUP BY grp, a) SELECT m.grp, m.idx, round(coalesce(penalty, 0.0), 4) AS penalty FROM m LEFT JOIN w ON w.grp = m.grp AND w.a = m.idx""",
)
def nested_penalty(spark, sf_dir):
    b = boxes(spark, sf_dir)
    measures = b.select("grp", "idx", F.lit(0).alias("target"), (F.col("x1") % 7).cast("bigint").alias("points"), F.col("conf").alias("movement"))
    return bx.nested_penalty(b, ["grp"], measures).select("grp", "idx", F.round("penalty", 4).alias("penalty"))


@query(
    "q_point_in_box",
    "SELECT b.grp, b.idx, CAST(sum(CASE WHEN p.x BETWEEN b.x1 AND b.x2 AND p.y BETWEEN b.y1 AND b.y2 THEN 1 ELSE 0 END) AS BIGINT) AS n_inside FROM v_boxes b JOIN (SELECT grp, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM v_boxes) p ON p.grp = b.grp GROUP BY b.grp, b.idx",
)
def point_in_box(spark, sf_dir):
    b = boxes(spark, sf_dir)
    points = b.select("grp", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return bx.points_inside(points, b, ["grp"])


@query("q_centroid_trace", "SELECT cand, t, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, count(*) AS n FROM v_tracks GROUP BY cand, t")
def centroid_trace(spark, sf_dir):
    out = sc.centroids(tracks(spark, sf_dir), ["cand", "t"], 2)
    return out.select("cand", "t", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), "n")


@query(
    "q_visibility_ratio",
    "SELECT cand, pt, round(avg(CASE WHEN x >= 0 THEN 1.0 ELSE 0.0 END), 4) AS seen FROM v_tracks GROUP BY cand, pt HAVING avg(CASE WHEN x >= 0 THEN 1.0 ELSE 0.0 END) > 0.5",
)
def visibility_ratio(spark, sf_dir):
    seen = F.avg((F.col("x") >= 0).cast("double"))
    return tracks(spark, sf_dir).groupBy("cand", "pt").agg(seen.alias("seen")).where("seen > 0.5").withColumn("seen", F.round("seen", 4))


@query(
    "q_spatial_overlap_median",
    f"WITH o AS (SELECT i.grp, {INTER} / ({AREA_I} + {AREA_J} - {INTER}) AS iou FROM v_boxes i JOIN v_boxes j ON i.grp = j.grp AND j.idx = i.idx + 1) SELECT g.grp, round(coalesce(median(o.iou), 1.0), 4) AS hand_iou FROM (SELECT DISTINCT grp FROM v_boxes) g LEFT JOIN o ON o.grp = g.grp GROUP BY g.grp",
)
def spatial_overlap_median(spark, sf_dir):
    """The median overlap of neighbours, 1 where there is none."""
    b = boxes(spark, sf_dir)
    w = Window.partitionBy("grp").orderBy("idx")
    ahead = b.withColumns({f"j_{c}": F.lead(c).over(w) for c in ("x1", "y1", "x2", "y2")})
    measured = F.when(F.col("j_x1").isNotNull(), bx.iou(bx.corners(), bx.corners("j_")))
    return ahead.groupBy("grp").agg(F.round(F.coalesce(F.median(measured), F.lit(1.0)), 4).alias("hand_iou"))
