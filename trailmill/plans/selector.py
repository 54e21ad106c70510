"""The preliminary selector in full: from tracked points of candidates to the pair of a start and a target box.

Points (by, start, pt, t, x, y, visible) are measured once per point, then per pair of a start and the targets in which
its points end; scores, penalties and ties are the operators that stand alone elsewhere. Joins have the trajectory's
key; pairs are made within one trajectory, of its candidates with its few targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import boxes as bx
from ..operators import scoring as sc
from ..operators import sequences as seq
from ..operators.scratch import staged
from . import publication as pub

#: Least share of frames in which a point must be seen, and least movement of a pair, in image sides a frame.
VISIBLE_SHARE, LEAST_MOVEMENT = 0.1, 0.001


def measured_pairs(points: DataFrame, starts: DataFrame, targets: DataFrame, by: list[str], interacting: Column, size: tuple[float, float], fps: float, has_phases: bool = True) -> DataFrame:
    """(by, start, target, points, movement, own_movement, temporal) of every start with every target: how many of the
    start's points end in the target, how much these moved, when, and how much the start moved at all (null without
    a point that is seen often enough)."""
    own = [*by, "start"]
    seen = F.sum(F.col("visible").cast("int")).over(Window.partitionBy(*own, "pt"))
    frames = F.count("*").over(Window.partitionBy(*own, "pt"))
    alive = points.withColumn("alive__", seen > VISIBLE_SHARE * frames).where("alive__").drop("alive__", "visible")
    moved = sc.displacement(alive.withColumns({"x": F.col("x") / size[1], "y": F.col("y") / size[0]}), own)
    inside, outside = F.when(interacting, F.col("moved")), F.when(~interacting, F.col("moved"))
    per = moved.groupBy(*own, "pt").agg(F.avg("moved").alias("mean"), F.sum(inside).alias("si"), F.count(inside).alias("ni"), F.sum(outside).alias("so"), F.count(outside).alias("no"))
    last = alive.groupBy(*own, "pt").agg(F.max_by(F.struct("x", "y"), "t").alias("p")).select(*own, "pt", "p.x", "p.y")
    hit = (F.col("x") >= F.col("x1")) & (F.col("x") <= F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") <= F.col("y2"))
    met = last.join(per, [*own, "pt"]).join(targets.select(*by, "target", "x1", "y1", "x2", "y2"), by).where(hit)
    mean = lambda s, n: F.coalesce(F.sum(s) / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0))
    arrived = met.groupBy(*own, "target").agg(F.count("*").alias("points"), F.avg("mean").alias("movement"), mean("si", "ni").alias("mi"), mean("so", "no").alias("mo"))
    timed = F.when(F.col("mi") + F.col("mo") > LEAST_MOVEMENT, F.col("mi") / (F.col("mi") + F.col("mo"))).otherwise(0.0) if has_phases else F.lit(1.0)
    velocity = seq.rolling_mean(sc.frame_motion(alive, own, fps, "median"), own, "t", "motion", "smooth")
    speed = velocity.groupBy(*own).agg(F.avg("smooth").alias("own_movement"))
    every = starts.select(*own).join(targets.select(*by, "target"), by).join(arrived.withColumn("temporal", timed), [*own, "target"], "left").join(speed, own, "left")
    return every.select(*own, "target", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("points", "movement", "temporal")), "own_movement")


def selected_pairs(points: DataFrame, starts: DataFrame, targets: DataFrame, by: list[str], interacting: Column, size: tuple[float, float], fps: float, intermediate: DataFrame | None = None, continuous: DataFrame | None = None) -> DataFrame:
    """(by, start, target, score, points, movement, reason): the best pair of every trajectory that has one with a score.
    starts: (by, start, x1 to y2); targets: (by, target, x1 to y2, conf); intermediate: (by, start, intermediate), matches
    on the way; continuous: (by, start, continuous), the penalty of what never rests. reason says why a pair is weak."""
    pairs = staged(measured_pairs(points, starts, targets, by, interacting, size, fps), "pairs")
    boxes = starts.withColumnRenamed("start", "idx")
    nested = bx.nested_penalty_of_crowds(boxes, by, pairs.withColumnRenamed("start", "idx").select(*by, "idx", "target", "points", "movement"))
    rows = pairs.join(nested.withColumnsRenamed({"idx": "start", "penalty": "nested"}), [*by, "start", "target"])
    for table, name in ((intermediate, "intermediate"), (continuous, "continuous")):
        rows = rows.withColumn(name, F.lit(0.0)) if table is None else rows.join(table, [*by, "start"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    scored = pub.preliminary_score(rows, by, LEAST_MOVEMENT, intermediate is not None)
    sized = scored.join(targets.select(*by, "target", "conf", bx.area(bx.corners()).alias("area")), [*by, "target"]).withColumn("number", F.struct("start", "target"))
    some = sized.withColumn("top__", F.max("score").over(Window.partitionBy(*by))).where("top__ > 0").drop("top__")
    best = sc.tie_break(some, by)
    reason = F.when(F.col("movement") < LEAST_MOVEMENT, pub.MILD_REJECTIONS[0]).when(F.col("points") < 2, pub.MILD_REJECTIONS[1])
    return best.select(*by, "start", "target", "score", F.col("points").cast("bigint").alias("points"), "movement", reason.alias("reason"))
