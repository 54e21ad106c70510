"""Hand interactions: contact phases by hand, their quality, how they pair up, and gripper signals from them.

Frames are (trajectory, t) with nullable box structs per slot. Phases are half-open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals
from .boxes import iou_of
from .sequences import close_gaps, runs, split_on_jump


def box_or_null(values: Column, at: int) -> Column:
    """Four numbers of an array from a place (counted from 1) on as a box; null if all are negative."""
    part = F.slice(values, at, 4)
    box = F.struct(*(F.element_at(part, k + 1).cast("double").alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))))
    return F.when(~F.forall(part, lambda v: v < 0), box)


def tracked(block: Column) -> Column:
    """Whether a hand was tracked: lost tracking leaves a block of zeros."""
    return ~F.forall(block, lambda v: v == 0)


def seconds_to_frames(seconds: float, fps: float) -> int:
    return max(1, round(seconds * fps))


def grasp_centre(keypoints: Column, thumb: int = 5, index: int = 9) -> Column:
    """Midpoint of the thumb's and the index finger's tip, for points of any dimension."""
    return F.zip_with(F.element_at(keypoints, thumb), F.element_at(keypoints, index), lambda a, b: (a + b) / 2)


def interactions(frames: DataFrame, by: list[str], own: str, shared: str, fps: float, gap: float = 0.25, least: float = 0.3, least_iou: float = 0.1) -> DataFrame:
    """(by, start_frame, end_frame, first_box, last_box, coverage): stretches in which a hand holds one
    object, in its own slot or the shared one. Short dropouts are bridged, short contacts dropped, and a
    stretch is cut where the box jumps to another object."""
    seen = frames.select(*by, "t", F.coalesce(own, shared).alias("box")).withColumn("held", F.col("box").isNotNull())
    closed = close_gaps(seen, by, "t", "held", seconds_to_frames(gap, fps))
    stretches = runs(closed.select(*by, "t", "held"), by, "t", "held").where("held")
    spans = stretches.select(*by, F.col("start_frame").alias("s"), F.col("end_frame").alias("e"))
    inside = closed.drop("held").join(spans, by).where("t >= s and t < e")
    pieces = split_on_jump(inside, [*by, "s"], "t", "box", least_iou)
    known = F.when(F.col("box").isNotNull(), F.col("t"))
    out = pieces.groupBy(*by, "s", "e", "piece").agg(
        F.min("t").alias("from"), F.min_by("box", known).alias("first_box"), F.max_by("box", known).alias("last_box"), F.count("box").alias("n_box"),
    )
    w = Window.partitionBy(*by, "s").orderBy("piece")
    bounded = out.withColumn("start_frame", F.when(F.row_number().over(w) == 1, F.col("s")).otherwise(F.col("from"))).withColumn("end_frame", F.coalesce(F.lead("from").over(w), F.col("e")))
    fit = bounded.where((F.col("end_frame") - F.col("start_frame") >= seconds_to_frames(least, fps)) & (F.col("n_box") > 0))
    return fit.select(*by, "start_frame", "end_frame", "first_box", "last_box", (F.col("n_box") / (F.col("end_frame") - F.col("start_frame"))).alias("coverage"))


def quality(phases: DataFrame, by: list[str], n_frames: Column, fps: float, least_open: float = 0.3, least_coverage: float = 0.6, most_iou: float = 0.7) -> DataFrame:
    """Marks phases with a clear start: the hand was open before, the object stayed known, and its box is
    not the hand's. Needs coverage and hand_iou (null: 1)."""
    w = Window.partitionBy(*by).orderBy("start_frame")
    before = F.col("start_frame") - F.coalesce(F.lag("end_frame").over(w), F.lit(0))
    after = F.coalesce(F.lead("start_frame").over(w), n_frames) - F.col("end_frame")
    out = phases.withColumns({"open_before": before, "open_after": after, "hand_iou": F.coalesce("hand_iou", F.lit(1.0))})
    clean = (F.col("open_before") >= seconds_to_frames(least_open, fps)) & (F.col("coverage") >= least_coverage) & (F.col("hand_iou") <= most_iou)
    return out.withColumn("is_clean", clean)


def paired(phases: DataFrame, by: list[str], least_overlap: int = 1, most_iou: float = 0.3) -> DataFrame:
    """Roles: 'shared' for both hands on one object, 'two_object' for hands busy at once on objects that do
    not coincide, else 'single'. Needs hand and first_box."""
    sides = [phases.where(F.col("hand") == h).select(*by, "start_frame", "end_frame", F.col("first_box").alias("b")) for h in ("left", "right")]
    met = intervals.pairs(*sides, by, least=least_overlap).where(iou_of(F.col("l_b"), F.col("r_b")) <= most_iou)
    busy = met.select(*by, F.lit("left").alias("hand"), F.col("l_start_frame").alias("start_frame")).union(met.select(*by, F.lit("right").alias("hand"), F.col("r_start_frame").alias("start_frame"))).distinct()
    role = F.when(F.col("hand") == "both", "shared").when(F.col("busy"), "two_object").otherwise("single")
    return phases.join(busy.withColumn("busy", F.lit(True)), [*by, "hand", "start_frame"], "left").withColumn("role", role).drop("busy")


def rescaled(phases: DataFrame, stride: int, n_output: Column | None = None) -> DataFrame:
    """Phases on the decimated clip: starts rounded down, ends up, cut to the clip, empty ones dropped."""
    start, end = F.floor(F.col("start_frame") / stride), F.ceil(F.col("end_frame") / stride)
    if n_output is not None:
        start, end = F.least(start, n_output), F.least(end, n_output)
    return phases.withColumns({"start_frame": start, "end_frame": end}).where("end_frame > start_frame")


def gripper_from_phases(frames: DataFrame, phases: DataFrame, by: list[str]) -> DataFrame:
    """1, open, and 0 inside of phases."""
    held = intervals.covering(frames.select(*by, "t"), phases.select(*by, "start_frame", "end_frame"), by, "t").select(*by, "t").distinct().withColumn("gripper", F.lit(0.0))
    return frames.join(held, [*by, "t"], "left").withColumn("gripper", F.coalesce("gripper", F.lit(1.0)))
