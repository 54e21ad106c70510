"""Publication: from scored candidates to rows that others read, and the composites on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import annotation_id, path_numbers, rounded
from ..operators import scoring as sc
from ..sources.annotations import NAME, VERSION

# Weights of the preliminary selection and of the published confidence.
POINTS, MOVEMENT, TEMPORAL, INTERMEDIATE = 0.35, 0.35, 0.15, 0.15
BONUS = 1.3
DETECTION_SHARE = 0.25
MILD_REJECTIONS = ("best_match_insufficient_movement", "best_match_insufficient_points")


def movement_gate(movement: Column, baseline: Column) -> Column:
    """0 at the scene's own movement, 1 from twice of it on; without a baseline by a small absolute value."""
    ratio = F.when(baseline <= 0, movement / 0.01).otherwise(F.greatest(F.lit(0.0), movement / baseline - 1))
    return F.when(movement > 0, F.least(F.lit(1.0), ratio)).otherwise(0.0)


def preliminary_score(df: DataFrame, by: list[str], least_movement: float = 0.01, intermediate: bool = True) -> DataFrame:
    """Adds `score` to pairs of start and target: points that arrive, gated by the start's own movement, its
    movement over the scene's, when it moves, and matches on the way. Columns points, movement, own_movement,
    temporal, intermediate, nested (a penalty), continuous (a penalty); baseline is the scene's median over
    start boxes, if there are three."""
    w = Window.partitionBy(*by)
    share = 1.0 if intermediate else 1 / (POINTS + MOVEMENT + TEMPORAL)
    starts = df.select(*by, "start", "own_movement").distinct().groupBy(*by)
    scene = starts.agg(F.when(F.count("own_movement") >= 3, F.median("own_movement")).otherwise(0.0).alias("baseline"))
    out = df.join(scene, by).withColumn("most__", F.greatest(F.max("points").over(w), F.lit(1)))
    score = (
        POINTS * share * F.col("points") / F.col("most__") * movement_gate(F.col("own_movement"), F.col("baseline"))
        + MOVEMENT * share * sc.movement_score(F.col("movement"), F.col("baseline"))
        + TEMPORAL * share * F.col("temporal")
        + (INTERMEDIATE * F.col("intermediate") if intermediate else F.lit(0.0))
    )
    strong = (F.col("points") > 2) & (F.col("movement") > least_movement) & (F.col("temporal") > 0.5)
    score = F.when((F.col("movement") < 0.5 * least_movement) | (F.col("points") < 1), 0.0).otherwise(score * F.when(strong, BONUS).otherwise(1.0))
    return out.withColumn("score", score * (1 - F.col("nested")) * (1 - F.col("continuous"))).drop("most__")


def confidence(detection: Column, tracking: Column, reason: Column) -> Column:
    """A quarter detection, three quarters tracking; less where the match was rejected; four digits."""
    base = DETECTION_SHARE * detection + F.coalesce((1 - DETECTION_SHARE) * tracking, F.lit(0.0))
    cut = F.when(reason.isNull(), 1.0).when(reason.isin(*MILD_REJECTIONS), 0.4).otherwise(0.2)
    return F.round(base * cut, 4)


def features(df: DataFrame, by: list[str]) -> DataFrame:
    """Scores of candidates from their signals (snr, sphere, conf, overlap, depth_gap), ready for winner()."""
    unit = df.withColumns({"snr_n": sc.unit_range("snr", by), "sphere_n": sc.unit_range("sphere", by), "penalty": sc.overlap_penalty(F.col("overlap"), F.col("depth_gap"))})
    return unit.withColumn("score", sc.adaptive_score(F.col("snr_n"), F.col("sphere_n"), F.col("conf"), F.col("penalty")))


def depth_rescued(overlap: Column, tip_distance: Column, most_overlap: float = 0.3, least_distance: float = 0.08) -> Column:
    """Candidates to keep: little overlap with the robot, or fingertips at another place than it seems."""
    return (overlap < most_overlap) | F.coalesce(tip_distance > least_distance, F.lit(False))


def selection(override: Column, pick: Column, scores: Column) -> Column:
    """What was selected: an override's fields before the pick's, its score before the candidate's."""
    index = F.coalesce(override["index"], pick["index"])
    score = F.coalesce(override["score"], pick["score"], F.try_element_at(scores, (index + 1).cast("int")))
    return F.struct(
        F.coalesce(override["method"], pick["method"]).alias("method"), rounded(score).alias("score"),
        F.when(score.isNotNull(), "ranking_score_not_calibrated_probability").alias("score_type"), index.alias("selected_candidate_index"),
        F.coalesce(override["reason"], pick["reason"]).alias("rejection_reason"),
    )


def source_episode(trajectory: Column, given: Column, nested: Column) -> Column:
    """The episode's number: as given, else the last number of the trajectory's path, or the one before it
    where the dataset nests subtrajectories."""
    numbers = F.filter(path_numbers(trajectory), lambda n: n.isNotNull())
    return F.coalesce(given, F.try_element_at(numbers, F.when(nested & (F.size(numbers) > 1), -2).otherwise(-1)))


def published_rows(df: DataFrame) -> DataFrame:
    """(annotation_id, line) of pipeline rows (dataset_id, trajectory_id, subtask_index, camera_view,
    start_frame, end_frame, instruction, selection): JSON without nulls, with an identity that the
    camera's view is part of. Rows that lack a trajectory or dataset raise."""
    c = F.col
    needed = F.when(F.coalesce(c("trajectory_id"), F.lit("")) == "", F.raise_error(F.lit("a row lacks its trajectory"))).when(
        F.coalesce(c("dataset_id"), F.lit("")) == "", F.raise_error(F.lit("a row lacks its dataset"))
    )
    identity = annotation_id(
        ("dataset_id", c("dataset_id")), ("trajectory_id", c("trajectory_id")), ("subtask_index", c("subtask_index")),
        ("start_frame", c("start_frame")), ("end_frame_exclusive", c("end_frame")), ("camera_view", c("camera_view")),
    )
    body = F.struct(
        F.struct(F.lit(NAME).alias("name"), F.lit(VERSION).alias("version")).alias("schema"), identity.alias("annotation_id"),
        F.struct(F.lit("original_uncropped_unresized_image").alias("image_reference"), F.lit("pixel_xyxy").alias("boxes"), F.lit("zero_based_trajectory_indices").alias("frame_indices")).alias("coordinates"),
        F.struct("dataset_id", "trajectory_id", "subtask_index", "camera_view").alias("source"),
        F.struct("start_frame", c("end_frame").alias("end_frame_exclusive")).alias("window"), F.struct("instruction").alias("task"), "selection",
    )
    return df.select(F.coalesce(needed.cast("string"), identity).alias("annotation_id"), F.to_json(body).alias("line"))
