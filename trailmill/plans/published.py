"""The whole published row: what the parts of an annotation say, joined from tables of their own.

Every part is a long table with the annotation's keys (trajectory_id, subtask_index): phases, keyframes with
masks, candidates of the detector, objects by arm, centroid traces, stored arrays. A part that is not given,
or has no row for an annotation, is left out of its line. Arms come from the objects: one without a name is
the robot's only one and stands at the top, named ones are listed under `arms`.

All parts are stacked and listed by the annotation's keys in one grouped aggregation; arms are looked up in the lists, which
hold one annotation's rows, before anything is built: what is built is many times as wide. A trajectory's key may be of any
type and is text in the line only, so that tables that come partitioned by their keys (by the trajectory, where the subtask
is one number everywhere) stay where they are: nothing is shuffled again.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import annotation_id
from ..sources.annotations import NAME, VERSION

KEYS = ("trajectory_id", "subtask_index")


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def phase_rows(phases: DataFrame) -> DataFrame:
    """(keys, spans): phases (phase, start_frame, end_frame, description)."""
    body = F.struct(
        F.col("phase").alias("type"), F.col("start_frame").cast("bigint").alias("start_frame"), F.col("end_frame").cast("bigint").alias("end_frame_inclusive"),
        _optional(phases, "description", "string").alias("description"),
    )
    return phases.select(*KEYS, body.alias("spans"))


def keyframe_rows(keyframes: DataFrame) -> DataFrame:
    """(keys, marks): keyframes (name, frame) without detections."""
    mark = F.struct(F.col("name").alias("type"), F.col("frame").cast("bigint").alias("frame"))
    return keyframes.where("name <> 'detection'").select(*KEYS, mark.alias("marks"))


def all_phases(spans: Column, marks: Column | None = None) -> Column:
    """Phases in order of their starts. With keyframes, each at which no phase of its kind ends is a phase of one frame,
    once, and all are in order of their ends. Null if there are none."""
    order = "start_frame" if marks is None else "end_frame_inclusive"
    if marks is not None:
        ends = lambda m: F.exists(spans, lambda p: (p["type"] == m["type"]) & (p["end_frame_inclusive"] == m["frame"]))
        one = lambda m: F.struct(m["type"].alias("type"), m["frame"].alias("start_frame"), m["frame"].alias("end_frame_inclusive"), F.lit(None).cast("string").alias("description"))
        missing = F.transform(F.filter(F.array_distinct(marks), lambda m: ~F.coalesce(ends(m), F.lit(False))), one)
    every = spans if marks is None else F.concat(spans, missing)
    ordered = F.array_sort(F.transform(every, lambda b: F.struct(b[order].alias("o"), b["type"].alias("t"), b.alias("b"))))
    return F.when((F.size(spans) > 0) if marks is None else (F.size(spans) + F.size(marks) > 0), F.transform(ordered, lambda x: x["b"]))


def _arm(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def candidate_rows(candidates: DataFrame) -> DataFrame:
    """(keys, candidates): candidates of the detector (arm, kind, cand, box, conf, source) with a confidence."""
    found = candidates.where(F.col("conf").isNotNull() & ~F.isnan("conf"))
    return found.select(*KEYS, F.struct(_arm(F.col("arm")).alias("arm"), "kind", "cand", "box", "conf", "source").alias("candidates"))


def _surest(candidates: Column, arm: Column, kind: str) -> Column:
    """The most confident candidate of an arm (kind initial or target), the first of equals."""
    own = F.filter(candidates, lambda p: (p["arm"] == _arm(arm)) & (p["kind"] == kind))
    return F.array_max(F.transform(own, lambda p: F.struct(p["conf"].alias("conf"), (-p["cand"]).alias("o"), p["cand"].alias("cand"), p["box"].alias("box"), p["source"].alias("source"))))


def _baselines(i: Column, t: Column) -> Column:
    """Without an initial candidate there is no baseline."""
    part = lambda p, index: (p["box"].alias("box_xyxy_pixels"), p["conf"].alias("detector_score"), p["cand"].alias(index))
    initial = F.struct(*part(i, "tracked_candidate_index"), i["source"].alias("source_detection_index"))
    target = F.when(t.isNotNull(), F.struct(*part(t, "candidate_index")))
    return F.when(i.isNotNull(), F.struct(F.struct(F.lit("maximum_detector_score").alias("method"), initial.alias("initial"), target.alias("target")).alias("detector")))


def trace_rows(traces: DataFrame) -> DataFrame:
    """(keys, points): the frames and places of candidates' centroids (arm, cand, frame, x, y) without unknown ones."""
    known = traces.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    return known.select(*KEYS, F.struct(_arm(F.col("arm")).alias("arm"), "cand", "frame", "x", "y").alias("points"))


def _track(points: Column, arm: Column, cand: Column) -> Column:
    """A candidate's frames and places, in order; null if there are none."""
    own = F.filter(points, lambda p: (p["arm"] == _arm(arm)) & (p["cand"] == cand))
    return F.array_sort(F.transform(own, lambda p: F.struct(p["frame"].alias("frame"), p["x"].alias("x"), p["y"].alias("y"))))


def array_rows(arrays: DataFrame) -> DataFrame:
    """(keys, arrays): where stored arrays (name, path, dtype, shape) lie."""
    return arrays.select(*KEYS, F.struct("name", F.struct("path", "dtype", "shape").alias("at")).alias("arrays"))


def object_rows(objects: DataFrame) -> DataFrame:
    """(keys, things): of an arm its object and selection. objects: (keys, arm, label, instance_id, relation_to_previous,
    detection_frame, initial_box, initial_score, target_box, target_score, verified, intermediate (frame to box), selected,
    selection)."""
    between = F.array_sort(F.map_entries(F.coalesce("intermediate", F.create_map().cast("map<bigint,array<double>>"))))
    thing = F.struct(
        "arm", "label", "instance_id", "relation_to_previous", "detection_frame", "initial_box", "initial_score", "target_box", "target_score", "verified",
        F.filter(between, lambda e: e["value"].isNotNull()).alias("between"), "selected", "selection",
    )
    return objects.select(*KEYS, thing.alias("things"))


def _object(x: Column, start: Column, end: Column) -> Column:
    between = F.transform(x["between"], lambda e: F.struct((start + e["key"]).alias("frame_index"), e["value"].alias("box_xyxy_pixels")))
    track = F.struct(F.transform(x["track"], lambda p: F.array(p["x"], p["y"])).alias("xy_pixels"), F.transform(x["track"], lambda p: p["frame"]).alias("frame_indices"))
    return F.struct(
        x["label"].alias("label"), x["instance_id"].alias("instance_id"), x["relation_to_previous"].alias("relation_to_previous"),
        F.struct((start + F.coalesce(x["detection_frame"], F.lit(0))).alias("frame_index"), x["initial_box"].alias("box_xyxy_pixels"), x["initial_score"].alias("detector_score")).alias("initial"),
        F.struct(F.greatest(start, end - 1).alias("frame_index"), x["target_box"].alias("box_xyxy_pixels"), x["target_score"].alias("detector_score"), x["verified"].alias("verified")).alias("target"),
        F.when(F.size(x["between"]) > 0, between).alias("intermediate"), F.when(F.size(x["track"]) > 0, track).alias("track"),
    )


def assembled(
    annotations: DataFrame,
    objects: DataFrame,
    phases: DataFrame | None = None,
    keyframes: DataFrame | None = None,
    candidates: DataFrame | None = None,
    traces: DataFrame | None = None,
    arrays: DataFrame | None = None,
) -> DataFrame:
    """(annotation_id, line) of annotations (dataset_id, keys, camera_view, start_frame, end_frame, instruction, and what
    else a source, window or task has). Lines have no nulls. A row without trajectory or dataset raises."""
    given = ((objects, object_rows), (candidates, candidate_rows), (traces, trace_rows), (phases, phase_rows), (None if phases is None else keyframes, keyframe_rows), (arrays, array_rows))
    parts = [rows_of(part) for part, rows_of in given if part is not None]
    stacked = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    lists = stacked.groupBy(*KEYS).agg(*(F.collect_list(n).alias(n) for n in stacked.columns if n not in KEYS))
    rows = annotations.join(lists, list(KEYS), "left")
    c, text = F.col, lambda n: _optional(annotations, n, "string")
    number = lambda n: _optional(annotations, n, "bigint")
    nothing = lambda kind: F.lit(None).cast(kind)
    trajectory, start, end = c("trajectory_id").cast("string"), c("start_frame"), c("end_frame")
    needed = F.when(F.coalesce(trajectory, F.lit("")) == "", F.raise_error(F.lit("a row lacks its trajectory"))).when(
        F.coalesce(c("dataset_id"), F.lit("")) == "", F.raise_error(F.lit("a row lacks its dataset"))
    )
    identity = annotation_id(
        ("dataset_id", c("dataset_id")), ("trajectory_id", trajectory), ("subtask_index", c("subtask_index")),
        ("start_frame", start), ("end_frame_exclusive", end), ("camera_view", c("camera_view")),
    )
    # Columns of their own, or they would be worked out wherever they are used.
    about = lambda x: x.withField("track", nothing("array<struct<frame:bigint,x:double,y:double>>") if traces is None else _track(c("points"), x["arm"], x["selected"]))
    if candidates is not None:
        plain = about
        about = lambda x: plain(x).withField("i", _surest(c("candidates"), x["arm"], "initial")).withField("t", _surest(c("candidates"), x["arm"], "target"))
    rows = rows.withColumns({"identity__": identity, "things__": F.transform("things", about)})
    rows = rows.withColumns({"own__": F.array_max(F.filter("things__", lambda x: x["arm"].isNull())), "named__": F.array_sort(F.filter("things__", lambda x: x["arm"].isNotNull()))})
    identity, own, named = c("identity__"), c("own__"), c("named__")
    baselines = lambda x: nothing("struct<detector:string>") if candidates is None else _baselines(x["i"], x["t"])
    size = F.when(number("height").isNotNull(), F.array(number("height"), number("width")))
    long_task = F.when(text("longtask_id").isNotNull(), F.struct(text("longtask_id").alias("id"), number("longtask_step").alias("step"), number("longtask_len").alias("length")))
    stored = nothing("array<string>") if arrays is None else F.when(F.size("arrays") > 0, F.map_from_entries(F.array_sort("arrays")))
    record = lambda x: F.struct(x["arm"].alias("arm"), _object(x, start, end).alias("object"), x["selection"].alias("selection"), baselines(x).alias("baselines"))
    spans = nothing("array<struct<type:string>>") if phases is None else all_phases(c("spans"), None if keyframes is None else c("marks"))
    tool = F.when(text("tool_name").isNotNull(), F.struct(text("tool_name").alias("name"), _optional(annotations, "tool_box", "array<double>").alias("box_xyxy_pixels")))
    body = F.struct(
        F.struct(F.lit(NAME).alias("name"), F.lit(VERSION).alias("version")).alias("schema"), identity.alias("annotation_id"),
        F.struct(
            F.lit("original_uncropped_unresized_image").alias("image_reference"), F.lit("pixel_xyxy").alias("boxes"),
            F.lit("binary_image_aligned").alias("masks"), F.lit("zero_based_trajectory_indices").alias("frame_indices"),
        ).alias("coordinates"),
        F.struct(
            "dataset_id", trajectory.alias("trajectory_id"), text("source_uuid").alias("source_uuid"), number("episode_index").alias("episode_index"), "subtask_index",
            text("split").alias("split"), _optional(annotations, "fps", "double").alias("fps"), "camera_view", long_task.alias("long_task"),
        ).alias("source"),
        F.struct("start_frame", c("end_frame").alias("end_frame_exclusive"), number("num_frames").alias("trajectory_frame_count"), size.alias("image_size_hw")).alias("window"),
        F.struct(
            "instruction", F.coalesce(text("parsing_mode"), F.lit("text")).alias("parsing_mode"), text("action").alias("action"),
            text("start_location").alias("start_location"), text("target_location").alias("target_location"), spans.alias("phases"),
        ).alias("task"),
        stored.alias("arrays"), F.when(own.isNotNull(), _object(own, start, end)).alias("object"), own["selection"].alias("selection"),
        baselines(own).alias("baselines"), tool.alias("tool"), F.when(F.size(named) > 0, F.transform(named, record)).alias("arms"),
    )
    return rows.select(F.coalesce(needed.cast("string"), identity).alias("annotation_id"), F.to_json(body).alias("line"))


def augmented_tracks(traces: DataFrame, annotations: DataFrame) -> DataFrame:
    """Track rows with what their annotation says (F36): instruction, and their place in the window from 0 to 1."""
    about = annotations.select(*KEYS, "instruction", F.col("start_frame").alias("s__"), F.col("end_frame").alias("e__"))
    out = traces.join(about, list(KEYS)).where("frame >= s__ and frame < e__")
    progress = F.when(F.col("e__") - F.col("s__") > 1, (F.col("frame") - F.col("s__")) / (F.col("e__") - F.col("s__") - 1)).otherwise(0.0)
    return out.withColumn("progress", progress).drop("s__", "e__")
