"""Model stages after the detector: prompted detection, masks, tracks, depth, robot masks, verdicts, token scores.

Every stage is one Arrow-batched call per row behind an interface of `models`, with one model for each worker
(made when its first row comes), a bounded number of rows in flight, and a row of its own for what failed. What
stands around the calls (prompts, merging, suppression, filters, scores) is columns and joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..operators import boxes as bx
from ..operators.dense_stages import MASK, struct_of
from . import models

#: Frames of a video that a robot segmenter is given at most, spread evenly; fixed value of the method.
ROBOT_FRAMES = 64
#: What a batch of answers weighs, about, on its way out of a worker.
ANSWER_BYTES = 4_000_000


def stage(make: Callable, call: Callable, schema: str, *inputs: Column, in_flight: int = 1) -> Column:
    """A model's answer for each row: call(model, *values). A null input is not asked. With more than one in
    flight, calls overlap, as remote models allow. Answers leave the worker in batches of about ANSWER_BYTES,
    whatever the rows of a batch that comes in, so that a worker holds no more masks than that."""
    kind = to_arrow_type(DataType.fromDDL(schema))

    # The closure travels without a model: a worker makes its own.
    def answers(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        model, take = None, max(in_flight, 1)
        with ThreadPoolExecutor(max(in_flight, 1)) as pool:
            each = pool.map if in_flight > 1 else map
            for columns in batches:
                columns = columns if isinstance(columns, tuple) else (columns,)
                model = model or [make()]
                ask = lambda row: None if any(v is None for v in row) else call(model[0], *row)  # noqa: B023, E731
                at = 0
                while at < len(columns[0]):
                    rows = zip(*(c.slice(at, take).to_pylist() for c in columns), strict=True)
                    found = pa.array(list(each(ask, rows)), kind)
                    yield found
                    at += len(found)
                    take = max(1, in_flight, min(take * 4, ANSWER_BYTES * len(found) // max(found.nbytes, 1)))

    return F.arrow_udf(answers, schema).asNondeterministic()(*inputs)


class Remote:
    """A model that runs elsewhere, with the methods of its interface. Each call goes through `send(method, arguments,
    seconds)`, at most so many times, with a growing pause after a failure of the connection; what the model itself
    raised is raised here, at once."""

    def __init__(self, send: Callable, attempts: int = 3, seconds: float = 600.0, pause: float = 0.5):
        self._send, self._attempts, self._seconds, self._pause = send, attempts, seconds, pause

    def __getattr__(self, method: str) -> Callable:
        if method.startswith("_"):
            raise AttributeError(method)

        def call(*arguments):
            import time

            for k in range(self._attempts):
                try:
                    return self._send(method, arguments, self._seconds)
                except (ConnectionError, TimeoutError):
                    if k + 1 == self._attempts:
                        raise
                    time.sleep(self._pause * 2**k)

        return call


def names_robot(prompt: Column) -> Column:
    """Whether a detector's prompt asks for the robot."""
    low = F.lower(prompt)
    return F.contains(low, F.lit("robot")) | F.contains(low, F.lit("gripper")) | F.contains(low, F.lit("arm"))


def robot_prompts(arm: Column, specific: bool = True) -> Column:
    """What a detector is asked for to find the arm's gripper: its side first, then any."""
    side = F.when(arm.isin("left", "right"), F.concat(arm, F.lit(" robot gripper"))) if specific else F.lit(None).cast("string")
    return F.filter(F.array(side, F.lit("robot gripper"), F.lit("robot arm")), lambda p: p.isNotNull())


def prompted(requests: DataFrame, image: str = "image", threshold: float = 0.3, make: Callable = models.BoxDetector) -> DataFrame:
    """(key, prompt_index, prompt, x1, y1, x2, y2, conf): boxes of the first of a request's prompts (key, image,
    prompts) for which there are any. Each prompt is one call; calls stop with the first that finds something."""
    found = "array<struct<prompt_index:int,x1:double,y1:double,x2:double,y2:double,conf:double>>"

    def call(model, picture: bytes, prompts: list[str]) -> list[dict]:
        for k, prompt in enumerate(prompts):
            rows = model.detect([picture], [prompt], threshold)[0]
            if rows:
                return [dict(zip(("prompt_index", "x1", "y1", "x2", "y2", "conf"), (k, *row[:5]), strict=True)) for row in rows]
        return []

    out = requests.select("key", "prompts", F.explode(stage(make, call, found, F.col(image), F.col("prompts"))).alias("b"))
    return out.select("key", "b.prompt_index", F.col("prompts")[F.col("b.prompt_index")].alias("prompt"), "b.x1", "b.y1", "b.x2", "b.y2", "b.conf")


def object_candidates(images: DataFrame, width: float, height: float, with_robot: bool = True, threshold: float = 0.3, most: int = 22, make: Callable = models.BoxDetector) -> DataFrame:
    """(key, idx, x1, y1, x2, y2, conf, is_robot): what an image (key, image, label, arm) shows of its object and,
    unless the robot comes from a segmenter, of its gripper; large boxes dropped, suppressed, the strongest kept."""
    asked = images.select("key", "image", F.array("label").alias("prompts"))
    boxes = prompted(asked, threshold=threshold, make=make).select("key", "x1", "y1", "x2", "y2", "conf", F.lit(False).alias("is_robot"))
    if with_robot:
        robots = prompted(images.select("key", "image", robot_prompts(F.col("arm")).alias("prompts")), threshold=threshold, make=make)
        boxes = boxes.unionByName(robots.select("key", "x1", "y1", "x2", "y2", "conf", F.lit(True).alias("is_robot")))
    order = F.struct(F.col("is_robot").cast("int"), -F.col("conf"), "x1", "y1")
    listed = bx.within_area(boxes, width, height).groupBy("key").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "x1", "y1", "x2", "y2", "conf", "is_robot"))).alias("l"))
    numbered = listed.select("key", F.posexplode("l").alias("idx", "b")).select("key", F.col("idx").cast("bigint").alias("idx"), "b.x1", "b.y1", "b.x2", "b.y2", "b.conf", "b.is_robot")
    kept = bx.strongest(bx.suppressed(numbered, ["key"]), ["key"], most).select("key", "idx")
    return numbered.join(kept, ["key", "idx"])


def segmented(rows: DataFrame, make: Callable = models.BoxSegmenter) -> DataFrame:
    """Adds `masks`, one for each of a row's boxes (image, boxes: lists of four), and `confidences` in which
    those of empty masks are zero."""

    def call(model, image: bytes, boxes: list[list[float]]) -> dict:
        found = [np.asarray(x) for x in model.segment(image, [tuple(b) for b in boxes])]
        return {"masks": [struct_of(x) for x in found], "empty": [not x.any() for x in found]}

    out = rows.withColumn("found__", stage(make, call, f"struct<masks:array<{MASK}>,empty:array<boolean>>", F.col("image"), F.col("boxes")))
    confidences = F.zip_with("confidences", "found__.empty", lambda c, e: F.when(e, 0.0).otherwise(c))
    return out.withColumns({"masks": F.col("found__.masks"), "confidences": confidences}).drop("found__")


def tracked(rows: DataFrame, n_points: int, make: Callable = models.StillTracker) -> DataFrame:
    """(columns of rows, frame, point, x, y, seen): tracks of the points (flat) over the frames (a list of
    images). A row with fewer than n_points points has the rest at -1, never seen, so that all rows are alike."""
    kind = "array<struct<frame:int,point:int,x:double,y:double,seen:boolean>>"

    def call(model, frames: list[bytes], points: list[float]) -> list[dict]:
        given = np.asarray(points, float).reshape(-1, 2)[:n_points]
        tracks, seen = model.track(frames, [tuple(p) for p in given])
        out = []
        for t in range(len(frames)):
            for p in range(n_points):
                known = p < len(given)
                out.append({"frame": t, "point": p, "x": float(tracks[t][p][0]) if known else -1.0, "y": float(tracks[t][p][1]) if known else -1.0, "seen": bool(seen[t][p]) if known else False})
        return out

    found = stage(make, call, kind, F.col("frames"), F.col("points"))
    return rows.withColumn("t__", F.explode(found)).select(*(c for c in rows.columns if c not in ("frames", "points")), "t__.*")


def lifted(rows: DataFrame, make: Callable = models.FlatDepth, fov: float | None = None) -> DataFrame:
    """Adds `xyz` to rows (frames, points: a flat list for each frame): where the points lie in space, three
    numbers each; a point takes the pixel it rounds to, inside of the image."""

    def call(model, frames: list[bytes], points: list[list[float]]) -> list[list[float]]:
        return [models.lifted(np.asarray(p, float).reshape(-1, 2), cloud).astype(float).reshape(-1).tolist() for p, cloud in zip(points, model.lift(frames, fov), strict=True)]

    return rows.withColumn("xyz", stage(make, call, "array<array<double>>", F.col("frames"), F.col("points")))


class BandRobot:
    """Stands in for a robot segmenter: the lower quarter of every image."""

    def __init__(self, height: int = 48, width: int = 64):
        self.size = height, width

    def segment_video(self, frames: list[bytes], category: str) -> list:
        mask = np.zeros(self.size, np.uint8)
        mask[self.size[0] * 3 // 4 :] = 1
        return [mask for _ in frames]


def spread_frames(n: int, most: int = ROBOT_FRAMES) -> list[int]:
    """At most so many frames of n, spread evenly, the first and the last among them."""
    return list(range(n)) if n <= most else sorted({int(x) for x in np.linspace(0, n - 1, most)})


def robot_masks(videos: DataFrame, category: str = "robot", most: int = ROBOT_FRAMES, make: Callable = BandRobot) -> DataFrame:
    """(key, frame, mask) of videos (key, frames): masks of the robot on at most `most` frames."""

    def call(model, frames: list[bytes]) -> list[dict]:
        at = spread_frames(len(frames), most)
        return [{"frame": k, "mask": struct_of(np.asarray(m))} for k, m in zip(at, model.segment_video([frames[k] for k in at], category), strict=True)]

    found = stage(make, call, f"array<struct<frame:int,mask:{MASK}>>", F.col("frames"))
    return videos.select("key", F.explode(found).alias("f")).select("key", "f.frame", "f.mask")


def verified(rows: DataFrame, prompts: list[str], make: Callable = models.WordVerifier, in_flight: int = 8, attempts: int = 2) -> DataFrame:
    """Adds `verdict` to rows (image, and a column for each prompt): 1 yes, 0 no, 0.5 undecided, of several prompts
    the least; an answer that never comes is undecided."""
    from ..functions.text import verdict

    def call(model, image: bytes, prompt: str) -> str:
        for _ in range(attempts):
            try:
                return model.verify(prompt, image)
            except OSError:
                continue
        return ""

    answers = {f"answer__{k}": stage(make, call, "string", F.col("image"), F.col(p), in_flight=in_flight) for k, p in enumerate(prompts)}
    out = rows.withColumns(answers)
    scores = [F.coalesce(verdict(F.col(a)), F.lit(0.5)) for a in answers]
    return out.withColumn("verdict", F.least(*scores) if len(scores) > 1 else scores[0]).drop(*answers)


def token_score(logits: Column, begin: Column, end: Column) -> Column:
    """Mean score of the tokens of a class's span, end exclusive; null for an empty span."""
    part = F.slice(logits, begin + 1, F.greatest(end - begin, F.lit(0)))
    return F.when(F.size(part) > 0, F.aggregate(part, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(part)))


def highlighted_prompt(label: Column, box: tuple[Column, ...]) -> Column:
    """Asks whether the marked box is the object."""
    return F.format_string("Is the box from (%d, %d) to (%d, %d) a %s? Close with **VERDICT: YES**, **VERDICT: NO** or **VERDICT: UNCERTAIN**.", *(b.cast("int") for b in box), label)


def parsing_prompt(instruction: Column, phases: Column) -> Column:
    """Asks for the action, object and places of an instruction whose phases are known, as JSON."""
    numbered = F.array_join(F.transform(phases, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p)), "\\n")
    return F.concat(
        F.lit("Instruction: "), F.coalesce(instruction, F.lit("none given")), F.lit("\\nPhases:\\n"), numbered,
        F.lit('\\nAnswer with one JSON object: {"action": ..., "object": ..., "start_location": ..., "target_location": ...}.'),
    )


def storyboard_prompt(instruction: Column, frames: Column) -> Column:
    """Asks which objects are grasped on the frames shown, in order, and whether a later grasp repeats one."""
    return F.concat(
        F.lit("The "), F.size(frames).cast("string"), F.lit(" images show frames "), F.array_join(frames.cast("array<string>"), ", "), F.lit(" of: "), instruction,
        F.lit(". For each name the object in the gripper and its relation to the one before: new_instance, same_instance_retry or same_instance_continuation."),
    )


def request_counts(asked: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """(rows, distinct, cached, sent): how many requests there were, and how many a stage really makes."""
    once = asked.groupBy(*keys).agg(F.count("*").alias("n")).join(cache.select(*keys).distinct().withColumn("hit__", F.lit(1)), keys, "left")
    return once.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct"), F.count("hit__").alias("cached"), (F.count("*") - F.count("hit__")).alias("sent"))
