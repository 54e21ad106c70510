"""Models as stages: interfaces that users implement, and deterministic stand-ins.

No network runs here. A stage is mapInPandas over batches with one model for each worker, behind a
duplicate filter and an anti-join with what is cached, so that a request is made once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Detector(Protocol):
    def detect(self, images: list[bytes], classes: list[str], threshold: float) -> list[list[tuple]]: ...


class Segmenter(Protocol):
    def segment(self, image: bytes, boxes: list[tuple]) -> list: ...


class Tracker(Protocol):
    def track(self, frames: list[bytes], points: list[tuple]) -> tuple: ...


class Depth(Protocol):
    def lift(self, frames: list[bytes], fov_x: float | None) -> list: ...


class TaskParser(Protocol):
    def parse(self, instruction: str, phase_key: str) -> str | None: ...


class Verifier(Protocol):
    def verify(self, prompt: str, image: bytes | None) -> str: ...


class RuleParser:
    """Stands in for a language model: verb, object and places of an instruction by its words."""

    def parse(self, instruction: str, phase_key: str) -> str | None:
        import json
        import re

        m = re.match(r"(?i)\s*(\w+)\s+(?:the\s+)?(.+?)(?:\s+from\s+(?:the\s+)?(.+?))?(?:\s+(?:to|into|on|onto|in)\s+(?:the\s+)?(.+?))?\s*\.?\s*$", instruction or "")
        if not m:
            return None
        action, thing, start, target = m.groups()
        return json.dumps({"action": action.lower(), "object": thing.lower(), "start_location": start, "target_location": target})


class BoxDetector:
    """Stands in for a detector: one box for each class, placed by a hash of the image and the class."""

    def detect(self, images: list[bytes], classes: list[str], threshold: float) -> list[list[tuple]]:
        import hashlib

        out = []
        for image in images:
            rows = []
            for k, name in enumerate(classes):
                code = int(hashlib.md5(image + name.encode()).hexdigest()[:8], 16)
                x, y, conf = code % 200, code // 200 % 150, (code >> 16) / 65_536
                if conf >= threshold:
                    rows.append((float(x), float(y), float(x + 40), float(y + 30), conf, k))
            out.append(rows)
        return out


def requests(df: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to be asked: each key once, without those that the cache has."""
    return df.select(*keys).dropDuplicates(keys).join(cache.select(*keys).distinct(), keys, "left_anti")


def parse_tasks(df: DataFrame, make: Callable[[], TaskParser] = RuleParser, in_flight: int = 16, attempts: int = 2) -> DataFrame:
    """(instruction, phase_key, answer): answers of a parser, at most `in_flight` requests at a time in a
    worker and `attempts` for each; null where all fail."""

    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = make()

        def ask(row: tuple) -> str | None:
            for _ in range(attempts):
                try:
                    if answer := parser.parse(*row):
                        return answer
                except OSError:
                    continue
            return None

        with ThreadPoolExecutor(in_flight) as pool:
            for pdf in batches:
                rows = zip(pdf["instruction"], pdf["phase_key"], strict=True)
                yield pdf.assign(answer=list(pool.map(ask, rows)))

    return df.select("instruction", "phase_key").mapInPandas(stage, "instruction string, phase_key string, answer string")


def latest(cache: DataFrame, keys: list[str], at: str) -> DataFrame:
    """An append-only cache's newest entry of each key."""
    rest = [c for c in cache.columns if c not in keys]
    return cache.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("e")).select(*keys, "e.*")


def detections(df: DataFrame, classes: list[str], threshold: float, make: Callable[[], Detector] = BoxDetector, batch: int = 4) -> DataFrame:
    """(key, x1, y1, x2, y2, conf, class_id) of images (key, image), in batches of `batch`."""

    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            rows = []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                for key, found in zip(part["key"], model.detect(list(part["image"]), classes, threshold), strict=True):
                    rows += [(key, *box) for box in found]
            yield pd.DataFrame(rows, columns=["key", "x1", "y1", "x2", "y2", "conf", "class_id"])

    kind = df.schema["key"].dataType.simpleString()
    return df.select("key", "image").mapInPandas(stage, f"key {kind}, x1 double, y1 double, x2 double, y2 double, conf double, class_id int")


def reassigned_for_tool(df: DataFrame) -> DataFrame:
    """Where a task needs a tool, the tool is what is grasped and the object becomes the target."""
    tool = F.coalesce(F.trim("tool_name_required"), F.lit("")) != ""
    return df.withColumns({"grasped": F.when(tool, F.col("tool_name_required")).otherwise(F.col("object")), "target": F.when(tool, F.col("object")).otherwise(F.col("target_location"))})


def resolved_target(df: DataFrame, by: list[str]) -> DataFrame:
    """The winner's target, else the most confident one: columns target, conf, winner (boolean)."""
    best = F.max_by("target", F.struct(F.coalesce(F.col("winner"), F.lit(False)), "conf", "target"))
    return df.groupBy(*by).agg(best.alias("target"), F.coalesce(F.bool_or("winner"), F.lit(False)).alias("verified"))


class BoxSegmenter:
    """Stands in for a segmenter: the inside of each box, on a grid of the image's size."""

    def __init__(self, height: int = 48, width: int = 64):
        self.size = height, width

    def segment(self, image: bytes, boxes: list[tuple]) -> list:
        import numpy as np

        out = []
        for x1, y1, x2, y2 in boxes:
            mask = np.zeros(self.size, np.uint8)
            mask[max(0, int(y1)) : int(y2) + 1, max(0, int(x1)) : int(x2) + 1] = 1
            out.append(mask)
        return out


class StillTracker:
    """Stands in for a tracker: points stay where they are and are always seen."""

    def track(self, frames: list[bytes], points: list[tuple]) -> tuple:
        import numpy as np

        tracks = np.repeat(np.asarray(points, np.float32)[None], len(frames), axis=0)
        return tracks, np.ones(tracks.shape[:2], bool)


class FlatDepth:
    """Stands in for a depth model: every frame lies at depth 1."""

    def __init__(self, height: int = 48, width: int = 64):
        self.size = height, width

    def lift(self, frames: list[bytes], fov_x: float | None) -> list:
        import numpy as np

        ys, xs = np.mgrid[: self.size[0], : self.size[1]].astype(np.float32)
        return [np.stack([xs, ys, np.ones_like(xs)], axis=-1) for _ in frames]


class WordVerifier:
    """Stands in for a verifier: yes if the prompt's object is named in it twice."""

    def verify(self, prompt: str, image: bytes | None) -> str:
        words = prompt.lower().split()
        return f"**verdict: {'yes' if len(words) > len(set(words)) else 'uncertain'}**"


def lifted(points, cloud):
    """Depth of track points: the cell they round to, inside of the image."""
    import numpy as np

    h, w = cloud.shape[:2]
    at = np.clip(np.rint(np.asarray(points)).astype(int), 0, (w - 1, h - 1))
    return cloud[at[..., 1], at[..., 0]]
