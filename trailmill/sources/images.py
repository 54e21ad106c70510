"""Frames of videos as a stage: which frames, by which decoder, at which size.

The index arithmetic is columns (`datasets.video_frame`); decoding is an interface that users implement. A
worker opens each video once for the frames that a row asks of it, and frames come out in the asked order.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .datasets import video_frame

#: Frames that are decoded and resized at a time.
BATCH = 8


class Decoder(Protocol):
    def decode(self, content: bytes, indices: list[int]) -> list[np.ndarray]:
        """Images (height, width, channels) of the given frames, which rise and are distinct."""

    def count(self, content: bytes) -> int: ...


class RawVideo:
    """A decoder of plain bytes: a header of four 4-byte numbers (frames, height, width, channels), then the pixels."""

    def shape(self, content: bytes) -> tuple[int, ...]:
        return tuple(int(x) for x in np.frombuffer(content, "<u4", 4))

    def count(self, content: bytes) -> int:
        return self.shape(content)[0]

    def decode(self, content: bytes, indices: list[int]) -> list[np.ndarray]:
        n, h, w, c = self.shape(content)
        pixels = np.frombuffer(content, np.uint8, n * h * w * c, 16).reshape(n, h, w, c)
        return [pixels[i] for i in indices]


def raw_video(frames: np.ndarray) -> bytes:
    return np.array(frames.shape, "<u4").tobytes() + np.ascontiguousarray(frames, np.uint8).tobytes()


def area_resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image at another size, each pixel the mean of the area that it covers, rounded half up."""

    def weights(old: int, new: int) -> np.ndarray:
        edges = np.linspace(0, old, new + 1)
        low, high = np.maximum(edges[:-1, None], np.arange(old)), np.minimum(edges[1:, None], np.arange(1, old + 1))
        share = np.maximum(high - low, 0)
        return share / share.sum(axis=1, keepdims=True)

    rows, cols = weights(image.shape[0], height), weights(image.shape[1], width)
    return np.floor(np.einsum("ih,hwc,jw->ijc", rows, image.astype(float), cols) + 0.5).astype(np.uint8)


def frame_indices(timestamps: Column, from_ts: Column, fps: Column, n_frames: Column) -> Column:
    """Video frames of a list of times."""
    return F.transform(timestamps, lambda t: video_frame(t, from_ts, fps, n_frames))


FRAMES = "array<struct<index:bigint,height:int,width:int,data:binary>>"


def decoded(videos: DataFrame, size: tuple[int, int] | None = None, make: Callable[[], Decoder] = RawVideo) -> DataFrame:
    """Replaces `content` of rows (content, indices) by `frames`, the asked frames in the asked order, repeated where
    they are asked twice; indices beyond the video are kept inside of it. A null video has null frames."""
    kind = pa.list_(pa.struct([("index", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())]))

    def one(decoder: Decoder, content: bytes, indices: list[int]) -> list[dict]:
        last = decoder.count(content) - 1
        asked = [min(max(0, i), last) for i in indices] if last >= 0 else []
        found: dict[int, dict] = {}
        distinct = sorted(set(asked))
        for at in range(0, len(distinct), BATCH):
            part = distinct[at : at + BATCH]
            for index, image in zip(part, decoder.decode(content, part), strict=True):
                image = image if size is None or image.shape[:2] == size else area_resized(image, *size)
                found[index] = {"index": index, "height": image.shape[0], "width": image.shape[1], "data": image.tobytes()}
        return [found[i] for i in asked]

    def batch(contents, indices):
        decoder = make()
        pairs = ((c.as_py(), i.as_py()) for c, i in zip(contents, indices, strict=True))
        return pa.array([None if c is None or i is None else one(decoder, c, i) for c, i in pairs], kind)

    frames = F.arrow_udf(batch, FRAMES)(F.col("content"), F.col("indices"))
    return videos.withColumn("frames", frames).drop("content")
