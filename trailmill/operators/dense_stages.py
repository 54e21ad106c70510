"""Dense operators as columns: masks, points and boxes of one frame in, numbers or masks out.

A mask is a struct (height, width, data), a byte for each pixel in reading order. Points are flat lists,
x and y in turn (or x, y and z). Every function here is one Arrow-batched call over rows, so that a plan
can use it between joins and aggregations; what one row holds is one frame's array, which bounds memory.
Null in gives null out. The arithmetic on single arrays is that of `dense`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from . import dense

MASK = "struct<height:int,width:int,data:binary>"


def mask_of(value: dict | None) -> np.ndarray | None:
    """The array of a mask's struct."""
    return None if value is None else np.frombuffer(value["data"], np.uint8).reshape(value["height"], value["width"])


def struct_of(mask: np.ndarray | None) -> dict | None:
    return None if mask is None else {"height": mask.shape[0], "width": mask.shape[1], "data": np.ascontiguousarray(mask, np.uint8).tobytes()}


def points_of(values: Sequence[float] | None, dims: int = 2) -> np.ndarray | None:
    return None if values is None else np.asarray(values, float).reshape(-1, dims)


def _each(function: Callable, schema: str, *inputs: Column) -> Column:
    """One call for each row of a batch, of which one at a time is turned into Python's values; rows with a null input are null."""
    kind = to_arrow_type(DataType.fromDDL(schema))

    def batch(*columns):
        rows = (tuple(v.as_py() for v in row) for row in zip(*columns, strict=True))
        return pa.array([None if any(v is None for v in row) else function(*row) for row in rows], kind)

    return F.arrow_udf(batch, schema)(*inputs)


def rasterised(points: Column, bounds: Column, size: int = 96) -> Column:
    """The cells of a size by size grid over the bounds (x1, y1, x2, y2) in which points lie."""
    return _each(lambda p, b: struct_of(dense.rasterised(points_of(p), tuple(b), size)), MASK, points, bounds)


def dilated(mask: Column, radius: int) -> Column:
    return _each(lambda m: struct_of(dense.dilated(mask_of(m), radius)), MASK, mask)


def n_components(mask: Column) -> Column:
    return _each(lambda m: dense.labelled(mask_of(m))[1], "int", mask)


def n_set(mask: Column) -> Column:
    """Pixels that are set. The bytes are read where Arrow holds them."""

    def batch(data):
        return pa.array([int(np.count_nonzero(np.frombuffer(v.as_buffer(), np.uint8))) if v.is_valid else None for v in data], pa.int64())

    return F.arrow_udf(batch, "bigint")(mask["data"])


def share_inside(points: Column, mask: Column) -> Column:
    """Share of the points within the image that lie on the mask: the join of points with a mask."""
    return _each(lambda p, m: dense.share_inside(points_of(p), mask_of(m)), "double", points, mask)


def mask_box(mask: Column) -> Column:
    """(x1, y1, x2, y2) around the set pixels; null without any."""
    return _each(lambda m: None if (box := dense.mask_box(mask_of(m))) is None else list(box), "array<int>", mask)


def restored(mask: Column, height: int, width: int, crop: Column, scale: Column) -> Column:
    """A mask of the processed crop in pixels of the original image of the given size."""
    return _each(lambda m, c, s: struct_of(dense.restored_mask(mask_of(m), (height, width), tuple(c), tuple(s))), MASK, mask, crop, scale)


def united(df: DataFrame, by: list[str], mask: str = "mask") -> DataFrame:
    """(by, mask): the masks of a frame's arms in one. A frame has as many masks as the robot has arms."""
    union = _each(lambda masks: struct_of(dense.united_masks([mask_of(m) for m in masks])), MASK, F.col("masks__"))
    return df.where(F.col(mask).isNotNull()).groupBy(*by).agg(F.collect_list(mask).alias("masks__")).select(*by, union.alias(mask))


def farthest_points(points: Column, k: int, dims: int = 2) -> Column:
    """Indices of k points that lie far from each other."""
    return _each(lambda p: dense.farthest_points(points_of(p, dims), k).tolist(), "array<int>", points)


def mask_points(mask: Column, k: int) -> Column:
    """k points on a mask, x and y in turn: up to half on its boundary, the rest spread over it."""
    return _each(lambda m: dense.mask_points(mask_of(m), k).astype(float).reshape(-1).tolist(), "array<double>", mask)


def grid_points(box: Column, n: int) -> Column:
    """An n by n grid inside a box, x and y in turn."""
    return _each(lambda b: dense.grid_points(tuple(b), n).astype(float).reshape(-1).tolist(), "array<double>", box)


def tracked_box(box: Column, before: Column, after: Column, seen: Column, height: int, width: int) -> Column:
    """The box moved as its points moved, and by which way; a null box where it can't be told."""

    def moved(b, p, q, s) -> dict:
        found, way = dense.tracked_box(np.asarray(b, float), points_of(p), points_of(q), np.asarray(s, bool), (height, width))
        return {"box": found, "way": way}

    return _each(moved, "struct<box:array<double>,way:string>", box, before, after, seen)


def oriented_extents(points: Column, percentile: float = 80.0, dims: int = 3) -> Column:
    """Half extents along the principal axes of a cloud."""
    return _each(lambda p: dense.oriented_extents(points_of(p, dims), percentile).tolist(), "array<double>", points)


def without_outliers(points: Column, neighbours: int = 20, deviations: float = 1.0, dims: int = 3) -> Column:
    """A cloud without points that lie far from their neighbours."""

    def kept(p: list[float]) -> list[float]:
        cloud = points_of(p, dims)
        return cloud[dense.inliers(cloud, neighbours, deviations)].reshape(-1).tolist()

    return _each(kept, "array<double>", points)


def grid_overlap(gripper: Column, candidate: Column, boxes: Column, size: int = 96, radius: int = 2, padding: float = 4.0) -> Column:
    """Share of a candidate's points where the gripper's points lie, on a grid over both; boxes: flat lists of four."""
    return _each(lambda g, c, b: dense.grid_overlap(points_of(g), points_of(c), [tuple(x) for x in np.asarray(b, float).reshape(-1, 4)], size, radius, padding), "double", gripper, candidate, boxes)


def closure_signals(frames: DataFrame, by: str, order: str, tips: str, wrist: str, seen: str) -> DataFrame:
    """(by, order, signals...) of every frame: how a hand is closed, from its fingertips (15 numbers, thumb first)
    and its wrist (3 numbers), in units of the hand's span over the trajectory. One trajectory is one group."""
    names = ("thumb_index", "thumb_min", "thumb_mean", "curl", "opposition", "combo")

    def signals(rows: list[dict]) -> list[dict]:
        found = dense.closure_signals(
            np.array([r["tips"] for r in rows], float).reshape(-1, 5, 3), np.array([r["wrist"] for r in rows], float), np.array([r["seen"] for r in rows], bool)
        )
        return [{"o": r["o"]} | {n: None if np.isnan(found[n][k]) else float(found[n][k]) for n in names} for k, r in enumerate(rows)]

    item = F.struct(F.col(order).cast("bigint").alias("o"), F.col(tips).alias("tips"), F.col(wrist).alias("wrist"), F.col(seen).alias("seen"))
    grouped = frames.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    found = _each(signals, f"array<struct<o:bigint,{','.join(f'{n}:double' for n in names)}>>", F.col("items"))
    return grouped.select(by, F.explode(found).alias("s")).select(by, F.col("s.o").alias(order), *(f"s.{n}" for n in names))
