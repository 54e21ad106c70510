"""Ordered operators over frames: runs, latches, gaps, splits, offsets, interpolation.

All take the columns of the partition and of the order; every window has a total order if the order
columns are unique in a partition. One shuffle, on the partition columns, serves a whole chain of
these operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def islands(df: DataFrame, by: list[str], order: str, key: Column, name: str = "island") -> DataFrame:
    """Numbers the stretches of equal consecutive keys; null is a key of its own."""
    w = _window(by, order)
    changed = ~key.eqNullSafe(F.lag(key).over(w)) & (F.row_number().over(w) > 1)
    flag = f"{name}__changed"
    return df.withColumn(flag, changed.cast("int")).withColumn(name, F.sum(flag).over(w)).drop(flag)


def runs(df: DataFrame, by: list[str], order: str, key: str) -> DataFrame:
    """(by, key, start_frame, end_frame, n): stretches of an equal key. The end is exclusive: where
    the next run starts, or one behind the last frame."""
    w = _window(by, "start_frame")
    grouped = (
        islands(df, by, order, F.col(key))
        .groupBy(*by, "island")
        .agg(F.first(key).alias(key), F.min(order).alias("start_frame"), F.max(order).alias("last"), F.count("*").alias("n"))
    )
    return grouped.select(*by, key, "start_frame", F.coalesce(F.lead("start_frame").over(w), F.col("last") + 1).alias("end_frame"), "n")


def true_runs(df: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """Half-open stretches in which the flag holds."""
    return runs(df, by, order, flag).where(F.col(flag)).drop(flag)


def close_gaps(df: DataFrame, by: list[str], order: str, flag: str, shortest: int) -> DataFrame:
    """Fills stretches of false below `shortest` frames, then drops stretches of true below it."""
    out = df
    for value in (False, True):
        out = islands(out, by, order, F.col(flag))
        length = F.count("*").over(Window.partitionBy(*by, "island"))
        short = (F.col(flag) == value) & (length < shortest)
        out = out.withColumn(flag, F.when(short, F.lit(not value)).otherwise(F.col(flag))).drop("island")
    return out


def latch(df: DataFrame, by: list[str], order: str, signal: str, enter: float, leave: float, name: str = "state") -> DataFrame:
    """Set and reset: 'interact' from below `enter` until `leave` is reached, 'grasp' before and else."""
    event = F.when(F.col(signal) < enter, "interact").when(F.col(signal) >= leave, "grasp")
    seen = F.last(event, ignorenulls=True).over(_window(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.coalesce(seen, F.lit("grasp")))


def scaled(df: DataFrame, by: list[str], signal: str, name: str = "scaled") -> DataFrame:
    """Signal in units of its range over the partition; null where the range is below 1e-8."""
    w = Window.partitionBy(*by)
    low, high = F.min(signal).over(w), F.max(signal).over(w)
    return df.withColumn(name, F.when(high - low >= 1e-8, (F.col(signal) - low) / (high - low)))


def action_spans(df: DataFrame, by: list[str], action: str, frame: str, labels: list[str]) -> DataFrame:
    """First frame, last frame + 1 and the first frame's labels of every action numbered 0 or more."""
    first = [F.min_by(c, frame).alias(c) for c in labels]
    return df.where(F.col(action) >= 0).groupBy(*by, action).agg(F.min(frame).alias("start_frame"), (F.max(frame) + 1).alias("end_frame"), *first)


def phase_offset(phases: DataFrame, by: list[str], ratio: float = 0.3) -> DataFrame:
    """Each phase (end inclusive) borrows the given share of the next one's duration."""
    w = _window(by, "start_frame")
    start, end = F.lead("start_frame").over(w), F.lead("end_frame").over(w)
    longer = F.least(F.col("end_frame") + F.floor((end - start) * ratio), end)
    return phases.withColumn("end_frame", F.coalesce(longer, F.col("end_frame")))


def sequence_key(phases: DataFrame, by: list[str], phase: str = "phase") -> DataFrame:
    """The names of a partition's phases in order, joined by underscores."""
    listed = F.array_sort(F.collect_list(F.struct("start_frame", phase)))
    return phases.groupBy(*by).agg(F.array_join(F.transform(listed, lambda p: p[phase]), "_").alias("phase_key"))


def episodes(phases: DataFrame, by: list[str], phase: str = "phase", closing: str = "release") -> DataFrame:
    """Numbers episodes: a new one begins behind every closing phase."""
    w = _window(by, "start_frame")
    closed = phases.withColumn("closed__", F.coalesce((F.lag(phase).over(w) == closing).cast("int"), F.lit(0)))
    return closed.withColumn("episode", F.sum("closed__").over(w)).drop("closed__")


def interpolated(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Fills nulls on the straight line between known neighbours, constant beyond the outer ones."""
    w = _window(by, order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    v0, t0 = F.last(value, ignorenulls=True).over(before), F.last(at, ignorenulls=True).over(before)
    v1, t1 = F.first(value, ignorenulls=True).over(after), F.first(at, ignorenulls=True).over(after)
    line = F.when(t0 == t1, v0).otherwise(v0 + (v1 - v0) * (F.col(order) - t0) / (t1 - t0))
    return df.withColumn(value, F.coalesce(line, v0, v1))


def ranked_steps(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds each step's place in its long task, from 0, and the task's number of steps."""
    whole = Window.partitionBy(*by)
    return df.withColumns({"longtask_index": (F.row_number().over(_window(by, order)) - 1).cast("bigint"), "longtask_len": F.count("*").over(whole)})


def decimated(df: DataFrame, by: list[str], order: str, stride: int) -> DataFrame:
    """Every stride-th frame of a partition, from the first."""
    place = F.row_number().over(_window(by, order)) - 1
    return df.withColumn("place__", place).where(F.pmod("place__", F.lit(stride)) == 0).drop("place__")


def previous_known(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """The last value that is not null, strictly before the row."""
    w = _window(by, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def difference(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Change since the frame before; zero at the first."""
    return df.withColumn(name, F.coalesce(F.col(value) - F.lag(value).over(_window(by, order)), F.lit(0.0)))


def rolling_mean(df: DataFrame, by: list[str], order: str, value: str, name: str, width: int = 3) -> DataFrame:
    """Centred mean in which frames beyond the ends count as zero; unchanged below `width` frames."""
    half = width // 2
    around = F.sum(value).over(_window(by, order).rowsBetween(-half, half)) / width
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn(name, F.when(n >= width, around).otherwise(F.col(value)))


def edge_padded_mean(df: DataFrame, by: list[str], order: str, value: str, name: str, width: int) -> DataFrame:
    """Centred mean in which the end values repeat beyond the ends. The window is odd and no longer
    than the partition."""
    w = Window.partitionBy(*by)
    ordered = _window(by, order)
    n, i = F.count("*").over(w), F.row_number().over(ordered)
    reach = F.floor((F.least(n, F.lit(width)) - 1) / 2)
    tmp = df.withColumns({"n__": n, "i__": i, "h__": reach, "first__": F.first(value).over(ordered), "last__": F.last(value).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    sums = None
    half = (width - 1) // 2
    for k in range(-half, half + 1):
        near = F.lag(value, -k).over(ordered) if k else F.col(value)
        part = F.when(F.abs(F.lit(k)) > F.col("h__"), F.lit(0.0)).when(F.col("i__") + k < 1, F.col("first__")).when(F.col("i__") + k > F.col("n__"), F.col("last__")).otherwise(near)
        sums = part if sums is None else sums + part
    return tmp.withColumn(name, sums / (2 * F.col("h__") + 1)).drop("n__", "i__", "h__", "first__", "last__")


def split_on_jump(df: DataFrame, by: list[str], order: str, box: str, least_iou: float = 0.1, name: str = "piece") -> DataFrame:
    """Numbers pieces: a new one begins where a box overlaps the last known one by less than `least_iou`."""
    from .boxes import iou_of

    w = _window(by, order)
    before = F.last(box, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    jumped = F.col(box).isNotNull() & before.isNotNull() & (iou_of(before, F.col(box)) < least_iou)
    out = df.withColumn("jumped__", F.coalesce(jumped, F.lit(False)).cast("int"))
    return out.withColumn(name, F.sum("jumped__").over(w)).drop("jumped__")
