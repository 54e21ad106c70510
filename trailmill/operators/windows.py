"""Windows and keyframes of subtasks, storyboards, masks of phases on a track's timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linspace(n: Column, last: Column) -> Column:
    """n whole numbers spread evenly from 0 to `last`; as many as there are, if fewer."""
    count = F.greatest(n, F.lit(1))
    spread = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.when(count > 1, F.floor(i * last.cast("double") / (count - 1))).otherwise(0).cast("bigint"))
    return F.when(last < 0, F.expr("array(cast(null as bigint))")).otherwise(F.array_distinct(spread))


def within_budget(required: Column, optional: Column, cap: int) -> Column:
    """All required frames, and of the others as many as the cap leaves room for, evenly chosen; sorted."""
    needed = F.array_sort(F.array_distinct(required))
    others = F.array_sort(F.array_except(optional, required))
    room = F.greatest(F.lit(cap) - F.size(needed), F.lit(0))
    picked = F.when(F.size(others) <= room, others).when(room == 0, F.filter(others, lambda x: F.lit(False))).otherwise(
        F.transform(linspace(room, F.size(others) - 1), lambda i: F.element_at(others, (i + 1).cast("int")))
    )
    return F.array_sort(F.array_union(needed, picked))


def storyboard(phases: DataFrame, by: list[str]) -> DataFrame:
    """(by, episode, frame): the middle of each episode's first interaction, else of the episode."""
    interact = F.when(F.col("phase") == "interact", F.col("start_frame"))
    first = F.min_by(F.struct("start_frame", "end_frame"), interact)
    grouped = phases.groupBy(*by, "episode").agg(first.alias("i"), F.min("start_frame").alias("s"), F.max("end_frame").alias("e"))
    return grouped.select(*by, "episode", F.floor(F.coalesce(F.col("i.start_frame") + F.col("i.end_frame"), F.col("s") + F.col("e")) / 2).alias("frame"))


def parsing_mode(phases: DataFrame, by: list[str], closing: str = "release") -> DataFrame:
    """'semantic' for trajectories with more than one finished cycle, else 'text'."""
    return phases.groupBy(*by).agg(F.when(F.count_if(F.col("phase") == closing) > 1, "semantic").otherwise("text").alias("mode"))


def frame_masks(timeline: DataFrame, phases: DataFrame, by: list[str], n_frames: Column, n_original: Column) -> DataFrame:
    """(by, t, interacting, resting): frames of a timeline of n_frames that lie in an interaction, its
    ends scaled from n_original frames, and those that lie in none and not near the ends. Phases over
    95 percent of the trajectory are not looked at."""
    scale = n_frames / F.greatest(n_original, F.lit(1))
    spans = phases.where((F.col("phase") == "interact") & (F.col("end_frame") - F.col("start_frame") < 0.95 * n_original))
    spans = spans.select(*by, F.rint(F.col("start_frame") * scale).alias("s"), (F.rint(F.col("end_frame") * scale) + 1).alias("e"))
    inside = timeline.select(*by, "t").join(spans, by).where("t >= s and t < e").select(*by, "t").distinct().withColumn("interacting", F.lit(True))
    margin = F.least(F.lit(3), F.floor(n_frames / 10))
    out = timeline.select(*by, "t").join(inside, [*by, "t"], "left").withColumn("interacting", F.coalesce("interacting", F.lit(False)))
    return out.withColumn("resting", ~F.col("interacting") & (F.col("t") >= margin) & (F.col("t") < n_frames - margin))


def subtask_windows(subtasks: DataFrame, by: list[str], length: Column) -> DataFrame:
    """(by, subtask, start_frame, end_frame): subtasks with phases (array of struct(start_frame, end_frame,
    phase)) get their phases' span; one behind another starts three quarters on from that one's end to
    its own grasp's end, or a small pause behind it if it has one phase; the last ends with the trajectory."""
    own = F.col("phases")
    w = Window.partitionBy(*by).orderBy("subtask")
    end = F.when(F.size(own) > 0, F.element_at(own, -1)["end_frame"]).otherwise(length - 1)
    start = F.when(F.size(own) > 0, own[0]["start_frame"]).otherwise(F.lit(0))
    known_end = F.when(F.size(own) > 0, F.element_at(own, -1)["end_frame"])
    before = F.last(known_end, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = subtasks.withColumns({"s__": start, "e__": end, "b__": before, "last__": F.lead("subtask").over(w).isNull()})
    grasp = F.filter(own, lambda p: p["phase"] == "grasp")
    many = F.when(F.size(grasp) > 0, F.col("b__") + F.floor((grasp[0]["end_frame"] - F.col("b__")) * 3 / 4)).otherwise(F.col("s__"))
    pause = F.least(F.lit(15), F.floor((F.col("e__") - F.col("s__")) / 4))
    moved = F.when(F.col("b__").isNull() | (F.size(own) < 1), F.col("s__")).when(F.size(own) > 1, many).otherwise(F.col("b__") + pause)
    rows = rows.withColumns({"s__": moved, "e__": F.when(F.col("last__"), length - 1).otherwise(F.col("e__"))})
    first = F.greatest(F.lit(0), F.least(F.col("s__"), length - 1))
    rows = rows.withColumn("start_frame", first)
    return rows.withColumn("end_frame", F.greatest(F.col("start_frame") + 1, F.least(F.col("e__"), length - 1))).drop("s__", "e__", "b__", "last__")


def keyframes(phases: Column, start: Column, end: Column, n: Column) -> Column:
    """Keyframes of a window, from its start: start, detection frame (the middle to the first grasp's
    end, else the start), then the ends of the phases that meet the window, the last one frame early."""
    met = F.filter(phases, lambda p: (p["end_frame"] >= start) & (p["start_frame"] <= end))
    ends = F.concat(F.array(start), F.transform(met, lambda p: p["end_frame"]))
    early = F.concat(F.slice(ends, 1, F.size(ends) - 1), F.array(F.element_at(ends, -1) - 1))
    place = lambda x: F.greatest(F.lit(0), F.least(x - start, n - 1))
    grasp = F.filter(phases, lambda p: p["phase"] == "grasp")
    detect = F.when(F.size(grasp) > 0, F.floor((start + grasp[0]["end_frame"]) / 2)).otherwise(start)
    return F.array_insert(F.transform(early, place), 2, place(detect))


def close_to(a: Column, b: Column, absolute: float = 1e-3, relative: float = 1e-5) -> Column:
    """Whether two arrays of numbers are equal but for a tolerance."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= absolute + relative * F.abs(y)), lambda z: z)
