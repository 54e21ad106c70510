"""Gripper phases, hand phases and grouping of steps: what needs state along a trajectory.

The phase detector works on runs of levels, not on frames: a frame is closed, open or between, and
each change of phase is the first run that is long enough. One trajectory is one group; its frames
are bounded by the length of a demonstration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The closing level, and the shares and bounds of the durations.
CLOSED_LEVEL = 0.6
BUDGET_SHARE = 0.07
FLAT_RANGE, IDLE_RANGE, IDLE_LEVEL = 0.05, 0.1, 0.9


@dataclass
class Levels:
    """Runs of closed and of open frames of a signal in units of its range."""

    n: int
    closed: list[tuple[int, int]]
    opened: list[tuple[int, int]]

    @classmethod
    def of(cls, unit: np.ndarray, enter: float, leave: float) -> Levels:
        return cls(len(unit), _runs(unit < enter), _runs(unit >= leave))

    def first(self, runs: list[tuple[int, int]], begin: int, need: int) -> int | None:
        """Where the first stretch of `need` frames starts, of frames from `begin` on."""
        return next((max(a, begin) for a, b in runs if b - max(a, begin) >= max(need, 1)), None)

    def next_closed(self, begin: int) -> int:
        return next((max(a, begin) for a, b in self.closed if b > begin), self.n)

    def closed_at_end(self, begin: int) -> int:
        """Closed frames up to the end, of frames from `begin` on."""
        if self.closed and self.closed[-1][1] == self.n:
            return self.n - max(self.closed[-1][0], min(begin, self.n))
        return 0


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _grips(levels: Levels, need: int, rest: int, judge: Callable[[int, int], bool]) -> Iterator[tuple]:
    """Events along the signal: ('closed', mark, start) and ('opened', start, end, valid) and
    ('rested', start, end), then ('end', state, mark, seen), where `seen` is the first frame that
    the state has looked at. A grip that is not valid is followed by no rest."""
    mark = seen = 0
    while True:
        start = levels.first(levels.closed, seen, need)
        if start is None:
            yield "end", "grasp", mark, seen
            return
        yield "closed", mark, start
        mark, seen = start, start + max(need, 1)
        end = levels.first(levels.opened, seen, need)
        if end is None:
            yield "end", "interact", mark, seen
            return
        valid = judge(mark, end)
        yield "opened", mark, end, valid
        mark, seen = end, end + max(need, 1)
        if valid:
            stop = min(max(seen, mark + rest), levels.next_closed(seen))
            if stop >= levels.n:
                yield "end", "release", mark, seen
                return
            yield "rested", mark, stop
            mark, seen = stop, stop + 1


@dataclass(frozen=True)
class Calibration:
    """What a whole signal says about itself: its range, the frames that a change of phase takes, those from which a grip
    counts. A flat signal is one interaction."""

    low: float = 0.0
    high: float = 1.0
    shortest: int = 7
    valid_from: float = 4.0
    flat: bool = False


def calibrated(signal: np.ndarray, budget: float | None = None, hysteresis: float = 0.1, shortest: int = 7) -> Calibration:
    """The first pass over a signal that is not empty: grips, found with a shorter wait, give the bounds of the second."""
    n, low, high = len(signal), float(signal.min()), float(signal.max())
    if high - low < FLAT_RANGE or (high - low < IDLE_RANGE and low > IDLE_LEVEL):
        return Calibration(low, high, flat=True)
    levels = Levels.of((signal - low) / (high - low + 1e-8), CLOSED_LEVEL - hysteresis, CLOSED_LEVEL + hysteresis)
    shortest = min(shortest, int(0.2 * n))

    grips = []
    for event in _grips(levels, min(5, int(0.05 * n)), shortest // 2, lambda a, b: True):
        if event[0] == "opened":
            grips.append(event[2] - event[1])
        elif event[0] == "end" and event[1] == "interact":
            grips.append(n - event[2])
        elif event[0] == "end" and event[1] == "grasp":
            tail = levels.closed_at_end(event[3])
            grips += [tail] if tail and tail >= shortest // 2 else []
    valid_from = _least_valid(grips, n, BUDGET_SHARE * n if budget is None else budget)
    return Calibration(low, high, min([shortest, *grips]), valid_from)


def gripper_phases(signal: np.ndarray, budget: float | None = None, hysteresis: float = 0.1, shortest: int = 7) -> list[tuple[int, int, str]]:
    """(first, last, phase) of a gripper signal, 0 closed and 1 open: grasp, interact, release, and
    grasp_failure for grips much shorter than the others."""
    signal = np.asarray(signal, float)
    if not len(signal):
        return []
    c = calibrated(signal, budget, hysteresis, shortest)
    if c.flat:
        return [(0, len(signal) - 1, "interact")]
    return _labelled(Levels.of((signal - c.low) / (c.high - c.low + 1e-8), CLOSED_LEVEL - hysteresis, CLOSED_LEVEL + hysteresis), c.shortest, c.valid_from)


def _least_valid(grips: list[int], n: int, budget: float) -> float:
    """Frames from which a grip counts: half of its share of the budget, or 0.4 of the median grip."""
    if len(grips) == 1:
        return grips[0] - 1
    attempts = max(1, len(grips))
    least = max(4, 0.5 * budget / attempts, 0.4 * float(np.median(grips)) if grips else 0)
    return min(least, 0.3 * n / attempts)


def _labelled(levels: Levels, shortest: int, valid_from: float) -> list[tuple[int, int, str]]:
    n, out = levels.n, []

    def add(first: int, last: int, phase: str) -> None:
        if last >= first:
            out.append((first, last, phase))

    for event in _grips(levels, shortest, shortest // 2, lambda a, b: b - a >= valid_from):
        match event:
            case ("closed", mark, start):
                mark -= _borrowed(out, start - mark, shortest, valid_from)
                add(mark, start - 1, "grasp")
            case ("opened", start, end, valid):
                add(start, end - 1, "interact" if valid else "grasp_failure")
            case ("rested", start, end):
                add(start, end - 1, "release")
            case ("end", "interact", mark, _):
                if n - mark >= valid_from:
                    out.append((mark, n - 1, "interact"))
            case ("end", "grasp", mark, seen):
                tail = levels.closed_at_end(seen)
                if tail and tail >= shortest // 2:
                    add(mark, n - tail - 1, "grasp")
                    out.append((n - tail, n - 1, "interact"))
            case ("end", "release", mark, _):
                add(mark, n - 1, "release")
    if not out:
        return [(0, n - 1, "interact")]
    if len(out) > 1 and out[-1][2] == "grasp" and out[-2][2] == "release":
        out.pop()
    if out[-1][2] == "release":
        out[-1] = (out[-1][0], n - 1, "release")
    return out


def _borrowed(out: list[tuple[int, int, str]], length: int, shortest: int, valid_from: float) -> int:
    """Frames that a grasp too short takes from the release before it, which it shortens."""
    if length >= valid_from or not out or out[-1][2] != "release":
        return 0
    first, last, phase = out[-1]
    spare = min(last - first + 1 - max(1, shortest // 2), last - first)
    taken = int(min(valid_from - length, max(0, spare)))
    out[-1] = (first, last - taken, phase)
    return taken


def _per_trajectory(df: DataFrame, by: str, item: Column, function: Callable[[list], list], result: str) -> DataFrame:
    """Applies a function to each trajectory's ordered items and explodes what it returns. Trajectories
    go to Python as arrays, many in a batch, so short ones cost no call of their own."""

    @F.pandas_udf(f"array<struct<{result}>>")
    def apply(column: pd.Series) -> pd.Series:
        return column.map(function)

    grouped = df.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select(by, F.explode(apply("items")).alias("r")).select(by, "r.*")


def detect_phases(frames: DataFrame, by: str, order: str, signal: str, hysteresis: float = 0.1) -> DataFrame:
    """(by, start_frame, end_frame, phase) of every trajectory; ends inclusive, frames counted from 0."""

    def detect(items: list) -> list[dict]:
        found = gripper_phases(np.array([i["v"] for i in items], float), hysteresis=hysteresis)
        return [{"start_frame": a, "end_frame": b, "phase": p} for a, b, p in found]

    item = F.struct(F.col(order).alias("o"), F.col(signal).cast("double").alias("v"))
    return _per_trajectory(frames, by, item, detect, "start_frame:bigint,end_frame:bigint,phase:string")


CALIBRATION = "low:double,high:double,shortest:bigint,valid_from:double,flat:boolean"


def calibrations(frames: DataFrame, by: str, order: str, signal: str, hysteresis: float = 0.1) -> DataFrame:
    """(by, low, high, shortest, valid_from, flat) of every trajectory of a table: what a live detector is told."""

    def told(items: list) -> list[dict]:
        c = calibrated(np.array([i["v"] for i in items], float), hysteresis=hysteresis)
        return [{"low": c.low, "high": c.high, "shortest": c.shortest, "valid_from": float(c.valid_from), "flat": c.flat}]

    return _per_trajectory(frames, by, F.struct(F.col(order).alias("o"), F.col(signal).cast("double").alias("v")), told, CALIBRATION)


# ---- grouping of steps -----------------------------------------------------------------------

# Skills that begin and that end an interaction.
START_SKILLS = frozenset({
    "Pick", "Grasp", "TakeOver", "Catch", "Open", "OpenJar", "OpenBox", "Uncap", "Pull", "Unzip", "Unscrew", "Suction", "HeavyObjLift", "Scan",
    "Point",
})
TERMINAL_SKILLS = frozenset({
    "Place", "Release", "Drop", "Handover", "HandOut", "Close", "CloseJar", "CloseBox", "Plug", "Stamp", "Throw", "Wipe", "Brush", "Paint", "Mop",
    "Sweep", "Clap", "Wave", "PressButton", "Press", "Lower",
})
START_WORDS = ("grasp", "pick up", "grab", "retrieve", "take ")
TERMINAL_WORDS = ("place", "put ", "store", "release", "drop", "insert", "return", "press", "pass ")


def arm_of(label: str) -> str | None:
    low = label.lower()
    return next((side for side in ("left", "right") if side in low), None)


@dataclass
class SkillRule:
    """Steps with skills: a group keeps one known arm; its first skill decides whether it has ended."""

    arm: str | None = None
    ended: bool = False

    def begin(self, step: dict) -> None:
        self.arm, self.ended = arm_of(step["label"]), step["skill"] in TERMINAL_SKILLS

    def joins(self, before: dict, step: dict) -> bool:
        arm = arm_of(step["label"])
        if step["start_frame"] == before["end_frame"]:
            arm = arm or self.arm
            self.arm = self.arm or arm
        return not self.ended and self.arm is not None and self.arm == arm and step["skill"] not in START_SKILLS

    def join(self, step: dict) -> None:
        pass


@dataclass
class LabelRule:
    """Steps with labels alone: arm and object carry on, unknown ones fit all; the last label decides
    whether the group has ended."""

    noun: Callable[[str], str | None] = field(default=lambda label: None)
    arm: str | None = None
    held: str | None = None
    ended: bool = False

    def begin(self, step: dict) -> None:
        self.arm, self.held = arm_of(step["label"]), self.noun(step["label"])
        self.ended = _has(step["label"], TERMINAL_WORDS)

    def joins(self, before: dict, step: dict) -> bool:
        arm, held = arm_of(step["label"]), self.noun(step["label"])
        if step["start_frame"] == before["end_frame"]:
            arm = arm or self.arm
            self.arm = self.arm or arm
        differs = lambda a, b: a is not None and b is not None and a != b
        return not (self.ended or _has(step["label"], START_WORDS) or differs(self.arm, arm) or differs(self.held, held))

    def join(self, step: dict) -> None:
        self.arm = arm_of(step["label"]) or self.arm
        self.held = self.noun(step["label"]) or self.held
        self.ended = _has(step["label"], TERMINAL_WORDS)


def _has(label: str, words: tuple[str, ...]) -> bool:
    return any(w in label.lower() for w in words)


def grouped_steps(steps: list[dict], rule) -> list[int]:
    """The group number of each step, in order."""
    out: list[int] = []
    for k, step in enumerate(steps):
        if k and rule.joins(steps[k - 1], step):
            rule.join(step)
            out.append(out[-1])
        else:
            rule.begin(step)
            out.append(out[-1] + 1 if out else 0)
    return out


def group_steps(steps: DataFrame, by: str, rule: Callable[[], object] = SkillRule) -> DataFrame:
    """Subtasks of trajectories: steps (by, start_frame, end_frame, label, skill) in groups, each with
    its window, joined instruction, place and the number of groups."""

    def group(items: list) -> list[dict]:
        steps = list(items)
        numbers = grouped_steps(steps, rule())
        out = []
        for g in range(numbers[-1] + 1):
            own = [s for s, n in zip(steps, numbers, strict=True) if n == g]
            text = " then ".join(s["label"].lower().rstrip(".") for s in own)
            out.append({"subtask": g, "start_frame": own[0]["start_frame"], "end_frame": own[-1]["end_frame"], "instruction": text, "n_steps": len(own), "longtask_len": numbers[-1] + 1})
        return out

    item = F.struct("start_frame", "end_frame", "label", "skill")
    return _per_trajectory(steps, by, item, group, "subtask:bigint,start_frame:bigint,end_frame:bigint,instruction:string,n_steps:bigint,longtask_len:bigint")


# ---- merging of episodes ---------------------------------------------------------------------

MERGING = frozenset({"same_instance_retry", "same_instance_continuation"})


def same_object(a: dict, b: dict) -> bool:
    """Whether two entries can mean one object: known instances agree, and one name's words are among
    the other's."""
    import re

    def known(entry: dict) -> str | None:
        value = str(entry.get("object_instance") or "").strip().lower()
        return value if value not in ("", "unknown", "none", "null") else None

    def words(entry: dict) -> set[str]:
        found = set(re.findall(r"[a-z0-9]+", str(entry.get("object") or "").lower())) - {"a", "an", "the"}
        return {re.sub(r"^(..+[^s])s$", r"\1", w) for w in found}

    if known(a) and known(b) and known(a) != known(b):
        return False
    x, y = words(a), words(b)
    return bool(x and y) and (x <= y or y <= x)


def merged_entries(entries: list[dict]) -> list[dict]:
    """Entries of consecutive episodes; one that retries or continues the object of the entry kept
    before it adds its phases there, one that claims to but cannot is marked uncertain."""
    out: list[dict] = []
    for entry in entries:
        claims = entry.get("instance_relation_to_previous") in MERGING
        if out and claims and same_object(out[-1], entry):
            kept = out[-1]
            kept["grasp_phases"] = [*kept["grasp_phases"], *entry["grasp_phases"]]
            kept["merged_episode_relations"] = [*kept.get("merged_episode_relations", []), entry["instance_relation_to_previous"]]
        else:
            out.append(dict(entry, instance_relation_to_previous="uncertain") if out and claims else dict(entry))
    return out


def merge_entries(entries: DataFrame, by: str, order: str) -> DataFrame:
    """(by, entry, object, object_instance, relation, grasp_phases): the entries of each trajectory's episodes
    (object, object_instance, relation, grasp_phases) with those that continue an object joined to it."""
    kind = entries.schema["grasp_phases"].dataType.elementType.simpleString()

    def merge(items: list) -> list[dict]:
        rows = [dict(i, instance_relation_to_previous=i["relation"], grasp_phases=list(i["grasp_phases"])) for i in items]
        return [
            {"entry": k, "object": e["object"], "object_instance": e["object_instance"], "relation": e["instance_relation_to_previous"], "grasp_phases": e["grasp_phases"]}
            for k, e in enumerate(merged_entries(rows))
        ]

    item = F.struct(F.col(order).alias("o"), "object", "object_instance", "relation", "grasp_phases")
    return _per_trajectory(entries, by, item, merge, f"entry:bigint,object:string,object_instance:string,relation:string,grasp_phases:array<{kind}>")
