"""Gripper phases of live trajectories, emitted as they close.

The second pass of the detector needs to look ahead by no more than a change of phase takes, and to look back by two phases:
a release gives frames to a grasp that is too short, and reaches to the end if only a grasp that comes to nothing
follows. So a trajectory's state is where its open phase began, two streaks and at most two phases, however
long it is. What the first pass says of a whole signal (its range, the bounds of phases) is told beforehand:
from the trajectory's index entry, or by one Calibration for a robot.

Frames are taken in their order. One that comes early waits, as list state, for those before it; when the watermark has passed it, what
is missing counts as lost. A trajectory ends with the frame that is marked, or by a timer when it has been
idle; for as long again, frames that are late are known as such and dropped, then its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.phases import CLOSED_LEVEL, Calibration, _borrowed

Phase = tuple[int, int, str]


@dataclass
class Machine:
    """The detector, frame by frame. `push` and `close` give the phases that can't change any more.

    mark: where the open phase began. idle_from: in a release, the frame from which it may end. closed, opened: frames of that
    level in a row, of those that the open phase has looked at. held: phases that may still change."""

    low: float = 0.0
    high: float = 1.0
    shortest: int = 7
    valid_from: float = 4.0
    flat: bool = False
    hysteresis: float = 0.1
    n: int = 0
    phase: str = "grasp"
    mark: int = 0
    idle_from: int = 0
    closed: int = 0
    opened: int = 0
    emitted: int = 0
    held: tuple[Phase, ...] = ()

    def _add(self, first: int, last: int, phase: str) -> list[Phase]:
        if last < first:
            return []
        self.held = (*self.held, (first, last, phase))
        done, self.held = list(self.held[:-2]), self.held[-2:]
        self.emitted += len(done)
        return done

    def _turn(self, phase: str, mark: int) -> None:
        self.phase, self.mark, self.closed, self.opened = phase, mark, 0, 0

    def push(self, value: float) -> list[Phase]:
        at, need = self.n, max(self.shortest, 1)
        self.n += 1
        if self.flat:
            return []
        unit = (value - self.low) / (self.high - self.low + 1e-8)
        is_closed, is_opened = unit < CLOSED_LEVEL - self.hysteresis, unit >= CLOSED_LEVEL + self.hysteresis
        if self.phase == "release":
            if at < self.idle_from and not is_closed:
                return []
            done = self._add(self.mark, at - 1, "release")
            self._turn("grasp", at)
            return done
        self.closed = self.closed + 1 if is_closed else 0
        self.opened = self.opened + 1 if is_opened else 0
        if self.phase == "grasp" and self.closed >= need:
            start = at - need + 1
            held = list(self.held)
            taken = _borrowed(held, start - self.mark, self.shortest, self.valid_from)
            self.held = tuple(held)
            done = self._add(self.mark - taken, start - 1, "grasp")
            self._turn("interact", start)
            return done
        if self.phase == "interact" and self.opened >= need:
            end = at - need + 1
            valid = end - self.mark >= self.valid_from
            done = self._add(self.mark, end - 1, "interact" if valid else "grasp_failure")
            self._turn("release" if valid else "grasp", end)
            self.idle_from = max(at + 1, end + self.shortest // 2)
            return done
        return []

    def close(self) -> list[Phase]:
        """The trajectory has ended with the last frame that was pushed."""
        n, done = self.n, []
        if not n:
            return []
        if self.flat:
            return [(0, n - 1, "interact")]
        if self.phase == "interact" and n - self.mark >= self.valid_from:
            done += self._add(self.mark, n - 1, "interact")
        elif self.phase == "grasp" and self.closed and self.closed >= self.shortest // 2:
            done += self._add(self.mark, n - self.closed - 1, "grasp")
            done += self._add(n - self.closed, n - 1, "interact")
        elif self.phase == "release":
            done += self._add(self.mark, n - 1, "release")
        out = list(self.held)
        if len(out) > 1 and out[-1][2] == "grasp" and out[-2][2] == "release":
            out.pop()
        if out and out[-1][2] == "release":
            out[-1] = (out[-1][0], n - 1, "release")
        self.held = ()
        return done + out if self.emitted or out else [(0, n - 1, "interact")]


_MACHINE = (
    "low double, high double, shortest bigint, valid_from double, flat boolean, hysteresis double, n bigint, phase string, mark bigint, idle_from bigint, closed bigint, opened bigint, emitted bigint, "
    "firsts array<bigint>, lasts array<bigint>, phases array<string>, next bigint, seen bigint, ended boolean"
)


class LivePhases(StatefulProcessor):
    """Rows (place, time_ms, value, done, low, high, shortest, valid_from, flat); the last five are null where nothing was told."""

    def __init__(self, by: str, default: Calibration, hysteresis: float, idle_ms: int, first: int):
        self.by, self.default, self.hysteresis, self.idle_ms, self.first = by, default, hysteresis, idle_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", _MACHINE)
        self.waiting = handle.getListState("waiting", "place bigint, time_ms bigint, value double, done boolean")

    def close(self) -> None:
        pass

    def _load(self) -> tuple[Machine, int, int, bool]:
        *fields, firsts, lasts, phases, after, seen, ended = self.machine.get()
        return Machine(*fields, tuple(zip(map(int, firsts), map(int, lasts), phases, strict=True))), int(after), int(seen), bool(ended)

    def _save(self, m: Machine, after: int, seen: int, ended: bool) -> None:
        *fields, held = astuple(m)
        columns = ([h[k] for h in held] for k in range(3))
        self.machine.update((*fields, *columns, after, seen, ended))

    def _advance(self, m: Machine, after: int, early: list, watermark: int) -> tuple[list[Phase], int, list, bool]:
        """Takes what is next in order, and past what the watermark has given up."""
        out: list[Phase] = []
        early.sort()
        at = 0
        while at < len(early):
            place, time, value, done = early[at]
            if place > after and time > watermark:
                break
            at += 1
            if place < after:
                continue  # a repeated frame, or one that was given up
            out += m.push(value)
            after = place + 1
            if done:
                return out + m.close(), after, [], True
        return out, after, early[at:], False

    def _frame(self, key, phases: list[Phase]) -> Iterator[pd.DataFrame]:
        if phases:
            out = pd.DataFrame(phases, columns=["start_frame", "end_frame", "phase"])
            out.insert(0, self.by, key[0])
            yield out

    def _settle(self, key, m: Machine, after: int, seen: int, early: list, watermark: int) -> Iterator[pd.DataFrame]:
        had = self.waiting.exists()
        phases, after, early, ended = self._advance(m, after, early, watermark)
        if early:
            self.waiting.put(early)
            self.handle.registerTimer(min(t for _, t, _, _ in early))
        elif had:
            self.waiting.clear()
        self.handle.registerTimer(seen + self.idle_ms)
        self._save(m if not ended else Machine(), after, seen, ended)
        yield from self._frame(key, phases)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.machine.exists()
        m, after, seen, ended = self._load() if known else (None, self.first, 0, False)
        early = [(int(p), int(t), float(v), bool(d)) for p, t, v, d in self.waiting.get()] if known and self.waiting.exists() else []
        for pdf in rows:
            if m is None:
                told = pdf[["low", "high", "shortest", "valid_from", "flat"]].iloc[0]
                c = self.default if told.isna().any() else Calibration(float(told["low"]), float(told["high"]), int(told["shortest"]), float(told["valid_from"]), bool(told["flat"]))
                m = Machine(c.low, c.high, c.shortest, c.valid_from, c.flat, self.hysteresis)
            if not ended:
                seen = max(seen, int(pdf["time_ms"].max()))
                early += zip(pdf["place"].tolist(), pdf["time_ms"].tolist(), pdf["value"].tolist(), pdf["done"].tolist(), strict=True)
        if m is not None and not ended:
            yield from self._settle(key, m, after, seen, early, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.machine.exists():
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        m, after, seen, ended = self._load()
        if watermark < seen + self.idle_ms:
            if not ended:
                early = [(int(p), int(t), float(v), bool(d)) for p, t, v, d in self.waiting.get()] if self.waiting.exists() else []
                yield from self._settle(key, m, after, seen, early, watermark)
            return
        if ended:
            self.machine.clear()
            return
        early = [(int(p), int(t), float(v), bool(d)) for p, t, v, d in self.waiting.get()] if self.waiting.exists() else []
        phases, after, _, closed = self._advance(m, after, early, watermark)
        phases += [] if closed else m.close()
        self.waiting.clear()
        # Late frames are known as such for as long again.
        self._save(Machine(), after, watermark, True)
        self.handle.registerTimer(watermark + self.idle_ms)
        yield from self._frame(key, phases)


def phases_as_they_close(
    frames: DataFrame, by: str, order: str, time: str, signal: str, done: str, told: DataFrame | None = None, default: Calibration = Calibration(), hysteresis: float = 0.1, late: str = "1 minute", idle: str = "10 minutes", first: int = 0
) -> DataFrame:
    """(by, start_frame, end_frame, phase) of a stream of frames, each when no later frame can change it; ends inclusive, frames counted
    from 0 as they are taken. told: calibrations by trajectory (operators.phases.calibrations), a table; `default` for trajectories that it lacks.
    late: how long a frame may come after later ones. idle: after how long without frames a trajectory has ended. first: the
    order of a trajectory's first frame. Values that are null don't move the gripper: they are no frames.

    Needs the RocksDB state store (`rocksdb_state`). State holds open phases and frames that wait, nothing of closed ones."""
    spark = frames.sparkSession
    rows = frames.withWatermark(time, late).where(F.col(signal).isNotNull())
    if told is None:
        told = spark.createDataFrame([], f"{by} {frames.schema[by].dataType.simpleString()}, low double, high double, shortest bigint, valid_from double, flat boolean")
    told = told.select(by, "low", "high", "shortest", "valid_from", "flat")
    asked = rows.select(
        by, time, F.col(order).cast("bigint").alias("place"), F.unix_millis(F.col(time)).alias("time_ms"), F.col(signal).cast("double").alias("value"), F.coalesce(F.col(done), F.lit(False)).alias("done")
    ).join(told, by, "left")
    idle_ms = round(spark.range(1).select((F.expr(f"unix_millis(timestamp_millis(0) + interval {idle})")).alias("ms")).first()["ms"])
    kind = frames.schema[by].dataType.simpleString()
    return asked.groupBy(by).transformWithStateInPandas(
        LivePhases(by, default, hysteresis, idle_ms, first), f"{by} {kind}, start_frame bigint, end_frame bigint, phase string", "Append", "EventTime"
    )


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB, which timers and list state need."""
    key, name = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, name)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
