"""Sequence operators for trajectories of any length: a prefix scan in two levels.

A window over a trajectory gives one task all its frames. Here frames are dealt by block, a stretch of the order; each block has a summary
(last known value, changes of a key, first and last run), and the summaries of a trajectory, one row for each
block, are scanned in order. What a block needs of those around it comes back with one row a block, and
windows then run inside blocks. Frames are shuffled once; what meets in one task is a block of them, or the summaries.

The results are those of operators.sequences. Rows whose trajectory or order is null go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of the order that a block covers.
SIZE = 1 << 16
BLOCK = "block__"


class Blocks:
    """Frames dealt by trajectory and block. `rows` may gain and lose columns between steps."""

    def __init__(self, rows: DataFrame, by: list[str], order: str, size: int = SIZE):
        self.by, self.order = by, order
        known = F.lit(True)
        for c in (*by, order):
            known &= F.col(c).isNotNull()
        self.rows = rows.where(known).withColumn(BLOCK, F.floor(F.col(order) / size)).repartition(*by, BLOCK)
        self.inside = Window.partitionBy(*by, BLOCK)
        self.ordered = self.inside.orderBy(order)
        across = Window.partitionBy(*by)
        self.whole = across
        self.before = across.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        self.after = across.orderBy(BLOCK).rowsBetween(1, Window.unboundedFollowing)
        self.upto = across.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0)
        self.across = across.orderBy(BLOCK)

    def carry(self, summary: dict[str, Column], *scans: dict[str, Column]) -> None:
        """Adds to every row what the scans give its block. summary: aggregates of a block; scans: columns over the
        summaries of a trajectory (windows before, after, upto, across, whole), each step with those before it at hand."""
        out = self.rows.groupBy(*self.by, BLOCK).agg(*(c.alias(n) for n, c in summary.items()))
        for scan in scans:
            out = out.withColumns(scan)
        last = list(scans[-1])
        self.rows = self.rows.join(out.select(*self.by, BLOCK, *last), [*self.by, BLOCK])

    def result(self, *drop: str) -> DataFrame:
        return self.rows.drop(BLOCK, *drop)


def _when(value: Column, condition: Column) -> Column:
    return F.when(condition, value)


def previous_known(df: DataFrame, by: list[str], order: str, value: str, name: str, size: int = SIZE) -> DataFrame:
    """The last value that is not null, strictly before the row."""
    b = Blocks(df, by, order, size)
    b.carry({"last__": F.max_by(value, _when(F.col(order), F.col(value).isNotNull()))}, {"carried__": F.last("last__", ignorenulls=True).over(b.before)})
    here = F.last(value, ignorenulls=True).over(b.ordered.rowsBetween(Window.unboundedPreceding, -1))
    b.rows = b.rows.withColumn(name, F.coalesce(here, "carried__"))
    return b.result("carried__")


def interpolated(df: DataFrame, by: list[str], order: str, value: str, size: int = SIZE) -> DataFrame:
    """Fills nulls on the straight line between known neighbours, constant beyond the outer ones."""
    b = Blocks(df, by, order, size)
    at = _when(F.col(order), F.col(value).isNotNull())
    point = F.struct(F.col(value).alias("v"), F.col(order).alias("t"))
    known = _when(point, F.col(value).isNotNull())
    b.carry(
        {"first__": F.min_by(point, at), "last__": F.max_by(point, at), "any__": F.max(at)},
        {"b0__": F.last(_when(F.col("last__"), F.col("any__").isNotNull()), ignorenulls=True).over(b.before), "b1__": F.first(_when(F.col("first__"), F.col("any__").isNotNull()), ignorenulls=True).over(b.after)},
    )
    p0 = F.coalesce(F.last(known, ignorenulls=True).over(b.ordered.rowsBetween(Window.unboundedPreceding, 0)), "b0__")
    p1 = F.coalesce(F.first(known, ignorenulls=True).over(b.ordered.rowsBetween(0, Window.unboundedFollowing)), "b1__")
    b.rows = b.rows.withColumns({"p0__": p0, "p1__": p1})
    v0, t0, v1, t1 = F.col("p0__.v"), F.col("p0__.t"), F.col("p1__.v"), F.col("p1__.t")
    line = F.when(t0 == t1, v0).otherwise(v0 + (v1 - v0) * (F.col(order) - t0) / (t1 - t0))
    b.rows = b.rows.withColumn(value, F.coalesce(line, v0, v1))
    return b.result("b0__", "b1__", "p0__", "p1__")


def scaled(df: DataFrame, by: list[str], order: str, signal: str, name: str = "scaled", size: int = SIZE) -> DataFrame:
    """Signal in units of its range over the trajectory; null where the range is below 1e-8."""
    b = Blocks(df, by, order, size)
    b.carry({"l__": F.min(signal), "h__": F.max(signal)}, {"low__": F.min("l__").over(b.whole), "high__": F.max("h__").over(b.whole)})
    b.rows = b.rows.withColumn(name, F.when(F.col("high__") - F.col("low__") >= 1e-8, (F.col(signal) - F.col("low__")) / (F.col("high__") - F.col("low__"))))
    return b.result("low__", "high__")


def latch(df: DataFrame, by: list[str], order: str, signal: str, enter: float, leave: float, name: str = "state", size: int = SIZE) -> DataFrame:
    """Set and reset: 'interact' from below `enter` until `leave` is reached, 'grasp' before and else."""
    event = F.when(F.col(signal) < enter, "interact").when(F.col(signal) >= leave, "grasp")
    b = Blocks(df.withColumn("event__", event), by, order, size)
    b.carry({"last__": F.max_by("event__", _when(F.col(order), F.col("event__").isNotNull()))}, {"carried__": F.last("last__", ignorenulls=True).over(b.before)})
    here = F.last("event__", ignorenulls=True).over(b.ordered.rowsBetween(Window.unboundedPreceding, 0))
    b.rows = b.rows.withColumn(name, F.coalesce(here, "carried__", F.lit("grasp")))
    return b.result("event__", "carried__")


def _numbered(b: Blocks, key: Column) -> None:
    """Numbers the stretches of equal consecutive keys along the trajectory (column island__), and says which frame follows
    (next__). Inside a block they are counted (inner__); a block's first stretch goes on from the block
    before if that ended with an equal key."""
    turned = ~key.eqNullSafe(F.lag(key).over(b.ordered)) & (F.row_number().over(b.ordered) > 1)
    b.rows = b.rows.withColumn("turned__", turned.cast("bigint"))
    b.rows = b.rows.withColumns({"inner__": F.sum("turned__").over(b.ordered), "within__": F.lead(b.order).over(b.ordered)})
    fresh = F.coalesce((~F.col("first__.k").eqNullSafe(F.lag("last__.k").over(b.across)) & F.lag("turns__").over(b.across).isNotNull()).cast("bigint"), F.lit(0))
    k = F.struct(key.alias("k"))
    b.carry(
        {"first__": F.min_by(k, b.order), "last__": F.max_by(k, b.order), "turns__": F.sum("turned__"), "start__": F.min(b.order)},
        {"fresh__": fresh},
        {"base__": F.coalesce(F.sum("turns__").over(b.before), F.lit(0)) + F.sum("fresh__").over(b.upto), "ahead__": F.lead("start__").over(b.across)},
    )
    b.rows = b.rows.withColumns({"island__": F.col("base__") + F.col("inner__"), "next__": F.coalesce("within__", "ahead__")}).drop("turned__", "within__", "base__", "ahead__")


def runs(df: DataFrame, by: list[str], order: str, key: str, size: int = SIZE) -> DataFrame:
    """(by, key, start_frame, end_frame, n): stretches of an equal key. The end is exclusive: where
    the next run starts, or one behind the last frame. A run of many blocks is added up from a row each."""
    b = Blocks(df.select(*by, order, key), by, order, size)
    _numbered(b, F.col(key))
    last = F.max_by(F.struct("next__"), order)["next__"]
    grouped = b.rows.groupBy(*by, "island__").agg(F.first(key).alias(key), F.min(order).alias("start_frame"), F.coalesce(last, F.max(order) + 1).alias("end_frame"), F.count("*").alias("n"))
    return grouped.drop("island__")


def true_runs(df: DataFrame, by: list[str], order: str, flag: str, size: int = SIZE) -> DataFrame:
    """Half-open stretches in which the flag holds."""
    return runs(df, by, order, flag, size).where(F.col(flag)).drop(flag)


def close_gaps(df: DataFrame, by: list[str], order: str, flag: str, shortest: int, size: int = SIZE) -> DataFrame:
    """Fills stretches of false below `shortest` frames, then drops stretches of true below it. Of a stretch inside a block the
    block knows the length; the first and last of each block are added up over the blocks that they cross."""
    b = Blocks(df, by, order, size)
    for value in (False, True):
        _numbered(b, F.col(flag))
        b.rows = b.rows.withColumn("length__", F.count("*").over(Window.partitionBy(*by, BLOCK, "inner__")))
        ends = b.rows.groupBy(*by, BLOCK).agg(F.min_by(F.struct("island__", "length__"), order).alias("first__"), F.max_by(F.struct("island__", "length__"), order).alias("last__"))
        # A block that is one stretch names it once.
        one = F.col("first__.island__") == F.col("last__.island__")
        listed = ends.select(*by, BLOCK, F.explode(F.when(one, F.array("first__")).otherwise(F.array("first__", "last__"))).alias("e"))
        island = Window.partitionBy(*by, "e.island__")
        totals = listed.withColumn("total__", F.sum("e.length__").over(island))
        totals = totals.groupBy(*by, BLOCK).agg(F.map_from_entries(F.collect_list(F.struct("e.island__", "total__"))).alias("totals__"))
        b.rows = b.rows.join(totals, [*by, BLOCK])
        length = F.coalesce(F.try_element_at("totals__", F.col("island__")), "length__")
        short = (F.col(flag) == value) & (length < shortest)
        b.rows = b.rows.withColumn(flag, F.when(short, F.lit(not value)).otherwise(F.col(flag))).drop("inner__", "island__", "next__", "length__", "totals__")
    return b.result()
