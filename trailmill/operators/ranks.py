"""Places in an order of all rows, or of all rows of a group however large, and what is drawn by them.

A window gives one task all rows of a group. Here rows are dealt by ranges of the order, so that a group is in as
many tasks as it fills; each task numbers its own rows, and what the tasks before it have is added. What
meets in one place are counts, one for each task and group.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import staged

_POSITION = (1 << 33) - 1


def _ranged(df: DataFrame, order: list[Column | str], within: list[str]) -> DataFrame:
    """The rows as they lie in ranges of the order, written: part__, and at__ in it. Rows that tie are placed by a hash of all their
    columns, so only rows that are equal, or collide, can change places. Written once, since a second run may cut the ranges elsewhere."""
    tie = F.xxhash64(*(F.to_json(F.struct(c)) if t.startswith("map") else F.col(c) for c, t in df.dtypes))
    by = [*within, *order, "tie__"]
    ranged = df.withColumn("tie__", tie).repartitionByRange(*by).sortWithinPartitions(*by).drop("tie__")
    return staged(ranged.withColumns({"part__": F.spark_partition_id(), "at__": F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION))}), "ranked")


def _with(rows: DataFrame, about: DataFrame, within: list[str]) -> DataFrame:
    """Rows with what a table of one row for each part and group says of theirs."""
    named = about.withColumnsRenamed({"part__": "p__", **{c: f"g{k}__" for k, c in enumerate(within)}})
    same = F.col("part__") == F.col("p__")
    for k, c in enumerate(within):
        same &= F.col(c).eqNullSafe(F.col(f"g{k}__"))
    return rows.join(named, same)


def numbered(df: DataFrame, order: list[Column | str], within: list[str] | None = None, name: str = "place", total: str | None = None) -> DataFrame:
    """The rows with their place (from 0) in the order, of all rows or within each group, and in `total` the number
    of rows there. Null groups are a group. One shuffle of the rows, by ranges."""
    within = within or []
    rows = _ranged(df, order, within)
    counts = rows.groupBy("part__", *within).agg(F.count("*").alias("n__"), F.min("at__").alias("first__"))
    group = Window.partitionBy(*(within or [F.lit(0)]))
    before = F.coalesce(F.sum("n__").over(group.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    about = counts.select("part__", *within, (before - F.col("first__")).alias("shift__"), F.sum("n__").over(group).alias("total__"))
    placed = _with(rows, about, within)
    own = [*df.columns, (F.col("at__") + F.col("shift__")).alias(name)]
    return placed.select(*own, *([F.col("total__").alias(total)] if total else []))


def running(df: DataFrame, order: list[Column | str], value: str, within: list[str] | None = None, name: str = "before") -> DataFrame:
    """The rows with the sum of an integer column over all rows before them in the order, of all rows or of their group. A window
    runs inside a range only; ranges are added up as rows are numbered."""
    within = within or []
    rows = _ranged(df, order, within)
    sums = rows.groupBy("part__", *within).agg(F.sum(value).alias("n__"))
    group = Window.partitionBy(*(within or [F.lit(0)])).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    about = sums.select("part__", *within, F.coalesce(F.sum("n__").over(group), F.lit(0)).alias("shift__"))
    inside = Window.partitionBy("part__", *within).orderBy("at__").rowsBetween(Window.unboundedPreceding, -1)
    held = _with(rows.withColumn("inside__", F.coalesce(F.sum(value).over(inside), F.lit(0))), about, within)
    return held.select(*df.columns, (F.col("inside__") + F.col("shift__")).alias(name))


def node_share(df: DataFrame, order: list[Column | str], nodes: int, rank: int) -> DataFrame:
    """Every nodes-th row of the whole order, from the rank-th: what one of several nodes works on."""
    return numbered(df, order, name="place__").where(F.pmod("place__", F.lit(nodes)) == rank).drop("place__")


def natural(path: str, digits: int = 20) -> Column:
    """A string that sorts as the path does when its numbers count as numbers and its letters in either case are one:
    each number gets zeros in front, up to so many digits, and a control character, so that text that ends there is less
    than text that goes on. Longer numbers keep their digits."""
    padded = F.regexp_replace(F.lower(path), r"\d+", "\x01" + "0" * digits + "$0")
    return F.regexp_replace(padded, r"0+(\d{%d,})" % digits, "$1")


def drawn(df: DataFrame, group: str, order: list[Column | str], quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """What random.Random(seed).sample draws from each group's rows in order, group by group in theirs, with its
    place in the draw (columns drawn_group, drawn). Positions are drawn, not rows: the driver
    holds one number for each row that is wanted, and no row or key passes it."""
    place, total = "place__", "total__"
    ranked = staged(numbered(df.where(F.col(group).isNotNull()), order, [group], place, total), "drawable")
    sizes = {str(r[0]): r[1] for r in ranked.where(F.col(group).cast("string").isin(*map(str, quotas))).groupBy(group).agg(F.max(total)).collect()}
    rng, wanted = random.Random(seed), []
    for k, g in enumerate(sorted(g for g in sizes if quotas.get(g))):
        wanted += [(g, p, k, i) for i, p in enumerate(rng.sample(range(sizes[g]), min(quotas[g], sizes[g])))]
    positions = df.sparkSession.createDataFrame(wanted, "g__ string, p__ bigint, drawn_group bigint, drawn bigint")
    met = ranked.join(positions, (F.col(group).cast("string") == F.col("g__")) & (F.col(place) == F.col("p__")))
    return met.select(*df.columns, "drawn_group", "drawn")
