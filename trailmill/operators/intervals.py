"""Joins of intervals along a trajectory, in bins whose width follows the intervals' lengths.

An interval of length up to 2^k lies in at most two bins of width 2^k. Of two intervals that overlap, the longer is looked up
under its own level k, the shorter under each level that the other side's intervals have from its own on; so
both are in at most two bins of one level, and only intervals no longer than a bin meet in it. The pair is
given once, by the bin in which its overlap starts. Long and short intervals can be mixed: a long one makes no more
bins than a short one, and rows that meet in vain are at most those within a bin's width of it.

Intervals are half-open, of any numeric type, with bounds up to 2^53. Null bounds or groups, and intervals that are empty, overlap nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels: an interval's length is at most 2^LEVELS.
LEVELS = 62


def level_of(start: Column, end: Column) -> Column:
    """The least k with end - start <= 2^k."""
    length = F.greatest(F.ceil(end - start), F.lit(1)).cast("bigint")
    # Bits of length - 1, as an exact number of binary digits.
    return F.when(length <= 1, F.lit(0)).otherwise(F.length(F.bin(length - 1))).cast("int")


def _bins(df: DataFrame, start: Column, end: Column, levels: Column) -> DataFrame:
    """A row for each bin that an interval touches on each of the levels, which are not below its own: two at most."""
    width = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
    last = lambda k: F.greatest(F.floor(start / width(k)), F.ceil(end / width(k)) - 1)
    each = F.flatten(F.transform(levels, lambda k: F.transform(F.sequence(F.floor(start / width(k)), last(k)), lambda b: F.struct(k.alias("level"), b.alias("bin")))))
    return df.withColumn("bin__", F.explode(each))


def _present(df: DataFrame, start: str, end: str) -> list[int]:
    """The levels that intervals have: at most LEVELS numbers, by one aggregate."""
    held = df.agg(F.collect_set(level_of(F.col(start), F.col(end)))).first()[0]
    return sorted(held or [])


def pairs(left: DataFrame, right: DataFrame, by: list[str], start: str = "start_frame", end: str = "end_frame", least: float = 1) -> DataFrame:
    """Pairs of a group that share at least `least` units, which is more than nothing; the columns of either side but `by`
    prefixed l_ and r_, and overlap."""
    if least <= 0:
        raise ValueError("intervals that share nothing can't be looked up by bins")
    real = lambda df: df.where((F.col(end) - F.col(start)) >= least)
    a, b = (df.select(*by, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in by)) for df, p in ((real(left), "l"), (real(right), "r")))
    ls, le, rs, re_ = f"l_{start}", f"l_{end}", f"r_{start}", f"r_{end}"
    level_a, level_b = level_of(F.col(ls), F.col(le)), level_of(F.col(rs), F.col(re_))
    array = lambda ks: F.array(*(F.lit(k) for k in ks)).cast("array<int>")
    overlap = F.least(le, re_) - F.greatest(ls, rs)
    owner = F.floor(F.greatest(ls, rs) / F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bin__.level")))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, [*by, "bin__"]).where((overlap >= least) & (owner == F.col("bin__.bin"))).withColumn("overlap", overlap).drop("bin__")

    # The longer on the left, or both alike; then the longer on the right.
    own = lambda k: F.array(k)
    first = met(
        _bins(a, F.col(ls), F.col(le), own(level_a)),
        _bins(b, F.col(rs), F.col(re_), F.filter(array(_present(a, ls, le)), lambda k: k >= level_b)),
    )
    second = met(
        _bins(a, F.col(ls), F.col(le), F.filter(array(_present(b, rs, re_)), lambda k: k > level_a)),
        _bins(b, F.col(rs), F.col(re_), own(level_b)),
    )
    columns = [*a.columns, *(c for c in b.columns if c not in by), "overlap"]
    return first.select(*columns).unionByName(second.select(*columns))


def covering(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str = "start_frame", end: str = "end_frame") -> DataFrame:
    """Each point with each interval of its group that holds it: a point is in one bin of each level."""
    about = [c for c in spans.columns if c not in (*by, start, end)]
    real = spans.where(F.col(end) > F.col(start)).select(*by, F.col(start).alias("s__"), F.col(end).alias("e__"), *about)
    levels = F.array(*(F.lit(k) for k in _present(real, "s__", "e__"))).cast("array<int>")
    width = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
    placed = points.withColumn("bin__", F.explode(F.transform(levels, lambda k: F.struct(k.alias("level"), F.floor(F.col(at) / width(k)).alias("bin")))))
    binned = _bins(real, F.col("s__"), F.col("e__"), F.array(level_of(F.col("s__"), F.col("e__"))))
    met = placed.join(binned, [*by, "bin__"]).where((F.col(at) >= F.col("s__")) & (F.col(at) < F.col("e__")))
    return met.select(*points.columns, F.col("s__").alias(start), F.col("e__").alias(end), *about)
