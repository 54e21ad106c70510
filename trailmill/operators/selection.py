"""Exact medians of groups of any size.

A median that is one aggregate gathers its whole group in one task. Here values are counted in buckets between the least and the
largest of what is left of a group; the bucket that holds the wanted rank is what is left next, between its own least and
largest value. What is shuffled are counts, summed before they move, however large a group is. Where few values are left
they are sorted, and where all are equal nothing is. Every value is a value of the group: no rounding takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import staged

#: Buckets of a round, and values of a group that are few enough to be sorted at once.
BUCKETS, FEW = 1_024, 4_096


def _bucket(value: Column, low: Column, high: Column, buckets: int) -> Column:
    """Never falls as the value grows; 0 for the least, buckets - 1 for the largest. Values of many magnitudes are dealt by their
    logarithms, others evenly, so rounds are few: about one for each 10 bits of a double."""
    scale = lambda v: F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.ln(F.abs(v)) + 746.0))
    wide = scale(high) - scale(low) > 1
    share = F.when(wide, (scale(value) - scale(low)) / (scale(high) - scale(low))).otherwise((value - low) / (high - low))
    return F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")


def at_ranks(df: DataFrame, by: list[str], value: str, wanted: DataFrame, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """(by, rank, value) of wanted (by, rank): the value at each rank of a group in ascending order, from 0. Null and NaN
    values have no rank; ranks that a group lacks are left out."""
    rows = df.select(*by, F.col(value).cast("double").alias("v__")).where(F.col("v__").isNotNull() & ~F.isnan("v__") & (F.abs("v__") < float("inf")))
    same = lambda prefix: [F.col(f"{prefix}{k}__").eqNullSafe(F.col(c)) for k, c in enumerate(by)]
    named = lambda frame, prefix: frame.select(*(F.col(c).alias(f"{prefix}{k}__") for k, c in enumerate(by)), *(c for c in frame.columns if c not in by))
    ends = rows.groupBy(*by).agg(F.count("*").alias("n__"), F.min("v__").alias("low__"), F.max("v__").alias("high__"))
    todo = wanted.join(named(ends, "e"), same("e") or F.lit(True)).where("rank < n__").select(*by, "rank", F.col("rank").alias("left__"), "n__", "low__", "high__")
    todo = staged(todo, "ranks")
    inside = F.col("v__").between(F.col("low__"), F.col("high__"))
    done = None
    while True:
        settled = todo.where("low__ = high__").select(*by, "rank", F.col("low__").alias("value"))
        done = settled if done is None else done.unionByName(settled)
        open_ = todo.where("low__ < high__")
        small = open_.where(F.col("n__") <= few)
        sorted_ = rows.join(named(small, "s"), same("s") or F.lit(True)).where(inside).groupBy(*by, "rank", "left__").agg(F.sort_array(F.collect_list("v__")).alias("vs__"))
        done = done.unionByName(sorted_.select(*by, "rank", F.get("vs__", F.col("left__").cast("int")).alias("value")))
        large = open_.where(F.col("n__") > few)
        if large.isEmpty():
            return done
        met = rows.join(named(large, "o"), same("o") or F.lit(True)).where(inside).withColumn("b__", _bucket(F.col("v__"), F.col("low__"), F.col("high__"), buckets))
        counted = met.groupBy(*by, "rank", "left__", "b__").agg(F.count("*").alias("n__"), F.min("v__").alias("low__"), F.max("v__").alias("high__"))
        # At most so many rows for each wanted rank.
        listed = counted.groupBy(*by, "rank", "left__").agg(F.array_sort(F.collect_list(F.struct("b__", "n__", "low__", "high__"))).alias("bs__"))
        zero = F.struct(F.lit(None).cast("struct<b__:int,n__:bigint,low__:double,high__:double>").alias("found"), F.col("left__").alias("left"))
        step = lambda a, b: F.when(a["found"].isNotNull(), a).when(a["left"] < b["n__"], F.struct(b.alias("found"), a["left"].alias("left"))).otherwise(F.struct(a["found"].alias("found"), (a["left"] - b["n__"]).alias("left")))
        kept = listed.select(*by, "rank", F.aggregate("bs__", zero, step).alias("k__"))
        todo = staged(kept.select(*by, "rank", F.col("k__.left").alias("left__"), "k__.found.n__", "k__.found.low__", "k__.found.high__"), "ranks")


def medians(df: DataFrame, by: list[str], value: str, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """(by, n, median): the middle value of each group, or the mean of the two middle ones, as the aggregate `median` gives."""
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) < float("inf"))
    sizes = staged(df.where(known).groupBy(*by).agg(F.count("*").alias("n")), "sizes")
    half = F.expr("n div 2")
    wanted = sizes.where("n > 0").select(*by, F.explode(F.array_distinct(F.array(F.expr("(n - 1) div 2"), half))).alias("rank"))
    found = at_ranks(df, by, value, wanted, buckets, few)
    middle = found.groupBy(*by).agg(F.min("value").alias("a__"), F.max("value").alias("b__"))
    out = sizes.select(*(F.col(c).alias(f"z{k}__") for k, c in enumerate(by)), "n")
    same = F.lit(True)
    for k, c in enumerate(by):
        same &= F.col(f"z{k}__").eqNullSafe(F.col(c))
    return middle.join(out, same).select(*by, "n", F.when(F.col("a__") == F.col("b__"), F.col("a__")).otherwise(0.5 * F.col("a__") + 0.5 * F.col("b__")).alias("median"))


def deviations(df: DataFrame, by: list[str], value: str, name: str = "deviation", buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """(by, n, median, deviation): with the median distance from the median."""
    middle = staged(medians(df, by, value, buckets, few), "medians")
    named = middle.select(*(F.col(c).alias(f"m{k}__") for k, c in enumerate(by)), "median")
    same = F.lit(True)
    for k, c in enumerate(by):
        same &= F.col(f"m{k}__").eqNullSafe(F.col(c))
    away = df.select(*by, F.col(value).alias("x__")).join(named, same).select(*by, F.abs(F.col("x__") - F.col("median")).alias("d__"))
    far = medians(away, by, "d__", buckets, few).select(*(F.col(c).alias(f"d{k}__") for k, c in enumerate(by)), F.col("median").alias(name))
    again = F.lit(True)
    for k, c in enumerate(by):
        again &= F.col(f"d{k}__").eqNullSafe(F.col(c))
    return middle.join(far, again).select(*by, "n", "median", name)
