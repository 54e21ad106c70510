"""Joins and set operators of indexing, resuming and merging.

Dimensions are joined without a broadcast hint: the planner broadcasts them when their size is known
to be small. Interval joins are those of `intervals`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals


def looked_up(df: DataFrame, dim: DataFrame, keys: list[tuple[str, str]], value: str, name: str) -> DataFrame:
    """Looks a value up by several keys in turn: the first key that finds one decides."""
    out, found = df, []
    for k, (own, other) in enumerate(keys):
        side = dim.groupBy(F.col(other).alias(f"k{k}__")).agg(F.min(value).alias(f"v{k}__"))
        out = out.join(side, F.col(own) == F.col(f"k{k}__"), "left")
        found.append(F.col(f"v{k}__"))
    return out.select(*df.columns, F.coalesce(*found).alias(name))


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def selected(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def merged(sources: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union in which the first row of a key stays: sources in their order, then `order`. Rows with a
    null or empty first key go."""
    ranked = [df.withColumn("source__", F.lit(k)) for k, df in enumerate(sources)]
    union = ranked[0]
    for df in ranked[1:]:
        union = union.unionByName(df, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("source__", *order))
    kept = union.where(F.col(keys[0]).isNotNull() & (F.col(keys[0]).cast("string") != "")).withColumn("place__", place)
    return kept.where("place__ = 1").drop("place__", "source__")


def overlapping(left: DataFrame, right: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """Pairs of half-open intervals of a group that share at least so many frames; columns start_frame,
    end_frame and whatever else, prefixed l_ and r_."""
    return intervals.pairs(left, right, by, least=least)


def clipped(phases: DataFrame, windows: DataFrame, by: list[str]) -> DataFrame:
    """Phases cut to the windows of their group that they meet."""
    met = intervals.pairs(phases, windows, by)
    cut = {"l_start_frame": F.greatest("l_start_frame", "r_start_frame"), "l_end_frame": F.least("l_end_frame", "r_end_frame")}
    about = [c for c in windows.columns if c not in (*by, "start_frame", "end_frame")]
    return met.withColumns(cut).select(*(F.col(c if c in by else f"l_{c}").alias(c) for c in phases.columns), *(F.col(f"r_{c}").alias(c) for c in about))


def nearest(wanted: DataFrame, timeline: DataFrame, by: list[str], at: str, t: str) -> DataFrame:
    """The timeline's entry nearest to each wanted place, the first of equals; by one sorted pass over
    both, so no pair of them is made."""
    both = wanted.select(*by, F.col(at).alias("p__"), F.lit(1).alias("ask__"), *(F.col(c) for c in wanted.columns if c not in (*by, at))).unionByName(
        timeline.select(*by, F.col(t).alias("p__"), F.lit(0).alias("ask__")).distinct(), allowMissingColumns=True
    )
    here = F.when(F.col("ask__") == 0, F.col("p__"))
    w = Window.partitionBy(*by).orderBy("p__", "ask__")
    before = F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(here, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    closer = F.when(before.isNull() | (after - F.col("p__") < F.col("p__") - before), after).otherwise(before)
    return both.withColumn("nearest", closer).where("ask__ = 1").withColumnRenamed("p__", at).drop("ask__")


def zipped(left: DataFrame, right: DataFrame, by: list[str], left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Joins two ordered sets of a group by their place."""
    a = left.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*left_order)))
    b = right.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*right_order)))
    return a.join(b, [*by, "place"])


def exact_or_same_end(wanted: DataFrame, keyframes: DataFrame, by: list[str]) -> DataFrame:
    """The keyframe of the same kind and end, else the first kind's of the same end."""
    exact = keyframes.groupBy(*by, "end_frame", "kind").agg(F.min("idx").alias("exact"))
    end = keyframes.groupBy(*by, "end_frame").agg(F.min("idx").alias("same_end"))
    return wanted.join(exact, [*by, "end_frame", "kind"], "left").join(end, [*by, "end_frame"], "left").select(*wanted.columns, F.coalesce("exact", "same_end").alias("keyframe"))


def allocated(counts: dict[str, int], total: int, strategy: str = "proportional", weights: dict[str, float] | None = None, floor: int = 0) -> dict[str, int]:
    """How many of `total` each group gives. First each gets up to `floor`, heavier groups before
    lighter; the rest by weight, rounded down, then one each by the largest remainders. No group gives
    more than it has; what it cannot give is shared out again."""
    if strategy not in ("proportional", "balanced", "weighted"):
        raise ValueError(f"unknown strategy {strategy!r}")
    groups = sorted(g for g in counts if counts[g])
    weight = {g: {"proportional": float(counts[g]), "balanced": 1.0, "weighted": max(0.0, (weights or {}).get(g, 1.0))}[strategy] for g in groups}
    if not any(weight.values()):
        weight = dict.fromkeys(groups, 1.0)
    given, left = dict.fromkeys(counts, 0), min(max(0, total), sum(counts.values()))

    def give(g: str, n: int) -> None:
        nonlocal left
        n = min(n, counts[g] - given[g], left)
        given[g] += n
        left -= n

    for _ in range(floor):
        for g in sorted(groups, key=lambda g: (weight[g], counts[g], g), reverse=True):
            give(g, 1)
    while left and (some := [g for g in groups if given[g] < counts[g]]):
        mass = sum(weight[g] for g in some)
        share = {g: left * (weight[g] / mass if mass else 1 / len(some)) for g in some}
        for g in some:
            give(g, int(share[g]))
        for g in sorted(some, key=lambda g: (share[g] % 1, weight[g], g), reverse=True):
            give(g, 1)
    return given


def sampled(groups: dict[str, list[str]], quotas: dict[str, int], seed: int = 42) -> list[str]:
    """Keys drawn from each group, in the groups' order, by one seeded generator: what a user of the
    random module gets. Key lists are those of an index, not of frames."""
    import random

    rng = random.Random(seed)
    return [key for g in sorted(groups) if quotas.get(g) for key in rng.sample(groups[g], min(quotas[g], len(groups[g])))]


def stratified(df: DataFrame, group: str, order: Column, quotas: dict[str, int]) -> DataFrame:
    """The first rows of each group by the order, as many as its quota. Quotas are one for each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    limits = df.sparkSession.createDataFrame(list(quotas.items()) or [(None, 0)], "g__ string, quota__ bigint")
    kept = df.withColumn("place__", place).join(limits, F.col(group).cast("string") == F.col("g__"))
    return kept.where("place__ <= quota__").drop("place__", "g__", "quota__")


def seeded(seed: int, *columns: str) -> Column:
    """A seeded order of rows that depends on the columns alone, the same in every engine that has MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def collected(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, values): the values of each group in order, as a map of lists would hold them."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("values"))


def per_group(df: DataFrame, group: str, most: int, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """At most so many rows of each group, chosen by a seeded hash of their keys (all columns): the same at any partitioning."""
    order = seeded(seed, *(keys or df.columns))
    place = F.row_number().over(Window.partitionBy(group).orderBy(order, *df.columns))
    return df.withColumn("place__", place).where(F.col("place__") <= most).drop("place__")


def node_share(df: DataFrame, order: list[str], nodes: int, rank: int, by: str) -> DataFrame:
    """Every nodes-th row of each group, from the rank-th: what one of several nodes works on."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return df.withColumn("place__", place).where(F.pmod("place__", F.lit(nodes)) == rank).drop("place__")


def shuffled(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows in a seeded order that depends on their keys alone."""
    return df.orderBy(seeded(seed, *keys), *keys).limit(n)


def same_sets(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
