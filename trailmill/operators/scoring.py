"""Motion statistics, robust filters, scores and picks over candidates.

Candidates carry an explicit number; every pick has a total order: largest score, then least number,
as the first maximum of an array. Scores that are null or not finite never win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Constants of the selection method.
SNR_POWER, REST_POWER, REST_EPSILON = 0.6, 0.2, 1.0
SNR_WEIGHT, DETECTOR_WEIGHT, DETECTOR_REDUCTION, SPHERE_WEIGHT = 0.5, 0.75, 0.15, 0.3
PENALTY_WEIGHT, RELIEF_STRENGTH, OVERLAP_FREE = 1.45, 0.85, 0.3
HARD_OVERLAP, HARD_PENALTY, DEPTH_LOW, DEPTH_HIGH = 0.98, 0.20, 0.05, 0.25


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def displacement(tracks: DataFrame, by: list[str]) -> DataFrame:
    """Pixels that each point moved since the frame before; no row for the first frame."""
    w = Window.partitionBy(*by, "pt").orderBy("t")
    moved = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return tracks.withColumn("moved", moved).where("moved is not null")


def frame_motion(tracks: DataFrame, by: list[str], fps: float, centre: str = "mean") -> DataFrame:
    """(by, t, motion): mean or median over points, in pixels per second."""
    pick = F.avg if centre == "mean" else F.median
    return displacement(tracks, by).groupBy(*by, "t").agg((pick("moved") * fps).alias("motion"))


def phase_motion(motion: DataFrame, by: list[str], interacting: Column, resting: Column) -> DataFrame:
    """Statistics of motion while interacting and while not. Where no frame interacts or fewer than
    three rest, `fallback` holds and the interacting ones cover what there is."""
    i, r = F.when(interacting, F.col("motion")), F.when(resting, F.col("motion"))
    raw = motion.groupBy(*by).agg(
        F.count(i).alias("n_interact"), F.count(r).alias("n_rest"), F.avg(i).alias("im"), F.stddev_pop(i).alias("isd"), F.sum(i).alias("isum"),
        F.avg(r).alias("rm"), F.stddev_pop(r).alias("rsd"), F.avg("motion").alias("am"), F.stddev_pop("motion").alias("asd"), F.sum("motion").alias("asum"),
    )
    fallback = (F.col("n_rest") < 3) | (F.col("n_interact") == 0)
    whole = F.col("n_interact") == 0
    return raw.select(
        *by, "n_interact", "n_rest", fallback.alias("fallback"),
        F.when(whole, F.col("am")).otherwise(F.col("im")).alias("interact_mean"), F.when(whole, F.col("asd")).otherwise(F.col("isd")).alias("interact_std"),
        F.when(whole, F.col("asum")).otherwise(F.col("isum")).alias("interact_sum"),
        F.when(fallback, 0.0).otherwise(F.col("rm")).alias("rest_mean"), F.when(fallback, 0.0).otherwise(F.col("rsd")).alias("rest_std"),
    )


def signal_to_noise(power: float = SNR_POWER, rest: float = REST_POWER, epsilon: float = REST_EPSILON) -> Column:
    """Interacting over resting motion; the mean alone on a fallback; -inf without any frame."""
    none = (F.col("n_interact") == 0) & (F.col("n_rest") == 0) & F.col("interact_mean").isNull()
    ratio = F.pow("interact_mean", F.lit(power)) / F.pow(F.col("rest_mean") + epsilon, F.lit(rest))
    return F.when(none, float("-inf")).when(F.col("fallback"), F.col("interact_mean")).otherwise(ratio)


def unit_range(value: str, by: list[str], all_equal: float = 1.0) -> Column:
    """A value in units of its group's range; not finite becomes 0, a range of nothing `all_equal`."""
    w = Window.partitionBy(*by)
    good = finite(F.col(value))
    low, high = F.min(F.when(good, F.col(value))).over(w), F.max(F.when(good, F.col(value))).over(w)
    return F.when(~good, 0.0).when(high > low, (F.col(value) - low) / (high - low)).otherwise(all_equal)


def overlap_penalty(overlap: Column, depth_gap: Column) -> Column:
    """Quadratic in the overlap beyond OVERLAP_FREE, relieved where the fingertips are at another depth."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    gap = F.when(finite(depth_gap), depth_gap).otherwise(DEPTH_LOW)
    relief = clip((gap - DEPTH_LOW) / (DEPTH_HIGH - DEPTH_LOW))
    excess = clip((overlap - OVERLAP_FREE) / (1 - OVERLAP_FREE))
    hard = F.when(overlap > HARD_OVERLAP, HARD_PENALTY * (1 - relief)).otherwise(0.0)
    return PENALTY_WEIGHT * excess * excess * (1 - RELIEF_STRENGTH * relief) + hard


def adaptive_score(snr: Column, sphere: Column, detector: Column, penalty: Column) -> Column:
    weight = DETECTOR_WEIGHT - DETECTOR_REDUCTION * sphere
    return SNR_WEIGHT * snr + weight * detector + SPHERE_WEIGHT * sphere - penalty


def winner(df: DataFrame, by: list[str], score: str, number: str = "cand") -> DataFrame:
    """The row of the largest finite score in each group, the first of equals."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), number))
    return df.where(finite(F.col(score))).withColumn("place__", place).where("place__ = 1").drop("place__")


def detector_baseline(df: DataFrame, by: list[str], score: str, number: str = "cand") -> DataFrame:
    """As winner(), but candidate 0 where no score is finite."""
    w = Window.partitionBy(*by).orderBy(finite(F.col(score)).desc(), F.when(finite(F.col(score)), F.col(score)).desc(), number)
    return df.withColumn("place__", F.row_number().over(w)).where("place__ = 1").drop("place__")


def tie_break(df: DataFrame, by: list[str], margin: float = 0.3) -> DataFrame:
    """Of the pairs (score, area, conf, points, number) within the margin of the best, the one best after
    small bonuses for a small area, a high confidence and dense points."""
    w = Window.partitionBy(*by)
    largest, most = F.max("area").over(w), F.greatest(F.max("points").over(w), F.lit(1))
    out = df.withColumns({"top__": F.max("score").over(w), "largest__": largest, "most__": most}).where(F.col("score") >= F.col("top__") * (1 - margin))
    relative = F.col("area") / F.col("largest__")
    dense = F.when(F.col("area") > 0, F.least(F.col("points") / relative / F.col("most__"), F.lit(1.0))).otherwise(0.0)
    out = out.withColumn("combined", F.col("score") + 0.1 * (1 - relative) + 0.08 * F.col("conf") + 0.05 * dense)
    return winner(out, by, "combined", "number").drop("top__", "largest__", "most__")


def density_target(df: DataFrame, by: list[str], least_share: float = 0.5) -> DataFrame:
    """The target with most points per root of relative area, among those of enough area; none if
    no target has points. Columns area, start_area, points, idx."""
    largest = F.max("area").over(Window.partitionBy(*by))
    enough = (F.col("area") >= least_share * F.coalesce("start_area", F.lit(0.0))) & (F.col("area") > 0)
    density = F.when(enough, F.col("points") / F.sqrt(F.col("area") / largest))
    return winner(df.withColumn("density", density).where("density > 0"), by, "density", "idx")


def gripper_pick(df: DataFrame, by: list[str], cap: float) -> DataFrame:
    score = 0.7 * F.col("conf") + 0.3 * F.sqrt(F.least(F.col("area") / cap, F.lit(1.0)))
    return winner(df.withColumn("pick_score", score), by, "pick_score", "idx")


def single_dominant(df: DataFrame, by: list[str], high: float = 0.5, low: float = 0.25) -> DataFrame:
    """Marks the one confidence above `high` where it is also the only one above `low`."""
    w = Window.partitionBy(*by)
    n = lambda limit: F.sum((F.col("conf") > limit).cast("int")).over(w)
    return df.withColumn("dominant", (n(high) == 1) & (n(low) == 1) & (F.col("conf") > high))


def movement_score(movement: Column, baseline: Column) -> Column:
    """Movement over the scene's baseline, compressed to at most 1."""
    return F.least(F.log1p(100 * F.greatest(movement - baseline, F.lit(0.0))) / 5, F.lit(1.0))


def continuous_penalty(movement: DataFrame, by: list[str], least: float = 0.001, full: float = 2.0, factor: float = 1.0) -> DataFrame:
    """(by, penalty): loss of what moves as much outside of the interaction as inside it.
    movement: (by, interact_sum, rest_sum)."""
    i, r = F.col("interact_sum"), F.col("rest_sum")
    gate = F.when(i + r <= least, 0.0).when(r <= least, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (i / r - 1) / (full - 1))))
    return movement.select(*by, (factor * (1 - gate)).alias("penalty"))


def depth_trimmed(points: DataFrame, by: list[str], value: str = "z", k: float = 2.0, least: int = 3) -> DataFrame:
    """Points within k median absolute deviations of their group's median. Groups of fewer than `least`
    points, or with no spread, stay whole. One shuffle: both medians are windows over the same groups."""
    w = Window.partitionBy(*by)
    off = points.withColumns({"mid__": F.median(value).over(w), "n__": F.count("*").over(w)}).withColumn("off__", F.abs(F.col(value) - F.col("mid__")))
    off = off.withColumn("mad__", F.median("off__").over(w))
    return off.where((F.col("n__") < least) | (F.col("mad__") <= 1e-9) | (F.col("off__") <= k * F.col("mad__"))).select(*points.columns)


def centroids(tracks: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """Mean of the points of a candidate's frame, null with fewer than `least`."""
    enough = F.count("*") >= least
    return tracks.groupBy(*by).agg(F.when(enough, F.avg("x")).alias("cx"), F.when(enough, F.avg("y")).alias("cy"), F.count("*").alias("n"))


def tip_centroids(points: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """Mean of the k points of least depth in each frame."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("z", "x", "y", "pt"))
    near = points.withColumn("place__", place).where(F.col("place__") <= k)
    return near.groupBy(*by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))


def sphere_fraction(points: DataFrame, spheres: DataFrame, by: list[str], frame: str = "t", multiple: float = 1.0) -> DataFrame:
    """(by, t, fraction): share of a candidate's points within the frame's sphere (sx, sy, sz, radius). A
    sphere belongs to those of the `by` columns that its table has, as a trajectory's to all its candidates."""
    d = F.sqrt(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2) + F.pow(F.col("z") - F.col("sz"), 2))
    inside = (d <= multiple * F.col("radius")).cast("double")
    on = [c for c in by if c in spheres.columns]
    if not on:
        raise ValueError(f"spheres of a frame alone would meet the points of all trajectories; they need one of {by}")
    return points.join(spheres, [*on, frame]).groupBy(*by, frame).agg(F.avg(inside).alias("fraction"))


def depth_gap(traces: DataFrame, by: list[str], side: str, one, other, frame: str = "t", depth: str = "z") -> DataFrame:
    """(by, dz): median distance in depth of two sides' mean traces, over the frames that both have."""
    mean = lambda which: F.avg(F.when(F.col(side) == which, F.col(depth)))
    per = traces.groupBy(*by, frame).agg(mean(one).alias("one__"), mean(other).alias("other__"))
    both = per.where("one__ is not null and other__ is not null")
    return both.groupBy(*by).agg(F.median(F.abs(F.col("one__") - F.col("other__"))).alias("dz"))


def top_mean(df: DataFrame, by: list[str], value: str, order: str, share: float = 0.1, least: int = 3, name: str = "peak") -> DataFrame:
    """Mean of the largest tenth of the values, but of at least three where there are as many."""
    n = F.count("*").over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), order))
    kept = df.withColumns({"n__": n, "place__": place}).where(F.col("place__") <= F.least("n__", F.greatest(F.lit(least), F.ceil(F.col("n__") * share))))
    return kept.groupBy(*by).agg(F.avg(value).alias(name))


def overlap_policy(df: DataFrame, by: list[str], policy: str = "first", share: float = 0.1, least: int = 1, quantile: float = 0.9) -> DataFrame:
    """(by, overlap) of frames (t, overlap, count) by one of five policies: the earliest frame as it is, or, of
    the frames with points and a known overlap, the mean weighted by counts, the largest, a quantile, or the
    weighted mean of the top share (of at least `least` frames). Without such frames the overlap is 0."""
    if policy == "first":
        return df.groupBy(*by).agg(F.min_by("overlap", "t").alias("overlap"))
    good = finite(F.col("overlap")) & (F.col("count") > 0)
    value = F.when(good, F.col("overlap"))
    if policy == "max":
        found = F.max(value)
    elif policy == "quantile":
        found = F.percentile(value, quantile)
    elif policy in ("mean", "top_mean"):
        kept = good
        if policy == "top_mean":
            w = Window.partitionBy(*by)
            df = df.withColumns({"place__": F.row_number().over(w.orderBy(good.desc(), F.desc("overlap"), "t")), "n__": F.count(value).over(w)})
            kept = good & (F.col("place__") <= F.greatest(F.lit(least), F.ceil(F.col("n__") * share)))
        weight = F.when(kept, F.col("count"))
        found = F.sum(F.when(kept, F.col("overlap") * F.col("count"))) / F.sum(weight)
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return df.groupBy(*by).agg(F.coalesce(found, F.lit(0.0)).alias("overlap"))


def replay_statistics(tracks: DataFrame, by: list[str], fps: float, interacting: Column, resting: Column, boxes: DataFrame | None = None, few_phases: Column | None = None) -> DataFrame:
    """What a candidate's motion was, for scores that are replayed: mean, median of points and total movement, the
    median in units of its box's diagonal (boxes: by, x1 to y2), and motion while interacting and while not. Points
    that are -1 throughout don't count; a candidate without others, or of one frame, has -inf. few_phases: whether
    the trajectory has at most one phase, so that all motion is interaction."""
    alive = tracks.withColumn("seen__", F.max(((F.col("x") != -1) | (F.col("y") != -1)).cast("int")).over(Window.partitionBy(*by, "pt"))).where("seen__ = 1").drop("seen__")
    per = displacement(alive, by).groupBy(*by, "t").agg(F.avg("moved").alias("mean__"), F.median("moved").alias("median__"))
    motion = F.col("mean__") * fps
    i, r = F.when(interacting, motion), F.when(resting, motion)
    sums = per.groupBy(*by).agg(
        F.count("*").alias("n_total"), F.avg(motion).alias("mean_movement"), F.avg(F.col("median__") * fps).alias("median_movement"), F.sum("mean__").alias("total_movement"),
        F.sum(motion).alias("all__"), F.count(i).alias("ni__"), F.count(r).alias("nr__"), F.avg(i).alias("im__"), F.avg(r).alias("rm__"), F.sum(i).alias("is__"), F.sum(r).alias("rs__"),
    )
    points = alive.groupBy(*by).agg(F.count_distinct("pt").alias("n_valid_points"))
    every = tracks.select(*by).distinct().join(points, by, "left").join(sums, by, "left")
    if boxes is not None:
        every = every.join(boxes.select(*by, F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox_diag")), by, "left")
    else:
        every = every.withColumn("bbox_diag", F.lit(None).cast("double"))
    flat = few_phases if few_phases is not None else F.lit(False)
    known, none = F.col("n_total").isNotNull(), F.lit(float("-inf"))
    whole = flat | (F.col("ni__") == 0)
    fallback = ~known | flat | (F.col("nr__") < 3) | (F.col("ni__") == 0)
    snr = F.pow("im__", F.lit(SNR_POWER)) / F.pow(F.coalesce("rm__", F.lit(0.0)) + REST_EPSILON, F.lit(REST_POWER))
    diagonal = F.coalesce("bbox_diag", F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return every.select(
        *by, F.coalesce("n_total", F.lit(0)).alias("n_total"), F.when(known, F.col("n_valid_points")).otherwise(0).alias("n_valid_points"), diagonal.alias("bbox_diag"),
        *(F.coalesce(c, none).alias(c) for c in ("mean_movement", "median_movement", "total_movement")),
        F.when(known & (diagonal > 0), F.col("median_movement") / diagonal).otherwise(none).alias("norm_movement"),
        F.when(~known, 0).when(flat, F.col("n_total")).otherwise(F.col("ni__")).alias("interact_frames"), F.when(~known | flat, 0).otherwise(F.col("nr__")).alias("non_interact_frames"),
        zero(F.when(whole, F.col("mean_movement")).otherwise(F.col("im__"))).alias("interact_mean"), zero(F.when(~flat, F.col("rm__"))).alias("non_interact_mean"),
        zero(F.when(whole, F.col("all__")).otherwise(F.col("is__"))).alias("interact_sum"), zero(F.when(~flat, F.col("rs__"))).alias("non_interact_sum"),
        F.coalesce(fallback, F.lit(True)).alias("phase_fallback"), F.when(~known, none).when(fallback, F.col("mean_movement")).otherwise(snr).alias("phase_snr_raw"),
    )


def gripper_spheres(points: DataFrame, by: list[str], centre: tuple[float, float], neighbours: int = 5, scale: float = 2.0, least: float = 0.05, cap: Column | None = None) -> DataFrame:
    """(by, sx, sy, sz, radius): around the point that is nearest the image's centre (u, v), as far as twice
    the median distance to its five nearest neighbours."""
    off = F.hypot(F.col("u") - centre[0], F.col("v") - centre[1])
    middle = points.groupBy(*by).agg(F.min_by(F.struct("x", "y", "z", "pt"), F.struct(off, "pt")).alias("c"))
    away = F.sqrt(F.pow(F.col("x") - F.col("c.x"), 2) + F.pow(F.col("y") - F.col("c.y"), 2) + F.pow(F.col("z") - F.col("c.z"), 2))
    others = points.join(middle, by).where(F.col("pt") != F.col("c.pt")).withColumn("away", away)
    near = others.withColumn("place__", F.row_number().over(Window.partitionBy(*by).orderBy("away", "pt"))).where(F.col("place__") <= neighbours)
    reach = near.groupBy(*by).agg(F.greatest(F.median("away") * scale, F.lit(least)).alias("radius"))
    radius = F.coalesce("radius", F.lit(least))
    out = middle.join(reach, by, "left")
    return out.select(*by, F.col("c.x").alias("sx"), F.col("c.y").alias("sy"), F.col("c.z").alias("sz"), (F.least(radius, cap) if cap is not None else radius).alias("radius"))


def fallback_pick(scores: DataFrame, by: list[str], candidates: DataFrame) -> DataFrame:
    """The candidate whose best pair scores most (start, score); without pairs, the most confident (idx, conf)."""
    best = winner(scores.groupBy(*by, "start").agg(F.max("score").alias("score")), by, "score", "start").select(*by, F.col("start").alias("by_score"))
    sure = winner(candidates, by, "conf", "idx").select(*by, F.col("idx").alias("by_conf"))
    return sure.join(best, by, "left").select(*by, F.coalesce("by_score", "by_conf").alias("pick"))


def top_pairs(scores: DataFrame, by: list[str], k: int = 8) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "start", "target"))
    return scores.withColumn("place", place).where(F.col("place") <= k)


def best_robot(df: DataFrame, by: list[str], object_class: int = 2) -> tuple[DataFrame, DataFrame]:
    """The objects of a detection, and its most confident robot box."""
    robots = winner(df.where(F.col("class_id") != object_class), by, "conf", "idx")
    return df.where(F.col("class_id") == object_class), robots


def replay_score(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds `score` by the weights of the task's group: motion and detection, the dominant detection's
    bonus, and points inside of the sphere. Columns group, snr, conf, dominant, fraction."""
    still = F.col("group") == "non_movement_articulate"
    snr = unit_range("snr", by, all_equal=0.0)
    motion = F.when(still, 0.0).otherwise(0.5)
    score = motion * snr + F.when(still, 1.0).otherwise(0.5) * F.col("conf") + 0.2 * F.col("dominant").cast("double") + F.when(still, 0.35).otherwise(0.2) * F.col("fraction")
    return df.withColumn("score", score)
