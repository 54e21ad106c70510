"""Boxes: areas, overlaps, containment, filters, suppression, extents. A box is x1, y1, x2, y2 in pixels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import staged


def corners(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(box: tuple[Column, ...]) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    zero = F.lit(0.0)
    width = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    return width * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    common = intersection(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def iou_of(a: Column, b: Column) -> Column:
    """Overlap of two struct columns."""
    fields = ("x1", "y1", "x2", "y2")
    return iou(tuple(a[f] for f in fields), tuple(b[f] for f in fields))


def within_area(df: DataFrame, width: float, height: float, most: float = 0.8, least: float | None = None) -> DataFrame:
    """Boxes of at most the share `most` of the image, and of more than the share `least`."""
    share = area(corners()) / (width * height)
    out = df.where(share <= most)
    return out if least is None else out.where(share > least)


def on_arm_side(df: DataFrame, arm: Column, width: float, reach: float = 0.7) -> DataFrame:
    """Boxes an arm can mean: the left arm those centred left of 0.7 of the width, the right mirrored."""
    centre = (F.col("x1") + F.col("x2")) / 2
    return df.where(F.when(arm == "left", centre < reach * width).when(arm == "right", centre >= width - reach * width).otherwise(True))


def strongest(df: DataFrame, by: list[str], k: int = 22) -> DataFrame:
    """The k boxes of most confidence, numbered by ascending confidence (candidate 0 is the weakest)."""
    best = Window.partitionBy(*by).orderBy(F.desc("conf"), "idx")
    kept = df.withColumn("place__", F.row_number().over(best)).where(F.col("place__") <= k).drop("place__")
    return kept.withColumn("cand", F.row_number().over(Window.partitionBy(*by).orderBy("conf", F.desc("idx"))) - 1)


def suppressed(df: DataFrame, by: list[str], threshold: float = 0.6) -> DataFrame:
    """Greedy suppression: by falling confidence a box stays unless it overlaps one that stays by more
    than the threshold. A fold over each group's sorted array, without Python; a group is the
    detections of one image, at most a few hundred."""
    item = F.struct((-F.col("conf")).alias("rank"), "idx", "x1", "y1", "x2", "y2", "conf")
    grouped = df.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))
    keep = F.aggregate("all", none, lambda kept, x: F.when(F.exists(kept, lambda k: iou_of(k, x) > threshold), kept).otherwise(F.concat(kept, F.array(x))))
    return grouped.select(*by, F.explode(keep).alias("b")).select(*by, "b.idx", "b.x1", "b.y1", "b.x2", "b.y2", "b.conf")


def strongest_kept(df: DataFrame, by: list[str], threshold: float = 0.6, k: int = 22, head: int = 880) -> DataFrame:
    """strongest(suppressed(df, by, threshold), by, k) for groups of any size. What a box does to others depends on
    stronger ones only, so the `head` strongest of a group are folded until k stay. Groups in which fewer do go on: what
    overlaps a kept box is gone, and of the rest the strongest come next, behind those kept. Each round keeps one box at
    least of every open group, so that there are k rounds at most, and one where k of the first stay."""
    fields = ("idx", "x1", "y1", "x2", "y2", "conf")
    item = F.struct((-F.col("conf")).alias("rank"), *fields)
    w = Window.partitionBy(*by).orderBy("b__.rank", *(f"b__.{c}" for c in fields))
    none = df.sparkSession.createDataFrame([], df.select(*by, F.array(item).alias("kept__")).schema)
    left, kept, done = df.select(*by, item.alias("b__")), none, []

    def met(rows: DataFrame, kept: DataFrame, how: str) -> DataFrame:
        named = kept.withColumnsRenamed({c: f"{c}__" for c in by})
        return rows.join(named, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"{c}__")) for c in by)), how).drop(*(f"{c}__" for c in by))

    while True:
        # One more than a fold takes tells whether there is a rest.
        first = left.withColumn("n__", F.row_number().over(w)).where(F.col("n__") <= head + 1)
        grouped = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("n__") <= head, F.col("b__")))).alias("all__"), (F.max("n__") > head).alias("more__"))
        grouped = met(grouped, kept, "left") if done else grouped.withColumn("kept__", F.lit(None).cast(none.schema["kept__"].dataType))
        stays = lambda kept, x: F.when((F.size(kept) >= k) | F.exists(kept, lambda y: iou_of(y, x) > threshold), kept).otherwise(F.concat(kept, F.array(x)))
        start = F.coalesce("kept__", F.filter("all__", lambda x: F.lit(False)))
        folded = staged(grouped.select(*by, F.aggregate("all__", start, stays).alias("kept__"), "more__", F.element_at("all__", -1).alias("last__")), "kept")
        unsure = F.col("more__") & (F.size("kept__") < k)
        done.append(folded.where(~unsure).select(*by, "kept__"))
        kept = folded.where(unsure).select(*by, "kept__", "last__")
        if kept.isEmpty():
            break
        left = met(left, kept, "inner").where(F.col("b__") > F.col("last__")).where(~F.exists("kept__", lambda y: iou_of(y, F.col("b__")) > threshold)).select(*by, "b__")
        kept = kept.drop("last__")
    whole = reduce(DataFrame.unionByName, done)
    return strongest(whole.select(*by, F.explode("kept__").alias("b")).select(*by, *(f"b.{c}" for c in fields)), by, k)


def pairs(df: DataFrame, by: list[str]) -> DataFrame:
    """Ordered pairs of different boxes of a group, prefixed i_ and j_. The join has the group's key."""
    cols = ("idx", "x1", "y1", "x2", "y2")
    left = df.select(*by, *(F.col(c).alias(f"i_{c}") for c in cols))
    right = df.select(*by, *(F.col(c).alias(f"j_{c}") for c in cols))
    return left.join(right, by).where("i_idx <> j_idx")


def contained(df: DataFrame, by: list[str], least: float = 0.3) -> DataFrame:
    """(by, inner, outer, ratio): more than `least` of the inner box lies in the larger outer one."""
    i, j = corners("i_"), corners("j_")
    ratio = intersection(i, j) / area(i)
    return (
        pairs(df, by).where((area(i) > 0) & (area(j) > area(i))).withColumn("ratio", ratio).where(F.col("ratio") > least)
        .select(*by, F.col("i_idx").alias("inner"), F.col("j_idx").alias("outer"), "ratio")
    )


def _like(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(1.0)


def _nested_loss(inner: Column, outer: Column, of: Callable, alike: float, factor: float, least: float) -> Column:
    """What the inner of two structs (idx, target, points, movement) loses to the outer one, whose boxes `of` gives."""
    i, j = of(inner), of(outer)
    points, movement = _like(inner["points"], outer["points"]), _like(inner["movement"], outer["movement"])
    nested = (inner["idx"] != outer["idx"]) & (inner["target"] == outer["target"]) & (area(i) > 0) & (area(j) > area(i)) & (intersection(i, j) / area(i) > least)
    meets = nested & (inner["points"] >= 1) & (outer["points"] >= 1) & (points > alike) & (movement > alike)
    return F.when(meets, factor * (points + movement) / 2).otherwise(0.0)


def nested_penalty(boxes: DataFrame, by: list[str], measures: DataFrame, alike: float = 0.5, factor: float = 0.15, least: float = 0.3) -> DataFrame:
    """(by, idx, target, penalty): what a box loses for lying in a larger one that gathers like points
    and moves alike. measures: (by, idx, target, points, movement). A group is the boxes of one image, so both
    sides are an array for each group and meet in one join on the group, with no pair in a shuffle."""
    corner = ("x1", "y1", "x2", "y2")
    held = boxes.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("idx", F.struct(*corner).alias("b")))).alias("boxes__"))
    told = measures.groupBy(*by).agg(F.collect_list(F.struct("idx", "target", "points", "movement")).alias("all__"))
    both = told.join(held, by, "left").withColumn("all__", F.transform("all__", lambda m: m.withField("box", F.try_element_at("boxes__", m["idx"]))))
    loss = lambda inner, outer: _nested_loss(inner, outer, lambda m: tuple(m["box"][c] for c in corner), alike, factor, least)
    worst = lambda inner: F.aggregate("all__", F.lit(0.0), lambda a, outer: F.greatest(a, loss(inner, outer)))
    out = both.select(*by, F.explode(F.transform("all__", lambda m: F.struct(m["idx"].alias("idx"), m["target"].alias("target"), worst(m).alias("penalty")))).alias("m"))
    return out.select(*by, "m.idx", "m.target", "m.penalty")


def nested_penalty_of_crowds(boxes: DataFrame, by: list[str], measures: DataFrame, alike: float = 0.5, factor: float = 0.15, least: float = 0.3, size: int = 128, shares: int = 16) -> DataFrame:
    """As nested_penalty(), for groups of any size. Those that can lose or take stand in blocks of `size` by their
    movement. A box meets its own block and the ones beside it; movement beyond these is less like its own than a bound,
    so that a loss of at least the bound's is the worst. The few without one meet all of their group, dealt over `shares`."""
    cols, keys = ("idx", "target", "points", "movement", "x1", "y1", "x2", "y2"), [*by, "target"]
    able = measures.select(*by, "idx", "target", "points", "movement").join(boxes.select(*by, "idx", "x1", "y1", "x2", "y2"), [*by, "idx"]).where((F.col("points") >= 1) & (area(corners()) > 0))
    w = Window.partitionBy(*keys)
    unknown = F.max(F.col("movement").isNull()).over(w).alias("unknown__")
    placed = staged(able.select(*by, *cols, F.floor((F.row_number().over(w.orderBy("movement", "idx")) - 1) / size).alias("block"), unknown), "nested")
    ends = placed.groupBy(*keys, "block").agg(F.min("movement").alias("lo"), F.max("movement").alias("hi"))
    ends = ends.select(*keys, "block", F.lead("lo", 2).over(w.orderBy("block")).alias("above"), F.lag("hi", 2).over(w.orderBy("block")).alias("below"))
    inner = placed.join(ends, [*keys, "block"]).select(*keys, F.col("block").alias("own"), F.struct(*cols, "unknown__", "above", "below").alias("i"))
    outer = placed.select(*keys, "block", F.struct(*cols).alias("j"))
    loss = _nested_loss(F.col("i"), F.col("j"), lambda m: tuple(m[c] for c in ("x1", "y1", "x2", "y2")), alike, factor, least)

    def worst(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        met = left.join(right, on).select(*by, F.col("i.idx").alias("idx"), F.col("i.target").alias("target"), loss.alias("penalty"))
        return met.where("penalty > 0").groupBy(*by, "idx", "target").agg(F.max("penalty").alias("penalty"))

    flat = inner.select(*keys, F.col("i.idx").alias("idx"), "i")
    near = worst(inner.withColumn("block", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))), outer, [*keys, "block"])
    known = staged(flat.join(near, [*by, "idx", "target"], "left").withColumn("penalty", F.coalesce("penalty", F.lit(0.0))), "nearest")
    far = lambda c: F.when(F.col(c).isNull(), 0.0).otherwise(_like(F.col("i.movement"), F.col(c)))
    bound = F.greatest(far("i.above"), far("i.below"))
    sure = ~F.col("i.unknown__") & ((bound <= alike) | (F.col("penalty") >= factor * (1.0 + bound) / 2))
    share = F.pmod(F.xxhash64("idx"), F.lit(shares))
    open_ = known.where(~sure).drop("penalty", "idx").withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint"))))
    rest = worst(open_, placed.select(*keys, share.alias("share"), F.struct(*cols).alias("j")), [*keys, "share"])
    most = known.select(*by, "idx", "target", "penalty").unionByName(rest).groupBy(*by, "idx", "target").agg(F.max("penalty").alias("penalty"))
    return measures.select(*by, "idx", "target").join(most, [*by, "idx", "target"], "left").withColumn("penalty", F.coalesce("penalty", F.lit(0.0)))


def crop_extent(df: DataFrame, by: list[str], width: int, height: int, pads: tuple[float, float, float] = (0.1, 0.3, 0.1)) -> DataFrame:
    """The region around all boxes of a group in whole pixels, padded by shares of the image at the sides,
    above and below, inside the image."""
    side, above, below = int(width * pads[0]), int(height * pads[1]), int(height * pads[2])
    whole = lambda c: F.floor(c).cast("int")
    return df.groupBy(*by).agg(
        whole(F.greatest(F.lit(0.0), F.min("x1") - side)).alias("left"), whole(F.greatest(F.lit(0.0), F.min("y1") - above)).alias("top"),
        whole(F.least(F.lit(float(width)), F.max("x2") + side)).alias("right"), whole(F.least(F.lit(float(height)), F.max("y2") + below)).alias("bottom"),
    )


def to_original(df: DataFrame, left: Column, top: Column, scale: Column) -> DataFrame:
    """Boxes of the processed image in pixels of the original: add the crop's origin, divide by the scale."""
    return df.withColumns({"x1": (F.col("x1") + left) / scale, "y1": (F.col("y1") + top) / scale, "x2": (F.col("x2") + left) / scale, "y2": (F.col("y2") + top) / scale})


def best_match(boxes: DataFrame, others: DataFrame, by: list[str]) -> DataFrame:
    """(by, idx, best): the most of overlap times confidence that a box has with another set's boxes."""
    left = boxes.select(*by, "idx", *(F.col(c).alias(f"i_{c}") for c in ("x1", "y1", "x2", "y2")))
    right = others.select(*by, F.col("conf").alias("c"), *(F.col(c).alias(f"j_{c}") for c in ("x1", "y1", "x2", "y2")))
    return left.join(right, by).groupBy(*by, "idx").agg(F.max(iou(corners("i_"), corners("j_")) * F.col("c")).alias("best"))


def points_inside(points: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """(by, idx, n_inside): points of a group inside each of its boxes, borders included."""
    hit = (F.col("x") >= F.col("x1")) & (F.col("x") <= F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") <= F.col("y2"))
    return boxes.join(points.select(*by, "x", "y"), by).groupBy(*by, "idx").agg(F.sum(hit.cast("bigint")).alias("n_inside"))


def normalised(box: tuple[Column, ...], width: Column, height: Column, units: int = 1_000) -> tuple[Column, ...]:
    """A box in whole units of the image's sides."""
    sides = (width, height, width, height)
    return tuple(F.floor(v * units / s).cast("int") for v, s in zip(box, sides, strict=True))


def scaled_intrinsics(focal: Column, principal: Column, sx: Column, sy: Column) -> Column:
    """A camera's focal lengths and principal point for a resized image."""
    by = lambda pair: F.array(F.element_at(pair, 1) * sx, F.element_at(pair, 2) * sy)
    return F.struct(by(focal).alias("focal_length"), by(principal).alias("principal_point"))


def fixed_row(values: Column, n: int) -> Column:
    """The first n numbers of a list; n NaNs where it is missing or shorter, so that frames stay aligned."""
    nothing = F.array_repeat(F.lit(float("nan")), n)
    return F.when(F.size(values) >= n, F.slice(values, 1, n).cast("array<double>")).otherwise(nothing)
