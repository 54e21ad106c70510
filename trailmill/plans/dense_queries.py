"""Queries of dense operators, over arrays made from the embeddings: each vector gives 32 points on a small image."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dense_stages as ds
from .registry import query, table

SIDE = 24
#: Whole coordinates of the i-th number of a vector, and points 0 to 31 of each.
CELLS = f"""e AS (SELECT vec_id, i, CAST(floor(abs(CAST(embedding[2 * i + 1] AS DOUBLE)) * 1000) AS BIGINT) % {SIDE} AS x, CAST(floor(abs(CAST(embedding[2 * i + 2] AS DOUBLE)) * 1000) AS BIGINT) % {SIDE} AS y FROM embeddings, (SELECT unnest(range(32)) AS i))"""


def _coordinate(v):
    return (F.floor(F.abs(v.cast("double")) * 1000) % SIDE).cast("double")


def _vectors(spark, sf_dir):
    """(vec_id, mine, other): the first and the last 16 points of each vector, x and y in turn."""
    whole = F.transform("embedding", _coordinate)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.slice(whole, 1, 32).alias("mine"), F.slice(whole, 33, 32).alias("other"))


def _mask(points: str):
    bounds = F.array(*(F.lit(float(x)) for x in (0, 0, SIDE - 1, SIDE - 1)))
    return ds.rasterised(F.col(points), bounds, SIDE)


@query("q_point_in_mask", f"WITH {CELLS}, m AS (SELECT DISTINCT vec_id, x, y FROM e WHERE i < 16) SELECT o.vec_id, avg(CASE WHEN m.x IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM e o LEFT JOIN m ON m.vec_id = o.vec_id AND m.x = o.x AND m.y = o.y WHERE o.i >= 16 GROUP BY o.vec_id")
def point_in_mask(spark, sf_dir):
    """Share of points on the mask that other points make."""
    v = _vectors(spark, sf_dir).withColumn("mask", _mask("mine"))
    return v.select("vec_id", ds.share_inside(F.col("other"), F.col("mask")).alias("share"))


@query("q_mask_box", f"WITH {CELLS} SELECT vec_id, CAST(min(x) AS INTEGER) AS x1, CAST(min(y) AS INTEGER) AS y1, CAST(max(x) AS INTEGER) AS x2, CAST(max(y) AS INTEGER) AS y2, count(DISTINCT x * 100 + y) AS n FROM e WHERE i < 16 GROUP BY vec_id")
def mask_box(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("mask", _mask("mine"))
    v = v.select("vec_id", ds.mask_box(F.col("mask")).alias("b"), ds.n_set(F.col("mask")).alias("n"))
    return v.select("vec_id", *(F.col("b")[k].alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))), "n")


@query("q_mask_dilate", f"WITH {CELLS}, d AS (SELECT a.d AS dx, b.d AS dy FROM (SELECT unnest([-2,-1,0,1,2]) AS d) a, (SELECT unnest([-2,-1,0,1,2]) AS d) b WHERE a.d * a.d + b.d * b.d <= 4), p AS (SELECT DISTINCT vec_id, x + dx AS x, y + dy AS y FROM e, d WHERE i < 16) SELECT vec_id, count(*) AS n FROM p WHERE x >= 0 AND y >= 0 AND x < {SIDE} AND y < {SIDE} GROUP BY vec_id")
def mask_dilate(spark, sf_dir):
    """Pixels within two of a set one."""
    v = _vectors(spark, sf_dir).withColumn("mask", _mask("mine"))
    return v.select("vec_id", ds.n_set(ds.dilated(F.col("mask"), 2)).alias("n"))


@query(
    "q_mask_components",
    f"""WITH RECURSIVE {CELLS}, c AS (SELECT DISTINCT vec_id, x, y FROM e WHERE i < 16), n AS (SELECT vec_id, x, y, x * 100 + y AS id FROM c), l AS (SELECT a.vec_id, a.id AS a, b.id AS b FROM n a JOIN n b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
 r AS (SELECT vec_id, a, b FROM l UNION SELECT r.vec_id, r.a, l.b FROM r JOIN l ON l.vec_id = r.vec_id AND l.a = r.b), m AS (SELECT vec_id, a, min(b) AS root FROM r GROUP BY vec_id, a) SELECT vec_id, CAST(count(DISTINCT root) AS INTEGER) AS n FROM m GROUP BY vec_id""",
)
def mask_components(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("mask", _mask("mine"))
    return v.select("vec_id", ds.n_components(F.col("mask")).alias("n"))


@query("q_united_masks", f"WITH {CELLS} SELECT vec_id, count(DISTINCT x * 100 + y) AS n FROM e GROUP BY vec_id")
def united_masks(spark, sf_dir):
    """The masks of two arms in one."""
    v = _vectors(spark, sf_dir)
    arms = v.select("vec_id", _mask("mine").alias("mask")).unionByName(v.select("vec_id", _mask("other").alias("mask")))
    return ds.united(arms, ["vec_id"]).select("vec_id", ds.n_set(F.col("mask")).alias("n"))


@query(
    "q_restored_mask",
    f"""WITH {CELLS}, c AS (SELECT DISTINCT vec_id, x, y FROM e WHERE i < 16), o AS (SELECT r.r, k.k, r.r * 50 // 40 AS cr, k.k * 60 // 48 AS ck FROM (SELECT unnest(range(40)) AS r) r, (SELECT unnest(range(48)) AS k) k),
 s AS (SELECT (cr - 5) * {SIDE} // 40 AS y, (ck - 10) * {SIDE} // 45 AS x FROM o WHERE cr >= 5 AND cr < 45 AND ck >= 10 AND ck < 55) SELECT vec_id, count(*) AS n FROM c JOIN s ON s.x = c.x AND s.y = c.y GROUP BY vec_id""",
)
def restored_mask(spark, sf_dir):
    """A mask of a crop of the scaled image, on the image itself: pixels that are set there."""
    crop, scale = F.array(*map(F.lit, (10, 5, 55, 45))), F.array(F.lit(1.25), F.lit(1.25))
    v = _vectors(spark, sf_dir).withColumn("mask", _mask("mine"))
    v = v.select("vec_id", ds.n_set(ds.restored(F.col("mask"), 40, 48, crop, scale)).alias("n"))
    return v.where("n > 0")


@query(
    "q_farthest_points",
    f"""WITH {CELLS}, p AS (SELECT vec_id, i, x, y FROM e WHERE i < 16), a AS (SELECT p.*, pow(p.x - o.x, 2) + pow(p.y - o.y, 2) AS d FROM p JOIN p o ON o.vec_id = p.vec_id AND o.i = 0),
 s AS (SELECT vec_id, arg_max(i, d * 100 - i) AS i1 FROM a GROUP BY vec_id), b AS (SELECT a.vec_id, a.i, s.i1, least(a.d, pow(a.x - q.x, 2) + pow(a.y - q.y, 2)) AS d FROM a JOIN s ON s.vec_id = a.vec_id JOIN p q ON q.vec_id = a.vec_id AND q.i = s.i1)
 SELECT vec_id, CAST(min(i1) AS INTEGER) AS second, CAST(arg_max(i, d * 100 - i) AS INTEGER) AS third FROM b GROUP BY vec_id""",
)
def farthest_points(spark, sf_dir):
    """Of 16 points the one farthest from the first, and the one farthest from both; the first of equals."""
    v = _vectors(spark, sf_dir).select("vec_id", ds.farthest_points(F.col("mine"), 3).alias("at"))
    return v.select("vec_id", F.col("at")[1].alias("second"), F.col("at")[2].alias("third"))


@query("q_mask_points", f"WITH {CELLS}, c AS (SELECT DISTINCT vec_id, x, y FROM e WHERE i < 16) SELECT vec_id, string_agg(x || ':' || y, ',' ORDER BY y, x) AS points FROM c GROUP BY vec_id")
def mask_points(spark, sf_dir):
    """A mask of few pixels gives them all, in reading order."""
    v = _vectors(spark, sf_dir).withColumn("p", ds.mask_points(_mask("mine"), 32))
    pairs = F.transform(F.sequence(F.lit(0), (F.floor(F.size("p") / 2) - 1).cast("int")), lambda i: F.concat_ws(":", *(F.col("p")[(2 * i + k).cast("int")].cast("bigint").cast("string") for k in (0, 1))))
    return v.select("vec_id", F.array_join(pairs, ",").alias("points"))


@query("q_grid_points", "WITH b AS (SELECT grp, idx, CAST(x1 AS BIGINT) AS x, CAST(y1 AS BIGINT) AS y, CAST(x2 AS BIGINT) - CAST(x1 AS BIGINT) AS w, CAST(y2 AS BIGINT) - CAST(y1 AS BIGINT) AS h FROM v_boxes) SELECT grp, idx, CAST(floor(x + 0.2 * w) AS DOUBLE) AS fx, CAST(floor(y + 0.2 * h) AS DOUBLE) AS fy, CAST(floor(x + w - 0.2 * w) AS DOUBLE) AS lx, CAST(floor(y + h - 0.2 * h) AS DOUBLE) AS ly FROM b")
def grid_points(spark, sf_dir):
    """The outer corners of a grid of three by three points in every box."""
    from .registry import boxes

    b = boxes(spark, sf_dir).withColumn("p", ds.grid_points(F.array("x1", "y1", "x2", "y2"), 3))
    return b.select("grp", "idx", *(F.element_at("p", k).alias(c) for k, c in ((1, "fx"), (2, "fy"), (-2, "lx"), (-1, "ly"))))


@query("q_tracked_box", f"WITH {CELLS}, b AS (SELECT vec_id, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM e WHERE i < 16 GROUP BY vec_id) SELECT vec_id, CAST(x1 + vec_id % 7 AS DOUBLE) AS x1, CAST(y1 + 3 AS DOUBLE) AS y1, CAST(x2 + vec_id % 7 AS DOUBLE) AS x2, CAST(y2 + 3 AS DOUBLE) AS y2 FROM b")
def tracked_box(spark, sf_dir):
    """Boxes whose points all move by one shift, but for a few that are lost or jump."""
    v = _vectors(spark, sf_dir).withColumn("mask", _mask("mine")).withColumn("b", ds.mask_box(F.col("mask")))
    box = F.array(F.col("b")[0], F.col("b")[1], F.col("b")[2] + 1, F.col("b")[3] + 1).cast("array<double>")
    moved = F.transform("mine", lambda x, i: x + F.when(i % 2 == 1, F.lit(3)).otherwise(F.col("vec_id") % 7) + F.when(i.isin(4, 12), F.lit(40)).otherwise(0))
    seen = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: i % 5 != 4)
    out = v.select("vec_id", ds.tracked_box(box, F.col("mine"), moved, seen, 200, 200)["box"].alias("m"))
    return out.select("vec_id", *(F.round(F.col("m")[k], 6).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))))


@query(
    "q_without_outliers",
    f"""WITH {CELLS}, p AS (SELECT vec_id, i, x + CASE WHEN i = 3 THEN 500 ELSE 0 END AS x, y FROM e WHERE i < 16), d AS (SELECT a.vec_id, a.i, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM p a JOIN p b ON b.vec_id = a.vec_id AND b.i <> a.i),
 k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, i ORDER BY d) AS n FROM d), m AS (SELECT vec_id, i, avg(d) AS away FROM k WHERE n <= 5 GROUP BY vec_id, i), l AS (SELECT vec_id, avg(away) + 2 * stddev_pop(away) AS most FROM m GROUP BY vec_id) SELECT m.vec_id, CAST(count(*) AS INTEGER) AS n FROM m JOIN l ON l.vec_id = m.vec_id WHERE away <= most GROUP BY m.vec_id""",
)
def without_outliers(spark, sf_dir):
    """Clouds of 16 points of which one lies far away."""
    cloud = F.transform("mine", lambda x, i: x + F.when(i == 6, 500.0).otherwise(0.0))
    return _vectors(spark, sf_dir).select("vec_id", (F.size(ds.without_outliers(cloud, 5, 2.0, 2)) / 2).cast("int").alias("n"))


@query("q_oriented_extents", "WITH a AS (SELECT vec_id, i, abs(CAST(embedding[i + 1] AS DOUBLE)) * 100 + 50 AS a, abs(CAST(embedding[i + 11] AS DOUBLE)) * 10 + 1 AS b FROM embeddings, (SELECT unnest(range(10)) AS i)), p AS (SELECT vec_id, a AS x, 0.0::DOUBLE AS y FROM a UNION ALL SELECT vec_id, a, 0.0 FROM a UNION ALL SELECT vec_id, 0.0, b FROM a UNION ALL SELECT vec_id, 0.0, b FROM a) SELECT vec_id, round(quantile_cont(x, 0.8), 6) AS major, round(quantile_cont(y, 0.8), 6) AS minor FROM p GROUP BY vec_id")
def oriented_extents(spark, sf_dir):
    """Clouds on two axes, each point with its mirror image, so that the principal axes are known."""
    e, zero = F.col("embedding"), F.lit(0.0)
    point = lambda x, y: F.array(x, y, zero)
    a = lambda i: F.abs(e[i].cast("double")) * 100 + 50
    b = lambda i: F.abs(e[i + 10].cast("double")) * 10 + 1
    parts = [F.transform(F.sequence(F.lit(0), F.lit(9)), f) for f in (lambda i: point(a(i), zero), lambda i: point(-a(i), zero), lambda i: point(zero, b(i)), lambda i: point(zero, -b(i)))]
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.flatten(F.concat(*parts)).alias("p"))
    out = v.select("vec_id", ds.oriented_extents(F.col("p")).alias("x"))
    return out.select("vec_id", F.round(F.col("x")[0], 6).alias("major"), F.round(F.col("x")[1], 6).alias("minor"))


@query(
    "q_grid_overlap",
    f"""WITH {CELLS}, b AS (SELECT vec_id, min(x) - 4 AS lx, min(y) - 4 AS ly, max(x) + 4 AS hx, max(y) + 4 AS hy FROM e GROUP BY vec_id),
 c AS (SELECT e.vec_id, i, CAST(round_even((x - lx) * 31 / CAST(hx - lx AS DOUBLE), 0) AS BIGINT) AS x, CAST(round_even((y - ly) * 31 / CAST(hy - ly AS DOUBLE), 0) AS BIGINT) AS y FROM e JOIN b ON b.vec_id = e.vec_id)
 SELECT o.vec_id, avg(CASE WHEN EXISTS (SELECT 1 FROM c g WHERE g.vec_id = o.vec_id AND g.i < 16 AND pow(g.x - o.x, 2) + pow(g.y - o.y, 2) <= 4) THEN 1.0 ELSE 0.0 END) AS share FROM c o WHERE o.i >= 16 GROUP BY o.vec_id""",
)
def grid_overlap(spark, sf_dir):
    """Share of a candidate's points near those of the gripper, on a grid over both."""
    v = _vectors(spark, sf_dir)
    return v.select("vec_id", ds.grid_overlap(F.col("mine"), F.col("other"), F.array().cast("array<double>"), 32).alias("share"))


@query(
    "q_closure_signals",
    """WITH f AS (SELECT label AS traj, vec_id AS t, list_transform(embedding[1:18], lambda v: CAST(v AS DOUBLE)) AS e, vec_id % 5 > 0 AS seen FROM embeddings), d AS (SELECT traj, t, e, seen, k, sqrt(pow(e[3 * k + 1] - e[16], 2) + pow(e[3 * k + 2] - e[17], 2) + pow(e[3 * k + 3] - e[18], 2)) AS span,
 sqrt(pow(e[3 * k + 1] - e[1], 2) + pow(e[3 * k + 2] - e[2], 2) + pow(e[3 * k + 3] - e[3], 2)) AS apart FROM f, (SELECT unnest(range(5)) AS k)), s AS (SELECT traj, quantile_cont(span, 0.95) FILTER (seen) AS scale FROM d GROUP BY traj)
 SELECT d.traj, d.t, CASE WHEN bool_and(seen) THEN round(min(apart) FILTER (k > 0) / min(scale), 6) END AS thumb_min, CASE WHEN bool_and(seen) THEN round(avg(apart) FILTER (k > 0) / min(scale), 6) END AS thumb_mean, CASE WHEN bool_and(seen) THEN round(avg(span) FILTER (k > 0) / min(scale), 6) END AS curl FROM d JOIN s ON s.traj = d.traj GROUP BY d.traj, d.t""",
)
def closure_signals(spark, sf_dir):
    """Fingertips and wrists from the vectors' numbers; every fifth frame the hand was not seen."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    f = table(spark, sf_dir, "embeddings").select(F.col("label").alias("traj"), F.col("vec_id").alias("t"), F.slice(e, 1, 15).alias("tips"), F.slice(e, 16, 3).alias("wrist"), (F.col("vec_id") % 5 > 0).alias("seen"))
    return ds.closure_signals(f, "traj", "t", "tips", "wrist", "seen").select("traj", "t", *(F.round(c, 6).alias(c) for c in ("thumb_min", "thumb_mean", "curl")))
