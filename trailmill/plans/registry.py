"""Named queries with their SQL twins, and the projections of tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; its SQL may use the projections below by name."""

    def register(function):
        QUERIES[name] = function
        if sql:
            used = [text for view, text in VIEWS.items() if view in sql]
            body = sql.strip()
            head = next((h for h in ("WITH RECURSIVE ", "WITH ") if body.startswith(h)), "")
            own = [body[len(head) :]] if head else []
            ORACLES[name] = (head or "WITH ") + ", ".join(used + own) + ("" if head else " " + body) if used else body
        return function

    return register


#: Frames of trajectories: one for each event of a user. Boxes: one for each line of an order.
#: Tracks: 16 frames of two points for each vector.
VIEWS = {
    "v_frames": """v_frames AS (SELECT user_id AS traj, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t,
 value AS signal, event_type AS label, event_id, props FROM events)""",
    "v_boxes": """v_boxes AS (SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY x1, y1, x2, y2, conf) - 1 AS BIGINT) AS idx, x1, y1, x2, y2, conf FROM
 (SELECT l_orderkey AS grp, CAST(l_partkey % 97 AS DOUBLE) AS x1, CAST(l_suppkey % 61 AS DOUBLE) AS y1, CAST(l_partkey % 97 + 5 AS DOUBLE) + l_quantity AS x2,
 CAST(l_suppkey % 61 + 5 + l_partkey % 40 AS DOUBLE) AS y2, l_extendedprice / 105000.0 AS conf FROM lineitem))""",
    "v_timeline": """v_timeline AS (SELECT 0 AS traj, event_id AS t, value AS signal, event_type AS label FROM events)""",
    "v_tracks": """v_tracks AS (SELECT vec_id AS cand, label AS traj, CAST(i // 2 AS BIGINT) AS t, CAST(i % 2 AS BIGINT) AS pt, CAST(embedding[2 * i + 1] AS DOUBLE) AS x,
 CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, (SELECT unnest(range(32)) AS i))""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("traj"), place.cast("bigint").alias("t"), F.col("value").alias("signal"), F.col("event_type").alias("label"), "event_id", "props"
    )


def spans(spark: SparkSession, sf_dir: str, length: int) -> DataFrame:
    """(traj, t, event_id) of stretches of `length` frames: their first frame and its event."""
    f = frames(spark, sf_dir)
    return f.groupBy("traj", F.floor(F.col("t") / length)).agg(F.min("t").alias("t"), F.min_by("event_id", "t").alias("event_id"), F.min_by("label", "t").alias("label")).select("traj", "t", "event_id", "label")


def spans_sql(length: int) -> str:
    return f"(SELECT traj, min(t) AS t, arg_min(event_id, t) AS event_id, arg_min(label, t) AS label FROM v_frames GROUP BY traj, t // {length})"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("grp"),
        (F.col("l_partkey") % 97).cast("double").alias("x1"),
        (F.col("l_suppkey") % 61).cast("double").alias("y1"),
        ((F.col("l_partkey") % 97 + 5).cast("double") + F.col("l_quantity")).alias("x2"),
        (F.col("l_suppkey") % 61 + 5 + F.col("l_partkey") % 40).cast("double").alias("y2"),
        (F.col("l_extendedprice") / 105000.0).alias("conf"),
    )
    place = F.row_number().over(Window.partitionBy("grp").orderBy("x1", "y1", "x2", "y2", "conf")) - 1
    return raw.select("grp", place.cast("bigint").alias("idx"), "x1", "y1", "x2", "y2", "conf")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    return vectors.select(
        F.col("vec_id").alias("cand"),
        F.col("label").alias("traj"),
        F.floor(F.col("i") / 2).alias("t"),
        (F.col("i") % 2).cast("bigint").alias("pt"),
        F.col("embedding")[2 * F.col("i")].cast("double").alias("x"),
        F.col("embedding")[2 * F.col("i") + 1].cast("double").alias("y"),
    )
