"""Annotation lines: reading, gates, the reliability filter, publishing.

Lines are JSON. A bad line is skipped when resuming and merging and fatal when filtering, as users
expect from the tools they know.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME, VERSION = "trailmill.annotation", "2.0"
SCHEMA = (
    "schema struct<name:string,version:string>, trajectory_id string, subtask_index int, start_frame bigint, end_frame_exclusive bigint, "
    "instruction string, error string, selection struct<score:double>, arms array<struct<arm:string,selection:struct<score:double>>>, "
    "arrays struct<storage:struct<path:string,group:string>>"
)
#: What identifies an annotation in a merge: base file first, then node files, then line order.
KEY = ("trajectory_id", "subtask_index", "start_frame", "end_frame_exclusive", "instruction")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, line) of JSON line files; numbers count from 1 within a file. Files are read
    whole by one task each, since a line's number needs all lines before it."""
    lines = F.posexplode(F.split("value", "\n")).alias("number", "line")
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), lines)
    return raw.select("file", (F.col("number") + 1).alias("number"), "line").where(F.trim("line") != "")


def parsed(lines: DataFrame, line: str) -> DataFrame:
    """Lines with their content as a struct `row`; fields of another type are null."""
    return lines.withColumn("row", F.from_json(line, SCHEMA, {"allowNonNumericNumbers": "true"}))


def malformed(line: Column) -> Column:
    """Whether a line is not a JSON object."""
    return F.from_json(line, "map<string,string>", {"allowNonNumericNumbers": "true"}).isNull()


def passes(score: Column, threshold: float) -> Column:
    return F.coalesce(score.isNotNull() & ~F.isnan(score) & (score < float("inf")) & (score >= threshold), F.lit(False))


def reliable(rows: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Annotations whose every arm's score, or else own score, is a finite number of at least the threshold."""
    arms = F.col("row.arms")
    every = F.forall(arms, lambda a: passes(a["selection"]["score"], threshold))
    return rows.where(F.when(F.size(arms) > 0, every).otherwise(passes(F.col("row.selection.score"), threshold)))


def published(rows: DataFrame, strict: bool = False, name: str = NAME, version: str = VERSION) -> DataFrame:
    """Rows of a published schema, our own or another's; others go, or raise where the gate is strict."""
    good = F.coalesce((F.col("row.schema.name") == name) & (F.col("row.schema.version") == version), F.lit(False))
    if strict:
        good = F.when(good, True).otherwise(F.raise_error(F.lit("unsupported annotation schema")).cast("boolean"))
    return rows.where(good)


def rebased(lines: DataFrame, line: str, prefix: str) -> DataFrame:
    """Lines whose relative array path is written from another folder: the prefix goes before it."""
    path = F.get_json_object(line, "$.arrays.storage.path")
    moved = F.replace(F.col(line), F.concat(F.lit('"path":"'), path, F.lit('"')), F.concat(F.lit(f'"path":"{prefix}'), path, F.lit('"')))
    return lines.withColumn(line, F.when(path.isNotNull() & ~F.startswith(path, F.lit("/")), moved).otherwise(F.col(line)))


def filter_file(spark: SparkSession, path: str, out: str, threshold: float = 0.95) -> tuple[int, int]:
    """Writes the reliable lines of a file, unchanged; (kept, total). A malformed line stops with its
    number before anything is written, and an existing output is never overwritten."""
    rows = parsed(read_lines(spark, path), "line")
    total, first = rows.agg(F.count("*"), F.min(F.when(malformed(F.col("line")), F.col("number")))).first()
    if first is not None:
        raise ValueError(f"line {first} is not a JSON object")
    kept = reliable(rows, threshold).orderBy("file", "number").select("line")
    kept.write.mode("errorifexists").text(out)
    return spark.read.text(out).count(), total


def resumable(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Trajectories that are done: bad lines and rows with an error do not count."""
    rows = None
    for path in paths:
        part = parsed(read_lines(spark, path), "line").where(~malformed(F.col("line")))
        rows = part if rows is None else rows.unionAll(part)
    return published(rows, strict=True).where("row.error is null").select("row.trajectory_id").where("trajectory_id <> ''").distinct()


def merge_files(spark: SparkSession, base: str, nodes: list[str]) -> DataFrame:
    """Lines of the base file and the node files, each annotation once."""
    from ..operators.relational import merged

    parts = []
    for path in [base, *nodes]:
        rows = published(parsed(read_lines(spark, path), "line").where(~malformed(F.col("line"))), strict=True)
        parts.append(rows.select(*(F.col(f"row.{k}").alias(k) for k in KEY), "file", "number", "line"))
    return merged(parts, list(KEY), ["file", "number"]).select("file", "number", "line")


def annotation_rows(arms: DataFrame, trajectory: str, score: str) -> DataFrame:
    """(trajectory, line): one published JSON row for each trajectory, with its arms; nulls are left out."""
    arm = F.struct(F.struct(F.col(score).alias("score")).alias("selection"))
    schema = F.struct(F.lit(NAME).alias("name"), F.lit(VERSION).alias("version"))
    grouped = arms.groupBy(trajectory).agg(F.array_sort(F.collect_list(arm)).alias("arms"))
    return grouped.select(trajectory, F.to_json(F.struct(schema.alias("schema"), F.col(trajectory), "arms")).alias("line"))
