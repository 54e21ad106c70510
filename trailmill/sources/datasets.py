"""Dataset sources: columnar demonstration datasets as tables of tasks, episodes and frames.

A dataset is a folder: meta/info.json, meta/tasks.jsonl (or tasks.parquet), meta/episodes/chunk-*/file*.parquet
with one row for each episode, data/**.parquet with one for each frame. What differs between
datasets is a Spec; no source has code of its own.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gripper:
    """Where the gripper's signal is and how it becomes 0 closed, 1 open."""

    source: str = "action"
    index: int = -1
    transform: str = "identity"


@dataclass(frozen=True)
class Spec:
    """A dataset's peculiarities: cameras by preference, grippers by arm, labels to skip."""

    name: str
    cameras: tuple[str, ...] = ()
    grippers: tuple[Gripper, ...] = (Gripper(),)
    skip_labels: tuple[str, ...] = ()
    per_episode_files: bool = False
    episode_view_choice: tuple[str, ...] = ()


# Presets by dataset.
PRESETS = {
    "bridge": Spec("bridge", ("observation.images.image_0", "observation.images.image_1"), (Gripper("observation.state", -1),)),
    "droid": Spec("droid", ("observation.images.exterior_1_left", "observation.images.exterior_2_left"), (Gripper("observation.state", -1, "invert"),)),
    "vla_arena": Spec("vla_arena", ("image",), (Gripper("action", -1, "neg1open_pos1close_to_01"),), per_episode_files=True),
    "robomind2": Spec("robomind2", (), (Gripper("puppet_left", -1), Gripper("puppet_right", -1)), episode_view_choice=("front", "left")),
    "agibot": Spec("agibot", ("observation.images.head",), (Gripper("observation.effector", 1, "invert"), Gripper("observation.effector", 2, "invert"))),
    "galaxea": Spec("galaxea", ("observation.images.head_rgb",), (Gripper("observation.left_gripper"), Gripper("observation.right_gripper")), ("unqualified", "qualified", "null", "")),
    "robocoin": Spec("robocoin", ("observation.images.cam_high_rgb",), (Gripper("gripper_open_scale_state", 1), Gripper("gripper_open_scale_state", 2)), ("null", "end", "abnormal", "static")),
}


def transformed(value: Column, transform: str, by: list[str]) -> Column:
    """A gripper signal as 0 closed, 1 open."""
    match transform.lower():
        case "identity" | "open01":
            return value
        case "invert" | "close01":
            return 1 - value
        case "neg1pos1_to_01" | "minus1_plus1_to_01":
            return (value + 1) / 2
        case "neg1open_pos1close_to_01" | "minus1_open_plus1_close_to_01":
            return (1 - value) / 2
        case "normalize":
            w = Window.partitionBy(*by)
            low, high = F.min(value).over(w), F.max(value).over(w)
            return F.when(high - low < 1e-8, 0.0).otherwise((value - low) / (high - low))
    raise ValueError(f"unknown gripper transform {transform!r}")


def info(spark: SparkSession, root: str) -> dict:
    """The dataset's description: chunk size, frames per second, cameras, path templates."""
    lines = spark.read.text(f"{root}/meta/info.json", wholetext=True).collect()
    raw = json.loads(lines[0]["value"])
    cameras = [k for k, v in raw.get("features", {}).items() if isinstance(v, dict) and v.get("dtype") in ("video", "image")]
    return {"chunk_size": int(raw.get("chunks_size", raw.get("chunk_size", 1000))), "fps": float(raw.get("fps", 30.0)), "cameras": cameras, "video_path": raw.get("video_path"), "data_path": raw.get("data_path")}


def tasks(spark: SparkSession, root: str, as_table: bool = False) -> DataFrame:
    """(task_index, task), from lines with either of two spellings, or from a table in one of three layouts."""
    if not as_table:
        raw = spark.read.schema("task_index bigint, id bigint, task string, instruction string").json(f"{root}/meta/tasks.jsonl")
        return raw.select(F.coalesce("task_index", "id").alias("task_index"), F.coalesce("task", "instruction").alias("task")).where("task_index is not null")
    raw = spark.read.parquet(f"{root}/meta/tasks.parquet")
    text = next(c for c in ("task", "__index_level_0__", raw.columns[-1]) if c in raw.columns)
    if "task_index" in raw.columns:
        return raw.select(F.col("task_index").cast("bigint"), F.col(text).alias("task"))
    # A table of tasks is a small dimension; its rows are numbered as they lie in its files.
    place = raw.select(F.col(text).alias("task"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    return place.select((F.row_number().over(Window.orderBy("f", "i")) - 1).cast("bigint").alias("task_index"), "task")


def chosen_camera(available: list[str], preferred: str | None = None, priority: tuple[str, ...] = ()) -> str | None:
    """The preferred camera if there is one, else the first of the priority, else the first of all."""
    for camera in (preferred, *priority):
        if camera in available:
            return camera
    return available[0] if available else preferred


def episodes(spark: SparkSession, root: str, about: dict, task_map: DataFrame | None = None) -> DataFrame:
    """The episode index: key, chunk, source id, task, and where each camera's video and the data lie.
    Columns that a dataset lacks are null; unreadable files are skipped."""
    raw = spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", True).parquet(f"{root}/meta/episodes/chunk-*")
    raw = raw.withColumn("chunk_idx", F.regexp_extract(F.col("_metadata.file_path"), r"chunk-(\d+)", 1).cast("bigint"))
    have = lambda c, kind: F.col(f"`{c}`").cast(kind) if c in raw.columns else F.lit(None).cast(kind)
    sources = [
        F.struct(F.lit(c).alias("camera"), have(f"videos/{c}/chunk_index", "bigint").alias("chunk"), have(f"videos/{c}/file_index", "bigint").alias("file"), F.coalesce(have(f"videos/{c}/from_timestamp", "double"), F.lit(0.0)).alias("from_ts"))
        for c in about["cameras"]
    ]
    first = F.try_element_at(F.col("tasks"), F.lit(1)).cast("string") if "tasks" in raw.columns else F.lit(None).cast("string")
    out = raw.select(
        F.format_string("%d/%d", "chunk_idx", F.col("episode_index").cast("bigint")).alias("trajectory_id"),
        F.col("episode_index").cast("bigint"), "chunk_idx", have("uuid", "string").alias("source_uuid"),
        F.coalesce(have("task_index", "bigint"), first.try_cast("bigint")).alias("task_index"), first.alias("task_text"),
        F.array(*sources).alias("videos") if sources else F.lit(None).alias("videos"),
        F.coalesce(have("data/chunk_index", "bigint"), F.col("chunk_idx")).alias("data_chunk"),
        F.coalesce(have("data/file_index", "bigint"), F.floor(F.col("episode_index") / about["chunk_size"])).alias("data_file"),
    )
    if task_map is None:
        return out
    from ..operators.relational import looked_up

    return looked_up(out, task_map, [("task_index", "task_index"), ("task_text", "task")], "task", "task")


def frames(spark: SparkSession, root: str, spec: Spec, schema: str | None = None) -> DataFrame:
    """Frames with a gripper column for each arm. With an explicit schema, columns that a file lacks are null."""
    reader = spark.read.schema(schema) if schema else spark.read
    raw = reader.option("recursiveFileLookup", True).parquet(f"{root}/data")
    if spec.per_episode_files and "episode_index" not in raw.columns:
        raw = raw.withColumn("episode_index", F.regexp_extract(F.col("_metadata.file_path"), r"episode_(\d+)", 1).cast("bigint"))
    for k, g in enumerate(spec.grippers):
        value = F.col(f"`{g.source}`")
        if dict(raw.dtypes)[g.source].startswith("array"):
            value = F.try_element_at(value, F.lit(g.index))
        raw = raw.withColumn(f"gripper_{k}", transformed(value.cast("double"), g.transform, ["episode_index"]))
    return raw


def video_frame(timestamp: Column, from_ts: Column, fps: Column, n_frames: Column) -> Column:
    """The video frame at a time, rounded half to even and kept inside the video."""
    return F.greatest(F.least(F.rint((timestamp + from_ts) * fps), n_frames - 1), F.lit(0)).cast("bigint")


def united(parts: dict[str, DataFrame]) -> DataFrame:
    """Several datasets as one: column `dataset`, columns that one lacks are null, keys prefixed."""
    out = None
    for name, df in sorted(parts.items()):
        named = df.withColumn("dataset", F.lit(name))
        if "trajectory_id" in named.columns:
            named = named.withColumn("trajectory_id", F.concat_ws("/", "dataset", "trajectory_id"))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def leaves(spark: SparkSession, root: str, subset: list[str] | None = None) -> list[str]:
    """Paths below the root of all datasets in a tree: folders with meta/info.json, in natural text order; or the
    named ones. Read by Spark, so from any store."""
    if subset:
        return sorted(dict.fromkeys(subset))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "info.json").load(root).select("path")
    full = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = full.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(full).toUri().getPath().rstrip("/")
    below = F.regexp_extract(F.regexp_replace("path", "^[A-Za-z0-9+.-]+:(//[^/]*)?", ""), f"^\\Q{base}\\E/?(.*?)/?meta/info\\.json$", 1)
    return sorted(r[0] for r in found.where(F.col("path").endswith("/meta/info.json")).select(below).collect())


def tree(spark: SparkSession, root: str, name: str, read, subset: list[str] | None = None) -> DataFrame:
    """Every dataset of a tree as one table: read(spark, folder) for each leaf, with its path below the root in
    `dataset` and in front of its keys. Leaves that can't be read are left out, as long as one can."""
    parts, failed = {}, None
    for leaf in leaves(spark, root, subset):
        try:
            parts[f"{name}/{leaf}" if leaf else name] = read(spark, f"{root.rstrip('/')}/{leaf}".rstrip("/"))
        except (AnalysisException, LookupError, ValueError) as error:  # a leaf of another layout; a lost executor is no such thing
            failed = error
    if not parts:
        raise ValueError(f"no dataset below {root} can be read") from failed
    return united(parts)


def label_segments(frames: DataFrame, by: list[str], label: str, skip: tuple[str, ...]) -> DataFrame:
    """Segments of equal labels, without those to skip and those that only drive."""
    from ..functions.text import is_body_motion, is_navigation
    from ..operators.sequences import runs

    low = F.lower(F.trim(F.col(label)))
    return runs(frames, by, "frame_index", label).where(F.col(label).isNotNull() & ~low.isin(*skip) & ~is_navigation(F.col(label)) & ~is_body_motion(F.col(label)))


def clip_segments(episodes: DataFrame, least: float, most: float, stride: int, pad_seconds: float, fps: float) -> DataFrame:
    """Segments listed in an episode (instruction_segments), of a fit duration and with an instruction,
    with a padded window and their place on the decimated clip."""
    seg = episodes.select("*", F.explode("instruction_segments").alias("s")).select(*(c for c in episodes.columns if c != "instruction_segments"), "s.*")
    fit = seg.where(F.col("duration_seconds").between(least, most) & (F.trim("instruction") != ""))
    pad = max(0, round(pad_seconds * fps))
    return fit.withColumns({
        "window_start": F.greatest(F.col("start_frame") - pad, F.lit(0)), "window_end": F.col("end_frame") + pad,
        "clip_start": F.floor(F.col("start_frame") / stride), "clip_end": F.ceil(F.col("end_frame") / stride),
    })


def mixture(sets: list[str] | list[dict]) -> list[str]:
    """Names of a mixture's datasets in order, each once. Mixtures are data, never code to run."""
    names = [s if isinstance(s, str) else s["name"] for s in sets]
    return list(dict.fromkeys(names))


def cached_index(spark: SparkSession, folder: str, name: str, subset: list[str], build) -> DataFrame:
    """An index as a table of its own, keyed by the dataset and the names of its subset; built if it is missing.
    It is built aside and moved into place whole: of two builders one wins, and what one left that died is no index."""
    import hashlib
    import uuid

    path = f"{folder}/{name}-{hashlib.sha256(','.join(sorted(subset)).encode()).hexdigest()[:10]}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    place, aside = hadoop.Path(path), hadoop.Path(f"{path}.building-{uuid.uuid4().hex}")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    done = hadoop.Path(path, "_SUCCESS")
    if not system.exists(done):
        if system.exists(place):
            system.delete(place, True)
        build().write.parquet(aside.toString())
        if not system.rename(aside, place) and not system.exists(done):
            raise OSError(f"the index can't be moved to {path}")
        if system.exists(aside):
            system.delete(aside, True)
    return spark.read.parquet(path)
