"""Array bundles: named arrays of an annotation in a map of packed tensors, or in a text archive."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dense import HALF, packed_arrays, unpacked_arrays

TENSOR = "struct<dtype:string,shape:array<int>,data:binary>"
BUNDLE = f"map<string,{TENSOR}>"


def tensor(name: str, values: Column, shape: list[int]) -> Column:
    """A column of numbers as a packed tensor, in half precision if its name asks for it."""
    kind = np.dtype(np.float16 if name in HALF else np.float32)

    @F.pandas_udf("binary")
    def pack(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else np.asarray(v, kind).tobytes())

    return F.struct(F.lit(kind.name).alias("dtype"), F.array(*(F.lit(n) for n in shape)).cast("array<int>").alias("shape"), pack(values).alias("data"))


def unpack(entry: dict) -> np.ndarray:
    return np.frombuffer(entry["data"], entry["dtype"]).reshape(entry["shape"])


def bundle_text(df: DataFrame, bundle: str, name: str = "blob") -> DataFrame:
    """Bundles as one text archive for each row."""

    @F.pandas_udf("string")
    def encode(column: pd.Series) -> pd.Series:
        return column.map(lambda m: packed_arrays({k: unpack(v) for k, v in (m or {}).items()}))

    return df.withColumn(name, encode(F.col(bundle)))


def bundle_of_text(df: DataFrame, blob: str, name: str = "arrays") -> DataFrame:
    """Text archives as bundles; nothing in them is executed."""

    @F.pandas_udf("array<struct<key:string,dtype:string,shape:array<int>,data:binary>>")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(lambda text: [{"key": k, "dtype": v.dtype.name, "shape": list(v.shape), "data": v.tobytes()} for k, v in unpacked_arrays(text).items()])

    entries = F.transform(decode(F.col(blob)), lambda e: F.struct(e["key"], F.struct(e["dtype"].alias("dtype"), e["shape"].alias("shape"), e["data"].alias("data"))))
    return df.withColumn(name, F.map_from_entries(entries))


# Arrays that are never stored with raw tracks, and those that are only on request.
NEVER_STORED = ("candidate_masks", "target_candidate_masks")
ON_REQUEST = ("cotracker_tracks_3d", "gripper_tracks_3d")


def stored_name(trajectory: Column, subtask: Column) -> Column:
    """The name under which a trajectory's raw tracks are stored: no slashes or blanks."""
    return F.concat_ws("_", F.regexp_replace(F.regexp_replace(trajectory, r"[/\s\\]+", "_"), "^_+|_+$", ""), subtask.cast("string"))


def raw_tracks(df: DataFrame, arrays: str, left: Column, top: Column, scale: Column, with_clouds: bool = False) -> DataFrame:
    """Bundles of raw tracks as they are stored: without masks (and clouds, unless asked for), places in pixels of the
    original image (the crop's origin added, divided by the scale), floats in half precision. Arrays whose name says
    tracks hold x and y in turn, boxes x1, y1, x2, y2; a place of -1, -1 is none and stays."""
    dropped = [*NEVER_STORED, *([] if with_clouds else ON_REQUEST)]
    kept = F.map_filter(F.col(arrays), lambda k, v: ~k.isin(*dropped))

    @F.pandas_udf("array<struct<key:string,dtype:string,shape:array<int>,data:binary>>")
    def restored(bundle: pd.Series, x: pd.Series, y: pd.Series, by: pd.Series) -> pd.Series:
        out = []
        for entries, dx, dy, s in zip(bundle, x, y, by, strict=True):
            rows = []
            for name, entry in (entries or {}).items():
                value = unpack(entry)
                if value.dtype.kind == "f" and name.endswith(("tracks", "boxes")) and value.shape[-1] in (2, 4):
                    pairs = value.astype(float).reshape(-1, 2)
                    none = (pairs == -1).all(axis=1)
                    value = np.where(none[:, None], -1.0, (pairs + (dx, dy)) / s).reshape(value.shape)
                value = value.astype(np.float16) if value.dtype.kind == "f" else value
                rows.append({"key": name, "dtype": value.dtype.name, "shape": list(value.shape), "data": value.tobytes()})
            out.append(rows)
        return pd.Series(out)

    entries = F.transform(restored(kept, left.cast("double"), top.cast("double"), scale.cast("double")), lambda e: F.struct(e["key"], F.struct(e["dtype"].alias("dtype"), e["shape"].alias("shape"), e["data"].alias("data"))))
    return df.withColumn(arrays, F.map_from_entries(entries))


#: Bytes of a shard after which the next one begins; fixed value of the method.
SHARD_BYTES = 1 << 30


def bundle_bytes(bundle: Column) -> Column:
    """Bytes of a bundle's tensors."""
    return F.aggregate(F.map_values(bundle), F.lit(0).cast("bigint"), lambda a, t: a + F.length(t["data"]))


def sharded(df: DataFrame, by: list[str], order: list[str], size: Column, target: int = SHARD_BYTES) -> DataFrame:
    """Adds `shard`: rows of a group in order, a new shard after every `target` bytes. A shard has at most the target
    and one row more. Sizes are summed over ranges of the order, so that a group has as many tasks as it fills."""
    from ..operators.ranks import running

    sized = df.withColumn("bytes__", size.cast("bigint"))
    return running(sized, order, "bytes__", by, "before__").withColumn("shard", F.floor(F.col("before__") / target).cast("int")).drop("before__", "bytes__")


def storage(trajectory: Column, subtask: Column, identity: Column, shard: Column) -> Column:
    """Where an annotation's arrays lie: the shard's folder, and the group that names them there."""
    from ..functions.text import quoted

    group = F.concat(F.lit("trajectories/"), quoted(trajectory), F.lit("/subtasks/"), F.lpad(subtask.cast("string"), 4, "0"), F.lit("/"), identity)
    return F.struct(F.concat(F.lit("shard="), shard.cast("string")).alias("path"), group.alias("group"))


def write_bundles(df: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """Bundles as Parquet by dataset, and by shard where rows have one, in files of a bounded number of rows."""
    parts = ["dataset", *(["shard"] if "shard" in df.columns else [])]
    df.write.mode("append").partitionBy(*parts).option("maxRecordsPerFile", rows_per_file).parquet(path)
