"""What the operators of this package share: words, scratch tables, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: The bytes that separate words; bytes.split() cuts at exactly these.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes that continue a UTF-8 character, so that deleting them leaves one byte a code point.
CONTINUATION = bytes(range(0x80, 0xC0))
#: SQL pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"


def utf8(array: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return [b"" if x is None else x for x in array.cast(pa.large_binary()).to_pylist()]


def code_points(data: bytes) -> int:
    return len(data.translate(None, CONTINUATION))


#: Rows that a function of texts is given at a time.
ROWS = 500


def map_column(function: Callable[..., pa.Array], schema: str, *inputs: Column) -> Column:
    """An Arrow function as a column. Spark bounds a batch by bytes; the function gets it in slices of at
    most ROWS rows, so that few texts are Python objects at once. Marked nondeterministic so that a
    filter on its result is not pushed below it, which would run it twice."""

    def sliced(*columns):
        n = len(columns[0])
        parts = [function(*(c.slice(at, ROWS) for c in columns)) for at in range(0, n, ROWS)] or [function(*columns)]
        pa.default_memory_pool().release_unused()  # else a worker keeps the largest batch that it has seen
        return pa.concat_arrays([x for part in parts for x in (part.chunks if isinstance(part, pa.ChunkedArray) else [part])])

    return arrow_udf(sliced, schema).asNondeterministic()(*inputs)


def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ROWS rows, without a copy."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)
        pa.default_memory_pool().release_unused()


def unused(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of the frame's columns, in any case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's checkpoint folder. Where
    neither is set, one of our own, but only if driver and executors are one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="trailmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch(spark)}/trailmill/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cuts the lineage: writes the frame as Parquet to the shared folder and reads it again.
    The table outlives lost executors; a retried task overwrites only its own part."""
    path = path or folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that no later plan reads."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go when the write or count that made them ends, not when the driver happens to
    collect its garbage. Not for toLocalIterator, which reads them after that, nor for frames that leave the block."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, batches for Python have at most so many rows, unless the session was given a number of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if before == "10000":
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))
