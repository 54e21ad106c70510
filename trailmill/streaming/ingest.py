"""Incremental ingest: an append stream of annotations, and the extension that closes idle trajectories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


#: Parts of a sink by the hash of its keys.
KEY_PARTS = 64


def append_new(stream: DataFrame, sink: str, key: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends rows whose key the sink does not have yet; a batch that runs twice adds nothing. The sink is dealt
    into folders by the hash of its keys (column key_part), so a batch reads the keys of those folders alone in
    which its own keys would lie."""

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key]).withColumn("key_part", F.pmod(F.xxhash64(key), F.lit(KEY_PARTS)).cast("int")).persist()
        try:
            parts = [r[0] for r in fresh.select("key_part").distinct().collect()]
            rows = fresh
            try:
                held = batch.sparkSession.read.parquet(sink).where(F.col("key_part").isin(parts)).select("key_part", key).distinct()
                rows = fresh.join(held, ["key_part", key], "left_anti")
            except Exception as error:
                if "PATH_NOT_FOUND" not in str(error):
                    raise
            rows.write.mode("append").partitionBy("key_part").parquet(sink)
        finally:
            fresh.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_committed(stream: DataFrame, sink: str, key: str, checkpoint: str, writer: str | None = None, once: bool = True) -> StreamingQuery:
    """Appends rows whose key the sink does not have yet, a batch all or nothing: an entry in the sink's log makes its files
    part of the table (sources.ledger). A batch that runs twice is known by its writer and number; several writers
    share a sink. Read it by ledger.Table(spark, sink).read()."""
    from ..sources.ledger import Table

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            Table(batch.sparkSession, sink).append(held, key, writer or checkpoint, number)
        finally:
            held.unpersist()

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def frame_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def sessions(frames: DataFrame, by: str, time: str, gap: str = "10 minutes", late: str | None = None) -> DataFrame:
    """(by, start_time, end_time, n): a trajectory ends when it has been idle for the gap. Works on tables
    and, with a bound for late frames, on streams."""
    source = frames.withWatermark(time, late) if late else frames
    grouped = source.groupBy(by, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n"))
    return grouped.select(by, F.col("s.start").alias("start_time"), F.col("s.end").alias("end_time"), "n")


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Runs a stream over what there is and writes it as Parquet."""
    shape(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def live_phases(frames: DataFrame, by: str, order: str, signal: str, done: str, hysteresis: float = 0.1) -> DataFrame:
    """(by, start_frame, end_frame, phase) of trajectories on a stream of frames: a trajectory's signal is
    kept as state until the batch that has its last frame, which is marked. Order within that does not matter;
    frames that come in later batches begin a trajectory anew."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    from ..operators.phases import gripper_phases

    kind = frames.schema[by].dataType.simpleString()

    def step(key: tuple, batches, state):
        places, values = map(list, state.get) if state.exists else ([], [])
        ended = False
        for pdf in batches:
            places += pdf[order].tolist()
            values += pdf[signal].tolist()
            ended = ended or bool(pdf[done].any())
        if not ended:
            state.update((places, values))
            return
        if state.exists:
            state.remove()
        found = gripper_phases(np.array(values)[np.argsort(places, kind="stable")], hysteresis=hysteresis)
        out = pd.DataFrame(found, columns=["start_frame", "end_frame", "phase"])
        out.insert(0, by, key[0])
        yield out

    rows = frames.select(by, F.col(order).cast("bigint").alias(order), F.col(signal).cast("double").alias(signal), done).groupBy(by)
    return rows.applyInPandasWithState(
        step, f"{by} {kind}, start_frame bigint, end_frame bigint, phase string", "places array<bigint>, signal array<double>", "append", GroupStateTimeout.NoTimeout
    )
