"""Requests to a remote model: bounded over the cluster, answers saved as they come, nothing that is saved asked again.

Requests are dealt to lanes, one task each, and a lane keeps a window of calls in flight that slides over all batches of
its task: a slow call holds its own place in the window and no other. Lanes times window is at most the limit, whatever
the executors. Every round of requests is committed to a table of answers (sources.ledger) before the next
begins, and a round asks only what the table lacks, so a run that died goes on where its last round ended; a task that is
killed asks its own lane's part of one round again. Speculative execution would double calls: leave it off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ledger import Table, dealt

#: Answers that a task hands on at a time.
CHUNK = 64


def answers(batches: Iterator[pa.RecordBatch], call: Callable, window: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(key, answer, error) of rows (key, *arguments), in the order in which calls end. At most `window` are in flight, over the
    borders of batches; rows are read only when there is room. What a call raises becomes the row's error."""
    done: list[tuple] = []

    def ask(key, *arguments) -> tuple:
        try:
            return key, call(*arguments), None
        except Exception as error:
            return key, None, f"{type(error).__name__}: {error}"

    def chunk(rows: list[tuple]) -> pa.RecordBatch:
        keys, said, errors = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(said, pa.string()), pa.array(errors, pa.string())], ["key", "answer", "error"])

    with ThreadPoolExecutor(window) as pool:
        flying: set = set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(flying) == window:
                    ended, flying = wait(flying, return_when=FIRST_COMPLETED)
                    done += [f.result() for f in ended]
                flying.add(pool.submit(ask, *row))
                if len(done) >= CHUNK:
                    yield chunk(done)
                    done = []
        while flying:
            ended, flying = wait(flying, return_when=FIRST_COMPLETED)
            done += [f.result() for f in ended]
            if len(done) >= CHUNK:
                yield chunk(done)
                done = []
    if done:
        yield chunk(done)


def asked(requests: DataFrame, key: str, arguments: list[str], make: Callable[[], Callable], limit: int, lanes: int | None = None) -> DataFrame:
    """(key, answer, error) of distinct requests. make: gives a worker its call(*arguments) -> str; lanes: tasks, as many as
    the cluster runs at once unless given; never more than the limit of calls in flight."""
    spark = requests.sparkSession
    lanes = max(1, min(limit, lanes or spark.sparkContext.defaultParallelism))
    window = limit // lanes
    schema = requests.select(F.col(key).alias("key"))
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema.schema["key"].dataType)

    def lane(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from answers(batches, make(), window, kind)

    # A count that is asked for is kept: the planner merges no lanes, so there are never more tasks than these.
    rows = requests.select(F.col(key).alias("key"), *arguments).repartition(lanes, "key")
    return rows.mapInArrow(lane, f"key {schema.dtypes[0][1]}, answer string, error string").withColumnRenamed("key", key)


def dispatched(spark: SparkSession, requests: DataFrame, key: str, arguments: list[str], make: Callable[[], Callable], path: str, limit: int, per_round: int = 10_000, lanes: int | None = None) -> DataFrame:
    """Asks what the table of answers at `path` lacks, each key once, in rounds of about `per_round` requests that are committed one by
    one, and gives that table (key, answer). Failed calls are not saved: they are asked again by the next run."""
    table = Table(spark, path)
    once = requests.where(F.col(key).isNotNull()).dropDuplicates([key])

    def lacking() -> DataFrame:
        held = table.read()
        return once if held is None else once.join(held.select(key), key, "left_anti")

    rounds = -(-lacking().count() // max(1, per_round))
    share = F.pmod(F.xxhash64(F.lit("round"), F.col(key)), F.lit(max(1, rounds)))
    for k in range(rounds):
        entries = table.log.entries()
        # Answers are written as they come, once: what follows reads the written ones.
        said = asked(lacking().where(share == k), key, arguments, make, limit, lanes).where("error is null").drop("error")
        table.commit(table.write(dealt(said, key), by_key=True), key, "dispatch", len(entries), entries)
    found = table.read()
    return found if found is not None else spark.createDataFrame([], once.select(key, F.lit("").alias("answer")).schema)
