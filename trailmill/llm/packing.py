"""Packing into fixed windows by best fit decreasing.

A document's ids, with the closing id, are cut into full windows first. What is left of each goes,
longest first, into the open window with the least room that still holds it; a segment tree over
remaining capacities finds that window. Each task packs its own documents in groups of a bounded
number of tokens, so memory is bounded, nothing is shuffled, and a lost task is simply run again.

Defined cases: a null text is an empty one, whose only id is the closing one; a very long text
gives as many full windows as it needs; repeated rows and null ids are packed like others; an
empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices_of
from .tokens import encode, vocabulary

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2_048
CLOSING = 1
#: Tokens that a task packs at a time.
GROUP = 1 << 22
WIDTH = 4


class OpenWindows:
    """Open windows by remaining capacity. Node i of the tree has the number of windows below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.held: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, window: int, room: int) -> None:
        self.held[room].append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out a window with the least room of at least `need`; returns it and its room."""
        node = need + self.size
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1  # until a right neighbour has windows
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                node += not self.tree[node]
        room = node - self.size
        window = self.held[room].pop()
        self._add(room, -1)
        return window, room


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], int]:
    """Window and offset of each length, and the number of windows."""
    windows, offsets = [0] * len(lengths), [0] * len(lengths)
    space, used = OpenWindows(capacity), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = space.tightest(lengths[i])
        window, room = found or (used, capacity)
        used += found is None
        windows[i], offsets[i] = window, capacity - room
        if room > lengths[i]:
            space.put(window, room - lengths[i])
    return windows, offsets, used


def pieces_of(ids: list[bytes], capacity: int = CAPACITY) -> Iterator[tuple[int, int, bytes, int, int, int]]:
    """(document, start, ids, document's tokens, window, offset) of every piece of a group."""
    used, tails = 0, []
    for k, data in enumerate(ids):
        total = len(data) // WIDTH
        full = total // capacity
        for j in range(full):
            yield k, j * capacity, data[j * capacity * WIDTH : (j + 1) * capacity * WIDTH], total, used, 0
            used += 1
        if total % capacity:
            tails.append((k, full * capacity, data[full * capacity * WIDTH :], total))
    windows, offsets, _ = best_fit_decreasing([len(t[2]) // WIDTH for t in tails], capacity)
    for tail, window, offset in zip(tails, windows, offsets, strict=True):
        yield *tail, used + window, offset


SCHEMA = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, closing: int = CLOSING, group: int = GROUP) -> DataFrame:
    """One row for each piece: the document's id, where the piece starts in it, its length, ids as
    little-endian unsigned 32-bit numbers, its sequence and the offset there. group: tokens that a task
    packs at a time."""
    path = path or vocabulary(VOCABULARY)
    end = np.asarray([closing], "<u4").tobytes()
    kind = docs.select(F.col(id).alias("id")).schema["id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        names: list = []
        ids: list[bytes] = []
        tokens, id_type = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal names, ids, tokens, base
            rows, last = [], -1
            for k, start, data, total, window, offset in pieces_of(ids, capacity):
                rows.append((names[k], start, len(data) // WIDTH, data, total, base + window, offset))
                last = max(last, window)
                if len(rows) == 4096:
                    yield as_batch(rows)
                    rows = []
            if rows:
                yield as_batch(rows)
            base += last + 1
            names, ids, tokens = [], [], 0

        def as_batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            labels = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], labels)

        for batch in slices_of(batches):
            id_type = batch.column(0).type
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(keys), 256):
                for key, data in zip(keys[at : at + 256], encode([t or "" for t in texts[at : at + 256]], path), strict=True):
                    names.append(key)
                    ids.append(data + end)
                    tokens += len(data) // WIDTH + 1
                if tokens >= group:
                    yield from flush()
        if ids:
            yield from flush()

    out = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(packed, f"id {kind}, {SCHEMA}")
    return out.withColumnRenamed("id", id)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, segments): each sequence's ids in order, and the pieces' lengths."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.col("p.length").alias("segments")
    )


def digest(docs: DataFrame) -> DataFrame:
    """The result of the query, for every piece."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
