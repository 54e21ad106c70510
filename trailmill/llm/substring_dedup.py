"""Substring dedup by seed and extend.

Seeds: of the 8-word grams of every 35-word window the least by hash (the leftmost of equals) is the
window's anchor. Equal windows choose equal anchors, so a repeat of 35 words or more always shares
one; about one position in 14 is an anchor. Anchors that occur once are dropped by a join on counts.

Extend: an anchor's windows lie side by side, so what is equal around it, both ways and as far as
any of its windows goes, is its stretch. Occurrences of an anchor with equal stretches are repeats
in full; they are grouped by a hash of the stretch, never paired. Where an anchor's stretches
differ, one occurrence of each different stretch is read again and extended window by window: a
window that two of them share is a repeat. Adjacent repeated windows make the maximal repeats.
So a group of copies costs one row for each copy, and no pair of occurrences is listed.

Hashes: grams, stretches and windows are polynomials over 64-bit word hashes. A stretch or window is
compared only under an equal anchor.

Defined cases: a null or empty text has no words, and a text of fewer than 35 words no window, so
both keep all they have. Null ids and repeated rows are rows like others: a row's words are found
by its id and its text's hash, and rows equal in both get the same result, being copies of each
other. Very long texts are worked off in slices of words. An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, folder, slices_of, staged, utf8

WINDOW = 35
GRAM = 8
#: Grams of a window; also the most windows that one anchor can have.
SPAN = WINDOW - GRAM + 1
#: Words worked off at a time.
SLICE = 1 << 18
_POSITION = np.uint64((1 << 20) - 1)
# Odd multiplier of the polynomials, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(n, SLICE + 2 * WINDOW)
        held = np.full(size, base, np.uint64)
        held[0] = 1
        held = _POWERS[base] = np.multiply.accumulate(held)
    return held[:n]


class Polynomials:
    """Hashes of any runs of words in a list, each in constant time."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * _powers(_BASE, n), out=self.sums[1:])
        self.shift = _powers(_INVERSE, n + 1)

    def __call__(self, starts: np.ndarray, lengths) -> np.ndarray:
        return mixed((self.sums[starts + lengths] - self.sums[starts]) * self.shift[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def least_of(keys: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each `span` neighbours."""
    width, out = 1, keys
    while 2 * width <= span:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = span - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Word hashes of some texts end to end, with (text, first word, place, words) of each part. A
    long text comes in parts that overlap, so that each window lies in exactly one."""
    parts, hashed, used = [], [], 0
    for k, data in enumerate(texts):
        words = data.split()
        for first in range(0, max(0, len(words) - WINDOW + 1), SLICE):
            part = word_hashes(words[first : first + SLICE + WINDOW - 1])
            parts.append((k, first, used, len(part)))
            hashed.append(part)
            used += len(part)
            if used >= SLICE:
                yield np.concatenate(hashed), parts
                parts, hashed, used = [], [], 0
    if parts:
        yield np.concatenate(hashed), parts


def anchors_of(words: np.ndarray, parts: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, ...]:
    """Of every anchor: its part, gram hash, stretch hash, first window and number of windows."""
    polynomials = Polynomials(words)
    grams = polynomials(np.arange(len(words) - GRAM + 1), GRAM)
    place = np.arange(len(grams), dtype=np.uint64) & _POSITION
    chosen = least_of((grams & ~_POSITION) | place, SPAN) & _POSITION
    # Windows that run over the end of a part are none.
    where = np.concatenate([np.arange(at, at + n - WINDOW + 1) for _, _, at, n in parts])
    part = np.repeat(np.arange(len(parts)), [n - WINDOW + 1 for *_, n in parts])
    chosen = chosen[where].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (part[1:] != part[:-1]))))
    count = np.diff(np.concatenate((new, [len(where)])))
    start = where[new]
    return part[new], grams[chosen[new]], polynomials(start, count + WINDOW - 1), start, count


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices_of(batches):
        ids, hashes = batch.column(0), batch.column(1)
        for words, parts in slices(utf8(batch.column(2))):
            part, gram, stretch, start, count = anchors_of(words, parts)
            rows = np.array([p[0] for p in parts])[part]
            shift = np.array([p[1] - p[2] for p in parts])[part]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(rows)),
                    hashes.take(pa.array(rows)),
                    pa.array(gram.view(np.int64)),
                    pa.array(stretch.view(np.int64)),
                    pa.array((start + shift).astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                ],
                ["id", "th", "h", "u", "start", "n_windows"],
            )


def extend_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all windows of the given stretches."""
    for batch in slices_of(batches):
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for data, stretches in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            words = data.split()
            for s in stretches:
                first, n = s["start"], s["n_windows"]
                local = Polynomials(word_hashes(words[first : first + n + WINDOW - 1]))
                windows = local(np.arange(n), WINDOW)
                for column, value in zip(out, (s["h"], s["u"], None, None, s["weight"]), strict=True):
                    column.append(np.full(n, 0 if value is None else value, np.int64))
                out[2][-1], out[3][-1] = np.arange(n), windows.view(np.int64)
        if out[0]:
            columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in out]
            yield pa.RecordBatch.from_arrays(columns, ["h", "u", "i", "w", "weight"])


def covered_words(n_words: int, stretches: list[dict]) -> np.ndarray:
    """Whether each word lies in a repeated window."""
    depth = np.zeros(n_words + 1, np.int64)
    for s in stretches:
        bits, at = s["mask"], s["start"]
        while bits:
            low = (bits & -bits).bit_length() - 1
            run = (~(bits >> low) & ((bits >> low) + 1)).bit_length() - 1  # adjacent windows
            depth[at + low] += 1
            depth[at + low + run + WINDOW - 1] -= 1
            bits &= ~(((1 << run) - 1) << low)
    return np.cumsum(depth[:-1]) > 0


def repeated_stretches(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, start, mask): first windows of stretches, and which of their windows are repeats."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()
    found = keyed.mapInArrow(find_anchors, f"id {kind}, th bigint, h bigint, u bigint, start int, n_windows int")
    anchors = staged(found, "anchors", all_path := folder(spark, "anchors"))
    # Tables of their own, so that the planner can split a hot anchor's rows when they are joined.
    repeated = staged(anchors.groupBy("h").count().where("count > 1").select("h"), "repeated")
    seeds = staged(anchors.join(repeated, "h"), "seeds", folder(spark, "seeds"))
    discard(spark, all_path)
    stretches = seeds.groupBy("h", "u").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "start", "n_windows")).alias("one"))
    stretches = staged(stretches, "stretches")
    differing = stretches.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest")).where("kinds > 1 and fewest = 1")
    differing = staged(differing.select("h"), "differing")
    to_read = (
        stretches.join(differing, "h")
        .select("one.id", "one.th", F.struct("h", "u", "one.start", "one.n_windows", F.least("n", F.lit(2)).alias("weight")).alias("s"))
        .groupBy("id", "th")
        .agg(F.collect_list("s").alias("stretches"))
        .withColumnsRenamed({"id": "rid", "th": "rth"})
    )
    # Rows equal in id and text hold the same stretches; one of them is read.
    once = keyed.join(to_read, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")))
    once = once.select("text", "stretches")
    windows = once.mapInArrow(extend_windows, "h bigint, u bigint, i bigint, w bigint, weight bigint")
    windows = staged(windows, "windows", windows_path := folder(spark, "windows"))
    # A window met under two stretches, or under one that occurs twice. Rows read twice count once.
    distinct = windows.groupBy("h", "w", "u").agg(F.max("weight").alias("weight"))
    shared = distinct.groupBy("h", "w").agg(F.sum("weight").alias("n")).where("n > 1").select("h", "w")
    shared = staged(shared.withColumn("shared", F.lit(True)), "shared")
    same = windows.groupBy("h", "u", "w").agg(F.bit_or(F.expr("shiftleft(1L, cast(i as int))")).alias("mask"), F.countDistinct("i").alias("within"))
    partly = same.join(shared, ["h", "w"], "left").where("shared or within > 1")
    partly = partly.groupBy("h", "u").agg(F.bit_or("mask").alias("mask"))
    fully = stretches.where("n > 1").select("h", "u", F.expr("shiftleft(1L, one.n_windows) - 1").alias("mask"))
    masks = staged(fully.union(partly.join(stretches.where("n > 1"), ["h", "u"], "left_anti")), "masks")
    discard(spark, windows_path)
    return seeds.join(masks, ["h", "u"]).select("id", "th", "start", "mask")


def by_document(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, stretches) of every row; stretches is null where nothing repeats."""
    grouped = repeated_stretches(docs, id, text).groupBy("id", "th").agg(F.collect_set(F.struct("start", "mask")).alias("stretches"))
    grouped = staged(grouped, "repeats").withColumnsRenamed({"id": "rid", "th": "rth"})
    keyed = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return keyed.join(grouped, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left").select("id", "text", "stretches")


def maximal_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, length) in words of every maximal repeat of at least WINDOW words. Rows without a repeat (null,
    empty and short texts among them) have no row here; repeated rows each have theirs; null ids stay null."""
    kind = docs.select(F.col(id).alias("id")).schema["id"].dataType.simpleString()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            rows, starts, lengths = [], [], []
            for k, (data, stretches) in enumerate(zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True)):
                edge = np.diff(np.concatenate(([0], covered_words(len(data.split()), stretches), [0])).astype(np.int8))
                begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                rows += [k] * len(begin)
                starts += begin.tolist()
                lengths += (end - begin).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())],
                ["id", "start", "length"],
            )

    found = by_document(docs, id, text).where("stretches is not null")
    return found.mapInArrow(runs, f"id {kind}, start bigint, length bigint").withColumnRenamed("id", id)


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept) of every row: the words outside all repeats, one space between. A null text
    has no words and keeps an empty text."""
    kind = docs.select(F.col(id).alias("id")).schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            totals, removed, kept = [], [], []
            for data, stretches in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = data.split()
                totals.append(len(words))
                if stretches:
                    gone = covered_words(len(words), stretches)
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "n_words", "n_removed", "kept"],
            )

    out = by_document(docs, id, text).mapInArrow(cut, f"id {kind}, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("id", id)


def digest(docs: DataFrame) -> DataFrame:
    """The result of the query, for every document."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
