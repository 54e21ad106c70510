"""Near-duplicates by fast similarity sketches, bands, and exact similarity.

A sketch has COORDINATES bins. In round i each shingle is thrown into one bin with a value of its own; a bin keeps the least value of
the first round that reached it. From round COORDINATES on, round i throws all shingles into bin i - COORDINATES,
so every bin is full after twice as many rounds, for a set of one shingle too; a set of n shingles is done after about
COORDINATES x ln(COORDINATES) / n rounds, instead of one pass for each coordinate. Two sets agree in a coordinate
with the probability of their similarity, and the share in which they agree is concentrated about it
as with as many independent ones.

A band is ROWS coordinates, hashed to a key; sets that share a key are candidates, and the exact similarity
of their whole sets decides. At a similarity of 0.85 all 32 bands of four miss once in 10^10 pairs, above it more rarely.
Sets that are equal are one node, known by 64 bits (of 10^10 different sets some three pairs would be taken for equal). A key
with many nodes doesn't give all pairs: its hub is compared with the others first, and what that leaves apart
meets again under its rarest shingles, counted exactly (simhash.similar_links); no link is lost by it.

Defined cases: a null or empty text, or one without words, has no shingles, is linked with nothing and is its own
component. A text with fewer words than a shingle is one shingle. A null id is a row like others; a component of which
no id is known has component_id null, and all its rows are kept. Repeated rows and ids each keep their row, with equal
results. Very long texts are taken whole. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, folder, map_column, rows_per_batch, shuffles_deleted, staged, utf8
from .simhash import components, exact_prefixes, roughly, shingle_set, similar_links

WIDTH, SIMILARITY = 5, 0.85
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Rows of a batch of whole texts for Python, which gives back sets as long.
BATCH = 250
_NONE = np.uint64(2**64 - 1)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit numbers, hashed anew for each salt."""
    x = x ^ np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """The sketch of each set of 64-bit hashes, a row each; rows of empty sets hold no value."""
    held = np.full(len(sets) * coordinates, _NONE)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate([*sets, np.zeros(0, np.uint64)])
    for i in range(2 * coordinates):
        unfinished = (held.reshape(-1, coordinates) == _NONE).any(axis=1)[owner]
        if not unfinished.all():
            owner, elements = owner[unfinished], elements[unfinished]
        if not len(elements):
            break
        thrown = mixed(elements, i)
        bins = (((thrown >> np.uint64(32)) * np.uint64(coordinates)) >> np.uint64(32)).astype(np.int64) if i < coordinates else np.int64(i - coordinates)
        at = owner * coordinates + bins
        free = held[at] == _NONE
        # A value comes from the shingle and the round alone, so only a shingle that both have makes sets agree.
        values = np.minimum(mixed(thrown[free], 2 * coordinates), _NONE - np.uint64(1))
        np.minimum.at(held, at[free], values)
    return held.reshape(-1, coordinates)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of each sketch, of the band's number and its coordinates."""
    parts = sketch[:, : bands * rows].reshape(-1, bands, rows)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        keys = mixed(keys ^ parts[:, :, k], k)
    return keys


_NODE = "struct<node: bigint, size: int, keys: array<bigint>>"


def described(texts: pa.Array, width: int, bands: int, rows: int) -> pa.Array:
    """Of each text: a digest of its set of shingles, their number, and the set's keys (none for an empty set)."""
    sets = [shingle_set(data, width) for data in utf8(texts)]
    keys = band_keys(sketches(sets, bands * rows), bands, rows).view(np.int64)
    columns = [
        pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)),
        pa.array([len(s) for s in sets], pa.int32()),
        pa.array([k if len(s) else k[:0] for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64())),
    ]
    return pa.StructArray.from_arrays(columns, ["node", "size", "keys"])


def described_column(text: str, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> Column:
    return map_column(lambda t: described(t, width, bands, rows), _NODE, F.col(text))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: the size of its set, the least id of its component, and
    whether that is its own."""
    spark = docs.sparkSession
    nodes_path, shared_path, entries_path, met_path = (folder(spark, f"sketch-{name}") for name in ("nodes", "shared", "entries", "met"))
    sets_paths: list[str] = []
    keyed = docs.select(F.col(id).alias("id"), F.xxhash64(id).alias("ik"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    with shuffles_deleted(spark), rows_per_batch(spark, BATCH):
        said = keyed.select("id", "ik", "th", described_column("text", width, bands, rows).alias("s"))
        all_rows = staged(said.select("id", "ik", "th", "s.node", "s.size", "s.keys"), "sketches")
        nodes = all_rows.where("size > 0").groupBy("node").agg(F.min("id").alias("least"), F.first(F.struct("ik", "th")).alias("row"), F.first("size").alias("size"), F.first("keys").alias("keys"))
        nodes = staged(nodes, "sketch-nodes", nodes_path)
        each = nodes.select("node", "size", F.explode("keys").alias("key"))
        shared = staged(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sketch-shared", shared_path)
        entries = staged(each.join(shared, "key"), "sketch-entries", entries_path)
        # Of near copies the one that was changed least shares its keys with most others.
        known = entries.groupBy("node").agg(F.sum("n").alias("known"))
        met = staged(entries.drop("n").join(known, "node"), "sketch-met", met_path)
        discard(spark, shared_path, entries_path)

        def sets(asked: DataFrame) -> DataFrame:
            """The whole sets of the nodes that are asked for, of one text each."""
            wanted = staged(nodes.join(asked, "node", "left_semi").select("node", "row.ik", "row.th"), "sketch-asked")
            texts = roughly(keyed.select("ik", "th", "text"), wanted, ["ik", "th"]).join(wanted, ["ik", "th"]).dropDuplicates(["node"])
            packed = map_column(lambda t: pa.array([shingle_set(d, width).view(np.int64) for d in utf8(t)], pa.list_(pa.int64())), "array<bigint>", F.col("text"))
            sets_paths.append(folder(spark, "sketch-sets"))
            return staged(texts.select("node", packed.alias("shingles")), "sketch-sets", sets_paths[-1])

        about = nodes.select("node", "size")
        refined = lambda some: exact_prefixes(sets(some), about.join(some, "node"), similarity)
        found = components(similar_links(met, sets, similarity, refined, many=0))
        placed = staged(nodes.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "sketch-placed")
        roots = placed.groupBy("root").agg(F.min("least").alias("component"))
        named = staged(placed.join(roots, "root").select(F.col("node").alias("node_"), "component"), "sketch-named")
        discard(spark, nodes_path, met_path, *sets_paths)
    out = all_rows.select("id", "node", "size").join(named, F.col("node") == F.col("node_"), "left")
    own = F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id), F.col("size").cast("bigint").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    """The result of the query, for every document."""
    return near_duplicates(docs)
