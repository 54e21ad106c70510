"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has the majority bit of its shingles' hashes at each place. Fingerprints at most k
bits apart agree on b - k of b blocks, so every choice of b - k blocks is a join key and close
pairs meet under one of them; a join verifies the Hamming distance. Only distinct fingerprints
take part: all copies of a text are one node, so a large group of copies costs one row.

A key shared by many distinct fingerprints (a large group of near copies) would give all pairs of
its group. Up to two bits such fingerprints link exactly in another way: each names the
fingerprints one bit from it, and two are within two bits if and only if they name a common one.
No link is lost, no pair listed. Only distances up to two are offered.

`distinct_documents` asks for a Jaccard similarity of whole texts. Fingerprints so linked are its first
candidates; for those that blocks of bits can't give, see the second half of this module.

Components: alternating large-star and small-star passes over the links, each pass written to the
shared folder, until nothing changes. Nothing about single documents reaches the driver.

Defined cases: a null or empty text has fingerprint zero, linked like any other. A null id is a
row like others; a component of which no id is known has component_id null. Repeated rows and
repeated ids each keep their row. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, folder, map_column, shuffles_deleted, staged, unused, utf8

SEED = 42
BITS = 64
#: Keys with more distinct fingerprints than this link by the exact other way.
CROWDED = 16
#: Links that a task of `components` takes, in expectation.
TASK_LINKS = 50_000
_LOWER = bytes.maketrans(ascii_uppercase.encode(), ascii_lowercase.encode())


def shingle_hashes(data: bytes, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of `width` lower-cased words, repeats included; of all words if fewer."""
    words = data.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(text[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[at : at + 255 * 256].astype(">u8").view(np.uint8))
        lanes = bits.view(np.uint64).reshape(-1, BITS // 8)
        whole = len(lanes) // 255 * 255
        # Sums of up to 255 bits stay within their byte, so eight bits are added at a time.
        parts = [lanes[:whole].reshape(-1, 255, BITS // 8).sum(axis=1, dtype=np.uint64)] if whole else []
        parts += [lanes[whole:].sum(axis=0, dtype=np.uint64)[None]] if whole < len(lanes) else []
        for part in parts:
            ones += np.ascontiguousarray(part).view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(hashes))
    return int.from_bytes(packed.tobytes(), "big")


def fingerprints(texts: pa.Array, width: int = 3, seed: int = SEED) -> pa.Array:
    out = np.array([fingerprint(shingle_hashes(data, width, seed)) for data in utf8(texts)], np.uint64)
    return pa.array(out.view(np.int64))


def fingerprint_column(text: str, width: int = 3, seed: int = SEED) -> Column:
    return map_column(lambda t: fingerprints(t, width, seed), "bigint", F.col(text))


def block_keys(fp: Column, blocks: int, distance: int) -> Column:
    """One key for each choice of blocks - distance blocks: which choice, and its bits."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    chosen = [signed(sum(c)) for c in combinations(masks, blocks - distance)]
    return F.array(*(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m).cast("bigint")).alias("bits")) for i, m in enumerate(chosen)))


def neighbours(fp: Column, varies: Column) -> Column:
    """The fingerprint and those that differ from it in one bit that varies."""
    flips = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit(varies, i) == 1)
    return F.concat(F.array(fp), F.transform(flips, lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))


def links(fps: DataFrame, distance: int = 2, blocks: int | None = None, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), at most `distance` bits apart, that
    join all fingerprints so related: every close pair is linked directly or by a path of links."""
    if not 0 <= distance <= 2:
        raise ValueError(f"distances of 0, 1 and 2 are offered, not {distance}")
    blocks = blocks or distance + 2
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), blocks, distance)).alias("key"))
    shared = (
        keyed.groupBy("key")
        .agg(F.count("*").alias("n"), F.bit_or("fp").alias("any"), F.bit_and("fp").alias("all"))
        .where("n > 1")
        .select("key", "n", F.expr("any & ~all").alias("varies"))
    )
    shared = staged(shared, "simhash-shared")
    met = staged(keyed.join(shared, "key"), "simhash-keys")
    few, many = met.where(F.col("n") <= crowded), met.where(F.col("n") > crowded)
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = a.join(b, "key").where(F.col("a") > F.col("b")).where(near).select("a", "b")
    dense = many.groupBy("fp").agg(F.bit_or("varies").alias("varies"))
    named = dense.select("fp", F.explode(neighbours(F.col("fp"), F.col("varies"))).alias("name"))
    if distance == 2:
        first = named.groupBy("name").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
        return pairs.union(named.join(first, "name").where("fp > b").select(F.col("fp").alias("a"), "b")).distinct()
    # Equal fingerprints are one row, so below two bits the neighbour itself is the other fingerprint.
    other = dense.select(F.col("fp").alias("b"))
    return pairs.union(named.join(other, F.col("name") == F.col("b")).where("fp > b").where(F.lit(distance) == 1).select(F.col("fp").alias("a"), "b")).distinct()


def _settled(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): of every node that has a link, the least node it reaches. Large-star hangs each
    node's larger neighbours on its least neighbour, small-star its smaller ones; together they
    halve long chains, so the number of passes grows with the logarithm of the longest."""
    spark = edges.sparkSession
    path = folder(spark, "links")
    edges, state = staged(edges.where("a > b"), "links", path), None
    while (now := _settled(edges)) != state:
        state = now
        # Tables of few links are few tasks and files, whatever the session's number of partitions.
        few = lambda df, n=-(-2 * now[0] // TASK_LINKS) or 1: df.coalesce(n)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A table of its own, so that the planner can split a hub's links when they are joined.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = staged(few(least), "least", least_path := folder(spark, "least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        mid = staged(few(large.where("a > b")), "links", mid_path := folder(spark, "links"))
        least = staged(few(mid.groupBy("a").agg(F.min("b").alias("m"))), "least", least_path)
        small = mid.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        edges = staged(few(small.where("a > b").distinct()), "links", new_path := folder(spark, "links"))
        discard(spark, path, mid_path, least_path)
        path = new_path
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(fps: DataFrame, distance: int = 2, blocks: int | None = None, crowded: int = CROWDED) -> DataFrame:
    """(fp, root) of all distinct fingerprints: fingerprints of one component share the root."""
    found = components(links(fps, distance, blocks, crowded)).select(F.col("node").alias("fp"), "root")
    return fps.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """(id, fp, component_id) of every row: its fingerprint and the least id of its component."""
    rows = staged(docs.select(F.col(id), fingerprint_column(text, width).alias("fp")), "fingerprints")
    fps = staged(rows.groupBy("fp").agg(F.min(id).alias("least")), "distinct")
    known = staged(classes(fps.select("fp"), distance), "classes")
    roots = staged(fps.join(known, "fp").groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = known.join(roots, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(id, "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The result of the query, for every document."""
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- near-duplicates by the exact Jaccard similarity of shingle sets -----------------------------
#
# Sets whose SimHash fingerprints are linked are candidates, and the exact similarity decides. That finds
# the closest ones only: at a similarity of 0.8 some 15 % of a fingerprint's bits differ. Blocks of intact bits that still meet
# then must be short (64 blocks of 20 bits: 0.91 of such pairs meet), and short blocks are shared by
# chance ever more often as the corpus grows. So for the rest the blocks are the shingles themselves: two sets of
# similarity s share one of the first 1 - s of their shingles in any common order (the pigeonhole
# principle again, and no pair is lost). Pairs that meet are held against their sizes, the place of the
# shared shingle, and Hamming distances: of SimHash fingerprints, and of one bit from each of 256 least
# hashes, which tell 0.6 from 0.8 as majority bits can't. The exact similarity decides what is left.

#: Texts whose shingles are counted to know the common ones, in expectation, and the least count. The
#: counts only order the shingles: any order finds the same pairs, but rare shingles first meet fewer others.
COUNTED, COMMON = 10_000, 3
#: Common shingles that are told apart by their counts.
ORDERED = 1 << 20
#: Slack of comparisons of similarities with the limit.
SLACK = 1e-9
#: Sets under a key up to which all pairs are compared at once; above it the key's hub comes first.
FEW = 8
#: Sets under a key up to which those outside its largest component are compared with all others.
MANY = 1_000
#: Standard deviations by which the distance of two fingerprints may exceed what is expected at the limit, and the
#: shingles that a set has at least for its bits to be spread so; smaller sets are not held against distances.
DEVIATIONS, SPREAD = 5.5, 64
#: Bits of a bitmap for each row that it has, and at most (16 MB): of more rows it lets more others through.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Least hashes of a set, of each of which a bit is kept, and how many shingles are multiplied at a time.
LEAST = 256
CHUNK = 1_024


def shingle_set(data: bytes, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(data, width))


def common_shingles(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are in several texts of a sample, sorted, and their counts."""
    last = min((1 << 63) - 1, int(COUNTED / max(1, docs.count()) * (1 << 64)) - (1 << 63))
    some = docs.where(F.xxhash64(text) <= F.lit(last).cast("bigint"))
    sets = map_column(lambda t: pa.array([shingle_set(d, width).view(np.int64) for d in utf8(t)], pa.list_(pa.int64())), "array<bigint>", F.col(text))
    counted = some.select(F.explode(sets).alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    rows = np.array([tuple(r) for r in counted.orderBy(F.desc("n"), "s").limit(ORDERED).toLocalIterator()], np.int64).reshape(-1, 2)
    hashes = np.ascontiguousarray(rows[:, 0]).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows[order, 1]


def prefix(shingles: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, rare ones first, so many that two sets of at least the similarity
    have one of them in common: they share `similarity` of either set, so all but the rest is enough."""
    n = len(shingles)
    if not n:
        return shingles
    most, counts = common
    place = np.minimum(np.searchsorted(most, shingles), max(0, len(most) - 1))
    times = np.where(most[place] == shingles, counts[place], 0) if len(most) else np.zeros(n, np.int64)
    return shingles[np.lexsort((shingles, times))[: n - int(np.ceil(similarity * n - SLACK)) + 1]]


_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(7).integers(0, 2**64, LEAST, dtype=np.uint64) | np.uint64(1)


def least_bits(shingles: np.ndarray) -> np.ndarray:
    """One bit of each of LEAST least hashes, as LEAST / 64 numbers: of sets of similarity s, (1 - s) / 2 of the bits differ."""
    least = np.full(LEAST, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), CHUNK):
        least = np.minimum(least, (shingles[at : at + CHUNK, None] * _FACTORS).min(axis=0))
    return np.packbits((least * _MIX) >> np.uint64(63) != 0).view(">u8").astype(np.uint64)


def _farthest(bits: int, share: float) -> int:
    return int(bits * share + DEVIATIONS * np.sqrt(bits * share * (1 - share)))


def farthest(similarity: float) -> tuple[int, int]:
    """Bits by which SimHash fingerprints and least hashes of two sets of at least the similarity differ, but
    for one pair in twenty million at the limit."""
    return _farthest(BITS, np.arccos(2 * similarity / (1 + similarity)) / np.pi), _farthest(LEAST, (1 - similarity) / 2)


#: Columns of the fingerprint and of the least hashes' bits.
BIT_COLUMNS = ("bits", *(f"least{k}" for k in range(LEAST // 64)))


def _nodes(texts: pa.Array, width: int, similarity: float, common) -> pa.Array:
    """Of each text: the id of its set of shingles, their number, the bits, and the keys under which it
    meets others, in their order."""
    ids, sizes, bits, keys = [], [], [], []
    for data in utf8(texts):
        found = shingle_set(data, width)
        ids.append(xxhash.xxh3_64_intdigest(found.tobytes()))
        sizes.append(len(found))
        bits.append((fingerprint(found), *least_bits(found).tolist()))
        keys.append(prefix(found, similarity, common).view(np.int64))
    signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
    of = np.array(bits, np.uint64).reshape(-1, len(BIT_COLUMNS))
    columns = [signed(ids), pa.array(sizes, pa.int32()), *(signed(of[:, k]) for k in range(len(BIT_COLUMNS))), pa.array(keys, pa.list_(pa.int64()))]
    return pa.StructArray.from_arrays(columns, ["node", "size", *BIT_COLUMNS, "keys"])


_NODE = f"struct<node: bigint, size: int, {', '.join(f'{c}: bigint' for c in BIT_COLUMNS)}, keys: array<bigint>>"


def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    """Exact similarity of sorted sets of 64-bit numbers, as bytes."""
    out = []
    for x, y in zip(utf8(a), utf8(b), strict=True):
        m, n = len(x) // 8, len(y) // 8
        both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        out.append(both / (m + n - both) if m + n else 1.0)
    return pa.array(out, pa.float64())


def fingerprint_pairs(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints (node, bits) are at most `distance` bits apart, that join all sets so
    related: of equal fingerprints each set with the least, of `links` the least sets of either fingerprint."""
    least = staged(nodes.groupBy(F.col("bits").alias("fp")).agg(F.min("node").alias("least")), "fingerprint-nodes")
    x, y = (least.select(F.col("fp").alias(n), F.col("least").alias(f"{n}_node")) for n in ("a", "b"))
    across = links(least.select("fp"), distance).join(x, "a").join(y, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    equal = nodes.select("node", F.col("bits").alias("fp")).join(least, "fp").where("node <> least")
    return across.union(equal.select(F.col("node").alias("a"), F.col("least").alias("b")))


def roughly(rows: DataFrame, some: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose keys are in `some`, a table that is written, and a few others: those whose hash is in a broadcast
    bitmap. A join may follow, which then needn't shuffle rows, with their texts, that it would drop."""
    bits = min(MOST_BITS, max(1 << 15, 1 << (BITS_EACH * some.count()).bit_length()))
    place = F.xxhash64(*keys).bitwiseAND(F.lit(bits - 1).cast("bigint"))
    bucket, bitmap = unused(rows, "bitmap_bucket"), unused(rows, "bitmap")
    maps = some.groupBy(F.bitmap_bucket_number(place).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(bitmap))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(at, 3) + 1).cast("int"), 1)), 16, 10).cast("int")
    met = rows.withColumn(bucket, F.bitmap_bucket_number(place)).join(F.broadcast(maps), bucket)
    return met.where(F.getbit(byte, at.bitwiseAND(F.lit(7).cast("bigint")).cast("int")) == 1).select(*rows.columns)


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, shingles) have at least the similarity. Sets are bytes, which are compared in Python by the batch, or
    arrays, which are compared row by row in the JVM, so that no batch of long ones is held."""
    x, y = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"{n}_set")) for n in ("a", "b"))
    both = pairs.join(y, "b").join(x, "a")
    if sets.schema["shingles"].dataType.typeName() == "array":
        shared = F.size(F.array_intersect("a_set", "b_set"))
        return both.where(shared >= similarity * (F.size("a_set") + F.size("b_set") - shared) - SLACK).select("a", "b")
    return both.where(map_column(jaccard, "double", F.col("a_set"), F.col("b_set")) >= similarity - SLACK).select("a", "b")


def may_be_similar(columns: list[str], similarity: float) -> Column:
    """Whether rows a_... and b_... under one key can be of sets of the similarity. `size`: of the set;
    `rest`: how many of its shingles come from the key on, itself included. The first shingle that two
    sets share has all their other common ones behind it; BIT_COLUMNS are compared by Hamming distance."""
    sizes = F.col("a_size") + F.col("b_size")
    out = F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size") - SLACK
    if "rest" in columns:
        out &= F.least("a_rest", "b_rest") >= similarity / (1 + similarity) * sizes - SLACK
    if BIT_COLUMNS[0] in columns:
        differ = [F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in BIT_COLUMNS]
        far, least_far = farthest(similarity)
        out &= (F.least("a_size", "b_size") < SPREAD) | ((differ[0] <= far) & (sum(differ[2:], differ[1]) <= least_far))
    return out


def similar_links(met: DataFrame, sets, similarity: float, refined=None, links: DataFrame | None = None, near: DataFrame | None = None, many: int | None = None) -> DataFrame:
    """Links between sets of at least the similarity that join all sets so related. met: (key, node,
    size), sets that share a key, and what else `may_be_similar` reads; sets: (node, shingles), or a
    function that gives it for a table of nodes; near: pairs (a, b) that are compared in any case.

    Of keys with few sets all pairs are compared; of others each with the key's hub, the set with most
    shared keys (`known`; of near copies, the one that was changed least). Where that leaves a key's sets in
    different components, those outside of the largest are compared with all others of the key. Of keys of
    over `many` (MANY) sets that would be too much: `refined` gives keys of another order for these sets, `met` again,
    with the components (`root`) that `links` made. So no order or size of groups loses a link."""
    held = sets if callable(sets) else lambda nodes: sets
    about = [c for c in ("size", "rest", *BIT_COLUMNS, "root") if c in met.columns]
    side = lambda rows, n: rows.select("key", F.col("node").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in about))
    fits = may_be_similar(met.columns, similarity)
    if "root" in about:
        fits &= F.col("a_root") != F.col("b_root")
    spark = met.sparkSession
    hubs_path, placed_path, mixed_path = (folder(spark, f"jaccard-{name}") for name in ("hubs", "placed", "mixed"))
    best = F.struct(F.col("known") if "known" in met.columns else F.lit(0).alias("known"), (-F.col("size")).alias("size_"), "node", *about)
    hubs = staged(met.groupBy("key").agg(F.count("*").alias("n"), F.max(best).alias("hub")).where("n > 1"), "jaccard-hubs", hubs_path)
    crowd = hubs.where(F.col("n") > FEW)
    small = met.join(hubs.where(F.col("n") <= FEW).select("key"), "key")
    close = side(small, "a").join(side(small, "b"), "key").where("a > b").where(fits).select("a", "b")
    centres = crowd.select("key", F.col("hub.node").alias("b"), *(F.col(f"hub.{c}").alias(f"b_{c}") for c in about))
    centred = side(met, "a").join(centres, "key").where("a <> b").where(fits).select("a", "b")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = staged(pairs, f"{name}-pairs")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        return staged(similar(pairs, held(nodes), similarity), name)

    first = close.union(centred)
    first = verified(first if near is None else first.union(near), "jaccard-first")
    links = first if links is None else first.union(links)
    known = components(links).select("node", "root")
    placed = met.drop("root").join(crowd.select("key", "n"), "key").join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = staged(placed, "jaccard-placed", placed_path)
    discard(spark, hubs_path)
    counts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("key", F.col("main.root").alias("main"))
    mixed = staged(placed.join(main, "key"), "jaccard-mixed", mixed_path)
    discard(spark, placed_path)
    if mixed.isEmpty():
        return first
    about = [c for c in about if c != "root"] + ["root"]
    many = MANY if many is None else many
    crowds = mixed.where(F.col("n") > many) if refined is not None else mixed.where("false")
    direct = mixed.where(F.col("n") <= many) if refined is not None else mixed
    second = first
    if refined is None or many:
        apart = side(direct.where("root <> main"), "a").join(side(direct, "b"), "key").where("a_root <> b_root").where(fits).select("a", "b")
        second = first.union(verified(apart, "jaccard-second"))
    again = None if crowds.isEmpty() else refined(crowds.select("node", "root").distinct())
    discard(spark, mixed_path)
    return second if again is None else second.union(similar_links(again, sets, similarity, links=second.union(links)))


def exact_prefixes(sets: DataFrame, about: DataFrame, similarity: float) -> DataFrame:
    """(key, node, size, rest, bits, known, root) of some nodes: prefixes in the order of how many of
    these nodes have a shingle, counted exactly. sets: (node, shingles); about: the other columns but
    key and rest. Shingles of one node alone come first and are no keys."""
    unpacked = F.col("shingles")
    if sets.schema["shingles"].dataType.typeName() != "array":
        unpacked = map_column(lambda t: pa.array([np.frombuffer(d, np.int64) for d in utf8(t)], pa.list_(pa.int64())), "array<bigint>", F.col("shingles"))
    spark = sets.sparkSession
    each_path, counts_path = folder(spark, "refined-shingles"), folder(spark, "refined-counts")
    each = staged(sets.select("node", F.explode(unpacked).alias("key")), "refined-shingles", each_path)
    counts = staged(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "refined-counts", counts_path)
    listed = each.join(counts, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("shared"))
    alone = F.col("size") - F.size("shared")
    long = F.col("size") - F.ceil(similarity * F.col("size") - SLACK) + 1 - alone
    some = listed.join(about, "node").withColumns({"alone": alone, "long": long.cast("int")}).where("long > 0")
    bits = [c for c in BIT_COLUMNS if c in about.columns]
    keys = some.select("node", "size", *bits, "root", "alone", F.posexplode(F.slice("shared", F.lit(1), F.col("long"))).alias("at", "one"))
    rest = F.col("size") - F.col("alone") - F.col("at")
    out = staged(keys.select(F.col("one.key").alias("key"), "node", "size", rest.alias("rest"), *bits, (-F.col("alone")).alias("known"), "root"), "refined")
    discard(spark, each_path, counts_path)
    return out


def distinct_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id, with all its columns.
    Groups are the components of all pairs whose sets of shingles have at least the Jaccard similarity: of
    those whose fingerprints are linked, and of those that meet under a shingle.

    Defined cases: null and empty texts are copies of each other, and so are texts of equal sets of
    shingles; a text of fewer words than a shingle is one shingle. A null id is the least. Rows equal in
    id and text are one document. Very long texts are taken whole; an empty table gives an empty result;
    extra columns pass through and clash with nothing."""
    spark = docs.sparkSession
    ik, th = unused(docs, "row_id_hash"), unused(docs, "row_text_hash")
    keyed = docs.withColumns({ik: F.xxhash64(id), th: F.xxhash64(text)})
    held = spark.sparkContext.broadcast(common_shingles(docs, text, width))
    with shuffles_deleted(spark):
        chosen = _chosen(keyed, (id, ik, th, text), width, similarity, held)
    return keyed.join(chosen, [ik, th], "left_semi").dropDuplicates([ik, th]).select(*docs.columns)


def _chosen(keyed: DataFrame, columns: tuple[str, str, str, str], width: int, similarity: float, held) -> DataFrame:
    """The hashes of id and text of the documents that stay, as a table. columns: id, its hash, the text's hash, the text."""
    id, ik, th, text = columns
    spark = keyed.sparkSession
    wide_path, nodes_path, places_path, about_path, met_path = (folder(spark, name) for name in ("nodes-keys", "nodes", "places", "about", "met"))
    sets_paths = []
    said = map_column(lambda t: _nodes(t, width, similarity, held.value), _NODE, F.col(text))
    rows = keyed.select(F.struct(F.col(id).alias("id"), F.col(th).alias("th"), F.col(ik).alias("ik")).alias("row"), said.alias("s"))
    wide = rows.groupBy(F.col("s.node").alias("node")).agg(F.min("row").alias("row"), F.first("s").alias("s"))
    wide = staged(wide.select("node", "row", "s.size", *(f"s.{c}" for c in BIT_COLUMNS), "s.keys"), "nodes-keys", wide_path)
    nodes = staged(wide.drop("keys"), "nodes", nodes_path)
    entries = wide.select("node", F.posexplode("keys").alias("at", "key"))
    shared = staged(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-keys", shared_path := folder(spark, "shared-keys"))
    places = staged(entries.join(shared, "key").select("key", "node", "at"), "places", places_path)
    discard(spark, wide_path, shared_path)
    degrees = places.groupBy("node").agg(F.count("*").alias("known"))
    about = staged(nodes.drop("row").join(degrees, "node"), "about", about_path)
    met = staged(places.join(about, "node").select("key", "node", "size", (F.col("size") - F.col("at")).alias("rest"), *BIT_COLUMNS, "known"), "met", met_path)
    discard(spark, places_path)

    def sets(asked: DataFrame) -> DataFrame:
        """The sets of the nodes that are asked for, of one text each."""
        texts_of = staged(nodes.join(asked, "node", "left_semi").select("node", F.col("row.ik").alias(ik), F.col("row.th").alias(th)), "asked")
        texts = roughly(keyed.select(ik, th, F.col(text).alias("text")), texts_of, [ik, th]).join(texts_of, [ik, th]).dropDuplicates(["node"])
        packed = map_column(lambda t: pa.array([shingle_set(d, width).tobytes() for d in utf8(t)], pa.binary()), "binary", F.col("text"))
        sets_paths.append(folder(spark, "sets"))
        return staged(texts.select("node", packed.alias("shingles")), "sets", sets_paths[-1])

    refined = lambda some: exact_prefixes(sets(some), about.join(some, "node"), similarity)
    near = fingerprint_pairs(nodes.select("node", "bits"))
    found = components(similar_links(met, sets, similarity, refined, near=near))
    roots = nodes.select("node", "row").join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("row").alias("row"))
    chosen = staged(roots.select(F.col("row.ik").alias(ik), F.col("row.th").alias(th)), "chosen")
    discard(spark, nodes_path, about_path, met_path, *sets_paths)
    return chosen
