"""A Merkle manifest of a dataset: a tree of digests over its rows, and for each row the path that proves it.

Rows are leaves, ordered by id within a group (a language); every two consecutive nodes of a level have a parent,
an odd one at the end has one of its own; what remains is the group's root, and the groups' roots, in order,
are the leaves of one more such tree. H is SHA-256 over the concatenated inputs, digests as hex.

The tree is built by message passing on RDDs, as in Pregel. A vertex is an aligned run of up to 2^LEVELS nodes of one
level with all their common ancestors up to LEVELS higher, so a message crosses LEVELS levels. Upward, in each
superstep the vertices that have all their children's digests hash, and send one digest to their
parent; downward, each vertex that has its own path sends each child that path, with the siblings below it put in
front. Leaves meet their path in the last superstep, where they are verified. Messages go up
once for every 2^LEVELS nodes and down as often, so shuffles shrink by that factor with each superstep, and their
number is the logarithm of the rows. All supersteps are one lineage over a table in the shared folder: a
lost executor's part is computed again.

Ranks within a group come from a shuffle by ranges (operators.ranks), so a group that has a third of all rows is
in as many tasks as it fills. No task holds more than its share of vertices; nothing about single rows passes the driver.

Defined cases: null fields hash as "-"; a null group is the first one; null ids come first; rows that tie in id
order by their leaf. Repeated rows are leaves of their own. An empty table has an empty manifest. Extra
columns are not read. A very long text is hashed where it is; only digests move.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ..operators.ranks import numbered
from .common import map_column, staged
from .hash_tree import DOWN, UP, dealt, folded, levels_of, nodes_of, siblings

#: Levels that a superstep crosses, and vertices of a partition.
LEVELS = 8
VERTICES = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The group that the groups' own roots form.
TOP = -1


def leaf_digest(fields: dict[str, Column]) -> Column:
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]
    return F.unhex(F.sha2(F.concat(*said), 256))


def manifest(docs: DataFrame, id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, found: dict[str, Column] | None = None, levels: int = LEVELS, vertices: int = VERTICES) -> DataFrame:
    """(id, group, leaf, subroot, root, sides, others, folded) of every row: its digest, its group's and the dataset's root,
    its path (see `siblings`), and the root that its path gives with the row's leaf as it is found now.
    found: columns that have changed since the digests were made, and what they hold."""
    now = {f: (found or {}).get(f, F.col(f)) for f in fields}
    leaves = staged(docs.select(F.col(id).alias("id"), F.col(group).alias("grp"), leaf_digest({f: F.col(f) for f in fields}).alias("leaf"), leaf_digest(now).alias("now")), "leaves")
    # What has not changed is not sent along.
    leaves = leaves.withColumn("now", F.when(F.col("now") != F.col("leaf"), F.col("now")))
    ranked = numbered(leaves, [F.col("id").asc_nulls_first(), "leaf"], ["grp"], "place", "total")
    groups = ranked.groupBy("grp").agg(F.max("total").alias("total_"))
    groups = staged(numbered(groups, [F.col("grp").asc_nulls_first()], name="run"), "groups")
    n, largest, rows = groups.agg(F.count("*"), F.max("total_"), F.sum("total_")).first()
    kinds = [StructField("id", leaves.schema["id"].dataType), StructField("grp", leaves.schema["grp"].dataType)]
    kinds += [StructField(c, BinaryType()) for c in ("leaf", "subroot", "root")] + [StructField("sides", StringType()), StructField("others", BinaryType()), StructField("folded", BinaryType())]
    schema, spark = StructType(kinds), docs.sparkSession
    if not n:
        return spark.createDataFrame([], schema).withColumnsRenamed({"id": id, "grp": group})
    runs = groups.select(F.col("grp").alias("grp_"), "run")
    placed = ranked.join(runs, F.col("grp").eqNullSafe(F.col("grp_")))
    one = F.struct(F.pmod("place", F.lit(1 << levels)).alias("k"), "id", "leaf", "now")
    packed = placed.groupBy("run", F.shiftright("place", levels).alias("number")).agg(F.first("grp").alias("grp"), F.first("total").alias("total"), F.sort_array(F.collect_list(one)).alias("rows"))

    # What goes to a vertex is (key, (UP, place, nodes of the level, digest)) or (key, (DOWN, sides, others, subroot, root)); at
    # the leaves, up is (key, (UP, group, nodes, rows)). Both are dealt by key alone, so a vertex meets its path where it is.
    def loaded(r) -> tuple:
        return (r.run, r.number), (UP, r.grp, r.total, [(x.id, bytes(x.leaf), bytes(x.now) if x.now is not None else None) for x in r.rows])

    context = spark.sparkContext
    parts = [max(-(-rows // (vertices << levels)), min(context.defaultParallelism, -(-rows >> levels)))]
    tree = [packed.rdd.map(loaded).partitionBy(parts[0], dealt)]

    def raised(to, bottom: bool):
        """Upward: a vertex that has all its nodes hashes them and sends its root on."""

        def send(vertex) -> tuple:
            (run, number), held = vertex
            total, nodes = nodes_of(held, bottom)
            left = -(-total >> levels) if total > 1 << levels else 1
            return to(run, number, left, levels_of(nodes, total, levels)[-1][0])

        return send

    def climb(to, most: int) -> None:
        sent = tree[-1].groupByKey(parts[-1], dealt).map(raised(to, len(tree) == 1))
        parts.append(most)
        tree.append(sent.partitionBy(most, dealt))

    above = lambda run, number, left, root: ((run, number >> levels), (UP, number, left, root))
    across = lambda run, number, left, root: ((TOP, run >> levels), (UP, run, n, root))
    steps = lambda total: max(0, -(-(total - 1).bit_length() // levels) - 1)  # noqa: E731  supersteps to the vertex that has all
    for _ in range(steps(largest)):
        climb(above, max(1, parts[-1] >> levels))
    seam = len(tree)
    climb(across, max(1, -(-n // (vertices << levels))))
    for _ in range(steps(n)):
        climb(above, max(1, parts[-1] >> levels))

    def lowered(at: int):
        """Downward: a vertex that has its path sends each child the path with what stands beside it in front."""

        def send(vertex) -> Iterator[tuple]:
            (run, number), held = vertex
            held = list(held)
            total, nodes = nodes_of(held, False)
            grown = levels_of(nodes, total, levels)
            sides, others, subroot, root = next((x[1:] for x in held if x[0] == DOWN), ("", b"", None, grown[-1][0]))
            for k, node in enumerate(nodes):
                side, other = siblings(grown, k)
                child = (number << levels) + k
                to, sub = ((child, 0), node) if at == seam else ((run, child), subroot)
                yield to, (DOWN, side + sides, other + others, sub, root)

        return send

    def proved(vertex) -> Iterator[tuple]:
        held = list(vertex[1])
        _, grp, total, own = next(x for x in held if x[0] == UP)
        sides, others, subroot, root = next(x[1:] for x in held if x[0] == DOWN)
        grown = levels_of([leaf for _, leaf, _ in own], total, levels)
        for k, (key, leaf, now) in enumerate(own):
            side, other = siblings(grown, k)
            side, other = side + sides, other + others
            yield key, grp, leaf, subroot, root, side, other, folded(now or leaf, side, other)

    met = tree[-1]
    for at in range(len(tree) - 1, 0, -1):
        paths = met.groupByKey(parts[at], dealt).flatMap(lowered(at)).partitionBy(parts[at - 1], dealt)
        met = tree[at - 1].union(paths)
    out = met.groupByKey(parts[0], dealt).flatMap(proved)
    return spark.createDataFrame(out, schema, verifySchema=False).withColumnsRenamed({"id": id, "grp": group})


def root_of(leaf: Column, sides: Column, others: Column) -> Column:
    """The root that leaves give with paths of a manifest: what a reader of some rows checks them with."""

    def roots(leaf: pa.Array, sides: pa.Array, others: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (leaf, sides, others)), strict=True)
        return pa.array([None if None in row else folded(*row) for row in rows], pa.binary())

    return map_column(roots, "binary", leaf, sides, others)


#: Fixed value: rows whose id's checksum it divides are tampered with.
TAMPERED = 7


def digest(docs: DataFrame) -> DataFrame:
    """The result of the query, for every document."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    longer = F.when(hit, F.col("n_chars").cast("decimal(38,0)") + 1).otherwise(F.col("n_chars").cast("decimal(38,0)"))
    out = manifest(docs, found={"n_chars": longer})
    said = lambda c: F.lower(F.hex(c))
    return out.select(
        "doc_id", *(said(c).alias(c) for c in ("leaf", "subroot", "root")), F.sha2(said("others").cast("binary"), 256).alias("proof_sha256"),
        said("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
