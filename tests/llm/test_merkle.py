from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from trailmill.llm import merkle as mk

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def paths(nodes):
    """The root, and for each node its siblings (side, digest or None) up to it."""
    out = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            j = i ^ 1
            out[k].append((j < i, nodes[j] if j < len(nodes) else None))
            at[k] = i // 2
        nodes = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
    return nodes[0], out


def plain(rows):
    if not rows:
        return []
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, done = [], {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        root, found = paths([leaf_of(r) for r in own])
        tops.append(root)
        done[g] = (own, found)
    root, above = paths(tops)
    out = []
    for k, g in enumerate(order):
        for row, path in zip(*done[g], strict=True):
            path = path + above[k]
            hit = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            fold = leaf_of((*row[:3], row[3] + 1, row[4])) if hit else leaf_of(row)
            for left, other in path:
                fold = h(fold) if other is None else h(other, fold) if left else h(fold, other)
            out.append((row[0], leaf_of(row), tops[k], root, h(*(o for _, o in path if o)), fold, fold == root))
    return out


def odd_rows(n=150):
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", "a", "é日\U0001f600", "x" * 50_000, "1:a-", "-"])
    rows = [(k, rng.choice(["s", None, "web"]), rng.choice(["en", "de", None, "", "é", "Z"]), rng.choice([None, 0, 5, 2**63 - 1]), text()) for k in range(n)]
    rows += [(None, None, None, None, None)] * 3 + [(None, "s", "en", 1, "no id"), (5, "s", "en", 5, "same id"), (5, "s", "en", 5, "same id"), (-9, "s", "alone", 1, "one of its language")]
    return rows


@pytest.mark.parametrize("levels,vertices", [(1, 1), (2, 3), (8, 256)])
def test_equals_a_plain_tree(spark, levels, vertices):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "more") for r in rows], SCHEMA + ", Total string").repartition(6)
    out = mk.manifest(df, found={"n_chars": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars").cast("decimal(38,0)") + 1).otherwise(F.col("n_chars").cast("decimal(38,0)"))}, levels=levels, vertices=vertices)
    got = sorted(((r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), hashlib.sha256(r.others.hex().encode()).hexdigest(), r.folded.hex(), r.folded == r.root) for r in out.collect()), key=repr)
    assert got == sorted(plain(rows), key=repr)


def test_query_equals_a_plain_tree(spark):
    for rows in (odd_rows(60), [(1, "s", "en", 1, "alone")], [(1, "s", "en", 1, "a"), (2, "s", "en", 1, "b"), (3, "s", None, 1, "c")], []):
        got = sorted(map(tuple, mk.digest(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
        assert got == sorted(plain(rows), key=repr)


def test_a_hot_group_of_many_blocks(spark):
    rows = [(k, "s", "en" if k % 50 else "de", k, f"text {k}") for k in range(3_000)]
    got = mk.manifest(spark.createDataFrame(rows, SCHEMA), levels=3, vertices=4)
    assert sorted((r.doc_id, r.leaf.hex(), r.root.hex()) for r in got.select("doc_id", "leaf", "root").collect()) == sorted((x[0], x[1], x[3]) for x in plain(rows))


def test_a_reader_of_some_rows_checks_them(spark):
    rows = odd_rows(40)
    made = mk.manifest(spark.createDataFrame(rows, SCHEMA)).where("doc_id in (3, 4, 20)")
    again = made.withColumn("seen", mk.root_of(F.when(F.col("doc_id") == 4, F.unhex(F.lit("00" * 32))).otherwise(F.col("leaf")), F.col("sides"), F.col("others")))
    assert {r.doc_id: r.seen == r.root for r in again.collect()} == {3: True, 4: False, 20: True}
    assert mk.folded(b"x", "", b"") == b"x"


def test_any_partitioning_gives_one_manifest(spark):
    df = spark.createDataFrame(odd_rows(80), SCHEMA)
    one, two = (sorted(map(tuple, mk.digest(df.repartition(k)).collect()), key=repr) for k in (1, 9))
    assert one == two
