from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from trailmill.llm import simhash as sh

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text, width=3):
    import re
    import string

    low = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes_of(numbers, distance=2):
    numbers = sorted(set(numbers))
    parent = {x: x for x in numbers}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(numbers):
        for b in numbers[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    return {x: find(x) for x in numbers}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def made(seed=1, n=80):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "gämma", "日本", "eps", "zeta", "Eta", "É"])
    base = [word() for _ in range(120)]
    out = [None, "", " \t", "one", "one two", "ONE two"]
    for k in range(n):
        w = list(base) if k % 2 else [word() for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = word()
        out.append(rng.choice([" ", "  ", "\n"]).join(w))
    return out


def test_against_brute_force(spark):
    rows = [*enumerate(made()), (3, "one"), (500, None), (None, "nothing like the others at all here")]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], SCHEMA + ", FP int, least string")
    prints = [plain_fingerprint(t) for _, t in rows]
    root = classes_of(prints)
    least = defaultdict(lambda: None)
    for (i, _), p in zip(rows, prints):
        least[root[p]] = min([x for x in (least[root[p]], i) if x is not None], default=None)
    want = sorted(((i, f"{p:016x}", least[root[p]]) for (i, _), p in zip(rows, prints)), key=str)
    assert sorted((tuple(r) for r in sh.digest(df).collect()), key=str) == want


@pytest.mark.parametrize("crowded", [1, 3, 16])
def test_crowded_keys_lose_no_link(spark, crowded):
    rng = random.Random(crowded)
    numbers = set()
    for centre in (rng.getrandbits(64) for _ in range(6)):
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.choice([0, 5, 9, 17, 23, 31, 32, 40, 47, 55, 63])
            numbers.add(x)
    df = spark.createDataFrame([(signed(x),) for x in numbers], "fp long")
    got = {r.fp % (1 << 64): r.root for r in sh.classes(df, crowded=crowded).collect()}
    want = classes_of(numbers)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups(got) == groups(want)


def test_long_chains(spark):
    edges = [(i + 1, i) for i in range(300)] + [(1_000 + i, 1_000) for i in range(1, 40)]
    got = {r.node: r.root for r in sh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[1_000 + i] == 1_000 for i in range(1, 40))


def test_counts_of_many_shingles():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**64, 255 * 256 + 777, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
    assert sh.fingerprint(hashes) == want


def test_distinct_documents(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(5_000)}" for _ in range(n)]
    rows, groups = [], []
    for g in range(12):
        text = words(300)
        groups.append([])
        for k in range(rng.randint(1, 4)):
            w = list(text)
            if k:
                w[rng.randrange(300)] = "changed"
            groups[-1].append(len(rows))
            rows.append((len(rows), " ".join(w), "en"))
    rows += [(0, rows[0][1], "en"), (None, "only one with no id but enough words to count", "x"), (900, None, None), (901, "", None)]
    df = spark.createDataFrame(rows, SCHEMA + ", row_id_hash string")
    got = sorted((r.doc_id for r in sh.distinct_documents(df).collect()), key=str)
    assert got == sorted([g[0] for g in groups] + [None, 900], key=str)


def least_of_components(texts, width=5, similarity=0.8):
    sets = [set(sh.shingle_hashes((t or "").encode(), width).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if not a | b or len(a & b) >= similarity * len(a | b) - 1e-9:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [i for i in range(len(texts)) if find(i) == i]


@pytest.mark.parametrize("counted", [0, 10_000])
def test_near_duplicates_are_all_pairs_of_the_similarity(spark, monkeypatch, counted):
    """Pairs around the limit, chains, and many texts with one passage, against all pairs."""
    monkeypatch.setattr(sh, "COUNTED", counted)
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(5_000)}" for _ in range(n)]
    texts, passage = [None, "", "a b", "a b", "a b c d e"], words(40)
    for _ in range(40):
        base = words(rng.randint(60, 250))
        texts.append(" ".join(base))
        w = list(base)
        for _ in range(rng.randint(1, 4)):  # a chain: each text is near the one before it
            for _ in range(max(1, round(len(w) * rng.uniform(0.015, 0.03)))):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [" ".join(passage + words(rng.randint(5, 60))) for _ in range(40)]
    rng.shuffle(texts)
    got = sorted(r.doc_id for r in sh.distinct_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect())
    want = least_of_components(texts)
    assert got == want and len(want) < len(texts) - 40


def test_linked_fingerprints_are_candidates(spark, monkeypatch):
    """Without pairs that meet under shingles, documents go whose fingerprints are linked and whose sets are similar."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(sh, "may_be_similar", lambda columns, similarity: F.lit(False))
    rng = random.Random(25)
    texts = []
    for _ in range(8):
        w = [f"w{rng.randrange(5_000)}" for _ in range(1_500)]
        for _ in range(4):
            texts.append(" ".join(w))
            w[rng.randrange(1_500)] = "changed"
    prints = [sh.fingerprint(sh.shingle_set(t.encode(), 5)) for t in texts]
    root = classes_of(prints)
    want = [i for i, p in enumerate(prints) if all(root[q] != root[p] for q in prints[:i])]
    got = sorted(r.doc_id for r in sh.distinct_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect())
    assert got == want and 8 <= len(want) < len(texts) - 4


def test_pairs_of_fingerprints_against_all_pairs(spark):
    rng = random.Random(26)
    bits = {}
    for centre in (rng.getrandbits(64) for _ in range(8)):
        for _ in range(30):
            x = centre
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.choice([0, 7, 15, 16, 31, 33, 48, 63])
            bits[len(bits)] = x
    df = spark.createDataFrame([(k, signed(x)) for k, x in bits.items()], "node long, bits long")
    pairs = [tuple(r) for r in sh.fingerprint_pairs(df).collect()]
    assert all((bits[a] ^ bits[b]).bit_count() <= 2 for a, b in pairs)
    root = {r.node: r.root for r in sh.components(spark.createDataFrame([(max(p), min(p)) for p in pairs], "a long, b long")).collect()}
    want = classes_of(bits.values())
    assert len({(root.get(k, k), want[x]) for k, x in bits.items()}) == len(set(want.values())) == len({root.get(k, k) for k in bits})


def test_similarity_decides_of_linked_fingerprints(spark):
    """Equal fingerprints of different sets are no link."""
    sets = {1: range(100), 2: range(1, 101), 3: range(500, 600)}
    held = spark.createDataFrame([(k, bytearray(np.array(v, np.uint64).tobytes())) for k, v in sets.items()], "node long, shingles binary")
    met = spark.createDataFrame([], "key long, node long, size int")
    near = sh.fingerprint_pairs(spark.createDataFrame([(k, 5) for k in sets], "node long, bits long"))
    assert [tuple(r) for r in sh.similar_links(met, held, 0.8, near=near).collect()] == [(2, 1)]


def test_links_do_not_depend_on_leaders(spark):
    """Large groups under one key, of which the least set is near only some."""
    rng = random.Random(22)
    base = list(range(1_000, 1_100))
    made = [frozenset(rng.sample(base, rng.randint(80, 95))) | {1} for _ in range(60)]
    sets = dict(enumerate(dict.fromkeys(made)))
    import numpy as np

    met = spark.createDataFrame([(1, k, len(v)) for k, v in sets.items()], "key long, node long, size int")
    held = spark.createDataFrame([(k, bytearray(np.array(sorted(v), np.uint64).tobytes())) for k, v in sets.items()], "node long, shingles binary")
    root = {r.node: r.root for r in sh.components(sh.similar_links(met, held, 0.85)).collect()}
    parent = {k: k for k in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if len(a & b) >= 0.85 * len(a | b) - 1e-9:
                    parent[i] = parent[j] = min(parent[i], parent[j])
    assert {k: root.get(k, k) for k in sets} == parent and len(set(parent.values())) > 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sh.digest(empty).collect() == [] and sh.distinct_documents(empty).collect() == []


@pytest.mark.parametrize("original", [True, False])
def test_large_groups_of_near_copies(spark, monkeypatch, original):
    """Copies of one text with more and more changed words, so that most pairs are below the limit and few above."""
    monkeypatch.setattr(sh, "COUNTED", 0)
    rng = random.Random(23)
    base = [f"w{rng.randrange(5_000)}" for _ in range(150)]
    texts = [" ".join(base)] if original else []
    for k in range(90):
        w = list(base)
        for at in rng.sample(range(150), 1 + k % 7):
            w[at] = f"x{k}y{at}"
        texts.append(" ".join(w))
    texts += [" ".join(f"w{rng.randrange(5_000)}" for _ in range(100)) for _ in range(20)]
    got = sorted(r.doc_id for r in sh.distinct_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect())
    want = least_of_components(texts)
    assert got == want and 21 < len(want) < len(texts)


def test_exact_prefixes_meet_every_similar_pair(spark):
    rng = random.Random(24)
    common = list(range(1_000, 1_060))
    sets = {k: np.array(sorted({*rng.sample(common, rng.randint(45, 60)), *rng.sample(range(5_000), rng.randint(0, 12))}), np.uint64) for k in range(60)}
    held = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in sets.items()], "node long, shingles binary")
    about = spark.createDataFrame([(k, len(v), *[0] * len(sh.BIT_COLUMNS), k) for k, v in sets.items()], f"node long, size int, {', '.join(f'{c} long' for c in sh.BIT_COLUMNS)}, root long")
    rows = sh.exact_prefixes(held, about, 0.8).collect()
    keys = defaultdict(dict)
    for r in rows:
        keys[r.node][r.key] = r.rest
    near = 0
    for i, a in sets.items():
        for j, b in sets.items():
            both = len(np.intersect1d(a, b))
            if i < j and both >= 0.8 * (len(a) + len(b) - both):
                near += 1
                met = keys[i].keys() & keys[j].keys()
                assert any(min(keys[i][k], keys[j][k]) >= 0.8 / 1.8 * (len(a) + len(b)) - 1e-9 for k in met)
    assert near > 50


def test_farthest_bits():
    """Bits of sets at the limit are within the distances that are allowed, those of other sets mostly are not."""
    rng = np.random.default_rng(5)
    near, far = [], []
    for n in (18, 63, 450, 3_000):
        for _ in range(60):
            for share, out in ((n // 9, near), (n // 3, far)):
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                b = np.unique(np.concatenate((a[share:], rng.integers(0, 2**64, share, dtype=np.uint64))))
                bits = [(sh.fingerprint(x), *sh.least_bits(x).tolist()) for x in (a, b)]
                differ = [(x ^ y).bit_count() for x, y in zip(*bits, strict=True)]
                out.append(differ[0] <= sh.farthest(0.8)[0] and sum(differ[1:]) <= sh.farthest(0.8)[1])
    assert all(near) and sum(far) < 0.1 * len(far)


def test_keys_of_very_many_sets(spark, monkeypatch):
    """Above MANY sets a key's sets get exact prefixes; the result is that of all pairs."""
    monkeypatch.setattr(sh, "COUNTED", 0)
    monkeypatch.setattr(sh, "MANY", 20)
    rng = random.Random(25)
    base = [f"w{rng.randrange(5_000)}" for _ in range(120)]
    texts = []
    for k in range(110):
        w = list(base)
        for at in rng.sample(range(120), k % 6):
            w[at] = f"x{k}y{at}"
        texts.append(" ".join(w))
    called = []
    exact = sh.exact_prefixes
    monkeypatch.setattr(sh, "exact_prefixes", lambda *a: called.append(1) or exact(*a))
    got = sorted(r.doc_id for r in sh.distinct_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect())
    assert got == least_of_components(texts) and called


@pytest.mark.parametrize("most", [1 << 15, 1 << 27])
def test_rows_of_a_bitmap(spark, monkeypatch, most):
    """No row that is asked for is lost, however full the bitmap; few others come along while it has room."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(sh, "MOST_BITS", most)
    rows = spark.range(40_000).withColumns({"k": F.xxhash64("id"), "bitmap": F.lit("x"), "bitmap_bucket": F.lit(None).cast("string")})
    for share in (1, 7, 40_000):
        out = sh.roughly(rows, rows.where(F.col("id") % share == 0).select("k"), ["k"])
        got = [r.id for r in out.collect()]
        assert out.columns == rows.columns and len(set(got)) == len(got) and set(got) >= set(range(0, 40_000, share))
        assert share == 1 or most == 1 << 15 or len(got) < 40_000 // share + 4_000
    assert sh.roughly(rows, rows.where("false").select("k"), ["k"]).collect() == []


def test_only_texts_of_candidates_are_joined(spark, monkeypatch):
    rng = random.Random(27)
    texts = [" ".join(f"w{rng.randrange(5_000)}" for _ in range(60)) for _ in range(400)]
    texts += [f"{t} changed" for t in texts[:5]]
    joined, roughly = [], sh.roughly
    monkeypatch.setattr(sh, "roughly", lambda rows, *a: joined.append(roughly(rows, *a)) or joined[-1])
    got = sorted(r.doc_id for r in sh.distinct_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect())
    assert got == least_of_components(texts) == list(range(400))
    assert joined and all(10 <= df.count() < 30 for df in joined)


def test_disk_is_given_back_on_the_way(spark, monkeypatch):
    """Past near-dedup no shuffle file of its steps is left, nor a table but those that its result reads; the setting is as before."""
    import time
    from pathlib import Path

    monkeypatch.setattr(sh, "common_shingles", lambda *a: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    tables = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "trailmill"
    folders = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for d in folders for p in Path(d).rglob("shuffle_*.data")}
    rng = random.Random(28)
    base = [f"w{rng.randrange(5_000)}" for _ in range(120)]
    texts = []
    for k in range(60):
        w = list(base)
        for at in rng.sample(range(120), k % 6):
            w[at] = f"x{k}y{at}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    before, there, setting = files(), {p.name for p in tables.glob("*")}, spark.conf.get(key)
    out = sh.distinct_documents(docs)
    left = {p.name.rsplit("-", 1)[0] for p in tables.glob("*") if p.name not in there}
    assert left.isdisjoint({"nodes-keys", "nodes", "shared-keys", "places", "about", "met", "sets", "jaccard-hubs", "jaccard-placed", "jaccard-mixed"})
    for _ in range(20):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(key) == setting
    assert sorted(r.doc_id for r in out.collect()) == least_of_components(texts)
