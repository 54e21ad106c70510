from __future__ import annotations

import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.llm import minhash as mh
from trailmill.llm import simhash as sh

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def set_of(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def plain(rows, hundredths=85):
    sets = [set_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= hundredths * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), k if not s else least.get(find(i)), k == (k if not s else least.get(find(i)))) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def copies(rng, n, words, edits):
    """A text and copies with some words changed, at random places."""
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


def made(seed=1):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "one", "ONE", "one two", "é É", "a b c d e", "a b c d e f", "A B C D E f", "a b c d e f g h"]
    texts += copies(rng, 30, 120, 6) + copies(rng, 20, 40, 2) + copies(rng, 12, 300, 12)
    # A chain: each is near the next, its ends are far apart.
    chain = [f"c{k}" for k in range(200)]
    for k in range(12):
        chain[k * 15] = f"y{k}"
        texts.append(" ".join(chain))
    texts += [" ".join(f"v{rng.randrange(40)}" for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(k * 3 - 20, t) for k, t in enumerate(texts)]
    return rows + [(7_000, "long " * 60_000), (7_001, "long " * 60_001), (None, texts[12]), (None, "nobody knows this one at all"), (9, texts[40]), (9, texts[40])]


def test_query_equals_all_pairs(spark):
    rows = made()
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", Node string").repartition(5)
    got = sorted((tuple(r) for r in mh.digest(df).collect()), key=repr)
    # Rows without an id whose component has none are kept.
    assert [(*r[:3], r[3] or r[0] is r[2] is None) for r in plain(rows)] == got
    assert mh.digest(df.limit(0)).collect() == []


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(sh, "FEW", 2)
    monkeypatch.setattr(sh, "MANY", 10)
    rng = random.Random(4)
    rows = list(enumerate(copies(rng, 70, 90, 9) + copies(rng, 40, 60, 4) + [" ".join(f"v{rng.randrange(9)}" for _ in range(12)) for _ in range(40)]))
    got = sorted((tuple(r) for r in mh.digest(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == plain(rows)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    for n in (1, 2, 5, 40, 3_000):
        both = draw(n)
        a, b = np.concatenate([both, draw(max(1, n // 10))]), np.concatenate([both, draw(max(1, n // 10))])
        got = mh.sketches([a, b, both, a[::-1].copy()], 512)
        assert (got != mh._NONE).all() and (got[0] == got[3]).all()
        assert abs((got[0] == got[1]).mean() - n / (n + 2 * max(1, n // 10))) < 0.11
    assert (mh.sketches([np.zeros(0, np.uint64)], 8) == mh._NONE).all() and mh.sketches([]).shape == (0, mh.COORDINATES)


def test_a_sketch_is_what_the_rounds_say():
    """Bin by bin, round by round, as the method is defined."""
    rng = np.random.default_rng(6)
    for n, t in ((1, 8), (3, 16), (100, 16)):
        elements = rng.integers(0, 2**64, n, dtype=np.uint64)
        want = {}
        for i in range(2 * t):
            thrown = mh.mixed(elements, i)
            new = {}
            for x, v in zip(thrown.tolist(), mh.mixed(thrown, 2 * t).tolist(), strict=True):
                b = ((x >> 32) * t) >> 32 if i < t else i - t
                new[b] = min(v, new.get(b, v))
            want |= {b: v for b, v in new.items() if b not in want}
        assert mh.sketches([elements], t)[0].tolist() == [want[b] for b in range(t)]


@pytest.mark.parametrize("similarity,least", [(0.85, 0.999), (0.9, 0.999)])
def test_bands_meet(similarity, least):
    rng = np.random.default_rng(7)
    met = 0
    for _ in range(1_000):
        both = rng.integers(0, 2**64, 170, dtype=np.uint64)
        rest = rng.integers(0, 2**64, round(170 / similarity) - 170, dtype=np.uint64)
        keys = mh.band_keys(mh.sketches([both, np.concatenate([both, rest])]), mh.BANDS, mh.ROWS)
        met += bool((keys[0] == keys[1]).any())
    assert met / 1_000 >= least


def test_columns_of_other_names(spark):
    df = spark.createDataFrame([("b", "one two three four five six"), ("a", "One two three four five six"), (None, None)], "name string, body string")
    assert sorted(map(tuple, mh.near_duplicates(df, "name", "body").collect()), key=repr) == [("a", 2, "a", True), ("b", 2, "a", False), (None, 0, None, True)]
    assert df.select(mh.described_column("body").alias("s")).where(F.size("s.keys") == 0).count() == 1
