from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from trailmill.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string"


def brute(rows):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[s : s + 35]) for _, w in texts for s in range(len(w) - 34))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - 34):
            if seen[tuple(w[s : s + 35])] > 1:
                gone[s : s + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed: int, n: int = 60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [text(rng.randint(30, 90)) for _ in range(6)]
    base = text(200)
    rows = []
    for i in range(n):
        kind = rng.randrange(7)
        w = text(rng.randint(0, 150))
        if kind == 1:
            p = rng.choice(passages)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            w = w[:40] + p[a:b] + w[40:]
        elif kind == 2:
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
        elif kind == 3:
            w = base
        elif kind == 4:
            w = [rng.choice(words)] * rng.randint(30, 80)
        elif kind == 5:
            w = passages[0] + w + passages[0]
        elif kind == 6:
            unit = text(rng.randint(2, 12))
            w = (unit * 12)[: rng.randint(30, 90)]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return [*rows, (n, None), (n + 1, ""), (None, " ".join(base)), (None, "é ü " * 20), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA + ", H string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.digest(df.repartition(5)).collect()), key=str)
    assert got == brute(rows)


def test_slices_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sd, "SLICE", 64)
    rows = [(i, t) for i, t in made(7, 30)]
    texts = [(t or "").encode() for _, t in rows]
    whole = {(k, first + s) for words, parts in sd.slices(texts) for k, first, _, n in parts for s in range(n - 34)}
    assert whole == {(k, s) for k, t in enumerate(texts) for s in range(len(t.split()) - 34)}
    for words, parts in sd.slices(texts):
        part, *_, start, count = sd.anchors_of(words, parts)
        assert count.max() <= sd.SPAN and count.sum() == sum(n - 34 for *_, n in parts)


def test_maximal_repeats(spark):
    rng = random.Random(5)
    text = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    p = text(50)
    docs = [(0, text(20) + p + text(30)), (1, text(100) + p), (2, p[:34] + text(40))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], SCHEMA)
    got = {(r.doc_id, r.start, r.length) for r in sd.maximal_repeats(df).collect()}
    assert got == {(0, 20, 50), (1, 100, 50)}


def test_empty_table(spark):
    assert sd.digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_least_of():
    x = np.array([5, 3, 9, 1, 7, 8, 2, 6], np.uint64)
    for span in range(1, 8):
        assert sd.least_of(x, span).tolist() == [int(x[i : i + span].min()) for i in range(len(x) - span + 1)]
