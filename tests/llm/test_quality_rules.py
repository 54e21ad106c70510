from __future__ import annotations

import math
import random
import re
import statistics
import string
from collections import Counter

import zstandard

from trailmill.llm import quality_rules as qr


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(inside) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), failed


def texts():
    rng = random.Random(1)
    vocab = [*"abcdefg", "#", "*x*", "é", "日本", "<b>", " y", " ", "\x1cz", "ß|"]
    out = [None, "", " \n\t", "a", "one\ntwo\none\n \n \none", "word " * 60, " ".join(map(str, range(60))), "x" * 200_000, " ".join(map(str, range(30_000)))]
    for _ in range(60):
        out.append("".join(rng.choice(vocab) + rng.choice([" ", "\n", "\t", "  ", "\x0b"]) for _ in range(rng.randint(1, 150))))
    return out


def test_against_brute_force(spark):
    rows = [(i, t, 0, "x") for i, t in enumerate(texts())] + [(0, "a b", 1, "y"), (None, "a b", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, QUALITY_ string")
    got = {r.doc_id: tuple(r)[1:7] for r in qr.digest(df.where("doc_id > 0")).collect()}
    assert got == {i: brute(t) for i, t, *_ in rows if i}
    out, name = qr.quality(df)
    assert name == "quality__" and out.columns == [*df.columns, name] and out.count() == len(rows)


def test_verdicts(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(n))
    line = prose(12)
    cases = {1: prose(300), 2: "\n".join(f"{line} {k} {k + 1}" for k in range(300)), 3: "".join(chr(rng.randint(0x4E00, 0x9FFF)) + " " * (k % 3 == 0) for k in range(900)), 4: prose(20), 5: prose(20_000)}
    df = spark.createDataFrame([(k, t) for k, t in cases.items()], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in qr.digest(df).collect()}
    assert kept[1] and kept[5] and not kept[2] and not kept[4]
    assert all(kept[k] in (True, False) for k in cases)


def plain_verdicts(texts):
    """kept of each text, by loops."""
    packer = zstandard.ZstdCompressor(level=3)
    ratio = lambda b: len(b) / len(packer.compress(b))
    half_octave = lambda n: int(2 * math.log2(n))
    parts = lambda b: [b[at : at + 4_096] for at in range(0, len(b), 4_096) if len(b[at : at + 4_096]) >= 1_024]
    good = {i: (t or "").encode() for i, t in enumerate(texts) if not brute(t)[-1]}
    ratios, chunks = {}, sorted(ratio(c) for b in good.values() for c in parts(b) if len(c) == 4_096)
    for b in good.values():
        ratios.setdefault(half_octave(len(b)), []).append(ratio(b))

    def quartiles(values):
        values = sorted(int(v / 0.005) for v in values)
        return [(values[max(0, math.ceil(q * len(values)) - 1)] + 0.5) * 0.005 for q in (0.25, 0.5, 0.75)]

    def wide(k):
        return next(b[1:] for b in ((512, 0.9, 4.0), (2_048, 1.15, 5.0), (8_192, 1.3, 6.0), (65_536, 1.4, 8.0), (1 << 60, 1.4, 10.0)) if 2 ** (k / 2) < b[0])

    def lean(n, middle, spread, k):
        share = n / (n + 10)
        return share * (middle - 3 * spread) + (1 - share) * wide(k)[0], share * (middle + 2 * spread) + (1 - share) * wide(k)[1]

    def limits(k):
        near = [(j, ratios[j], quartiles(ratios[j])) for j in range(k - 2, k + 3) if len(ratios.get(j, ())) >= 8]
        if not near:
            return wide(k)
        slope = statistics.median([(a[2][1] - b[2][1]) / (a[0] - b[0]) for a in near for b in near if a[0] > b[0]] or [0])
        middle = statistics.median(q[1] + slope * (k - j) for j, _, q in near)
        return lean(sum(len(r) for _, r, _ in near), middle, max(0.02, statistics.median(q[2] - q[0] for _, _, q in near)), k)

    def between(n):
        """The limits of a length, between the middles of its class and the next one's."""
        place = max(0.0, 2 * math.log2(n) - 0.5)
        (a, b), (c, d), share = limits(int(place)), limits(int(place) + 1), place - int(place)
        return a * (1 - share) + c * share, b * (1 - share) + d * share

    if len(chunks) >= 8:
        low, middle, high = quartiles(chunks)
        of_chunks = lean(len(chunks), middle, max(0.02, high - low), 24)
    else:
        of_chunks = wide(24)
    out = []
    for i in range(len(texts)):
        b = good.get(i)
        ok = b is not None
        if ok:
            low, high = between(len(b))
            bad = 0
            for c in parts(b):
                least, most = of_chunks if len(c) == 4_096 else between(len(c))
                bad += not least <= ratio(c) <= most
            ok = low <= ratio(b) <= high and bad <= 0.5 * len(parts(b))
        out.append(ok)
    return out


def corpus():
    rng = random.Random(12)
    vocab = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(3_000)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    out = [prose(int(60 * 1.012**k)) for k in range(400)]
    noise = ["".join(rng.choices(string.ascii_letters + string.digits + "+/", k=rng.randint(5, 9))) for _ in range(3_000)]
    repeated = [" ".join(w + "%%%" for w in rng.sample(vocab[:40], 30) + rng.choices(vocab, k=30)) + "\n" for _ in range(12)]
    out += [" ".join(rng.sample(noise, 250)) for _ in range(8)] + [a * 2 + " ".join(rng.sample(vocab, 140)) for a in repeated]
    mixed = [prose(600) + " " + " ".join(rng.sample(noise, 1_800)) for _ in range(4)]
    return [*out, *mixed, None, "", prose(20_000), "word " * 400]


def test_verdicts_against_plain_rules(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.kept for r in qr.digest(df).collect()}
    want = plain_verdicts(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(want[:400]) >= 388, "prose stays, but for the tails of its own ratios"
    assert not any(want[400:408]), "noise goes"
    assert not any(want[420:424]), "texts that are noise for the most part go"
    out, q = qr.quality(df)
    assert {r.doc_id: r[q].kept for r in out.collect()} == got


def test_copies_move_no_limit():
    """A group of copies as large as all others together is in one class; the others' limits stay."""
    rng = random.Random(13)
    counts = {k: Counter(int((1.0 + 0.05 * k + rng.gauss(0, 0.05)) / qr.STEP) for _ in range(400)) for k in range(16, 26)}
    before = qr.fitted(counts)
    counts[20][int(2.15 / qr.STEP)] += 4_000
    after = qr.fitted(counts)
    assert all(abs(a - b) < 0.1 for x, y in zip(before, after, strict=True) for a, b in zip(x, y, strict=True))


def test_bands():
    assert qr.inside(2.0, 100) and not qr.inside(5.0, 100) and qr.inside(5.0, 4_000) and not qr.inside(0.5, 10**6)


def test_empty_table(spark):
    assert qr.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
