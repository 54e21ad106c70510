from __future__ import annotations

import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest

from trailmill.llm import packing, token_counts, tokens

SCHEMA = "doc_id long, text string"


def texts():
    rng = random.Random(5)
    parts = ["the", " The", "'s", "I'LL", "don't", "\n", "\n\n", "  ", "\t", "é", "É", "ß", "日本語", "½", "²x", "123", "...", "“q”", "€5", "<|endoftext|>", "<|startoftext|>", "<|", " ", "\x85", "\x1c", "İ", "ǅ", "é", "‍", "😀", "­", "ªº", "_a-b_", "ſ"]
    out = [None, "", " ", "a" * 5_000, "word " * 3_000, " ".join(map(str, range(4_000)))]
    return out + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 40))) for _ in range(250)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_are_the_librarys(name):
    path = tokens.vocabulary(name)
    rows = [t or "" for t in texts()]
    want = [e.ids for e in tokens.library(path).encode_batch(rows, add_special_tokens=False)]
    if name.startswith("byte"):
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(rows, path)] == want
    else:
        assert tokens.count(rows, path) == [len(w) for w in want]
        assert tokens.count(rows, path, {"the": 1, "word": 1}) == [len(w) for w in want]


def strings():
    """Words of every category of code points, of the whole plain alphabet, and all code points once."""
    rng = random.Random(8)
    by = defaultdict(list)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for c in points:
        by[unicodedata.category(c)].append(c)
    plain, kinds = [*sorted(tokens._INSIDE), " ", "\n"], sorted(by)
    out = ["«Ə»", "¨Ʌƒ”₷Ŕ", "ΑΣ ΑΣ.", "İI ıi", "e\u0301 \u0301e", *"ƁƆƉƊƏƐƓƔƖƗƜƝƟƦƩƮƱƲƷȺȾɄɅ"]
    out += ["".join(rng.choices(plain, k=rng.randint(1, 12))) for _ in range(4_000)]
    for _ in range(6_000):
        out.append("".join(rng.choice(by[rng.choice(kinds)]) if rng.random() < 0.6 else rng.choice("abcXYZ's 'll 12 .,\t\u3000é") for _ in range(rng.randint(1, 14))))
    return out + [" a".join(points[at : at + 300]) for at in range(0, len(points), 300)]


@pytest.mark.parametrize("stretch", [5, tokens.STRETCH])
def test_counts_of_all_scripts_are_the_librarys(monkeypatch, stretch):
    monkeypatch.setattr(tokens, "STRETCH", stretch)
    path, rows = tokens.vocabulary("word_bpe_49k.json"), strings()
    want = [len(e.ids) for e in tokens.library(path).encode_batch(rows, add_special_tokens=False)]
    assert [row for row, n, w in zip(rows, tokens.count(rows, path), want, strict=True) if n != w] == []


def test_words_as_shown_read_back():
    assert all(tokens.read(tokens.shown(w)) == w for w in ("a", "é", "日本語", "\x00 \x7f"))


def test_small_caches_give_the_same(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 3)
    path = tokens.vocabulary("word_bpe_49k.json")
    tokens._CACHES.clear()
    rows = [t or "" for t in texts()][:60]
    assert tokens.count(rows, path) == [len(tokens.library(path).encode(t, add_special_tokens=False).ids) for t in rows]


def test_counts(spark):
    rows = list(enumerate(texts())) + [(1, "a"), (None, "b")]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], SCHEMA + ", N_TOKENS int")
    path = tokens.vocabulary("word_bpe_49k.json")
    want = sorted(((i, len((t or "").encode()), len(tokens.library(path).encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=str)
    got = token_counts.digest(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 2_048) for r in got)
    assert token_counts.digest(df.where("false")).collect() == []


def test_frequent_table_has_lengths(spark):
    df = spark.createDataFrame([(1, "the cat the cat the"), (2, None)], SCHEMA)
    path = tokens.vocabulary("word_bpe_49k.json")
    assert token_counts.frequent(df, "text", path) == {"the": 1, "cat": 1}
    assert token_counts.frequent(df, "text", path, 1) == {"the": 1}


@pytest.mark.parametrize("held", [7, token_counts.HELD])
def test_frequent_table_is_of_all_documents(spark, monkeypatch, held):
    """Words that are twice in the corpus, in two documents far apart, among thousands that are there once."""
    monkeypatch.setattr(token_counts, "HELD", held)
    twice = [f"{a}{b}é日" if b == "x" else f"{a}{b}" for a in "bcdfghjklmnpqrstvwxz" for b in "xy"]
    letters = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    rows = [(k, f"u{letters(k)}u") for k in range(9_000)]
    rows = [*enumerate(twice), *rows, *enumerate(twice)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = tokens.vocabulary("word_bpe_49k.json")
    pieces = [w for t in twice for as_shown, words in tokens.pretokens(t, path) for w in (map(tokens.read, words) if as_shown else words)]
    assert set(token_counts.frequent(df, "text", path, len(set(pieces)))) == set(pieces) and len(set(pieces)) >= 40


def test_best_fit_decreasing_against_plain_search():
    rng = random.Random(6)
    for _ in range(30):
        capacity = rng.choice([1, 7, 64, 2_048])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        windows, offsets, used = packing.best_fit_decreasing(lengths, capacity)
        room = {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [r for r in room.values() if r >= lengths[i]]
            assert (capacity - offsets[i] == min(fits)) if fits else (offsets[i] == 0 and windows[i] not in room)
            room[windows[i]] = capacity - offsets[i] - lengths[i]
        assert used == len(room)


def test_round_trip(spark):
    rows = list(enumerate(texts())) + [(2_000, "x"), (2_000, "x"), (None, "y")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA + ", start string").repartition(3)
    got = packing.digest(df).collect()
    path = tokens.vocabulary("byte_bpe_50k.json")
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*tokens.library(path).encode(t or "", add_special_tokens=False).ids, 1])
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, lists in want.items():
        ids = lists[0]
        assert sum(r.length for r in by[i]) == len(ids) * len(lists) and {r.doc_tokens for r in by[i]} == {len(ids)}
        for r in by[i]:
            piece = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.length == len(piece) // 4 and r.ids_crc32 == zlib.crc32(piece)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2_048
    sequences = {r.sequence_id: r for r in packing.sequences(packing.pack(df)).collect()}
    assert {k: len(v.ids) // 4 for k, v in sequences.items()} == {k: sum(n for _, n in p) for k, p in filled.items()}


def test_groups_are_bounded(spark):
    """Several groups in a task share no sequence, and all ids stay."""
    rows = [(i, "word " * (10 + i % 90)) for i in range(3_000)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    whole, parts = (packing.pack(df, group=n).collect() for n in (packing.GROUP, 5_000))
    key = lambda r: (r.doc_id, r.start)
    assert sorted((*key(r), r.length, r.ids) for r in whole) == sorted((*key(r), r.length, r.ids) for r in parts)
    filled = defaultdict(list)
    for r in parts:
        filled[r.sequence_id].append((r.offset, r.length))
    assert len(filled) > len({r.sequence_id for r in whole})
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2_048


def test_empty_table(spark):
    assert packing.digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_summaries_keep_what_is_frequent():
    import pickle
    import random
    from collections import Counter

    rng = random.Random(2)
    parts = [Counter(str(min(int(rng.paretovariate(0.8)), 9_999)) for _ in range(3_000)) for _ in range(9)]
    true, counters = sum(parts, Counter()), 50
    found = b""
    for part in parts:
        found = token_counts.merged(found, pickle.dumps(token_counts.cut(part, counters)), counters)
    kept = pickle.loads(found)
    assert len(kept) <= counters
    for word, n in true.items():
        assert n - true.total() / (counters + 1) <= kept.get(word, 0) <= n
    assert token_counts.merged(b"", b"x", 3) == b"x" and token_counts.cut(Counter("aab"), 2) == Counter("aab")
