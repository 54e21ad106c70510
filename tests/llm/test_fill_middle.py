from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmill.llm import fill_middle as fm

ODD = st.text(alphabet="<>PSMab \né日\U0001f600́", max_size=60)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    """The contract, by slices."""
    text = text or ""
    n, hx = len(text), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(hx[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    out, form = (f"<S>{suf}<P>{pre}<M>{mid}", "spm") if h4 % 100 < 20 else (f"<P>{pre}<S>{suf}<M>{mid}", "psm")
    return (doc_id, n, form, len(pre), len(mid), sha(out), sha(text))


def depth_is_fine(rope):
    if rope.left is None:
        return rope.height == 0 and rope.points == len(rope.text)
    a, b = rope.left, rope.right
    same = rope.units == a.units + b.units and rope.points == a.points + b.points and rope.height == max(a.height, b.height) + 1
    return same and abs(a.height - b.height) <= 2 and depth_is_fine(a) and depth_is_fine(b)


@given(ODD, st.lists(st.integers(0, 70), max_size=8), st.integers(1, 5))
def test_splits_and_concatenations_keep_the_text(text, ranks, size):
    rope = fm.rope_of(text, size=size)
    assert fm.read(rope) == text and rope.units == len(text)
    for r in ranks:
        a, b = fm.split(rope, r)
        assert fm.read(a) == text[:r] and fm.read(b) == text[r:] and depth_is_fine(a) and depth_is_fine(b)
        rope, text = fm.concat(b, a), text[r:] + text[:r]
        assert depth_is_fine(rope)
    needle = text[3:6] or "<P>"
    for start in (0, 2, 5):
        assert fm.find(rope, needle, start) == text.find(needle, start)


@given(ODD, st.integers(0, 12), st.integers(1, 4))
def test_units_of_a_pattern(text, rank, size):
    rope = fm.rope_of(text, r"\S+\s*|\s+", size)
    import re

    units = re.findall(r"\S+\s*|\s+", text)
    a, b = fm.split(rope, rank)
    assert rope.units == len(units) and fm.read(a) == "".join(units[:rank]) and fm.read(b) == "".join(units[rank:])
    assert a.units == len(units[:rank]) and b.units == len(units[rank:])
    c, d = fm.split(rope, rank, points=True)
    assert fm.read(c) == text[:rank] and fm.read(d) == text[rank:] and c.points == min(rank, len(text))


@given(st.integers(), ODD, st.sampled_from([None, r"\w+\W*", "[^\n]*\n"]), st.integers(0, 100))
def test_round_trip(key, text, unit, share):
    rules = fm.Rules(unit=unit, suffix_first=share)
    out, form, n, pre, mid = fm.rearranged(str(key), text, rules)
    assert fm.restored_text(out, form, rules) == text
    assert form == "plain" or len(out) == len(text) + 9 and pre + mid <= len(text)


def test_many_edits_stay_balanced():
    rope = fm.rope_of("abc" * 5_000, size=4)
    rng = random.Random(2)
    for _ in range(300):
        a, b = fm.split(rope, rng.randrange(15_000))
        rope = fm.concat(b, a)
    assert depth_is_fine(rope) and rope.height < 30 and sorted(fm.read(rope)) == sorted("abc" * 5_000)


def test_damaged_outputs_and_sentinels():
    for out, form in [("<P>a<S>b", "psm"), ("a<S>b<M>c", "psm"), ("<P>a<M>b<S>c", "psm"), ("<P>a<S>b<M>c", "spm"), ("x", "other"), (None, "psm")]:
        assert fm.restored_text(out, form) is None
    for bad in [("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("<<P", "<S>", "<M>"), ("<P>", "x<", "<M>")]:
        with pytest.raises(ValueError):
            fm.Rules(*bad)


def test_query_equals_slices(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "<P>", "a<S>b", "<<P", "<", "é日\U0001f600́" * 9, "line\nline\r\n\x00", "x" * 300_000, "日本" * 60_000, "same", "same"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (None, None), (-5, "negative"), (7, "tie"), (7, "tie")]
    rows += [(1_000 + k, "".join(rng.choices("<>PSM abé日\U0001f600", k=rng.randint(0, 30)))) for k in range(400)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, Form string, n int").repartition(5)
    got = sorted(map(tuple, fm.digest(df).collect()), key=repr)
    assert got == sorted((plain(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fm.digest(df.limit(0)).collect() == []


def test_operator_keeps_columns_and_texts(spark):
    df = spark.createDataFrame([(k, f"one two {k}\nthree", "x") for k in range(50)], "doc_id long, text string, fim string")
    out, name = fm.transformed(df, rules=fm.Rules(unit=r"\S+\s*", percent=100))
    assert name == "fim_" and out.columns == [*df.columns, name]
    back = out.withColumn("back", fm.restored(F.col("fim_.output"), F.col("fim_.form")))
    rows = back.collect()
    assert all(r.back == r.text and r.fim == "x" and r.fim_.units == 4 for r in rows)
    # Cuts lie between words, so every part ends with a whole one.
    assert all(p in r.text for r in rows for p in r.fim_.output.replace("<P>", "|").replace("<S>", "|").replace("<M>", "|").split("|"))
