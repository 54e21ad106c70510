from __future__ import annotations

import random

from pyspark.sql import functions as F

from trailmill.llm import decontaminate as dc

ITEMS = [
    (1, "A train leaves Paris at 9 and travels 120 km to Lyon while a second train leaves Lyon at 9 towards Paris at 80 km per hour, when do they meet?"),
    (2, "Maria buys 5 apples for 3 dollars each and Maria sells the 5 apples for 4 dollars each, how much profit does she make in the end?"),
    (3, "too short"),
    (4, None),
    (5, "1 2 3 4 5 6 7 8 9 10 11 12"),
]
ITEM = "item_id long, text string"
DOC = "doc_id long, text string"


def filler(rng, n):
    return " ".join(f"word{rng.randrange(10_000)}" for _ in range(n))


def cases():
    rng = random.Random(10)
    other = ITEMS[1][1].replace("Maria", "Peter").replace("5", "7").replace("3", "11").replace("4", "13")
    mixed = "Maria buys 5 apples for 3 dollars each and Peter sells the 9 apples for 4 dollars each, how much profit does she make in the end?"
    half = " ".join(ITEMS[0][1].split()[:13])
    return {
        1: (f"{filler(rng, 50)} {ITEMS[0][1]} {filler(rng, 40)}", {1}),
        2: (f"{filler(rng, 20)}\n{other}", {2}),
        3: (mixed.replace("Peter", "Anna").replace("Maria", "Bob") + " " + mixed.replace("dollars", "euros"), None),
        4: (half, set()),
        5: (filler(rng, 300), set()),
        6: (" ".join(map(str, range(100))), set()),
        7: (None, set()),
        8: ("", set()),
        9: (ITEMS[0][1] + " " + ITEMS[1][1], {1, 2}),
        10: (f"{filler(rng, 30_000)} {ITEMS[1][1].upper().lower()}", None),
        11: (ITEMS[0][1].replace("second", "2nd other"), {1}),
        12: ("too short", set()),
    }


def test_passages(spark):
    docs = cases()
    df = spark.createDataFrame([(k, t, 0) for k, (t, _) in docs.items()] + [(1, docs[1][0], 0), (None, ITEMS[0][1], 0)], DOC + ", leaks int")
    bench = spark.createDataFrame([*ITEMS, (6, ITEMS[0][1])], ITEM)
    found: dict = {}
    for r in dc.digest(df, bench).collect():
        found.setdefault(r.doc_id, set()).add(r.item_id)
        assert r.share >= dc.SHARE and r.agreement >= dc.AGREE and r.length >= 5
    for k, (_, want) in docs.items():
        if want is not None:
            assert found.get(k, set()) == want | ({6} if 1 in want else set()), k
    assert found[None] == {1, 6}
    marked, name = dc.flagged(df, bench)
    assert name == "leaks_" and {r.doc_id for r in marked.where(name).collect()} == {k for k, v in found.items() if v}


def test_inconsistent_slots():
    bench = dc.Benchmark([(2, ITEMS[1][1])])
    clean = ITEMS[1][1]
    assert [h[1] for h in dc.search([clean.encode()], bench)] == [2]
    # Each stand of a value became something else.
    odd = "Zoe buys 51 apples for 33 dollars each and Tim sells the 62 apples for 44 dollars each, how much profit does she make in the end?"
    share, agreement = next((h[2], h[3]) for h in dc.search([odd.encode()], _lenient(bench)))
    assert share == 1.0 and agreement < dc.AGREE
    assert list(dc.search([odd.encode()], bench)) == []


def _lenient(bench):
    class Any(dc.Benchmark):
        def __init__(self):
            self.__dict__ = dict(bench.__dict__)

        def judge(self, words, hits):
            group = [(at - p, p) for at, lo, hi in hits for _, p in self.places[lo:hi].tolist()]
            return [(2, len({p for _, p in group}) / self.total[0], self._agreement(0, words, group), 0, 0)]

    return Any()


def test_blocks_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(k, t) for k, (t, _) in cases().items()], DOC)
    bench = spark.createDataFrame(ITEMS, ITEM)
    whole = sorted(map(tuple, dc.digest(df, bench).collect()))
    monkeypatch.setattr(dc, "BLOCK", 20)
    monkeypatch.setattr(dc, "GROUP", 64)
    assert len(dc.blocks(bench, "item_id", "text")) > 1
    assert sorted(map(tuple, dc.digest(df, bench).collect())) == whole
    marked, name = dc.flagged(df.withColumn("leaks", F.lit(1)), bench)
    assert marked.columns == ["doc_id", "text", "leaks", "leaks_"] and marked.count() == df.count()
    assert {r.doc_id for r in marked.where(name).collect()} == {r[0] for r in whole}


def test_against_brute_force(spark):
    """Verbatim passages, held against a search of the words themselves."""
    rng = random.Random(12)
    items = [(i, filler(rng, rng.randint(15, 40))) for i in range(20)]
    rows, want = [], set()
    for k in range(120):
        parts = [filler(rng, rng.randint(1, 60))]
        for i, text in rng.sample(items, rng.randint(0, 2)):
            parts += [text, filler(rng, rng.randint(0, 30))]
        rows.append((k, " ".join(parts)))
    for k, text in rows:
        want |= {(k, i) for i, t in items if f" {t} " in f" {text} "}
    got = {(r.doc_id, r.item_id) for r in dc.digest(spark.createDataFrame(rows, DOC), spark.createDataFrame(items, ITEM)).collect()}
    assert got == want


def test_short_items_are_found_verbatim(spark):
    rows = [(1, "He asked: who WROTE Don Quixote? Nobody knew."), (2, "who wrote don"), (3, "Who wrote Don Quixote?"), (4, "quixote who wrote don"), (5, "wrote Don Quixote? Who")]
    items = [(1, "Who wrote Don Quixote?"), (2, "Who wrote it?"), (3, "who wrote don quixote")]
    got = {tuple(r) for r in dc.digest(spark.createDataFrame(rows, DOC), spark.createDataFrame(items, ITEM)).collect()}
    assert got == {(d, i, 1.0, 1.0, at, 4) for d, at in ((1, 2), (3, 0)) for i in (1, 3)}


def test_every_passage_is_reported(spark):
    rng = random.Random(16)
    text = " ".join([ITEMS[0][1], filler(rng, 30), ITEMS[0][1], filler(rng, 30), ITEMS[0][1]])
    got = dc.digest(spark.createDataFrame([(1, text)], DOC), spark.createDataFrame(ITEMS[:2], ITEM)).collect()
    n = len(ITEMS[0][1].split())
    assert sorted((r.item_id, r.start, r.length) for r in got) == [(1, k * (n + 30), n) for k in range(3)]


def test_windows_that_many_items_share(monkeypatch):
    """With a list of any length the same passages are found, also of items that are equal to many others."""
    rng = random.Random(17)
    start = "Read the text below with care and then answer the question that follows it"
    items = [(k, f"{start} {filler(rng, rng.randint(3, 60))}") for k in range(60)] + [(100 + k, f"{start} in one word or more please now") for k in range(20)]
    docs = [f"{filler(rng, 20)} {items[k][1]} {filler(rng, 20)}".encode() for k in (0, 3, 17, 59, 61, 79)] + [start.encode(), filler(rng, 50).encode()]
    found = []
    for listed in (0, 5, 64, 1_000):
        monkeypatch.setattr(dc, "LISTED", listed)
        found.append(sorted(dc.search(docs, dc.Benchmark(items))))
    assert found[0] == found[1] == found[2] == found[3] and {f[0] for f in found[0]} == set(range(6))


def test_items_of_one_form_with_other_names(monkeypatch):
    """Their windows as templates are shared by all, those with names as words are rare; a document with new names holds the first only."""
    rng = random.Random(30)
    names = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)).title() for _ in range(202)]
    form = "yesterday {0} bought some green paint for {1} and then {0} drove home while {1} was waiting near the old bridge"
    items = [(k, form.format(*names[2 * k : 2 * k + 2])) for k in range(100)]
    docs = [t.encode() for t in (form.format(*names[200:]), items[5][1], items[5][1].upper(), f"{filler(rng, 9)} {form.format('Zorano', 'Quexila')} {filler(rng, 9)}")]
    found = []
    for listed in (0, 5, 64, 1_000):
        monkeypatch.setattr(dc, "LISTED", listed)
        found.append(sorted(dc.search(docs, dc.Benchmark(items))))
    assert found[0] == found[1] == found[2] == found[3]
    assert [{f[1] for f in found[2] if f[0] == k} for k in range(4)] == [set(range(100)), set(range(100)), {5}, set(range(100))]


def test_canonical():
    assert dc.canonical(b"(Paris,")[0] == dc.NAME and dc.canonical(b"1,200.5")[0] == dc.NUMBER and dc.canonical(b"12km.")[0] == dc.NUMBER
    assert dc.canonical(b"kg")[0] == dc.UNIT and dc.canonical(b"apples,") == (b"apples", b"apples") and dc.canonical(b"...")[0] == b""


def test_case_does_not_hide_passages(spark):
    text = "Doesbo wrote that Anna Karl lives in Große Straße near Utrecht on the 2nd floor, and Doesbo sells Anna Karl 5 red lamps for 12 km of Dutch wire each."
    rng = random.Random(15)
    forms = [str.upper, str.lower, str.title, str.swapcase, lambda t: t[:70].upper() + t[70:], lambda t: t.upper().replace("12", "17")]
    rows = [(k, f"{filler(rng, 30)} {form(text)} {filler(rng, 30)}") for k, form in enumerate(forms)]
    rows.append((len(forms), f"{filler(rng, 30)} {' '.join(text.upper().split()[:14])} {filler(rng, 30)}"))
    found = dc.digest(spark.createDataFrame(rows, DOC), spark.createDataFrame([(1, text)], ITEM)).collect()
    assert {r.doc_id for r in found} == set(range(len(forms)))


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    some = spark.createDataFrame([(1, ITEMS[0][1])], DOC)
    assert dc.digest(docs, spark.createDataFrame(ITEMS, ITEM)).collect() == [] and dc.digest(some, bench).collect() == []
    marked, name = dc.flagged(some, bench)
    assert [r[name] for r in marked.collect()] == [False]
