from __future__ import annotations

import random

import pytest

import corpus_pipeline as cp
from trailmill.llm import secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(15)
    path = str(tmp_path_factory.mktemp("sf"))
    items = [(i, prose(rng, 25)) for i in range(5)]
    texts = {k: prose(rng, 200) for k in range(40)}
    texts[40] = texts[0]
    changed = texts[1].split()
    changed[100] = "changed"
    texts[41] = " ".join(changed)
    texts[42] = prose(rng, 60) + " " + items[2][1] + " " + prose(rng, 60)
    texts[43] = texts[2][:400] + " password=hunter2hunter2 " + prose(rng, 100)
    texts[44], texts[45], texts[46] = None, "", "again and again " * 60
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()] + [(3, texts[3], "en", "s", 1), (None, prose(rng, 150), None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, items


def test_stages_against_plain_rules(spark, folder):
    path, texts, items = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in cp.STAGES:
        columns = docs.columns
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.columns == columns
        docs = cp.staged(out, name)
        seen.append((name, sorted((r.doc_id for r in docs.select("doc_id").distinct().collect()), key=str)))
    kept = dict(seen)
    clean = [k for k in range(40)]
    assert kept["quality_rules"] == sorted([*clean, 40, 41, 42, 43, None], key=str)
    assert kept["simhash_near_dedup"] == sorted([*clean, 42, 43, None], key=str)
    assert kept["decontamination"] == kept["secret_scan"] == kept["packing"] == sorted([*clean, 43, None], key=str)


def test_run(spark, folder):
    path, texts, _ = folder
    rows = cp.run(spark, path).collect()
    assert {r.doc_id for r in rows} == {*range(40), 43, None}
    from trailmill.llm.tokens import encode, vocabulary

    text = secret_scan.redact(texts[43], secret_scan.scan(texts[43].encode(), None))
    assert "hunter2" not in text
    assert sum(r.length for r in rows if r.doc_id == 43) == len(encode([text], vocabulary("byte_bpe_50k.json"))[0]) // 4 + 1
    assert len([r for r in rows if r.doc_id == 3 and r.start == 0]) == 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_with_clashing_names(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 as quality", "2 as leaks", "3 as row_id_hash", "4 as FP")
    for _, stage in cp.STAGES:
        out = stage(spark, docs, path)
        assert out.count() > 0


def test_very_long_texts(spark, tmp_path):
    """Texts of 60,000 words pass every stage whole: a copy goes, a passage near the end is found, a key there is cut out."""
    rng = random.Random(16)
    item, key = prose(rng, 25), "password=hunter2hunter2"
    long = prose(rng, 60_000)
    rows = [(1, long), (2, long), (3, f"{prose(rng, 60_000)} {item} end"), (4, f"{prose(rng, 60_000)} {key}")]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {1, 4}
    for k, text in ((1, long), (4, rows[3][1].replace(key, "<ASSIGN>"))):
        from trailmill.llm.tokens import encode, vocabulary

        n = len(encode([text], vocabulary("byte_bpe_50k.json"))[0]) // 4 + 1
        assert {r.doc_tokens for r in pieces if r.doc_id == k} == {n} and sum(r.length for r in pieces if r.doc_id == k) == n
