from __future__ import annotations

import math
import random
import time

from trailmill.llm import language_id as li

DOCS = "doc_id long, text string, lang string, source string"
PAGES = "page_id long, url string, html string"
SYLLABLES = {"en": "the and ing tion er re on at".split(), "de": "ung heit sch ein und ber keit ge".split(), "fr": "eau oi que ment tre les ou aux".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def corpus(seed=13, n=240):
    rng = random.Random(seed)
    docs, pages = [], []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        docs.append((i, text(rng, lang, rng.randint(20, 80)), lang, f"src{i % 7}"))
    for i in range(60):
        lang = rng.choice(list(SYLLABLES))
        tld = {"en": "com", "de": "de", "fr": "fr"}[lang]
        pages.append((i, f"https://{lang}{i % 3}.site.{tld}/p", f'<!DOCTYPE html><html lang="{lang}-XX"><head><style>the and</style></head><body><p>{text(rng, lang, 30)}</p><!-- x --></body></html>'))
    return docs, pages


def test_accuracy(spark):
    docs, pages = corpus()
    truth = {("d", i): lang for i, _, lang, _ in docs}
    rng = random.Random(14)
    noisy = [(i, t, rng.choice(list(SYLLABLES)) if i % 10 == 0 else lang, s) for i, t, lang, s in docs]
    got = li.digest(spark.createDataFrame(noisy, DOCS), spark.createDataFrame(pages, PAGES)).collect()
    assert len(got) == len(docs) + len(pages)
    right = [r.language == truth["d", r.doc_id] for r in got if r.doc_id is not None]
    assert sum(right) >= 0.97 * len(right)
    assert all(r.language == r.declared and r.suffix for r in got if r.page_id is not None)
    assert all(0 < r.probability <= 1 for r in got)


def test_other_evidence_decides_where_text_is_silent(spark):
    docs, pages = corpus()
    silent = [(900, "http://de1.site.de/x", None), (901, "http://unheard.example.de/x", "<html><body></body></html>"), (902, None, '<html lang="fr"></html>'), (903, "no url", "")]
    got = {r.page_id: r for r in li.digest(spark.createDataFrame(docs, DOCS), spark.createDataFrame(pages + silent, PAGES)).collect() if r.page_id}
    assert got[900].language == "de" and got[901].language == "de" and got[902].language == "fr"
    assert got[903].text_language is None and got[903].language is not None and got[903].host is None


def test_every_declared_language_is_a_class(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    langs = [a + b for a in letters[:8] for b in letters[8:13]]
    own = lambda lang, n: " ".join(f"{lang}{lang[::-1]}{lang}q{lang}" for _ in range(n))
    docs = [(i, own(lang, 30), lang, f"src{i}") for i, lang in enumerate(langs * 2)] + [(900, own(langs[39], 30), None, "s")]
    pages = [(i, f"http://h{i}.example/p", f'<html lang="zz"><body>{own("zz", 30)}</body></html>') for i in range(3)]
    got = li.digest(spark.createDataFrame(docs, DOCS), spark.createDataFrame(pages, PAGES)).collect()
    want = {i: lang for i, _, lang, _ in docs} | {900: langs[39]}
    assert all(r.language == (want[r.doc_id] if r.doc_id is not None else "zz") for r in got) and len(got) == len(docs) + 3


def test_odd_rows(spark):
    docs, _ = corpus(n=60)
    odd = [(None, None, None, None), (70, "", "zz-top", ""), (71, "é" * 50_000, "EN", "src0"), (5, docs[5][1], docs[5][2], docs[5][3])]
    df = spark.createDataFrame([(*d, 1) for d in docs + odd], DOCS + ", Scores int")
    empty = spark.createDataFrame([], PAGES)
    assert len(li.digest(df, empty).collect()) == len(docs) + len(odd)
    nothing = li.digest(spark.createDataFrame([(1, "a", None, "s")], DOCS), empty).collect()
    assert [(r.doc_id, r.language) for r in nothing] == [(1, None)]
    assert li.digest(spark.createDataFrame([], DOCS), empty).collect() == []


def test_model_against_plain_counts(spark):
    import numpy as np

    rows = [("en", "abab"), ("fr", "ab"), ("en", None)]
    model = li.fit(spark.createDataFrame(rows, "lang string, text string"), ["en", "fr"])
    counts = np.full((2, li.FEATURES), li.TRIGRAM)
    for lang, t in rows:
        for k in li.trigrams((t or "").encode()):
            counts["en fr".split().index(lang), k] += 1
    assert np.allclose(model, np.log(counts / counts.sum(axis=1, keepdims=True)), atol=1e-5)


def test_columns(spark):
    from pyspark.sql import functions as F

    urls = {"https://user@Host.Example.ORG:80/p?q": "host.example.org", "http://a/": "a", "mailto:x": None, None: None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.h for r in df.select("u", li.host_of(F.col("u")).alias("h")).collect()} == urls
    pages = {"<HTML class=x LANG='de-AT'>": "de", "<html><p lang=fr>": None, "<html lang=en>": "en", None: None}
    df = spark.createDataFrame([(p,) for p in pages], "p string")
    assert {r.p: r.d for r in df.select("p", li.declared_language(F.col("p")).alias("d")).collect()} == pages


def test_fusion_against_loops(spark):
    """Posteriors of made evidence, with hosts that lean on domains and domains on the whole corpus."""
    rng = random.Random(31)
    languages = ["de", "en", "fr"]
    rows = []
    for k in range(300):
        domain = rng.choice(["a.de", "b.com", "c.fr", None])
        host = None if domain is None else f"{rng.choice(['www', 'm', 'x'])}.{domain}"
        lean = {"a.de": 0, "b.com": 1, "c.fr": 2}.get(domain, rng.randrange(3))
        scores = [0.0, 0.0, 0.0] if k % 11 == 0 else [round(rng.uniform(0, 4), 3) + (3 if i == lean else 0) for i in range(3)]
        declared = rng.choice([None, languages[lean], rng.choice(languages), "xx"])
        rows.append((k, None, declared, domain and domain.split(".")[1], domain, host, scores))
    schema = "doc_id long, page_id long, declared string, suffix string, domain string, host string, scores array<double>"
    got = {r.doc_id: r for r in li.fuse(spark.createDataFrame(rows, schema), languages).collect()}

    guess = {r[0]: (r[6].index(max(r[6])) if max(r[6]) > 0 else None) for r in rows}

    def counts(place, value):
        of = [guess[r[0]] for r in rows if r[place] == value and guess[r[0]] is not None]
        return [of.count(i) for i in range(3)]

    seen = [1 + sum(g == i for g in guess.values()) for i in range(3)]
    everywhere = [x / sum(seen) for x in seen]
    lean_on = lambda n, above: [(c + li.LEAN * p) / (sum(n) + li.LEAN) for c, p in zip(n, above)]
    for k, _, declared, suffix, domain, host, scores in rows:
        prior = everywhere if host is None else lean_on(counts(5, host), lean_on(counts(4, domain), everywhere))
        logs = [s + math.log(p) for s, p in zip(scores, prior)]
        for place, value in ((2, declared), (3, suffix)):
            if value is not None:
                logs = [x + math.log((n + li.AGREE) / (s + li.AGREE * 3)) for x, n, s in zip(logs, counts(place, value), seen)]
        weights = [math.exp(x - max(logs)) for x in logs]
        assert got[k].language == languages[logs.index(max(logs))]
        assert abs(got[k].probability - max(weights) / sum(weights)) < 1e-9
        assert got[k].text_language == (None if guess[k] is None else languages[guess[k]])


def test_visible_text_of_odd_pages():
    assert li.visible(b"<p>a<!-- b --> c<SCRIPT x>d</script >e<style>f</style>g &amp; h").split() == [b"a", b"c", b"e", b"g", b"&", b"h"]
    assert li.visible(b"a <script>never closed").split() == [b"a", b"never", b"closed"]
    assert li.visible(b"a <b").split() == [b"a", b"<b"] and li.visible(b"") == b""
    assert li.visible(b"<scripted>x</scripted>").split() == [b"x"]
    began = time.perf_counter()
    li.visible(b"<!--" * 200_000 + b"<script>" * 200_000)
    assert time.perf_counter() - began < 20


def test_declared_language_is_the_roots_own(spark):
    pages = [('<html lang="fr">', "fr"), ("<HTML class=x LANG=de-AT>", "de"), ('<html data-lang="en">', None), ('<html xml:lang="en">', None), ('<html xml:lang="en" lang="es">', "es"), (None, None), ("<htmlx lang=en>", None)]
    df = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(pages)], "k long, html string")
    got = {r.k: r.d for r in df.select("k", li.declared_language(df.html).alias("d")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(pages)}
