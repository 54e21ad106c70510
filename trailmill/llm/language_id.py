"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of what each piece of evidence says: the text by a
byte-trigram model, the language that the markup declares, the address's suffix, and a prior of the
host. The prior is smoothed hierarchically: a host's counts lean on its domain's, these on the
whole corpus's. All counts come from grouped aggregation over all rows, of the text's own best
guesses; declared languages and suffixes are believed as far as they agree with such guesses.

The trigram model is fitted on a bounded sample of every language that documents or pages declare,
however rare: about SAMPLE rows of each, those whose hash of id and text is below a limit. (Rows equal
in both are chosen together or not at all.)

Defined cases: a null or empty text says nothing, so the other evidence decides; a missing or
unknown declaration, suffix or host says nothing either. With no labelled row at all the language is
null. Ties go to the language first in the alphabet. Very long texts are scored whole. Repeated rows
get equal results; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_column, slices_of, staged, utf8

SAMPLE = 400
#: Hashed trigrams of the model.
FEATURES = 1 << 14
#: Trigrams that a text's evidence counts as at most: neighbours are not independent.
SATURATION = 60
#: Pseudo-counts: of a trigram, a declaration or suffix, and of the level above in the prior.
TRIGRAM, AGREE, LEAN = 0.5, 1.0, 20.0
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Elements whose content is not text, and what ends it.
_HIDDEN = re.compile(rb"<(?:(!--)|(script|style)\b)", re.I)


def trigrams(data: bytes) -> np.ndarray:
    """Numbers of the byte trigrams of a lower-cased text; white space is one kind of byte."""
    a = np.frombuffer(b" " + b" ".join(data.translate(_LOWER).split()) + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    keys = (a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(0x9E3779B1)
    return (keys >> np.uint32(32 - 14)).astype(np.int64)


def visible(html: bytes) -> bytes:
    """The text of a page. One pass: what is never closed is looked for once."""
    low, out, at, open_ended = html.lower(), [], 0, set()
    while (begin := html.find(b"<", at)) >= 0:
        out.append(html[at:begin])
        end = -1
        if (m := _HIDDEN.match(html, begin)) and (closing := b"-->" if m[1] else b"</" + m[2].lower()) not in open_ended:
            end = low.find(closing, m.end())
            if end < 0:
                open_ended.add(closing)
            elif not m[1]:
                end = html.find(b">", end)
            else:
                end += 2
        if end < 0:
            end = html.find(b">", begin)
        if end < 0:
            out.append(html[begin:])
            at = len(html)
            break
        at = end + 1
    out.append(html[at:])
    return unescape(b" ".join(out).decode("utf-8", "replace")).encode()


def fit(labelled: DataFrame, languages: list[str]) -> np.ndarray:
    """Log-likelihoods (language, trigram), from rows (lang, text), counted on the executors. Of rows with
    a true column `markup` the text is the visible one."""
    index = {lang: k for k, lang in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(index), FEATURES), np.int64)
        for batch in slices_of(batches):
            for lang, data, markup in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                sums[index[lang]] += np.bincount(trigrams(visible(data) if markup else data), minlength=FEATURES)
        lang, feature = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(feature), pa.array(sums[lang, feature])], ["lang", "feature", "n"])

    markup = F.col("markup") if "markup" in labelled.columns else F.lit(False)
    rows = labelled.select("lang", "text", markup.alias("markup")).mapInArrow(counted, "lang bigint, feature bigint, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect()
    counts = np.full((len(languages), FEATURES), TRIGRAM)
    for r in rows:
        counts[r["lang"], r["feature"]] += r["n"]
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def sample(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """The bounded labelled sample (lang, text, markup), and all languages, from rows (lang, key, text, markup): of each language
    the rows whose key, a hash, is below the share that SAMPLE is of its count. A filter, so nothing is ranked or shuffled."""
    rows = rows.where("lang <> ''")
    counted = rows.groupBy("lang").count().collect()
    last = {r["lang"]: min((1 << 63) - 1, int(SAMPLE / r["count"] * (1 << 64)) - (1 << 63)) for r in counted}
    if not last:
        return rows.select("lang", "text", "markup"), []
    limits = F.create_map(*(F.lit(x) for pair in last.items() for x in pair))
    return rows.where(F.col("key") <= F.try_element_at(limits, F.col("lang")).cast("bigint")).select("lang", "text", "markup"), sorted(last)


def labelled_documents(docs: DataFrame) -> DataFrame:
    lang = F.lower(F.regexp_extract(F.coalesce(F.col("lang"), F.lit("")), "^([A-Za-z]{2,3})", 1))
    return docs.select(lang.alias("lang"), F.xxhash64("doc_id", "text").alias("key"), F.col("text").alias("text"), F.lit(False).alias("markup"))


def labelled_pages(pages: DataFrame) -> DataFrame:
    """Pages by what their markup declares."""
    return pages.select(F.coalesce(declared_language(F.col("html")), F.lit("")).alias("lang"), F.xxhash64("page_id", "html").alias("key"), F.col("html").alias("text"), F.lit(True).alias("markup"))


def text_scores(texts: pa.Array, model: np.ndarray, markup: bool = False) -> pa.Array:
    """Evidence of each language, in nats over the least likely."""
    out = []
    weights = np.ascontiguousarray(model.T)
    for data in utf8(texts):
        keys = trigrams(visible(data) if markup else data)
        if len(keys):
            total = np.zeros(len(model))
            for at in range(0, len(keys), 1 << 16):
                total += weights[keys[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
            total *= min(1.0, SATURATION / len(keys))
            out.append((total - total.min()).tolist())
        else:
            out.append([0.0] * len(model))
    return pa.array(out, pa.list_(pa.float64()))


def declared_language(html: Column) -> Column:
    """The primary subtag that the page's root declares, or null."""
    found = F.regexp_extract(html, r"(?is)<html(?=\s)[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    return F.nullif(F.lower(found), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def evidence_of_documents(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """Documents: the column lang is what was declared, the column source is the host."""
    lang = F.nullif(F.lower(F.regexp_extract(F.col("lang"), "^([A-Za-z]{2,3})", 1)), F.lit(""))
    scores = map_column(lambda t: text_scores(t, model), "array<double>", F.col("text"))
    return docs.select(
        F.col("doc_id").cast("bigint"), F.lit(None).cast("bigint").alias("page_id"), lang.alias("declared"),
        F.lit(None).cast("string").alias("suffix"), F.col("source").alias("domain"), F.col("source").alias("host"), scores.alias("scores"),
    )


def evidence_of_pages(pages: DataFrame, model: np.ndarray) -> DataFrame:
    host = host_of(F.col("url"))
    labels = F.split(host, r"\.")
    scores = map_column(lambda t: text_scores(t, model, markup=True), "array<double>", F.col("html"))
    return pages.select(
        F.lit(None).cast("bigint").alias("doc_id"), F.col("page_id").cast("bigint"), declared_language(F.col("html")).alias("declared"),
        F.try_element_at(labels, F.lit(-1)).alias("suffix"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"),
        host.alias("host"), scores.alias("scores"),
    )


def _counts(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Guesses of each language under each value of the key."""
    per = [F.count_if(F.col("guess") == i) for i in range(k)]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*per).alias(f"{key}_n"))


def fuse(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """doc_id, page_id, declared, suffix, host, text_language, language, probability."""
    k = len(languages)
    if not k:
        none = [F.lit(None).cast("string").alias("text_language"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability")]
        return evidence.select("doc_id", "page_id", "declared", "suffix", "host", *none)
    best = F.array_position("scores", F.array_max("scores")) - 1
    rows = staged(evidence.withColumn("guess", F.when(F.array_max("scores") > 0, best)), "evidence")
    total = rows.where("guess is not null").groupBy("guess").count().collect()
    seen = np.ones(k)
    for r in total:
        seen[r["guess"]] += r["count"]
    everywhere = F.array(*(F.lit(float(x)) for x in seen / seen.sum()))
    lean = lambda n, above: F.transform(
        F.zip_with(n, above, lambda c, p: c + LEAN * p), lambda x: x / (F.aggregate(n, F.lit(0).cast("bigint"), lambda a, c: a + c) + LEAN)
    )
    domains = _counts(rows, "domain", k).select("domain", lean(F.col("domain_n"), everywhere).alias("domain_p"))
    hosts = (
        rows.where("host is not null").groupBy("host").agg(F.min("domain").alias("domain")).join(_counts(rows, "host", k), "host")
        .join(domains, "domain").select("host", lean(F.col("host_n"), F.col("domain_p")).alias("prior"))
    )

    def believed(key: str) -> DataFrame:
        """Log-likelihoods of each value of the key under each language, with one more for values not seen."""
        return _counts(rows, key, k).select(
            key, F.zip_with(F.col(f"{key}_n"), F.array(*(F.lit(float(s)) for s in seen)), lambda n, s: F.log((n + AGREE) / (s + AGREE * k))).alias(f"{key}_ll")
        )

    nothing = F.array(*[F.lit(0.0)] * k)
    # A table of its own, so that the planner can broadcast it or split a hot host's rows.
    hosts = staged(hosts, "hosts")
    joined = rows.join(hosts, "host", "left").join(believed("declared"), "declared", "left").join(believed("suffix"), "suffix", "left")
    logs = F.zip_with(F.col("scores"), F.transform(F.coalesce("prior", everywhere), lambda p: F.log(p)), lambda a, b: a + b)
    for key in ("declared_ll", "suffix_ll"):
        logs = F.zip_with(logs, F.coalesce(F.col(key), nothing), lambda a, b: a + b)
    out = joined.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    names = F.array(*(F.lit(x) for x in languages))
    weight = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return out.select(
        "doc_id", "page_id", "declared", "suffix", "host",
        F.try_element_at(names, (F.col("guess") + 1).cast("int")).alias("text_language"),
        F.element_at(names, F.array_position("logs", F.col("top")).cast("int")).alias("language"),
        (1 / weight).alias("probability"),
    )


def digest(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """The result of the query: the language of every document and of every page."""
    labelled, languages = sample(labelled_documents(docs).unionByName(labelled_pages(pages)))
    model = fit(labelled, languages)
    return fuse(evidence_of_documents(docs, model).unionByName(evidence_of_pages(pages, model)), languages)
