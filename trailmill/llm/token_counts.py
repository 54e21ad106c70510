"""Token counts by a map-side two-tier lookup.

First tier: a compact table of the lengths of the most frequent pre-tokens of all documents, broadcast;
its size is fixed by FREQUENT. No pre-token is shuffled to find them: each task keeps a summary of COUNTERS counters (Misra and
Gries), which holds every pre-token that makes more than one in COUNTERS of what it read, and summaries merge, with
that bound kept, up a tree of tasks; the driver gets the tree's few last ones. Second tier: each worker's own caches of
what the library said about the rest. The table only saves work; counts are the library's with any table.

Defined cases: a null text is an empty one with no tokens and no bytes; very long texts are counted
whole; repeated rows get equal counts; an empty table gives an empty result; other columns pass
through untouched, and the added column takes a name that clashes with none.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_column, slices_of, unused
from .tokens import LONG, SPECIAL, count, pretokens, read, vocabulary

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2_048
#: Entries of the broadcast table.
FREQUENT = 16_384
#: Counters of a summary, and how many a task lets grow before it cuts them back to that. Only counts above the cut are kept, less
#: the cut, so a pre-token's count falls short by at most a COUNTERS-th of all pre-tokens.
COUNTERS = 2 * FREQUENT
HELD = 1 << 17
#: Levels of the tree of summaries.
DEPTH = 4


def cut(counts: Counter, counters: int) -> Counter:
    """At most so many counters: the largest, less the count of the largest that goes."""
    if len(counts) <= counters:
        return counts
    least = heapq.nlargest(counters + 1, counts.values())[-1]
    return Counter({w: n - least for w, n in counts.items() if n > least})


def merged(a: bytes, b: bytes, counters: int) -> bytes:
    """Two summaries as one, no larger."""
    if not a or not b:
        return a or b
    both = pickle.loads(a)
    both.update(pickle.loads(b))
    return pickle.dumps(cut(both, counters))


def summaries(path: str, counters: int, held: int):
    """Gives one summary of the pre-tokens of up to LONG characters that a task's texts hold."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices_of(batches):
            for text in batch.column(0).to_pylist():
                if text and SPECIAL not in text:
                    for as_shown, words in pretokens(text, path):
                        kinds[as_shown].update(words)
                if sum(map(len, kinds)) > held:
                    kinds = cut(_plain(kinds), counters), Counter()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(cut(_plain(kinds), counters))], pa.binary())], ["summary"])

    return summed


def _plain(kinds: tuple[Counter, Counter]) -> Counter:
    """Counts of pre-tokens as themselves, of both kinds, without long ones."""
    out = Counter({w: n for w, n in kinds[False].items() if len(w) <= LONG})
    out.update({w: n for x, n in kinds[True].items() if len(x) <= 4 * LONG and len(w := read(x)) <= LONG})
    return out


def frequent(docs: DataFrame, text: str, path: str, size: int = FREQUENT, counters: int = COUNTERS, held: int | None = None) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of all documents, at most `size`."""
    each = docs.select(text).mapInArrow(summaries(path, counters, held or HELD), "summary binary").rdd.map(lambda r: bytes(r[0]))
    both = lambda a, b: merged(a, b, counters)
    found = each.treeAggregate(b"", both, both, DEPTH)
    counts = pickle.loads(found) if found else {}
    words = sorted(counts, key=lambda w: (-counts[w], w))[:size]
    return dict(zip(words, count(words, path), strict=True))


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None, size: int = FREQUENT) -> tuple[DataFrame, str]:
    """The documents with the number of tokens, and that column's name."""
    path = path or vocabulary(VOCABULARY)
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, text, path, size))
    name = unused(docs, "n_tokens")

    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(count([t or "" for t in texts.to_pylist()], path, table.value), pa.int64())

    return docs.withColumn(name, map_column(counted, "bigint", F.col(text))), name


def digest(docs: DataFrame) -> DataFrame:
    """The result of the query, for every document."""
    out, n = token_counts(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.col(n).alias("n_tokens"),
        (F.col(n) > LIMIT).alias("over_limit"),
    )
