"""Quality rules by compression bands.

A text passes if its zstandard ratio (bytes over compressed bytes) lies inside the band of its
length class, as a whole and in most of its fixed chunks. Repetitive text compresses too well,
noise too badly. Longer texts compress better, so each length class has its own limits. A few
counts of words, symbols, lines and repeated word windows go along, and a base rule on them
rejects before the bands are asked.

The limits come from the corpus: all texts that pass the base rule are counted by length class
(half octaves) and ratio, the chunks of full length by ratio, and a band reaches from BELOW
interquartile ranges under the median to ABOVE over it. A class leans on its neighbours, by medians
of five, so that a group of copies, which lies in one class, moves no limit; and on the wide bands
BANDS, which count as PRIOR texts, so that a class of which little is seen rejects little. Counts are
exact and small, so the limits are the same for any order of rows and after any lost task. Between the
middles of two classes the limits run straight, since ratios grow steadily with the length.

Defined cases: a null text is an empty one; an empty text has zero words, ratio 0.0, and fails
the base rule. Rows are judged one by one, so repeated rows and ties get equal verdicts (each row
counts for the limits); an empty table gives an empty result; other columns pass through untouched,
and the added struct takes a name that clashes with none.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CONTINUATION, SPACES, map_column, staged, unused, utf8

#: Upper length in bytes, least and largest ratio of the wide bands.
BANDS = ((512, 0.9, 4.0), (2_048, 1.15, 5.0), (8_192, 1.3, 6.0), (65_536, 1.4, 8.0), (None, 1.4, 10.0))
CHUNK_BYTES = 4_096
#: A last chunk below this length is not judged: its ratio says little.
LEAST_CHUNK = 1_024
#: Share of judged chunks that may lie outside their band.
BAD_CHUNKS = 0.5
LEVEL = 3
MIN_WORDS = 50
#: Percent of words inside repeated windows at which a text fails.
MAX_REPEATED = 50
SYMBOLS = b"[#*$%&|<>]"
WINDOW = 3

#: Interquartile ranges below and above a class's median that lie inside of its band.
BELOW, ABOVE = 3.0, 2.0
#: Width of the ratios' counts, and the number of them; larger ratios are in the last.
STEP, STEPS = 0.005, 3_200
#: Length classes, neighbours on each side that a class leans on, texts of which a class has quartiles.
CLASSES, REACH, LEAST = 80, 2, 8
#: Texts as which the wide bands count, and the least interquartile range.
PRIOR, LEAST_RANGE = 10.0, 0.02

SCHEMA = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "base_failed:boolean,ratio:double,size:double,chunks:array<double>,last_chunk:double,last_size:double>"
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of `window` words that occur at least twice, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    key = ids[:n]
    size = len(numbers)
    for k in range(1, window):
        # The product stays far inside 63 bits for texts below two billion words.
        key = np.unique(key, return_inverse=True)[1] if k > 1 and size**(k + 1) >= 2**62 else key
        key = key * size + ids[k : n + k]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not starts.size:
        return 0
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    counts = Counter(line for line in data.split(b"\n") if line.strip(SPACES))
    return sum(counts.values()) - len(counts)


def inside(ratio: float, length: int, bands=BANDS) -> bool:
    low, high = next((b[1], b[2]) for b in bands if b[0] is None or length <= b[0])
    return low <= ratio <= high


def half_octaves(length: int) -> float:
    """The length in bytes in half octaves; a length class is its whole part."""
    return min(CLASSES - 0.5, float(2 * np.log2(length))) if length else 0.0


def figures(data: bytes, packer: zstandard.ZstdCompressor) -> tuple:
    """What SCHEMA lists; `chunks` are the ratios of chunks of full length, `last_chunk` that of the rest."""
    words = data.split()
    word_chars = len(data.translate(None, SPACES + CONTINUATION))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS[1:-1]))
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEATED * len(words)
    ratio = len(data) / len(packer.compress(data)) if data else 0.0
    chunks, last, last_size = [], None, None
    for at in range(0, len(data), CHUNK_BYTES):
        chunk = data[at : at + CHUNK_BYTES]
        if len(chunk) >= LEAST_CHUNK:
            part = len(chunk) / len(packer.compress(chunk))
            if len(chunk) == CHUNK_BYTES:
                chunks.append(part)
            else:
                last, last_size = part, half_octaves(len(chunk))
    return len(words), word_chars, n_symbols, duplicate_lines(data), repeats, failed, ratio, half_octaves(len(data)), chunks, last, last_size


def measured(texts: pa.Array) -> pa.Array:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    rows = [figures(data, packer) for data in utf8(texts)]
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed ratio size chunks last_chunk last_size".split()
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.float64()]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def figures_column(text: str) -> Column:
    return map_column(measured, SCHEMA, F.col(text))


# ---- limits ----------------------------------------------------------------------------------

#: The class under which chunks of full length are counted.
CHUNKS = -1


def counted(rows: DataFrame, q: str) -> dict[int, dict[int, int]]:
    """How many texts that pass the base rule, and how many of their full chunks, have each step of ratio.
    At most (CLASSES + 1) * STEPS counts reach the driver."""
    step = lambda r: F.least(F.floor(r / STEP), F.lit(STEPS - 1)).cast("int")
    good = rows.where(~F.col(q)["base_failed"]).select(F.col(q).alias("q"))
    whole = F.struct(F.floor("q.size").cast("int").alias("k"), step(F.col("q.ratio")).alias("r"))
    parts = F.transform("q.chunks", lambda c: F.struct(F.lit(CHUNKS).alias("k"), step(c).alias("r")))
    table = good.select(F.explode(F.concat(F.array(whole), parts)).alias("x")).groupBy("x.k", "x.r").count().collect()
    out: dict[int, dict[int, int]] = defaultdict(dict)
    for k, r, n in table:
        out[k][r] = n
    return out


def quartiles(counts: dict[int, int]) -> tuple[int, float, float, float]:
    """Number and quartiles, at the middle of their steps."""
    steps = sorted(counts)
    sums = np.cumsum([counts[x] for x in steps])
    return int(sums[-1]), *((steps[int(np.searchsorted(sums, q * sums[-1]))] + 0.5) * STEP for q in (0.25, 0.5, 0.75))


def wide(k: int, bands=BANDS) -> tuple[float, float]:
    """The wide band of a length class."""
    return next((b[1], b[2]) for b in bands if b[0] is None or 2 ** (k / 2) < b[0])


def leaned(seen: int, low: float, high: float, prior: tuple[float, float]) -> tuple[float, float]:
    share = seen / (seen + PRIOR)
    return share * low + (1 - share) * prior[0], share * high + (1 - share) * prior[1]


def fitted(counts: dict[int, dict[int, int]], bands=BANDS) -> list[tuple[float, float]]:
    """Least and largest ratio of each length class, and behind them those of full chunks."""
    of = {k: quartiles(c) for k, c in counts.items() if sum(c.values()) >= LEAST}
    out = []
    for k in range(CLASSES):
        near = [j for j in range(k - REACH, k + REACH + 1) if j in of and j != CHUNKS]
        if not near:
            out.append(wide(k, bands))
            continue
        slopes = [(of[a][2] - of[b][2]) / (a - b) for a in near for b in near if a > b]
        slope = float(np.median(slopes)) if slopes else 0.0
        middle = float(np.median([of[j][2] + slope * (k - j) for j in near]))
        spread = max(LEAST_RANGE, float(np.median([of[j][3] - of[j][1] for j in near])))
        out.append(leaned(sum(of[j][0] for j in near), middle - BELOW * spread, middle + ABOVE * spread, wide(k, bands)))
    prior = wide(int(half_octaves(CHUNK_BYTES)), bands)
    if CHUNKS not in of:
        return [*out, prior]
    n, low, middle, high = of[CHUNKS]
    spread = max(LEAST_RANGE, high - low)
    return [*out, leaned(n, middle - BELOW * spread, middle + ABOVE * spread, prior)]


def fit(docs: DataFrame, text: str = "text") -> list[tuple[float, float]]:
    """The limits of a corpus, from all of its texts."""
    return fitted(counted(docs.select(figures_column(text).alias("q")), "q"))


def verdict(q: str, limits: list[tuple[float, float]]) -> list[Column]:
    """n_chunks, n_bad_chunks and kept, from the figures in the struct q."""
    lows, highs = (F.array(*(F.lit(float(x[i])) for x in limits)) for i in (0, 1))
    outside_chunk = lambda r: ~r.between(*limits[CLASSES])

    def outside(ratio: Column, size: Column) -> Column:
        place = F.greatest(F.lit(0.0), F.least(size - 0.5, F.lit(CLASSES - 1.0)))
        below = F.floor(place).cast("int")
        share = place - below
        at = lambda limit: F.element_at(limit, below + 1) * (1 - share) + F.element_at(limit, F.least(below + 2, F.lit(CLASSES))) * share
        return ~ratio.between(at(lows), at(highs))

    at = F.col(q)
    n = F.size(at["chunks"]) + at["last_chunk"].isNotNull().cast("int")
    bad = F.size(F.filter(at["chunks"], outside_chunk)) + F.coalesce(outside(at["last_chunk"], at["last_size"]).cast("int"), F.lit(0))
    kept = ~at["base_failed"] & ~outside(at["ratio"], at["size"]) & (bad <= BAD_CHUNKS * n)
    return [n.alias("n_chunks"), bad.alias("n_bad_chunks"), kept.alias("kept")]


_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio")


def quality(docs: DataFrame, text: str = "text", limits: list[tuple[float, float]] | None = None) -> tuple[DataFrame, str]:
    """The documents with one struct of figures and the verdict, and that struct's name. Without limits
    they are fitted to these documents first, by one more pass."""
    limits = limits or fit(docs, text)
    name = unused(docs, "quality")
    out = docs.withColumn(name, figures_column(text))
    return out.withColumn(name, F.struct(*(F.col(name)[c].alias(c) for c in _FIGURES), *verdict(name, limits))), name


def digest(docs: DataFrame) -> DataFrame:
    """The result of the query: the figures of every document. They are made once and kept, without the
    texts, in a table of which both the limits and the verdicts come."""
    rows = staged(docs.select("doc_id", figures_column("text").alias("q")), "quality")
    limits = fitted(counted(rows, "q"))
    return rows.select("doc_id", *(F.col("q")[c].alias(c) for c in _FIGURES), *verdict("q", limits))
