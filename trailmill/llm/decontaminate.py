"""Benchmark decontamination by templates.

Words become template words: numbers, names and units are typed placeholders, all others their
lower-cased letters without punctuation. Windows of five template words are hashed; a document's
windows are looked up in a hash table of the benchmark's. Case can hide or feign a name, so windows
with names are hashed and looked up in a second form too, in which names stay plain words: passages
are found in any case. (Names that were replaced in a passage whose case changed too stay unknown.)
Matches of one item at about one offset are a candidate; it counts if it holds at least 0.8 of the item's windows, of either form, and its slots are
consistent: what an item's number, name or unit became is the same wherever it stands. So verbatim
passages and re-parameterised questions are caught, and text that only shares a form is not.
An item of four words has no such window; it is found verbatim, in any case, as one window of words.

A window that many items share is not listed item by item: a passage of an item holds one of its rarer
ones too, and the shared ones are then counted for these items alone. Where the shared ones alone could make
0.8 of an item's windows, of either form, they are listed all the same, so no candidate is lost.

The benchmark is broadcast in blocks of a bounded number of words, some 50 bytes each, with one
pass over the documents for each block; documents are never shuffled. A worker holds one block.

Defined cases: null and empty texts match nothing, nor do items with fewer than four words. Windows
with fewer than two plain words say nothing and are not looked up; an item with no other windows
matches nothing. Items that are equal are all reported, and so is every passage of an item in a
document. Rows with null ids are judged like others.
Very long texts are worked off whole, in groups of words. Empty tables give empty results. Extra
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_column, slices_of, staged, unused, utf8

WINDOW = 5
#: Share of the item's windows, and of its slots that must agree.
SHARE = 0.8
AGREE = 0.8
PLAIN_WORDS = 2
#: Words of the shortest items, which are found verbatim only.
SHORT = 4
#: Items of a window up to which they are listed.
LISTED = 64
#: Words by which an offset may drift within one passage.
DRIFT = 4
#: Words of the benchmark that are broadcast at a time: up to two windows of 16 bytes each, and what judges them.
BLOCK = 1 << 20
#: Words worked off at a time.
GROUP = 1 << 18
#: Entries of the table of bits that is asked before the hashes.
BITS = 22

NUMBER, NAME, UNIT = b"<number>", b"<name>", b"<unit>"
# Units of measure and money.
UNITS = frozenset(
    "mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec min h hr hrs ms hz khz mhz ghz w kw mw v mv a ma j kj "
    "cal kcal n pa kpa bar c f k kb mb gb tb mol rad deg percent dollar dollars euro euros cent cents pound pounds yen usd "
    "eur gbp meter meters metre metres kilometer kilometers centimeter centimeters inch inches foot feet yard yards mile "
    "miles gram grams kilogram kilograms liter liters litre litres second seconds minute minutes hour hours day days week "
    "weeks month months year years degree degrees watt watts volt volts joule joules newton newtons".split()
)
_UNITS = frozenset(u.encode() for u in UNITS)
_EDGES = b".,;:!?\"'()[]{}<>|*#$&~`"
_NUMBER = re.compile(rb"[+-]?\d[\d.,:/]*(?:%|st|nd|rd|th)?$")
_ATTACHED = re.compile(rb"[+-]?\d[\d.,]*([A-Za-z]+)$")


def canonical(word: bytes) -> tuple[bytes, bytes]:
    """Template word and value of a word."""
    bare = word.strip(_EDGES)
    low = bare.decode("utf-8", "replace").casefold().encode()
    if _NUMBER.match(low):
        return NUMBER, low
    if low in _UNITS:
        return UNIT, low
    if (m := _ATTACHED.match(bare)) and m[1].lower() in _UNITS:
        return NUMBER, low
    text = bare.decode("utf-8", "replace")
    if len(text) > 1 and text[0].isupper() and text[1:].islower():
        return NAME, low
    return low, low


#: Words whose hashes a worker keeps.
KEPT = 100_000


class Templates(dict):
    """Hash of each word's template word; the lowest bit says whether it is a placeholder."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
        form, _ = canonical(word)
        value = self[word] = xxhash.xxh3_64_intdigest(form) & ~1 | (form in (NUMBER, NAME, UNIT))
        return value


class Folded(dict):
    """Hash of a name as a plain word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(canonical(word)[1]) & ~1
        return value


class Literal(dict):
    """Hash of a word's value, whatever its kind."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(canonical(word)[1]) & ~1
        return value


_TEMPLATES, _FOLDED, _LITERAL = Templates(), Folded(), Literal()
_NAME_HASH = np.uint64(xxhash.xxh3_64_intdigest(NAME) | 1)
# Odd multipliers of the words of a window.
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def template_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_TEMPLATES.__getitem__, words), np.uint64, len(words))


def folded_hashes(words: list[bytes], typed: np.ndarray) -> np.ndarray:
    """The template hashes with names as plain words."""
    out = typed.copy()
    at = np.flatnonzero(typed == _NAME_HASH)
    out[at] = np.fromiter((_FOLDED[words[i]] for i in at.tolist()), np.uint64, len(at))
    return out


def literal_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_LITERAL.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window, and whether it has enough plain words."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out, slots = np.zeros(n, np.uint64), np.zeros(n, np.int8)
    for k in range(width):
        part = words[k : n + k]
        out += (part ^ (part >> np.uint64(29))) * _WEIGHTS[k]
        slots += (part & np.uint64(1)).astype(np.int8)
    return out ^ (out >> np.uint64(32)), width - slots >= PLAIN_WORDS


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)


class Benchmark:
    """A block of items: their windows by hash, and what is needed to judge a candidate."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids = [i for i, _ in items]
        hashes, places, slots, telling, short = [], [], [], [], {}
        # Windows that say something as templates, their number, and the number of those that do with names as words.
        self.total, self.folded, self.first = [], [], [0]
        for k, (_, text) in enumerate(items):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            typed = template_hashes(words)
            found, tells = window_hashes(typed)
            plain, saying = window_hashes(folded_hashes(words, typed))
            at, also = np.flatnonzero(tells), np.flatnonzero(saying & ((plain != found) | ~tells))
            self.total.append(len(at))
            self.folded.append(int(saying.sum()))
            hashes += [found[at], plain[also]]
            places += [np.stack([np.full(len(x), k), x], axis=1) for x in (at, also)]
            said = (canonical(w) for w in words)
            slots.append(np.array([xxhash.xxh3_64_intdigest(form + value) | 1 if form in (NUMBER, NAME, UNIT) else 0 for form, value in said], np.uint64))
            telling.append(np.pad(tells, (0, len(words) - len(tells))))
            self.first.append(self.first[-1] + len(words))
            if len(words) == SHORT:
                for h in window_hashes(literal_hashes(words), SHORT)[0].tolist():
                    short.setdefault(h, []).append(k)
        flat = _joined(hashes, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.places = np.concatenate(places)[order].astype(np.int32) if places else np.zeros((0, 2), np.int32)
        #: Of every word: 0 if it is a plain one, else a hash of its kind and value; whether a window that tells starts there.
        self.slots, self.telling = _joined(slots, np.uint64), _joined(telling, bool)
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[(self.hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
        self.short = dict(sorted(short.items()))
        self.short_hashes = np.array(list(self.short), np.uint64)
        self.listed = self._listed()

    def _listed(self) -> np.ndarray:
        """Whether a window's items are listed: if they are few, or if one of them has too few rare windows to be met under."""
        if not len(self.hashes):
            return np.zeros(0, bool)
        starts = np.flatnonzero(np.concatenate(([True], self.hashes[1:] != self.hashes[:-1])))
        sizes = np.diff(np.append(starts, len(self.hashes)))
        rare = np.repeat(sizes <= LISTED, sizes)
        # Words at which a window that is not rare starts, in either form: an item of which they alone are enough could be met under none of its rare ones.
        common: dict[int, set[int]] = defaultdict(set)
        for k, place in self.places[~rare].tolist():
            common[k].add(place)
        unmet = np.zeros(len(self.ids), bool)
        unmet[[k for k, places in common.items() if self.share(k, places) >= SHARE]] = True
        lacking = np.add.reduceat(unmet[self.places[:, 0]].astype(np.int64), starts) > 0
        return rare | np.repeat(lacking, sizes)

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in `hashes` that are windows of items, with the ranges of their entries."""
        maybe = np.flatnonzero(self.bits[(hashes >> np.uint64(64 - BITS)).astype(np.int64)])
        low = np.searchsorted(self.hashes, hashes[maybe], "left")
        high = np.searchsorted(self.hashes, hashes[maybe], "right")
        hit = high > low
        return maybe[hit], low[hit], high[hit]

    def share(self, k: int, places: set[int]) -> float:
        """Share of the item's windows, of the form of which more are there."""
        tells = self.telling[self.first[k] : self.first[k + 1]]
        typed = int(tells[list(places)].sum()) / self.total[k] if self.total[k] else 0.0
        return max(typed, len(places) / self.folded[k] if self.folded[k] else 0.0)

    def judge(self, words: list[bytes], hits: list[tuple[int, int, int]]) -> list[tuple[object, float, float, int, int]]:
        """(item, share, agreement, first word, words) of all passages of items that a document holds."""
        by_item: dict[int, set[tuple[int, int]]] = defaultdict(set)
        shared = []
        for at, low, high in hits:
            if self.listed[low]:
                for k, place in self.places[low:high].tolist():
                    by_item[k].add((at - place, place))
            else:
                shared.append((at, low, high))
        for at, low, high in shared:
            for k in by_item:
                for place in self.places[low + np.searchsorted(self.places[low:high, 0], k) : high]:
                    if place[0] != k:
                        break
                    by_item[k].add((at - int(place[1]), int(place[1])))
        out = []
        for k, met in by_item.items():
            if self.share(k, {p for _, p in met}) < SHARE:
                continue
            matches, begin = sorted(met), 0
            for end in range(1, len(matches) + 1):
                if end < len(matches) and matches[end][0] - matches[end - 1][0] <= DRIFT:
                    continue
                group, begin = matches[begin:end], end
                share = self.share(k, {p for _, p in group})
                if share >= SHARE and (agreement := self._agreement(k, words, group)) >= AGREE:
                    first = min(d + p for d, p in group)
                    out.append((self.ids[k], share, agreement, first, max(d + p for d, p in group) + WINDOW - first))
        return out

    def _agreement(self, k: int, words: list[bytes], group: list[tuple[int, int]]) -> float:
        """Share of slots that became what their value became most often."""
        pairs = {(p + j, d + p + j) for d, p in group for j in range(WINDOW)}
        became: dict[int, Counter] = defaultdict(Counter)
        for i, j in pairs:
            if slot := int(self.slots[self.first[k] + i]):
                became[slot][canonical(words[j])[1]] += 1
        total = sum(sum(c.values()) for c in became.values())
        return sum(max(c.values()) for c in became.values()) / total if total else 1.0

    def verbatim(self, words: list[bytes]) -> Iterator[tuple[int, object]]:
        """(first word, item) of the short items in a run of words."""
        hashes = window_hashes(literal_hashes(words), SHORT)[0]
        for at in np.flatnonzero(np.isin(hashes, self.short_hashes)).tolist():
            for k in self.short[int(hashes[at])]:
                yield at, self.ids[k]


def groups(texts: list[bytes]) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Texts' numbers and words, as many at a time as have GROUP words."""
    rows, held, size = [], [], 0
    for k, data in enumerate(texts):
        words = data.split()
        if len(words) >= SHORT:
            rows.append(k)
            held.append(words)
            size += len(words)
        if size >= GROUP:
            yield rows, held
            rows, held, size = [], [], 0
    if rows:
        yield rows, held


def search(texts: list[bytes], benchmark: Benchmark) -> Iterator[tuple]:
    """(text's number, item, share, agreement, first word, words) of all passages found."""
    for rows, held in groups(texts):
        words = [w for text in held for w in text]
        typed = template_hashes(words)
        hashes, telling = window_hashes(typed)
        plain, saying = window_hashes(folded_hashes(words, typed))
        ends = np.cumsum([len(w) for w in held])
        told, named = np.flatnonzero(telling), np.flatnonzero(saying & ((plain != hashes) | ~telling))
        found = [(which[i], lo, hi) for which, form in ((told, hashes), (named, plain)) for i, lo, hi in [benchmark.lookup(form[which])]]
        at, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        owner = np.searchsorted(ends, at, "right")
        inside = at + WINDOW <= ends[owner]
        by_text: dict[int, list] = defaultdict(list)
        for t, a, lo, hi in zip(owner[inside].tolist(), at[inside].tolist(), low[inside].tolist(), high[inside].tolist(), strict=True):
            by_text[t].append((a - int(ends[t]) + len(held[t]), lo, hi))
        for t, hits in by_text.items():
            for found in benchmark.judge(held[t], hits):
                yield rows[t], *found
        if benchmark.short:
            for at, item in benchmark.verbatim(words):
                t = int(np.searchsorted(ends, at, "right"))
                if at + SHORT <= ends[t]:
                    yield rows[t], item, 1.0, 1.0, at - int(ends[t]) + len(held[t]), SHORT


def blocks(bench: DataFrame, item: str, text: str) -> list[list[tuple]]:
    """The items in lists of at most BLOCK words each (or one item, if it has more)."""
    out, size = [[]], 0
    for row in bench.select(item, text).toLocalIterator():
        n = len((row[1] or "").split())
        if out[-1] and size + n > BLOCK:
            out.append([])
            size = 0
        out[-1].append((row[0], row[1]))
        size += n
    return out


def leaks(docs: DataFrame, bench: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, share, agreement, start, length): the benchmark passages in the documents, in words."""
    spark = docs.sparkSession
    id_kind, item_kind = (t.simpleString() for t in (docs.select(id).schema[0].dataType, bench.select(item).schema[0].dataType))
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    out = None
    for block in blocks(bench, item, item_text):
        held = spark.sparkContext.broadcast(Benchmark(block))

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in slices_of(batches):
                found = list(search(utf8(batch.column(1)), held.value))
                if found:
                    k, items, share, agreement, start, length = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(k)), pa.array(items), pa.array(share), pa.array(agreement), pa.array(start, pa.int64()), pa.array(length, pa.int64())],
                        ["id", "item", "share", "agreement", "start", "length"],
                    )

        part = rows.mapInArrow(find, f"id {id_kind}, item {item_kind}, share double, agreement double, start bigint, length bigint")
        out = part if out is None else out.unionAll(part)
    return out.withColumnsRenamed({"id": id, "item": item if item != id else f"{item}_"})


def flagged(docs: DataFrame, bench: DataFrame, text: str = "text", item_text: str = "text") -> tuple[DataFrame, str]:
    """The documents with a boolean column that says whether they hold a passage, and its name. Of a
    benchmark of several blocks each is a pass of its own, which keeps the hashes of the texts it finds;
    so no worker holds two blocks. Defined cases are those of this module; all columns stay."""

    def leaking(held):
        def judge(texts: pa.Array) -> pa.Array:
            found = {hit[0] for hit in search(utf8(texts), held.value)}
            return pa.array([k in found for k in range(len(texts))], pa.bool_())

        return judge

    context, name = docs.sparkSession.sparkContext, unused(docs, "leaks")
    held = [context.broadcast(Benchmark(b)) for b in blocks(bench.select(F.lit(0).alias("n"), F.col(item_text).alias("t")), "n", "t")]
    if len(held) == 1:
        return docs.withColumn(name, map_column(leaking(held[0]), "boolean", F.col(text))), name
    a, b = unused(docs, "text_hash_a"), unused(docs, "text_hash_b")
    hashed = docs.withColumns({a: F.xxhash64(text), b: F.xxhash64(F.lit(1), F.col(text))})
    found = None
    for block in held:
        part = staged(hashed.where(map_column(leaking(block), "boolean", F.col(text))).select(a, b).distinct(), "leaking")
        block.unpersist()
        found = part if found is None else found.union(part)
    found = found.distinct().withColumn(name, F.lit(True))
    return hashed.join(found, [a, b], "left").select(*docs.columns, F.coalesce(name, F.lit(False)).alias(name)), name


def digest(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The result of the query: every passage of an item in a document."""
    return leaks(docs, bench)
