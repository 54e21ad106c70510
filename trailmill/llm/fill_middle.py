"""Fill-in-the-middle: a text is cut at two ranks of its units and its parts change places.

A text is a rope: a balanced tree whose leaves hold some of it and, as the nodes above do, the number of
its units and of its code points. A cut at a rank goes down one path and shares all other subtrees, and
parts are concatenated tree by tree with the sentinels, so that no part is copied before the output is
read off the leaves. Undoing it is the same: the output becomes a rope, sentinels are found leaf by
leaf, and splits at their ranks give the parts back.

Units are code points, or what matches a pattern (words, lines), left to right. Where the cuts lie and
which form a text takes come from a hash of its id, so reruns and retries give the same output.

Every row is judged alone: nothing is shuffled, and a lost task is run again. A task holds a batch of at
most ROWS texts, of which one at a time is a rope, three times its length at most.

Defined cases: a null text is an empty one, and stays plain. A null id hashes as an empty one. A text
that contains a sentinel stays plain. Repeated rows give equal outputs. An output that is not of its
form is restored as null. An empty table gives an empty result; other columns pass through, and added
columns take names that clash with none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_column, unused

#: Units of a leaf.
LEAF = 4_096


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (text) or the concatenation of two ropes. ends: of a leaf, the code points up to the end of each
    unit; None where units are code points."""

    units: int
    points: int
    height: int = 0
    text: str = ""
    ends: tuple[int, ...] | None = None
    left: Rope | None = None
    right: Rope | None = None


EMPTY = Rope(0, 0)


def leaf(text: str, ends: tuple[int, ...] | None = None) -> Rope:
    return Rope(len(text) if ends is None else len(ends), len(text), 0, text, ends)


def _joined(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.points + b.points, max(a.height, b.height) + 1, "", None, a, b)


def _balanced(a: Rope, b: Rope) -> Rope:
    """Both as one, by a rotation where one is two levels higher."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return _joined(a.left, _joined(a.right, b))
        return _joined(_joined(a.left, a.right.left), _joined(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return _joined(_joined(a, b.left), b.right)
        return _joined(_joined(a, b.left.left), _joined(b.left.right, b.right))
    return _joined(a, b)


def concat(a: Rope, b: Rope) -> Rope:
    """Goes down the higher one's edge to where the other fits; as many steps as their heights differ."""
    if not a.points or not b.points:
        return a if a.points else b
    if a.height > b.height + 1:
        return _balanced(a.left, concat(a.right, b))
    if b.height > a.height + 1:
        return _balanced(concat(a, b.left), b.right)
    return _joined(a, b)


def split(rope: Rope, rank: int, points: bool = False) -> tuple[Rope, Rope]:
    """The first `rank` units (or code points), and the rest."""
    size = rope.points if points else rope.units
    if rank <= 0 or rank >= size:
        return (EMPTY, rope) if rank <= 0 else (rope, EMPTY)
    if rope.left is not None:
        before = rope.left.points if points else rope.left.units
        if rank < before:
            a, b = split(rope.left, rank, points)
            return a, concat(b, rope.right)
        a, b = split(rope.right, rank - before, points)
        return concat(rope.left, a), b
    if rope.ends is None:
        return leaf(rope.text[:rank]), leaf(rope.text[rank:])
    # A cut by code points may fall inside a unit, which becomes two.
    at = rank if points else rope.ends[rank - 1]
    first = tuple(e for e in rope.ends if e < at) + (at,)
    return leaf(rope.text[:at], first), leaf(rope.text[at:], tuple(e - at for e in rope.ends if e > at))


def leaves(rope: Rope) -> Iterator[Rope]:
    todo = [rope]
    while todo:
        at = todo.pop()
        if at.left is None:
            yield at
        else:
            todo += [at.right, at.left]


def read(rope: Rope) -> str:
    return "".join(x.text for x in leaves(rope))


def rope_of(text: str, unit: str | None = None, size: int = LEAF) -> Rope:
    """A balanced rope. unit: a pattern; each match ends a unit, and so does the text. None: code points."""
    if unit is None:
        row = [leaf(text[at : at + size]) for at in range(0, len(text), size)]
    else:
        ends = [m.end() for m in re.finditer(unit, text) if m.end() > m.start()]
        ends += [len(text)] if text and ends[-1:] != [len(text)] else []
        row = []
        for at in range(0, len(ends), size):
            start, some = ends[at - 1] if at else 0, ends[at : at + size]
            row.append(leaf(text[start : some[-1]], tuple(e - start for e in some)))
    while len(row) > 1:
        pairs = [_joined(row[k], row[k + 1]) for k in range(0, len(row) - 1, 2)]
        row = pairs[:-1] + [concat(pairs[-1], row[-1])] if len(row) % 2 else pairs
    return row[0] if row else EMPTY


def find(rope: Rope, needle: str, start: int = 0) -> int:
    """The code points before the first occurrence at or behind `start`, or -1. Leaves are searched with as much of
    the text before them as an occurrence across the border has."""
    before, tail = 0, ""
    for part in leaves(rope):
        text = tail + part.text
        base = before - len(tail)
        at = text.find(needle, max(0, start - base))
        if at >= 0:
            return base + at
        before += part.points
        tail = text[-(len(needle) - 1) :] if len(needle) > 1 else ""
    return -1


@dataclass(frozen=True)
class Rules:
    """Sentinels, the share of texts that are rearranged, of those the share with the suffix first, and the seed."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    percent: int = 90
    suffix_first: int = 20
    seed: int = 1
    unit: str | None = None

    def __post_init__(self) -> None:
        said = (self.prefix, self.suffix, self.middle)
        # Else the end of a part and a sentinel could together read as a sentinel that comes earlier.
        if not all(said) or len(set(said)) < 3 or any(s[0] in t[1:] for s in said for t in said):
            raise ValueError("sentinels must differ, and none may hold the first character of one behind its own start")


CONTRACT = Rules()


def draws(key: str, seed: int) -> tuple[int, int, int, int]:
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digits[8 * k : 8 * k + 8], 16) for k in range(4))


def rearranged(key: str, text: str, rules: Rules = CONTRACT) -> tuple[str, str, int, int | None, int | None]:
    """(output, form, units, code points of the prefix, of the middle)."""
    rope = rope_of(text, rules.unit)
    n = rope.units
    h1, h2, h3, h4 = draws(key, rules.seed)
    if not n or h3 % 100 >= rules.percent or any(s in text for s in (rules.prefix, rules.suffix, rules.middle)):
        return text, "plain", n, None, None
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = split(rope, last)
    prefix, middle = split(head, first)
    p, s, m = leaf(rules.prefix), leaf(rules.suffix), leaf(rules.middle)
    form = "spm" if h4 % 100 < rules.suffix_first else "psm"
    out = EMPTY
    for part in (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle):
        out = concat(out, part)
    return read(out), form, n, prefix.points, middle.points


def restored_text(output: str | None, form: str | None, rules: Rules = CONTRACT) -> str | None:
    """The text before it was rearranged; None if the output is not of this form."""
    if output is None or form == "plain":
        return output
    one, two = {"psm": (rules.prefix, rules.suffix), "spm": (rules.suffix, rules.prefix)}.get(form, (None, None))
    if one is None or not output.startswith(one):
        return None
    rope = rope_of(output)
    second = find(rope, two, len(one))
    third = find(rope, rules.middle, second + len(two)) if second >= 0 else -1
    if third < 0:
        return None
    rest, middle = split(rope, third + len(rules.middle), points=True)
    rest, last = split(split(rest, third, points=True)[0], second + len(two), points=True)
    first = split(split(rest, second, points=True)[0], len(one), points=True)[1]
    prefix, suffix = (first, last) if form == "psm" else (last, first)
    return read(concat(concat(prefix, middle), suffix))


_KIND = "struct<output: string, form: string, units: bigint, prefix_chars: bigint, middle_chars: bigint>"


def transformed(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Rules = CONTRACT) -> tuple[DataFrame, str]:
    """The rows with what became of each (output, form, units, prefix_chars, middle_chars), and that column's name."""

    def outputs(keys: pa.Array, texts: pa.Array) -> pa.Array:
        made = [rearranged(k or "", t or "", rules) for k, t in zip(keys.to_pylist(), texts.to_pylist(), strict=True)]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array([row[k] for row in made], kind) for k, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, ["output", "form", "units", "prefix_chars", "middle_chars"])

    name = unused(docs, "fim")
    return docs.withColumn(name, map_column(outputs, _KIND, F.col(id).cast("string"), F.col(text))), name


def restored(output: Column, form: Column, rules: Rules = CONTRACT) -> Column:
    """The text of an output and its form."""

    def texts(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([restored_text(o, f, rules) for o, f in zip(outputs.to_pylist(), forms.to_pylist(), strict=True)], pa.string())

    return map_column(texts, "string", output, form)


def digest(docs: DataFrame) -> DataFrame:
    """The result of the query, for every document."""
    out, fim = transformed(docs.select("doc_id", "text"))
    f = F.col(fim)
    rows = out.select("doc_id", f["units"].alias("n"), f["form"].alias("form"), f["prefix_chars"].alias("prefix_chars"), f["middle_chars"].alias("middle_chars"), f["output"].alias("output"))
    back = rows.withColumn("restored", restored(F.col("output"), F.col("form")))
    hashed = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed("output").alias("output_sha256"), hashed("restored").alias("restored_sha256"))
