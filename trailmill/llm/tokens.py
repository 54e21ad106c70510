"""Exact tokens of public vocabularies, by their library or by faster ways that agree with it.

Byte-level ids (`encode`): a plain text, one without special strings and without characters on which
libraries and their Unicode tables could differ, goes to the same vocabulary as ranks; every other
text goes to the library whole.

Counts of the lower-casing word vocabulary (`count`): every text is cut into pre-tokens, whose lengths
come from two tiers of tables. Plain texts are cut by a pattern; texts of other scripts by the library's
own normaliser and pre-tokeniser, so that no Unicode table but its own is asked. Only texts with special
strings go to the library whole.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: Characters outside of the plain alphabet: Latin letters, common punctuation and currency.
_PLAIN = "\t\n\x0b\x0c\r\x20-\x7e\xa1-\xac\xae-įı-ɏ‐-‧‰-⁞₠-₿"
UNUSUAL = re.compile(f"[^{_PLAIN}]")
SPECIAL = "<|"

_INSIDE = {chr(c) for c in range(0x20C0) if not UNUSUAL.match(chr(c)) and not chr(c).isspace()}
#: Some capitals of the plain alphabet have small letters outside of it.
_LOWERED = sorted(_INSIDE | {c for x in _INSIDE for c in x.lower()})
_LETTERS = "".join(c for c in _LOWERED if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _LOWERED if unicodedata.category(c)[0] == "N")
#: Pre-tokens of the lower-casing word vocabulary, within the plain alphabet.
PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")

#: Entries of a worker's cache, after which it starts anew from the broadcast table.
CACHED = 120_000
#: Pre-tokens above this length are not kept.
LONG = 128
#: Characters of a text that are cut into pre-tokens at a time.
STRETCH = 1 << 18

_LOADED: dict = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def library(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def ranked(path: str):
    """The same byte-level vocabulary as ranks, if it lies beside the file; else None."""
    if (key := (path, "ranks")) not in _LOADED:
        beside = path.removesuffix(".json") + ".tiktoken"
        _LOADED[key] = None
        if os.path.exists(beside):
            import public_tokenizers
            import tiktoken

            with open(beside, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
            _LOADED[key] = tiktoken.Encoding(beside, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


def plain(text: str) -> bool:
    return SPECIAL not in text and not UNUSUAL.search(text)


def encode(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers."""
    fast, out = ranked(path), []
    for text in texts:
        ids = fast.encode_ordinary(text) if fast and plain(text) else library(path).encode(text, add_special_tokens=False).ids
        out.append(np.asarray(ids, "<u4").tobytes())
    return out


def _visible_bytes() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible,
    else the next one above 255."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


_VISIBLE = _visible_bytes()
_BYTES = {c: b for b, c in _VISIBLE.items()}


def shown(word: str) -> str:
    """The word as a byte-level vocabulary writes it."""
    return word if word.isascii() else "".join(map(_VISIBLE.__getitem__, word.encode()))


def read(word: str) -> str:
    """The word that a byte-level vocabulary writes so."""
    return word if word.isascii() else bytes(map(_BYTES.__getitem__, word)).decode()


class Lengths(dict):
    """Number of tokens of a lower-cased pre-token, as itself or as shown; what is not held is asked of
    the library's model."""

    def __init__(self, path: str, table: dict[str, int], visible: bool):
        self.model, self.visible = library(path).model, visible
        self.table = {shown(w): n for w, n in table.items()} if visible else table
        super().__init__(self.table)

    def __missing__(self, word: str) -> int:
        n = len(self.model.tokenize(word if self.visible else shown(word)))
        if len(word) <= LONG:
            if len(self) >= CACHED + len(self.table):
                self.clear()
                self.update(self.table)
            self[word] = n
        return n


#: By vocabulary: the table, and the caches of words as themselves and as shown.
_CACHES: dict[str, tuple[dict, Lengths, Lengths]] = {}


def stretches(text: str) -> Iterator[str]:
    """The text in parts of about STRETCH characters, cut before blanks. A blank neither takes part in a
    pre-token nor composes with what is before it, so that the parts' pre-tokens are the text's."""
    at = 0
    while len(text) - at > STRETCH:
        end = text.find(" ", at + STRETCH)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def pretokens(text: str, path: str) -> Iterator[tuple[bool, list[str]]]:
    """The lower-cased pre-tokens of a text without special strings, in parts: whether they are as
    shown, and the pre-tokens."""
    own = library(path)
    for part in stretches(text):
        if UNUSUAL.search(part):
            yield True, [w for w, _ in own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(part))]
        else:
            yield False, PRETOKEN.findall(part.lower())


def count(texts: list[str], path: str, table: dict[str, int] | None = None) -> list[int]:
    """The number of tokens of each text in the lower-casing word vocabulary. The worker's caches
    are kept from task to task while the table is the same."""
    table = table or {}
    if path not in _CACHES or _CACHES[path][0] != table:
        _CACHES[path] = table, Lengths(path, table, False), Lengths(path, table, True)
    length = [c.__getitem__ for c in _CACHES[path][1:]]
    return [
        len(library(path).encode(text, add_special_tokens=False).ids) if SPECIAL in text
        else sum(sum(map(length[as_shown], words)) for as_shown, words in pretokens(text, path))
        for text in texts
    ]
