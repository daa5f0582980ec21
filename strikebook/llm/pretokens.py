"""Splitting texts into pre-tokens as the public tokenizer files do, with caches of what each encodes to.

Only the split is done here, with ``re`` over a known range of characters; ids come from the tokenizers
library. A stretch with any character outside that range goes to the library whole, so results are the
library's in all cases. Special strings inside a text are taken as special tokens, the library's default.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries a worker keeps; beyond it the cache starts anew.
MOST_CACHED = 800_000
#: Longer pre-tokens are encoded but not kept.
LONGEST_KEPT = 64


def _ranges(chars: list[int]) -> str:
    spans: list[list[int]] = []
    for c in chars:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)


_PLAIN = [
    c
    for c in (*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC)
    if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x2100 and unicodedata.normalize("NFC", chr(c)) == chr(c)
]
_SPACES = "\\t-\\r \\x85\\xa0"
_LETTERS = _ranges([c for c in _PLAIN if unicodedata.category(chr(c))[0] == "L"])
_NUMBERS = _ranges([c for c in _PLAIN if unicodedata.category(chr(c))[0] == "N"])
_OUTSIDE = re.compile(f"[^{_ranges(_PLAIN)}]")
_OTHER = f"[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: The split patterns of the two tokenizer files.
_SPLITS = {
    "byte_bpe_50k.json": f"{_SHORT}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?{_OTHER}|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+",
    "word_bpe_49k.json": f"{_SHORT}|[{_LETTERS}]+|[{_NUMBERS}]|{_OTHER}",
}
_LOWER = {"word_bpe_49k.json"}


def _printable() -> dict[int, str]:
    """Byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes follow from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_PRINTABLE = _printable()


class Splitter:
    """Pre-tokens of texts for one tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        name = os.path.basename(path)
        self.find = re.compile(_SPLITS[name]).findall
        self.lower = name in _LOWER
        specials = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")")
        self.model = self.library.model
        self.hint = os.path.commonprefix(specials)

    def whole(self, piece: str) -> list[int]:
        """Ids of any stretch of text."""
        return self.library.encode(piece, add_special_tokens=False).ids

    def ids(self, word: str) -> list[int]:
        """Ids of one pre-token: the library's model on its bytes, each written as a printable character."""
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_PRINTABLE))]

    def parts(self, text: str) -> Iterator[tuple[list[str], str]]:
        """Pre-tokens, or a piece for the library to encode whole."""
        pieces = self.special.split(text) if self.hint in text else (text,)
        for i, piece in enumerate(pieces):
            if i % 2 or (not piece.isascii() and _OUTSIDE.search(piece)):
                yield [], piece
            elif piece:
                yield self.find(piece.lower() if self.lower else piece), ""


class Cached(dict):
    """What each pre-token encodes to, in the form ``make`` gives; misses are asked of the library."""

    def __init__(self, splitter: Splitter, make: Callable[[list[int]], object]) -> None:
        super().__init__()
        self.splitter, self.make = splitter, make

    def __missing__(self, word: str):
        value = self.make(self.splitter.ids(word))
        if len(word) <= LONGEST_KEPT:
            if len(self) >= MOST_CACHED:
                self.clear()
            self[sys.intern(word)] = value
        return value

    def values_of(self, text: str) -> Iterator[Iterator[object]]:
        """Values in text order, an iterator for each stretch."""
        get = self.__getitem__
        for words, whole in self.splitter.parts(text):
            yield (self.make(self.splitter.whole(whole)),) if whole else map(get, words)


_WORKER: dict = {}


def worker_cache(path: str, kind: str, make: Callable[[list[int]], object]) -> Cached:
    """The cache of this Python worker, kept between tasks."""
    if (path, kind) not in _WORKER:
        _WORKER[path, kind] = Cached(Splitter(path), make)
    return _WORKER[path, kind]


def packed(width: str) -> Callable[[list[int]], bytes]:
    """Ids as little-endian bytes of the array type ``width`` (``H`` or ``I``)."""
    import struct

    return lambda ids: struct.pack(f"<{len(ids)}{width}", *ids)


def id_bytes(cache: Cached, text: str | None) -> bytes:
    return b"".join([b"".join(x) for x in cache.values_of(text or "")])
