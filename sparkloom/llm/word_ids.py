"""Token ids of whole texts by a tokenizers file, quickly and exactly.

Text is cut at ASCII white space, which the tokenizer drops, and the ids of
each piece are kept in bounded caches. A piece of letters with punctuation
behind it is taken apart further, as the tokenizer's own pre-tokenizer does,
so that the caches hold few variants of a word. ``ids_by_library`` is the
plain call that tests hold this against.
"""

from __future__ import annotations

import gc
import struct
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

#: Entries of each cache of a Python worker; at about 200 bytes each.
CACHE_ENTRIES = 400_000
_TAIL = ".,!|*$%&#?;:"


def broadcast_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer's file (a few MB) for all tasks."""
    return spark.sparkContext.broadcast(Path(path).read_text())


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable
    Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def ids_by_library(tokenizer: Tokenizer, text: str) -> list[int]:
    return tokenizer.encode(text, add_special_tokens=False).ids


_SHORT = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _packed(ids: list[int]) -> bytes:
    return _SHORT[len(ids)](*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)


class _Cache(dict):
    """Ids by piece, made when a piece is first asked for; emptied when it is full."""

    def __init__(self, made: Callable[[bytes], bytes]) -> None:
        super().__init__()
        self.made = made

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self[piece] = self.made(piece)
        return ids


class WordEncoder:
    """Ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, definition: str) -> None:
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenize = self.tokenizer.model.tokenize
        self.pieces = _Cache(self._piece)
        self.words: dict[str, bytes] = {}
        self.letters = dict(zip(range(256), _byte_letters()))
        probe = ["the", "été", "wörter", "!!", "straßen"]
        self.direct = all(self._by_model(w) == ids_by_library(self.tokenizer, w) for w in probe)

    def _by_model(self, word: str) -> list[int]:
        """One pre-token, lower case: straight to the merges, past normalizer and splitter."""
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return [t.id for t in self.tokenize(word)]

    def _word(self, word: str) -> bytes:
        """Ids of letters only or punctuation only: one pre-token."""
        held = self.words.get(word)
        if held is None:
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            found = self._by_model(word) if self.direct else ids_by_library(self.tokenizer, word)
            held = self.words[word] = _packed(found)
        return held

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8", "replace")
        low = text.lower()
        word = low.rstrip(_TAIL)
        if word.isalpha() and len(low) == len(text) and (low.isascii() or max(low) < "ƀ"):
            if len(word) == len(low):
                return self._word(word)
            return self._word(word) + self._word(low[len(word) :])
        return _packed(ids_by_library(self.tokenizer, text))

    def __call__(self, text: bytes | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, (text or b"").split()))


@lru_cache(maxsize=2)
def encoder(definition: str) -> WordEncoder:
    """One encoder, with its caches, for all tasks of a Python worker. The
    caches hold very many objects and no cycles: looking for cycles often is
    of no use there."""
    gc.set_threshold(200_000, 20, 20)
    return WordEncoder(definition)
