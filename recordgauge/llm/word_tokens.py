"""Token ids of whole texts, word by word, with each distinct word encoded once per worker.

The vocabulary's pre-tokenizer never joins characters across white space and sees no context
beyond a word, so a text's ids are its words' ids in a row; the name of a special token is that
token, also beside letters. It also parts letters from a run of
punctuation after them, so ``word,`` is looked up as ``word`` and ``,``.

Words of plain Latin letters are single pre-tokens whatever the normaliser does but for their
case, and go to the vocabulary's merges directly. Everything else takes the whole way.
"""

from __future__ import annotations

import os
import struct
from functools import lru_cache

from tokenizers import Tokenizer

#: The memory bound of a worker's cache, in distinct words; a full one starts again.
MAX_WORDS = 400_000
#: Punctuation that may follow a word; the apostrophe can belong to a contraction.
_TRAILING = b'.,;:!?%&*$#"|()[]{}<>/+=~^@_-'
#: The last letter whose lower case is one letter that depends on nothing else; one is left out.
_LAST_PLAIN, _DOTTED_I = "ſ", "İ"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a printable byte as itself, others as letters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(printable))
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


class WordEncoder(dict):
    """Little-endian unsigned 32-bit ids by word, under a ``tokenizers`` file."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model

    def encode(self, text: str | None) -> bytes:
        if len(self) > MAX_WORDS:
            self.clear()
        # bytes.split() splits at ASCII white space only; other kinds stay within a "word".
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8").split()))

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(_TRAILING)
        plain = _plain(stem)
        if plain is None:
            ids = self._whole(word)
        else:
            tail = word[len(stem) :]
            found = [t.id for t in self.merges.tokenize(plain)]
            ids = struct.pack(f"<{len(found)}I", *found) + (self._tail(tail) if tail else b"")
        self[word] = ids
        return ids

    def _tail(self, tail: bytes) -> bytes:
        found = self.get(tail)
        if found is None:
            found = self[tail] = self._whole(tail)
        return found

    def _whole(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def _plain(stem: bytes) -> str | None:
    """The stem as the merges take it, or None if it is not of plain Latin letters."""
    if stem.isascii():
        return stem.lower().decode("ascii") if stem.isalpha() else None
    text = stem.decode("utf-8")
    if not text.isalpha() or max(text) > _LAST_PLAIN or _DOTTED_I in text:
        return None
    return "".join(map(_LETTERS.__getitem__, text.lower().encode("utf-8")))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a file; kept between tasks."""
    return WordEncoder(path)
