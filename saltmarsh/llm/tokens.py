"""Token ids of texts by a public byte-level BPE vocabulary, with a bounded cache of words.

The vocabulary file of ``tokenizers`` is read as it is; its ids are also its merge
order, so ``tiktoken`` gives the same ids from it, at several times the speed (a test
compares them). A text is cut before single spaces, where no token can reach across, and
the ids of frequent pieces come from the cache.

``Words.tokens`` gives the ids of ``tokenizers`` with its settings as they are and
``add_special_tokens=False``: added tokens of the vocabulary are matched inside text.
``Words.encode`` reads them as ordinary characters.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: How byte-level BPE splits text before merging; fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# Python counts these as white space, Unicode does not.
SEPARATORS = re.compile(r"[\x1c-\x1f]")
LONG_PIECE = 10_000
CACHED_PIECES, CACHED_LENGTH = 300_000, 24


def byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Words(dict):
    """Ids (little-endian 32-bit) of pieces of text."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        to_byte = byte_of()
        ranks = {}
        for token, number in model["vocab"].items():
            if all(c in to_byte for c in token):
                ranks[bytes(to_byte[c] for c in token)] = number
        added = content.get("added_tokens") or []
        # Texts with one of these go to the tokenizer itself.
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        self.path = path
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._exact: Tokenizer | None = None
        self._default: Tokenizer | None = None

    def exact(self, text: str) -> bytes:
        if self._exact is None:
            self._exact = Tokenizer.from_file(self.path)
            self._exact.encode_special_tokens = True
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONG_PIECE:
            return self.exact(piece)
        ids = np.array(self.fast.encode_ordinary(piece), dtype="<u4").tobytes()
        if len(piece) <= CACHED_LENGTH and len(self) < CACHED_PIECES:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, four bytes each."""
        if SEPARATORS.search(text):
            return self.exact(text)
        return b"".join(map(self.__getitem__, PIECE.findall(text)))

    def tokens(self, text: str) -> bytes:
        """Ids of a whole text in which added tokens count, four bytes each."""
        if self.added is None or not self.added.search(text):
            return self.encode(text)
        if self._default is None:
            self._default = Tokenizer.from_file(self.path)
        return np.array(self._default.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@functools.cache
def words(path: str) -> Words:
    """One vocabulary and cache for each worker."""
    return Words(path)
