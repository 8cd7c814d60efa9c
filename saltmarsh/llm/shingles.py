"""Hashed word shingles of many texts at a time, in numpy.

Words are runs without white space; a shingle is five words in a row, or all words of a
shorter text. A shingle weighs 1 + ln(times it occurs), so that a line repeated many
times does not outweigh the rest of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SIZE = 5
#: Bytes handled at a time; a slice also ends after 4,096 texts.
SLICE_BYTES = 1 << 21
SLICE_TEXTS = 4096

_RANDOM = np.random.default_rng(20240501)
_OF_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_OF_PLACE = _RANDOM.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_OF_WORD = _RANDOM.integers(1, 1 << 63, SIZE, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_KIND = np.where(_SPACE, 0, 1).astype(np.uint8)
#: Letters, digits and all non-ASCII are words, other signs are words of their own.
SIGNS = np.array([0 if _SPACE[b] else 1 if b >= 128 or chr(b).isalnum() or b == 0x5F else 2 for b in range(256)], dtype=np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit value spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded size; a longer text stands alone."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if i > begin and (held + len(text) > SLICE_BYTES or i - begin >= SLICE_TEXTS):
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces of bounded size, cut before white space where there is any."""
    begin = 0
    while begin < len(data):
        end = begin + 2 * SLICE_BYTES
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[begin:end]
        begin = end


def word_hashes(data: bytes, kinds: np.ndarray = _KIND) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word: a run of bytes of one kind other than 0."""
    codes = np.frombuffer(data, dtype=np.uint8)
    kind = kinds[codes]
    space = kind == 0
    first = ~space
    first[1:] &= kind[1:] != kind[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    codes = codes[starts[0]:]
    place = np.arange(len(codes), dtype=np.int64)
    place -= np.repeat(starts - starts[0], np.diff(np.append(starts - starts[0], len(codes))))
    values = _OF_BYTE[codes] * _OF_PLACE[place & 4095]
    values[space[starts[0]:]] = 0
    return mixed(np.add.reduceat(values, starts - starts[0])), starts


def weighted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of at most ``SLICE_TEXTS`` texts: number of the text, hash (52 bits) and weight of each distinct shingle.

    Sorted by text, then hash.
    """
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    if len(coded) == 1:
        parts = [word_hashes(p)[0] for p in pieces(coded[0])]
        words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        owner = np.zeros(len(words), dtype=np.int64)
    else:
        words, starts = word_hashes(b"\n".join(coded))
        ends = np.cumsum([len(c) + 1 for c in coded])
        owner = np.searchsorted(ends, starts, side="right")
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0)
    count = np.bincount(owner, minlength=len(texts))
    n = max(len(words) - SIZE + 1, 0)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(SIZE):
        value += words[k:k + n] * _OF_WORD[k]
    whole = owner[:n] == owner[SIZE - 1:] if n else np.empty(0, bool)
    value, of = value[whole], owner[:n][whole]
    short = np.flatnonzero((count > 0) & (count < SIZE))
    if len(short):
        first = np.searchsorted(owner, short)
        own = np.zeros(len(short), dtype=np.uint64)
        for k in range(SIZE - 1):
            there = count[short] > k
            own[there] += words[first[there] + k] * _OF_WORD[k]
        value, of = np.concatenate([value, own]), np.concatenate([of, short])
    key = np.sort((of.astype(np.uint64) << np.uint64(52)) | (mixed(value) >> np.uint64(12)))
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    times = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1), 1.0 + np.log(times)
