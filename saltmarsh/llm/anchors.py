"""Anchors of byte windows, in numpy.

The anchor of a window is the place of its k-gram with the smallest hash, the leftmost of
equal ones. Equal windows have their anchor at the same place, and neighbouring windows
mostly share one, so a text has far fewer anchors than windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from saltmarsh.llm.shingles import mixed

#: Bytes handled at a time; places within take 24 bits of a key.
SLICE_BYTES = 1 << 21
_OF_BYTE = np.random.default_rng(20240502).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEPS = [np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53,
    0x87C37B91114253D5, 0x4CF5AD432745937F, 0x52DCE729DA3ED7A1, 0x38495AB5A3C59AE3,
)]


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` bytes, by doubling."""
    out, have, level = None, 0, _OF_BYTE[codes]
    width, step, left = 1, 0, size
    while left:
        if left & 1:
            if out is None:
                out, have = level, width
            else:
                n = len(codes) - have - width + 1
                out = out[:n] * _STEPS[step + 5 & 7] + level[have:have + n]
                have += width
        left >>= 1
        if left:
            n = len(level) - width
            level = level[:n] * _STEPS[step] + level[width:width + n]
            width *= 2
            step += 1
    return mixed(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def parts(texts: list[bytes], window: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Texts joined into parts of bounded size: their numbers, first bytes in the text, and bytes.

    A longer text is cut into overlapping parts, so that every window is in one.
    """
    numbers: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text) > SLICE_BYTES:
            for begin in range(0, len(text) - window + 1, SLICE_BYTES):
                yield [i], [begin], text[begin:begin + SLICE_BYTES + window - 1]
            continue
        if held and size + len(text) > SLICE_BYTES:
            yield numbers, [0] * len(numbers), b"".join(held)
            numbers, held, size = [], [], 0
        if len(text) >= window:
            numbers.append(i)
            held.append(text)
            size += len(text)
    if held:
        yield numbers, [0] * len(numbers), b"".join(held)


def anchored(data: bytes, lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts: start of every window inside a text, place of its anchor, and hash of every gram."""
    codes = np.frombuffer(data, dtype=np.uint8)
    grams = gram_hashes(codes, gram)
    keyed = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(keyed, window - gram + 1)
    inside = np.ones(len(least), dtype=bool)
    for end in np.cumsum(lengths)[:-1]:
        inside[max(end - window + 1, 0):end] = False
    starts = np.flatnonzero(inside)
    return starts, (least[starts] & np.uint64((1 << 24) - 1)).astype(np.int64), grams
