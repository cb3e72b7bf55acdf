"""Vectorised 64-bit hashes of the words and shingles of whole texts.

Words are the runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z only.  A
word's hash is a polynomial over its bytes, read off a running sum, so a block
of many texts takes a fixed number of numpy calls.  Long texts are cut into
blocks between words; memory is a small multiple of the block.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1 << 17  # bytes hashed at once, unless one word is longer
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GAP = re.compile(rb"[\x20\x09-\x0d]")
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * BLOCK)
        made = []
        for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[:] = made
    return _POWERS


def _hash_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of a block."""
    data = np.frombuffer(block.lower(), np.uint8)
    gap = np.empty(len(data) + 2, bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = _SPACE[data]
    change = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = change[0::2], change[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), start


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > BLOCK:
        cut = _GAP.search(text, at + BLOCK)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def word_hashes(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in order; a null text has none."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        h, start = _hash_block(b" ".join(group))
        ends = np.cumsum([len(t) + 1 for t in group])
        cuts = np.searchsorted(start, ends)
        at = 0
        for cut in cuts:
            yield h[at:cut]
            at = cut

    for text in texts:
        text = text or b""
        if len(text) > BLOCK:
            if group:
                yield from flush()
                group, size = [], 0
            yield np.concatenate([_hash_block(p)[0] for p in _pieces(text)])
            continue
        group.append(text)
        size += len(text) + 1
        if size > BLOCK:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive items."""
    count = len(h) - n + 1
    out = np.full(count, n * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(n):
        out = (out ^ h[j : j + count]) * np.uint64(0xE7037ED1A0B428DB)
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct ``n``-word shingles; the whole sequence if it is shorter; empty without words."""
    if not len(words):
        return words
    return np.unique(combine(words, min(n, len(words))))
