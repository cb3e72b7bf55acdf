"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared as runs of lower-case letters and digits with single spaces.
A benchmark item is cut into windows of ``WINDOW`` characters, half overlapping
(a shorter item is one window), each with a budget of ``RATE`` of its length in
edits, and into windows of ``SHORT`` characters, one every ``STRIDE``, with a
budget of ``SHORT_RATE``.  So a verbatim quote of ``SHORT + STRIDE - 1``
characters or more is found wherever it starts.  By the q-gram lemma, a part of a document within ``k`` edits of a window
of ``m`` characters shares ``m - q + 1 - k * q`` q-grams with it or more, on
``k + 1`` neighbouring diagonals.  So per document:

1. look up the q-grams of the whole text in the windows' index;
2. count the shared ones by window and diagonal band; bands are ``2 * (k + 1)``
   diagonals wide and overlap by half, so one holds all of an alignment's;
3. retain the bands that reach the bound;
4. verify each by banded alignment of the window with that part of the text.

The benchmark is taken in blocks of about ``BLOCK_CHARS`` characters: a block's
index is broadcast (about 140 bytes a character), and each block is one pass over
the documents, with one block's index in the workers at a time.

An item of fewer than ``LEAST`` normalised characters has no room for edits: it
is found where it stands whole, between spaces, by the hashes of all runs of its
length.

Defined results: null or empty texts and items, and those without a letter or
digit, have no hit; repeated items and rows are reported as often as they occur,
an item with a null id as item null; a text that repeats itself gives a region
for each place; other columns are ignored, or kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm import scratch
from grovekit.llm.hashing import mix

Q = 9
WINDOW = 100
RATE = 0.08
SHORT, STRIDE = 50, 10
SHORT_RATE = 0.04
LEAST = 24
BLOCK_CHARS = 500_000
BITS = 20
CHUNK = 1 << 17
#: Shared q-grams that are counted at once.
HITS = 1 << 21
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """For each code point: whether it is a letter or digit, and its lower case."""
    if not _TABLES:
        kept, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalnum():
                kept[i] = True
                low = c.lower()
                if low != c and len(low) == 1:
                    lower[i] = ord(low)
        _TABLES.extend([kept, lower])
    return _TABLES


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the compared form, and which code points of the text are kept."""
    kept, lower = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = kept[points]
    space = np.zeros(len(points), bool)
    space[1:] = word[:-1] & ~word[1:]  # the first other character after a word
    stay = word | space
    if len(points) and not word[-1]:
        stay[np.flatnonzero(word)[-1] + 1 if word.any() else 0 :] = False  # no space at the end
    return np.where(word, lower[points], np.uint32(32))[stay], stay


def qgrams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all runs of ``q`` code points, by doubling."""
    if len(points) < q:
        return np.empty(0, np.uint64)
    one = points.astype(np.uint64)
    h, width = one, 1
    while width * 2 <= q:
        h = (h[:-width] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[width:] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(1)) ^ (h[width:] << np.uint64(7))
        width *= 2
    for at in range(width, q):
        h = (h[: len(one) - at] * np.uint64(0x9E3779B97F4A7C15)) ^ one[at:]
    return mix(h)


def budget(m: int, rate: float = RATE) -> tuple[int, int]:
    """(edits, shared q-grams) for a window of ``m`` characters."""
    k = max(0, min(int(rate * m), (m - Q + 1 - 3) // Q))
    return k, m - Q + 1 - k * Q


def banded_distances(windows: np.ndarray, texts: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(edits, start, end) of the best alignment of each whole window with a part of its text.

    ``texts[c, j]`` is the text's character on diagonal ``o`` for window place
    ``i`` where ``j = i + o``: only ``texts.shape[1] - m + 1`` diagonals are
    filled, for all candidates at once, row by row of the windows.  ``first``
    and ``last`` bound each candidate's places ``j`` within its text; starts and
    ends are places too.
    """
    n, m = windows.shape
    width, far = texts.shape[1] - m + 1, 2 * texts.shape[1] + 1
    offset = np.arange(width)
    a, b = first[:, None], last[:, None]
    cost = np.where((offset >= a) & (offset <= b), 0, far)
    begin = np.broadcast_to(offset, (n, width)).copy()
    for i in range(m):
        match = cost + (texts[:, i : i + width] != windows[:, i, None])
        match[(offset + i < a) | (offset + i >= b)] = far
        drop = np.full((n, width), far)  # a window character without a text character
        drop[:, :-1] = cost[:, 1:] + 1
        shifted = begin.copy()
        shifted[:, :-1] = begin[:, 1:]
        start = np.where(match <= drop, begin, shifted)
        new = np.minimum(match, drop)
        new[(offset + i + 1 < a) | (offset + i + 1 > b)] = far
        spread = new - offset  # then text characters without a window character
        best = np.minimum.accumulate(spread, axis=1)
        source = np.maximum.accumulate(np.where(spread == best, offset, 0), axis=1)
        cost, begin = np.minimum(best + offset, far), np.take_along_axis(start, source, axis=1)
        cost[(offset + i + 1 < a) | (offset + i + 1 > b)] = far
    end = cost.argmin(1)
    row = np.arange(n)
    return cost[row, end], begin[row, end], m + end


@dataclass
class Index:
    items: list
    windows: list[np.ndarray]
    item_of: np.ndarray
    start_of: np.ndarray
    need: np.ndarray
    edits: np.ndarray
    keys: np.ndarray  # sorted distinct q-grams, with their places in CSR form
    first: np.ndarray
    window_of: np.ndarray
    place_of: np.ndarray
    maybe: np.ndarray
    short: dict[int, dict[int, list[int]]]  # windows of items shorter than LEAST, by length and hash

    def _bands(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """(window, lowest, highest diagonal) of the bands that reach the lemma's bound."""
        places, rows = [], []
        for at in range(0, max(0, len(points) - Q + 1), CHUNK):
            h = qgrams(points[at : at + CHUNK + Q - 1])
            likely = np.flatnonzero(self.maybe[(h >> np.uint64(64 - BITS)).astype(np.int64)])
            if len(likely):
                row = np.minimum(np.searchsorted(self.keys, h[likely]), len(self.keys) - 1)
                hit = self.keys[row] == h[likely]
                places.append(likely[hit] + at)
                rows.append(row[hit])
        place, row = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (places, rows))
        if len(place) < int(self.need.min()):
            return []
        size = len(points) + 2 * WINDOW + 4
        many = self.first[row + 1] - self.first[row]
        code = count = np.empty(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []  # counts of parts, added to the rest once they are as many
        held = 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            codes, counts = (np.concatenate(x) for x in zip((code, count), *waiting, strict=True))
            codes, back = np.unique(codes, return_inverse=True)
            return codes, np.bincount(back, counts, len(codes)).astype(np.int64)

        ends = np.cumsum(many)
        at = 0
        while at < len(row):  # a part of the hits at once, as those of a text that repeats itself are many
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HITS, "right")))
            part, r = many[at:to], row[at:to]
            flat = np.repeat(self.first[r] - np.concatenate([[0], np.cumsum(part)[:-1]]), part) + np.arange(part.sum())
            window, diagonal = self.window_of[flat], np.repeat(place[at:to], part) - self.place_of[flat]
            band = (diagonal + WINDOW) // (self.edits[window] + 1)  # diagonals below 0 too
            codes, counts = np.unique(np.concatenate([window * size + band, (window * size + band - 1)[band > 0]]), return_counts=True)
            waiting.append((codes, counts))
            held += len(codes)
            if held > max(HITS, len(code)):
                (code, count), waiting, held = added(), [], 0
            at = to
        code, count = added()
        kept = []
        for c in code[count >= self.need[code // size]].tolist():
            w, b = divmod(c, size)
            k = int(self.edits[w])
            low = b * (k + 1) - WINDOW
            kept.append((w, low - k, low + 2 * (k + 1) - 1 + k))
        return kept

    def _whole(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(window, start, end, 0) of the short items that stand whole in the text."""
        found = []
        for m, held in self.short.items():
            known = np.fromiter(held, np.uint64, len(held))
            h = qgrams(points, m)
            for at in np.flatnonzero(np.isin(h, known)).tolist():
                if (at == 0 or points[at - 1] == 32) and (at + m == len(points) or points[at + m] == 32):
                    found += [(w, at, at + m, 0) for w in held[int(h[at])] if (self.windows[w] == points[at : at + m]).all()]
        return found

    def search(self, texts: Iterator[str | None]) -> list[list[tuple]]:
        """For each text its verified regions: (item_id, start, end, item_start, item_end, edits).

        Starts and ends are in code points of the text and of the normalised item.
        """
        out: list[list[tuple]] = []
        waiting: list[tuple[int, int, int, np.ndarray, int]] = []  # text, window, first place, slice, where it starts
        found: dict[int, list[tuple]] = {}
        kept: dict[int, np.ndarray] = {}

        def verify() -> None:
            by_length: dict[tuple[int, int], list[tuple]] = {}
            for c in waiting:
                by_length.setdefault((len(self.windows[c[1]]), int(self.edits[c[1]])), []).append(c)
            for (m, k), group in by_length.items():
                length = m + 4 * k + 1
                slices = np.full((len(group), length), 0xFFFFFFFF, np.uint32)
                first = np.array([c[2] for c in group])
                last = first + [len(c[3]) for c in group]
                for i, c in enumerate(group):
                    slices[i, first[i] : last[i]] = c[3]
                edits, start, end = banded_distances(np.stack([self.windows[c[1]] for c in group]), slices, first, last)
                for i in np.flatnonzero(edits <= k).tolist():
                    t, w, _, _, low = group[i]
                    found.setdefault(t, []).append((w, int(start[i]) + low, int(end[i]) + low, int(edits[i])))
            waiting.clear()

        for t, text in enumerate(texts):
            out.append([])
            if not text or not self.windows:
                continue
            points, stay = normalise(text)
            if whole := self._whole(points):
                found[t], kept[t] = whole, stay
            for w, low, high in self._bands(points) if len(self.keys) else ():
                m = len(self.windows[w])
                a, b = max(0, low), min(len(points), high + m)
                if a >= b:
                    continue
                part = points[a:b]
                same = part.tobytes().find(self.windows[w].tobytes())
                if same >= 0 and same % 4 == 0:  # an alignment without edits
                    found.setdefault(t, []).append((w, a + same // 4, a + same // 4 + m, 0))
                else:
                    waiting.append((t, w, a - low, part.copy(), low))
                kept.setdefault(t, stay)
            if len(waiting) >= 2000:
                verify()
                kept = {i: s for i, s in kept.items() if i in found}
        verify()
        for t, regions in found.items():
            out[t] = self._spans(regions, kept[t])
        return out

    def _spans(self, found: list[tuple], stay: np.ndarray) -> list[tuple]:
        """Verified windows of one item that touch in the text become one region."""
        if not found:
            return []
        back = np.flatnonzero(stay)
        out: list[list] = []
        for item, start, end, edits, w in sorted((int(self.item_of[w]), s, e, d, w) for w, s, e, d in found):
            lo, hi = int(self.start_of[w]), int(self.start_of[w]) + len(self.windows[w])
            if out and out[-1][0] == item and start <= out[-1][2]:
                last = out[-1]
                last[2], last[3], last[4], last[5] = max(last[2], end), min(last[3], lo), max(last[4], hi), max(last[5], edits)
            else:
                out.append([item, start, end, lo, hi, edits])
        return [(self.items[i], int(back[s]), int(back[e - 1]) + 1 if e > s else int(back[s]), lo, hi, d) for i, s, e, lo, hi, d in out]


def build_index(items: list[tuple[int | None, str | None]]) -> Index:
    ids, windows, item_of, start_of, limits = [], [], [], [], []
    for item_id, text in items:
        points, _ = normalise(text or "")
        if not len(points):
            continue
        for width, stride, rate in ((WINDOW, WINDOW // 2, RATE), (SHORT, STRIDE, SHORT_RATE)):
            if width == SHORT and len(points) <= SHORT:
                continue  # one window already
            last = max(0, len(points) - width)
            for start in sorted({*range(0, last, stride), last}):
                windows.append(points[start : start + width].copy())
                limits.append(budget(len(windows[-1]), rate))
                item_of.append(len(ids))
                start_of.append(start)
        ids.append(item_id)
    limits = np.array(limits, np.int64).reshape(-1, 2)
    short: dict[int, dict[int, list[int]]] = {}
    for w, points in enumerate(windows):
        if len(points) < LEAST:
            short.setdefault(len(points), {}).setdefault(int(qgrams(points, len(points))[0]), []).append(w)
    grams = [qgrams(w) if len(w) >= LEAST else np.empty(0, np.uint64) for w in windows]
    h = np.concatenate([np.empty(0, np.uint64), *grams])
    window_of = np.repeat(np.arange(len(windows)), [len(g) for g in grams])
    place_of = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in grams)])
    order = np.argsort(h, kind="stable")
    keys, first = np.unique(h[order], return_index=True)
    maybe = np.zeros(1 << BITS, bool)
    maybe[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
    need = np.where([len(w) >= LEAST for w in windows], limits[:, 1], 1 << 40) if windows else limits[:, 1]
    return Index(ids, windows, np.array(item_of), np.array(start_of), need, limits[:, 0], keys, np.append(first, len(h)), window_of[order].astype(np.int64), place_of[order].astype(np.int64), maybe, short)


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Index]:
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)  # about BLOCK_CHARS characters
        yield build_index(sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")))


_HIT = "item_id long, doc_start int, doc_end int, item_start int, item_end int, edits int"


def _searcher(docs: DataFrame, index: Index):
    scratch.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf(f"array<struct<{_HIT.replace(' ', ':').replace(',:', ',')}>>")
    def search(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("item_id", "doc_start", "doc_end", "item_start", "item_end", "edits"), h, strict=True)) for h in hits] for hits in shared.value.search(texts)])

    return search


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each region of a document that repeats a benchmark passage: doc_id, item_id, doc_start, doc_end, item_start, item_end, edits."""
    found = before = None
    for index in _blocks(benchmark, item, item_text):
        if before is not None:  # one block's index at a time in the workers
            done, _ = scratch.settle(before, "hits")
            found = done if found is None else found.unionByName(done)
        before = docs.select(F.col(key).alias("doc_id"), F.explode(_searcher(docs, index)(F.col(text))).alias("h")).select("doc_id", "h.*")
    return before if found is None else found.unionByName(before)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leaked passage."""
    last = None
    for index in _blocks(benchmark, item, item_text):
        if last is not None:  # one block's index at a time in the workers
            docs, _ = scratch.settle(docs, "clean")
        docs = last = docs.withColumn("__hits", _searcher(docs, index)(F.col(text))).where(F.size("__hits") == 0).drop("__hits")
    return docs
