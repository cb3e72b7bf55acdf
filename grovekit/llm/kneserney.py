"""Language-model scoring: an interpolated modified Kneser-Ney bigram model.

Counting runs in Spark, in two passes over the training texts.

1. *Words.*  Each task hashes and counts the words of its texts and packs the
   sorted counts into one binary row for each slice of the hash range; one task
   then merges a slice and writes it as a sorted hash array.  A word's id is its
   place in these arrays.
2. *Bigrams.*  A bigram is the pair of ids, one 64-bit number without
   collisions.  Bigrams are counted in the same way, sliced by the hash of the
   left word, so that a context's statistics are local to a slice; a left word
   with more than ``SLICE`` tokens is sliced by the whole bigram instead.

Counts are added up before each shuffle, and nothing is pruned: the model grows
with the corpus.  Its files lie in the shared folder and workers memory-map
them (where that folder isn't a mounted file system, a worker copies a file to
its own disk on first use and removes it when it ends).

Tokens are the words after lower-casing A-Z, then one end mark; the first
token's context is a begin mark.  ``score`` is the sum of log10 p over tokens:

    p(w | u) = (c(uw) - D(c(uw))) / c(u) + gamma(u) * q(w)
    q(w)     = (b(w) - E(b(w))) / B + delta / (V + 1)

with b(w) the number of distinct words before w, B their sum, V the number of
distinct tokens, D and E the three discounts of each order by its counts of
counts.  An unknown word has q = delta / (V + 1), an unknown context p = q; both
distributions sum to one over the known words and one unknown.

Defined results: a null or wordless text is the end mark alone; repeated rows
count as often as they occur; without training rows the model is uniform over
one unknown word (log probability 0); other columns are ignored.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm import scratch
from grovekit.llm.hashing import mix, word_hashes

BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Tokens that a task holds before it packs their counts.
FLUSH = 2_000_000
#: Tokens of a slice, about; also where a context counts as hot.
SLICE = 1_500_000
#: Tokens scored at once.
CHUNK = 300_000
#: Discounts stay above this, so that an unknown word never has probability 0.
LEAST_DISCOUNT = 0.01


# packed counts


def sum_by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[first], *(np.add.reduceat(v[order].astype(np.int64), first) for v in values))


def _slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """Equal ranges of the hashes, in order; ``slices`` is a power of two."""
    return (keys >> np.uint64(64 - (slices - 1).bit_length())).astype(np.int64) if slices > 1 else np.zeros(len(keys), np.int64)


def _packed(kind: str, at: np.ndarray, slices: int, *arrays: np.ndarray) -> list[tuple[str, int, bytes]]:
    """One row for each slice: the arrays' parts, which are in order of ``at``."""
    cuts = np.searchsorted(at, np.arange(slices + 1))
    return [(kind, int(s), b"".join(a[cuts[s] : cuts[s + 1]].tobytes() for a in arrays)) for s in np.flatnonzero(cuts[1:] > cuts[:-1])]


def _unpacked(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    parts: list[list[np.ndarray]] = [[np.empty(0, k)] for k in kinds]
    for blob in blobs:
        n, at = len(blob) // sum(widths), 0
        for part, kind, width in zip(parts, kinds, widths, strict=True):
            part.append(np.frombuffer(blob, kind, n, at))
            at += n * width
    return [np.concatenate(p) for p in parts]


_ROW = "kind string, slice int, data binary"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "slice", "data"])


def _by_slice(rows: DataFrame, merge) -> DataFrame:
    """Runs ``merge(slice, {kind: blobs})`` for each slice, which returns rows again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, {}
        for batch in batches:
            for kind, at, data in batch.itertuples(index=False):
                if at != now:
                    if held:
                        yield _frame(merge(now, held))
                    now, held = at, {}
                held.setdefault(kind, []).append(data)
        if held:
            yield _frame(merge(now, held))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "slice").sortWithinPartitions("slice").mapInPandas(run, _ROW)


# files


def _write(uri: str, *arrays: np.ndarray) -> None:
    """Writes the arrays one after the other, under a temporary name first."""
    system, path = pafs.FileSystem.from_uri(uri)
    draft = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    system.move(draft, path)


_OPEN: dict[str, str] = {}


def _local(uri: str) -> str:
    """A path of the file that can be memory-mapped."""
    if uri not in _OPEN:
        system, path = pafs.FileSystem.from_uri(uri)
        if not isinstance(system, pafs.LocalFileSystem):
            with tempfile.NamedTemporaryFile(delete=False) as copy, system.open_input_stream(path) as stream:
                while data := stream.read(1 << 24):
                    copy.write(data)
            atexit.register(os.unlink, copy.name)
            path = copy.name
        _OPEN[uri] = path
    return _OPEN[uri]


_MAPPED: dict[tuple, list[np.ndarray]] = {}


def _map(uri: str, n: int, *kinds: str) -> list[np.ndarray]:
    """Arrays of ``n`` entries each, memory-mapped."""
    if (uri, n) not in _MAPPED:
        out, at = [], 0
        for kind in kinds:
            out.append(np.memmap(_local(uri), np.dtype(kind), "r", at, (n,)) if n else np.empty(0, kind))
            at += n * np.dtype(kind).itemsize
        _MAPPED[uri, n] = out
    return _MAPPED[uri, n]


# the model


@dataclass
class Model:
    root: str
    word_slices: int
    pair_slices: int
    words: dict[int, int] = field(default_factory=dict)  # entries of each word file
    starts: dict[int, int] = field(default_factory=dict)  # id of its first word
    pairs: dict[int, tuple[int, int]] = field(default_factory=dict)  # entries of each bigram file, and large counts
    docs: int = 0
    tokens: int = 0
    vocabulary: int = 0
    before: int = 0  # distinct bigrams
    discounts: tuple = (1.0, 1.0, 1.0)
    word_discounts: tuple = (1.0, 1.0, 1.0)
    before_counts: tuple = (0, 0, 0)  # words with b of 1, of 2, of 3 or more

    def word_file(self, s: int) -> str:
        return f"{self.root}/words-{s}.bin"

    def stats_file(self, s: int) -> str:
        return f"{self.root}/stats-{s}.bin"

    def pair_file(self, s: int) -> str:
        return f"{self.root}/pairs-{s}.bin"

    def find(self, keys: np.ndarray, stats: bool) -> list[np.ndarray]:
        """For sorted hashes: id (-1: unknown) and count, and with ``stats`` b, n1, n2, n3."""
        out = [np.full(len(keys), -1, np.int64), *(np.zeros(len(keys), np.int64) for _ in range(5 if stats else 1))]
        cuts = np.searchsorted(_slice_of(keys, self.word_slices), np.arange(self.word_slices + 1))
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            if not self.words.get(s):
                continue
            known, count = _map(self.word_file(s), self.words[s], "<u8", "<i8")
            part = keys[cuts[s] : cuts[s + 1]]
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            hit = np.flatnonzero(known[at] == part)
            to, at = hit + cuts[s], at[hit]
            out[0][to], out[1][to] = at + self.starts[s], count[at]
            if stats:
                for i, column in enumerate(_map(self.stats_file(s), self.words[s], "<u4", "<u4", "<u4", "<u4")):
                    out[2 + i][to] = column[at]
        return out

    def pair_slice(self, left: np.ndarray, right: np.ndarray, left_count: np.ndarray) -> np.ndarray:
        by = left.astype(np.uint64)
        hot = left_count > SLICE
        by = np.where(hot, (by << np.uint64(32)) | right.astype(np.uint64), by)
        return _slice_of(mix(by + np.uint64(0x9E3779B97F4A7C15)), self.pair_slices)

    def pair_counts(self, left: np.ndarray, right: np.ndarray, left_count: np.ndarray) -> np.ndarray:
        at = self.pair_slice(left, right, left_count)
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        order = np.lexsort((keys, at))
        keys, found = keys[order], np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(at[order], np.arange(self.pair_slices + 1))
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            if s not in self.pairs:
                continue
            n, large = self.pairs[s]
            known, small = _map(self.pair_file(s), n, "<u8", "u1")
            part = keys[cuts[s] : cuts[s + 1]]
            place = np.minimum(np.searchsorted(known, part), n - 1)
            hit = np.flatnonzero(known[place] == part)
            count = small[place[hit]].astype(np.int64)
            if large and (count == 255).any():
                where, full = _map(self.pair_file(s) + ".large", large, "<u4", "<i8")
                over = np.flatnonzero(count == 255)
                count[over] = full[np.searchsorted(where, place[hit][over])]
            found[hit + cuts[s]] = count
        out = np.empty(len(keys), np.int64)
        out[order] = found
        return out

    def score(self, texts: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        """(n_tokens, n_known, base_score, score) of texts given as word hashes."""
        right = np.concatenate([np.append(h, END) for h in texts])
        ends = np.cumsum([len(h) + 1 for h in texts])
        starts = np.concatenate([[0], ends[:-1]])
        left = np.concatenate([[BEGIN], right[:-1]])
        left[starts] = BEGIN
        keys, back = np.unique(np.append(right, BEGIN), return_inverse=True)
        word, count, before, n1, n2, n3 = self.find(keys, True)
        r, marker = back[:-1], back[-1]
        lft = np.concatenate([[marker], r[:-1]])
        lft[starts] = marker
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))
        e = np.array([0.0, *self.word_discounts])
        total = max(self.before, 1)
        spare = float(np.dot(self.word_discounts, self.before_counts)) / total if self.before else 1.0
        q = np.maximum(before - e[np.minimum(before, 3)], 0.0) / total + spare / (self.vocabulary + 1)
        d = np.array([0.0, *self.discounts])
        gamma = np.where(count > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(count, 1), 1.0)
        p = gamma[lft] * q[r]
        both = np.flatnonzero((word[lft] >= 0) & (word[r] >= 0))
        if len(both):
            c = self.pair_counts(word[lft[both]], word[r[both]], count[lft[both]])
            p[both] += np.maximum(c - d[np.minimum(c, 3)], 0.0) / count[lft[both]]
        sums = [np.add.reduceat(x, starts) for x in ((count[r] > 0).astype(np.int64), base[r], np.log10(p))]
        return list(zip((ends - starts).tolist(), *(s.tolist() for s in sums), strict=True))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three modified Kneser-Ney discounts from the counts of counts n1 to n4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return tuple(min(float(k), max(LEAST_DISCOUNT, x)) for k, x in zip((1, 2, 3), found, strict=True))


def _slices(tokens: float, each: int) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, tokens / each)))))


def train(docs: DataFrame, text: str = "text") -> Model:
    """Counts the model of all rows of ``docs``."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    rows = docs.select(F.col(text).cast("binary").alias("t"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("t"), F.lit(0))).alias("b")).first()
    tokens = (size["b"] or 0) / 6 + size["n"]
    root = scratch.fresh(spark, "model")
    system, path = scratch.filesystem(spark, root)
    system.mkdirs(path)
    model = Model(root if "://" in root else "file://" + root, _slices(tokens, 4 * SLICE), _slices(tokens, SLICE), docs=size["n"])
    if not size["n"]:
        return model

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, docs = [], 0, 0

        def flush() -> pd.DataFrame:
            keys, count = np.unique(np.concatenate(held), return_counts=True)
            keys, count = sum_by_key(np.append(keys, [END, BEGIN]), np.append(count, [docs, docs]))
            return _frame(_packed("word", _slice_of(keys, model.word_slices), model.word_slices, keys, count.astype("<u4")))

        for batch in batches:
            for h in word_hashes(batch["t"]):
                held.append(h)
                n, docs = n + len(h) + 1, docs + 1
                if n >= FLUSH:
                    yield flush()
                    held, n, docs = [], 0, 0
        if docs:
            yield flush()

    def merge_words(s: int, blobs: dict[str, list[bytes]]) -> list[tuple]:
        keys, count = sum_by_key(*_unpacked(blobs["word"], "<u8", "<u4"))
        _write(model.word_file(s), keys, count.astype("<i8"))
        return [("n", s, np.array([len(keys), count.sum()], "<i8").tobytes())]

    for r in _by_slice(rows.mapInPandas(words, _ROW), merge_words).collect():  # one row for each slice
        n, total = np.frombuffer(r["data"], "<i8").tolist()
        model.words[r["slice"]] = n
        model.tokens += total
    at = 0
    for s in sorted(model.words):
        model.starts[s] = at
        at += model.words[s]
    model.vocabulary, model.tokens = at - 1, model.tokens - model.docs  # without the begin mark
    if at >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    word_starts = np.array([model.starts[s] for s in sorted(model.words)], np.int64)
    word_slices = np.array(sorted(model.words), np.int64)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[np.ndarray] = []
        n = size = 0

        def take() -> None:
            right = np.concatenate([np.append(h, END) for h in texts])
            starts = np.concatenate([[0], np.cumsum([len(h) + 1 for h in texts])[:-1]])
            keys, back = np.unique(np.append(right, BEGIN), return_inverse=True)
            word, count = model.find(keys, False)
            r, marker = back[:-1], back[-1]
            left = np.concatenate([[marker], r[:-1]])
            left[starts] = marker
            pair = (word[left].astype(np.uint64) << np.uint64(32)) | word[r].astype(np.uint64)
            pair, first, many = np.unique(pair, return_index=True, return_counts=True)
            held.append((pair, model.pair_slice(word[left[first]], word[r[first]], count[left[first]]), many))

        def flush() -> pd.DataFrame:
            pair, at, many = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((pair, at))
            pair, at, many = pair[order], at[order], many[order]
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            many = np.add.reduceat(many, first)
            return _frame(_packed("pair", at[first], model.pair_slices, pair[first], many.astype("<u4")))

        for batch in batches:
            for h in word_hashes(batch["t"]):
                texts.append(h)
                n, size = n + len(h) + 1, size + len(h) + 1
                if n >= CHUNK:
                    take()
                    texts, n = [], 0
                if size >= FLUSH:
                    if texts:
                        take()
                    texts, n = [], 0
                    yield flush()
                    held, size = [], 0
        if texts:
            take()
        if held:
            yield flush()

    def merge_pairs(s: int, blobs: dict[str, list[bytes]]) -> list[tuple]:
        keys, count = sum_by_key(*_unpacked(blobs["pair"], "<u8", "<u4"))
        large = np.flatnonzero(count >= 255)
        if len(large):
            _write(model.pair_file(s) + ".large", large.astype("<u4"), count[large].astype("<i8"))
        _write(model.pair_file(s), keys, np.minimum(count, 255).astype("u1"))
        left, n1, n2, n3 = sum_by_key((keys >> np.uint64(32)).astype(np.int64), count == 1, count == 2, count >= 3)
        right, before = np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
        to = lambda ids: word_slices[np.searchsorted(word_starts, ids, "right") - 1]
        out = _packed("left", to(left), model.word_slices, left.astype("<u4"), *(x.astype("<u4") for x in (n1, n2, n3)))
        out += _packed("right", to(right), model.word_slices, right.astype("<u4"), before.astype("<u4"))
        told = [s, len(keys), len(large), *(int((count == k).sum()) for k in (1, 2, 3, 4))]
        return [*out, ("pairs", -1, np.array(told, "<i8").tobytes())]

    def merge_stats(s: int, blobs: dict[str, list[bytes]]) -> list[tuple]:
        if s < 0:
            return [("pairs", s, b) for b in blobs["pairs"]]
        n, start = model.words[s], model.starts[s]
        table = np.zeros((4, n), np.int64)
        right, before = _unpacked(blobs.get("right", []), "<u4", "<u4")
        np.add.at(table[0], right.astype(np.int64) - start, before.astype(np.int64))
        left, *counts = _unpacked(blobs.get("left", []), "<u4", "<u4", "<u4", "<u4")
        for i, c in enumerate(counts):
            np.add.at(table[1 + i], left.astype(np.int64) - start, c.astype(np.int64))
        _write(model.stats_file(s), *table.astype("<u4"))
        told = [table[0].sum(), *((table[0] == k).sum() for k in (1, 2, 3, 4)), (table[0] >= 3).sum()]
        return [("words", s, np.array(told, "<i8").tobytes())]

    told = _by_slice(_by_slice(rows.mapInPandas(pairs, _ROW), merge_pairs), merge_stats).collect()  # a row for each slice
    of_pairs, of_words = [0] * 4, [0] * 6
    for r in told:
        found = np.frombuffer(r["data"], "<i8").tolist()
        if r["kind"] == "pairs":
            model.pairs[found[0]] = (found[1], found[2])
            of_pairs = [a + b for a, b in zip(of_pairs, found[3:], strict=True)]
        else:
            of_words = [a + b for a, b in zip(of_words, found, strict=True)]
    model.before = of_words[0]
    model.discounts, model.word_discounts = discounts(of_pairs), discounts(of_words[1:5])
    model.before_counts = (of_words[1], of_words[2], of_words[5])
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs``' columns but the text, with n_tokens, n_known, train_tokens, base_score and score."""
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    own = [c for c in docs.columns if c not in (*added, text)]
    scratch.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # sizes of files and totals only

    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        out, group, n = [], [], 0
        for h in word_hashes(texts):
            group.append(h)
            n += len(h) + 1
            if n >= CHUNK:
                out += shared.value.score(group)
                group, n = [], 0
        if group:
            out += shared.value.score(group)
        return pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "score"])

    scored = docs.withColumn("__s", run(F.col(text).cast("binary")))
    return scored.select(*own, "__s.n_tokens", "__s.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "__s.base_score", "__s.score")
