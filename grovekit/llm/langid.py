"""Language identification.

Sparse multinomial logistic regression on TF-IDF weighted character n-grams,
trained with follow-the-regularised-leader (FTRL-proximal) under elastic-net
penalties, then calibrated with one temperature.

* Document frequencies are counted over every training document.
* The weights are fitted on a bounded sample of labelled rows: about
  ``per_language`` rows of each language (default 500), taken by a hash of
  (doc_id, text), so the same rows are taken on every run.  A fifth of them is
  kept from the learner and fits the temperature.
* A prediction reads the text alone.
* ``accept`` keeps the texts that the model can tell: the calibrated score has
  to be at least 0.5, so that the language is likelier than all others together,
  and at least half of the n-grams have to occur in labelled texts, as the score
  alone says little of letters that no labelled text has.

Defined results: a null text or one without a letter is ``und`` with score 0;
rows with a null ``lang`` are never learned from; repeated rows are predicted
alike; without any labelled row every text is ``und``; other columns of the
input are ignored.  Texts are read whole, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.llm import scratch

BITS = 15
DIM = 1 << BITS
ORDERS = (1, 2, 3)
BLOCK = 1 << 18  # code points hashed at once
_ALPHA: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """For each code point: whether it is a letter, and its lower case."""
    if not _ALPHA:
        alpha, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                alpha[i] = True
                low = c.lower()
                if low != c and len(low) == 1:
                    lower[i] = ord(low)
        _ALPHA.extend([alpha, lower])
    return _ALPHA


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of the whole text: (bucket, count), or None without letters.

    Runs of other characters count as one space.
    """
    if not text:
        return None
    alpha, lower = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(DIM, np.int64)
    seen, tail = False, np.array([32], np.uint32)
    for at in range(0, len(points), BLOCK):
        block = points[at : at + BLOCK]
        is_letter = alpha[block]
        seen = seen or bool(is_letter.any())
        block = np.where(is_letter, lower[block], np.uint32(32))
        joined = np.concatenate([tail, block])
        space = joined == 32
        keep = np.ones(len(joined), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        keep[: len(tail)] = True
        joined = joined[keep]
        have = len(tail)
        for n in ORDERS:
            first = max(0, have - n + 1)  # n-grams that end in the new block
            part = joined[first:]
            if len(part) < n:
                continue
            code = np.full(len(part) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for j in range(n):
                code = (code ^ part[j : len(part) - n + 1 + j]) * np.uint32(0x85EBCA6B)
                code ^= code >> np.uint32(13)
            total += np.bincount(code * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS), minlength=DIM)
        tail = joined[-(max(ORDERS) - 1) :]
    if not seen:
        return None
    index = np.flatnonzero(total)
    return index.astype(np.int32), total[index].astype(np.float32)


def _weights(index: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf[index]
    return x / max(float(np.sqrt(np.dot(x, x))), 1e-12)


@dataclass
class LanguageModel:
    """Weights ``w[DIM + 1, languages]`` (the last row is the bias), and the temperature."""

    languages: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.ones(DIM, np.float32))
    w: np.ndarray = field(default_factory=lambda: np.zeros((DIM + 1, 0), np.float32))
    temperature: float = 1.0
    seen: np.ndarray = field(default_factory=lambda: np.zeros(DIM, bool))  # buckets of the labelled texts' n-grams

    def logits(self, index: np.ndarray, count: np.ndarray) -> np.ndarray:
        return _weights(index, count, self.idf) @ self.w[index] + self.w[DIM]

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """The prediction, its score, and the share of the text's n-grams that occur in labelled texts."""
        counted = ngram_counts(text) if self.languages else None
        if counted is None:
            return "und", 0.0, 0.0
        index, count = counted
        p = softmax(self.logits(index, count) / self.temperature)
        best = int(np.argmax(p))
        known = float(count[self.seen[index]].sum(dtype=float) / count.sum(dtype=float))
        return self.languages[best], float(min(1.0, max(0.0, p[best]))), known


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 4,
) -> np.ndarray:
    """FTRL-proximal with elastic net over (index, value) rows, in the given order."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def lazy(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(zs) <= l1] = 0.0
        return w

    for _ in range(epochs):
        for (index, value), y in zip(rows, labels, strict=True):
            at, x = np.append(index, DIM), np.append(value, 1.0)
            w = lazy(at)
            error = softmax(x @ w)
            error[y] -= 1.0
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return lazy(np.arange(DIM + 1)).astype(np.float32)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden section."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / math.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]))

    lo, hi, ratio = math.log(0.2), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 500) -> LanguageModel:
    """Fits a model to the rows of ``labelled`` with a non-null ``lang``."""
    scratch.small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel()

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, docs = np.zeros(DIM + 1, np.int64), 0
        for batch in batches:
            for t in batch["t"]:
                counted = ngram_counts(t)
                if counted is not None:
                    df[counted[0]] += 1
                    docs += 1
        df[DIM] = docs
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": at, "df": df[at]})

    counted = rows.select("t").mapInPandas(frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()  # DIM + 1 rows at most
    df = np.zeros(DIM + 1)
    df[counted["bucket"]] = counted["df"]
    idf = (np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1).astype(np.float32)

    # pmod(hash) < share of the language: about per_language rows of each, whatever its size
    share: Column = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("l") == name, F.lit(min(1.0, per_language / sizes[name]))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(20), F.col("k"), F.col("t")), F.lit(1 << 30))
    sample = rows.withColumn("draw", draw).where(F.col("draw") < share * float(1 << 30))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(d, name, *c) for d, name, t in zip(batch["draw"], batch["l"], batch["t"], strict=True) if (c := ngram_counts(t)) is not None]
            yield pd.DataFrame(made, columns=["draw", "l", "at", "n"])

    got = sample.select("draw", "l", "t").mapInPandas(features, "draw long, l string, at array<int>, n array<float>").toPandas()
    got["order"] = [(int(d) * 2654435761) % (1 << 30) for d in got["draw"]]
    got = got.sort_values(["order", "l"], kind="stable").reset_index(drop=True)
    labels = np.array([languages.index(x) for x in got["l"]], np.int64)
    vectors = [(np.asarray(a, np.int64), _weights(np.asarray(a, np.int64), np.asarray(n, np.float32), idf)) for a, n in zip(got["at"], got["n"], strict=True)]
    held = np.arange(len(labels)) % 5 == 4
    learn = [v for v, h in zip(vectors, held, strict=True) if not h]
    w = fit_ftrl(learn, labels[~held], len(languages))
    logits = np.array([x @ w[a] + w[DIM] for (a, x), h in zip(vectors, held, strict=True) if h])
    return LanguageModel(languages, idf, w, fit_temperature(logits, labels[held]), df[:DIM] > 0)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` appended (columns of those names are replaced)."""
    kept = docs.select([c for c in docs.columns if c not in ("lang_pred", "score")])
    return kept.withColumn("__p", _judged(docs, model, text)).select(*kept.columns, "__p.lang_pred", "__p.score")


def _judged(docs: DataFrame, model: LanguageModel, text: str) -> Column:
    """(lang_pred, score, known) of the text."""
    scratch.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, known double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.judge(t) for t in texts], columns=["lang_pred", "score", "known"])

    return judge(F.col(text))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def accept(docs: DataFrame, model: LanguageModel, min_score: float = 0.5, min_known: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in a learned language.

    ``und`` goes, and so do texts whose score is below ``min_score`` and those
    with a lesser share than ``min_known`` of n-grams that labelled texts have.
    """
    told = docs.withColumn("__p", _judged(docs, model, text))
    return told.where((F.col("__p.lang_pred") != "und") & (F.col("__p.score") >= min_score) & (F.col("__p.known") >= min_known)).select(*docs.columns)
