"""Similarity over several features, with learned weights and link rules; text encoders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.functions import vectors as V

#: Weights of rule features (fixed values).
MUST_LINK, MUST_NOT_LINK = 5000.0, -20000.0
#: Weight and bias of a feature that nothing was learned for (fixed values).
DEFAULT_WEIGHT, DEFAULT_BIAS = 1.0, 1e-4
#: English words that carry no topic: a short general list.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the to was were will with".split()


@dataclass(frozen=True)
class FeatureSpec:
    """One feature: its column, how two values compare, and how a cluster's values are averaged.

    ``calc``: ``dot``, ``cosine``, ``l2`` (squared distance), ``l2_gt_one`` (1 where the
    squared distance is above 1) or ``no_match`` (1 where both are known and
    differ).  ``centroid``: ``none``, ``l2`` or ``binary``.
    """

    name: str
    calc: str = "dot"
    dense: bool = True
    centroid: str = "l2"

    def __post_init__(self) -> None:
        if self.calc not in ("dot", "cosine", "l2", "l2_gt_one", "no_match"):
            raise ValueError(f"unknown comparison {self.calc!r}")

    def compare(self, left: Column, right: Column) -> Column:
        if self.calc == "no_match":
            return no_match(left, right)
        if self.dense:
            left, right = V.wide(left), V.wide(right)
            if self.calc == "dot":
                return V.dot(left, right)
            if self.calc == "cosine":
                return V.cosine(left, right)
            distance = V.squared_distance(left, right)
        else:
            if self.calc == "dot":
                return V.sparse_dot(left, right)
            if self.calc == "cosine":
                lengths = V.sparse_norm(left) * V.sparse_norm(right)
                return F.when(lengths > 0, V.sparse_dot(left, right) / lengths).otherwise(F.lit(0.0))
            distance = V.sparse_squared_distance(left, right)
        return (distance > 1).cast("double") if self.calc == "l2_gt_one" else distance


def no_match(left: Column, right: Column) -> Column:
    return F.coalesce((left != right).cast("double"), F.lit(0.0))


@dataclass
class FeatureWeights:
    """Learned (weight, bias) by feature, and rules: feature -> must or must-not weight."""

    learned: dict[str, tuple[float, float]] = field(default_factory=dict)
    rules: dict[str, float] = field(default_factory=dict)

    def of(self, name: str) -> tuple[float, float | None]:
        if name in self.rules:
            return self.rules[name], None
        return self.learned.get(name, (DEFAULT_WEIGHT, DEFAULT_BIAS))


def similarity(specs: list[FeatureSpec], left: dict[str, Column], right: dict[str, Column], weights: FeatureWeights | None = None) -> Column:
    """Sum over the features of weight * comparison + bias; without weights the plain sum."""
    parts = []
    for s in specs:
        value = s.compare(left[s.name], right[s.name])
        if weights is not None:
            w, b = weights.of(s.name)
            value = value * F.lit(w) if b is None else value * F.lit(w) + F.lit(b)
        parts.append(value)
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def distance_from_similarity(s: Column, least: Column) -> Column:
    """Distance of a pair, where ``least`` is the least similarity of all pairs."""
    return 1 / (1 + F.greatest(s, least) - F.least(F.lit(0.0), least))


def similarity_from_distance(d: Column, least: Column) -> Column:
    """The inverse, for thresholds."""
    return 1 / d - 1 + F.least(F.lit(0.0), least)


def distance_below_largest(s: Column, largest: Column) -> Column:
    return largest - s


@dataclass(frozen=True)
class Encoder:
    """A feature of records: its specification, and how a record's columns give its value."""

    spec: FeatureSpec
    value: Column


def encode(records: DataFrame, encoders: list[Encoder], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of the records, and one column for each feature."""
    return records.select(*keep, *[e.value.alias(e.spec.name) for e in encoders])


def initial_weights(specs: list[FeatureSpec], must_link: set[str] = frozenset(), must_not_link: set[str] = frozenset()) -> FeatureWeights:
    """Weights before learning: features that are named as rules have the rule's weight, all others weight 1 and a small bias."""
    rules = {s.name: MUST_LINK if s.name in must_link else MUST_NOT_LINK for s in specs if s.name in must_link or s.name in must_not_link}
    return FeatureWeights({s.name: (DEFAULT_WEIGHT, DEFAULT_BIAS) for s in specs if s.name not in rules}, rules)


# text encoders


def words(text: Column) -> Column:
    """Lower-case words without punctuation and stop words."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[/.\-']", " $0 ")
    parts = F.split(F.regexp_replace(spaced, r"[^\p{L}\p{N}\s]+", " "), r"\s+")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(parts, lambda w: (w != "") & ~F.array_contains(stop, w))


def md5_hash(text: Column) -> Column:
    """The first 31 bits of MD5, for hashes that other engines can repeat."""
    return F.shiftright(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), 1).cast("int")


def hashed_counts(tokens: Column, size: int = 1 << 20, hashed: Callable[[Column], Column] = F.hash) -> Column:
    """Bag of tokens as map from hash bucket to count, by sorting the buckets."""
    buckets = F.array_sort(F.transform(tokens, lambda w: F.pmod(hashed(w), F.lit(size))))

    def counted(s: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return V.let(firsts, lambda f: F.map_from_entries(F.transform(f, lambda i, j: F.struct(F.get(s, i), (F.coalesce(F.get(f, j + 1), F.size(s)) - i).cast("double")))))

    return F.when(F.size(tokens) > 0, V.let(buckets, counted)).otherwise(F.create_map().cast("map<int,double>"))


def single_bucket(tokens: Column, size: int = 1 << 20, hashed: Callable[[Column], Column] = F.hash) -> Column:
    """One hash bucket for the whole token list; -1 for none."""
    return F.when(F.size(tokens) == 0, F.lit(-1)).otherwise(F.pmod(hashed(F.concat_ws(" ", tokens)), F.lit(size)))


def count_vectorizer(tokens_col: str, out_col: str, vocabulary: int = 1 << 16, idf: bool = True):
    """A Pipeline that learns a vocabulary, and with ``idf`` its weights."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, CountVectorizer

    counts = CountVectorizer(inputCol=tokens_col, outputCol=out_col if not idf else out_col + "_counts", vocabSize=vocabulary)
    return Pipeline(stages=[counts] + ([IDF(inputCol=out_col + "_counts", outputCol=out_col)] if idf else []))


def hashing_features(tokens_col: str, out_col: str, size: int = 1 << 20, normalise: bool = False):
    """A Pipeline of unsigned hashed counts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, Normalizer

    counts = HashingTF(inputCol=tokens_col, outputCol=out_col if not normalise else out_col + "_counts", numFeatures=size)
    return Pipeline(stages=[counts] + ([Normalizer(inputCol=out_col + "_counts", outputCol=out_col)] if normalise else []))


def embedding(model, dim_type: str = "array<double>"):
    """A Column function of a text model: ``model(texts)`` gives one row for each text; rows are scaled to length 1 (0 stays 0)."""

    @F.pandas_udf(dim_type)
    def run(texts: pd.Series) -> pd.Series:
        rows = np.asarray(model(texts.fillna("").tolist()), float)
        length = np.sqrt((rows * rows).sum(1, keepdims=True))
        return pd.Series(list(rows / np.where(length > 0, length, 1.0)))

    return run


def clean_label(label: Column) -> Column:
    """A label fit for a quoted DOT string."""
    return F.regexp_replace(F.coalesce(label, F.lit("None")), r"[^\w .:-]", "_")


def random_name() -> Column:
    """A name that no other node has."""
    return F.expr("uuid()")


def node_name(seq: Column) -> Column:
    """A deterministic name of the ``seq``-th node."""
    return F.md5(F.concat(F.lit("node-"), seq.cast("string")))
