"""Text categories by ranks of character n-grams (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidValueError
from ..functions import text


def ngrams(sample: str, longest: int, pattern: str = text.WORD) -> Counter:
    """Counts of all n-grams of up to ``longest`` characters of the words, each between bars."""
    out: Counter = Counter()
    for word in text.words_of(sample, pattern):
        w = f"|{word}|"
        for i in range(len(w)):
            for n in range(1, min(longest, len(w) - i) + 1):
                out[w[i : i + n]] += 1
    return out


def profile(sample: str, longest: int = 5, most: int = 400, pattern: str = text.WORD) -> list[str]:
    """The most frequent n-grams, ties by bytes."""
    counts = ngrams(sample, longest, pattern)
    return sorted(counts, key=lambda g: (-counts[g], g.encode()))[:most]


def distance(sample: list[str], target: list[str], sample_most: int, target_most: int) -> int:
    """How far ranks differ: missing n-grams, and ranks that the sample leaves empty, cost the limit."""
    n = min(sample_most, target_most)
    rank = {g: i for i, g in enumerate(target[:n])}
    own = sample[:n]
    return (n - len(own)) * n + sum(abs(rank[g] - i) if g in rank else n for i, g in enumerate(own))


@dataclass
class Categoriser:
    """Profiles by label, and when the best ones count as an answer."""

    profiles: dict[str, list[str]] = field(default_factory=dict)
    accuracy_threshold: float = 1.03
    max_ngram_length: int = 5
    max_ngrams: int = 400
    max_candidates: int = 3
    pattern: str = text.WORD  # how texts are cut into words; not part of the configuration

    def __post_init__(self):
        if not 1 <= self.max_ngram_length <= 100 or not 1 <= self.max_ngrams <= 65536:
            raise InvalidValueError("n-gram limits are 100 characters and 65536 n-grams")

    def add(self, label: str, sample: str) -> None:
        self.profiles[label] = profile(sample, self.max_ngram_length, self.max_ngrams, self.pattern)

    def categorise(self, sample: str) -> list[str]:
        """Labels near the best distance; none if too many are."""
        own = profile(sample, self.max_ngram_length, self.max_ngrams, self.pattern)
        found = sorted((distance(own, p, self.max_ngrams, self.max_ngrams), label) for label, p in self.profiles.items())
        near = [label for d, label in found if d <= found[0][0] * self.accuracy_threshold] if found else []
        return near if len(near) <= self.max_candidates else []

    def column(self, column: Column) -> Column:
        """``categorise`` for a column of texts."""
        model = self

        @F.pandas_udf("array<string>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield part.map(lambda t: None if t is None else model.categorise(t))

        return run(column)

    def to_json(self) -> dict:
        return {
            "type": "ngram_rank", "accuracy_threshold": self.accuracy_threshold, "max_ngram_length": self.max_ngram_length, "max_ngrams": self.max_ngrams,
            "max_candidates": self.max_candidates, "profiles": {k: self.profiles[k] for k in sorted(self.profiles)},
        }

    @staticmethod
    def of(config: dict) -> Categoriser:
        config = dict(config)
        if config.pop("type", "ngram_rank") != "ngram_rank":
            raise InvalidValueError("the only kind of categoriser is ngram_rank")
        return Categoriser(**config)


def ngram_rows(docs: DataFrame, label: str, column: str, longest: int = 5, pattern: str = text.WORD) -> DataFrame:
    """``(label, ngram, n)``: counts over all texts of a label, pre-aggregated by word."""
    words = docs.select(F.col(label).alias("label"), F.explode(text.words(F.col(column), pattern)).alias("w"))
    words = words.groupBy("label", "w").agg(F.count("*").alias("n")).withColumn("b", F.concat(F.lit("|"), "w", F.lit("|")))
    starts = words.select("label", "n", "b", F.explode(F.expr("sequence(1, length(b))")).alias("i"))
    grams = starts.select("label", "n", F.explode(F.expr(f"transform(sequence(1, least({longest}, length(b) - i + 1)), k -> substring(b, i, k))")).alias("ngram"))
    return grams.groupBy("label", "ngram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, label: str, column: str, longest: int = 5, most: int = 400, pattern: str = text.WORD) -> DataFrame:
    """``(label, ngram, n, rank)``: each label's profile as a table; ranks start at 0."""
    by = Window.partitionBy("label").orderBy(F.desc("n"), F.asc("ngram"))
    counts = ngram_rows(docs, label, column, longest, pattern)
    # The limit stands on row_number itself, so that each task keeps only the first rows of its part of a label.
    first = counts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    return first.withColumn("rank", (F.col("rank") - 1).cast("int"))


def distances(samples: DataFrame, targets: DataFrame, most: int = 400) -> DataFrame:
    """``(label, target, distance)`` between profiles as tables; targets is a model (labels x most rows),
    whose labels the driver knows."""
    of = targets.select(F.col("label").alias("target"), F.col("ngram").alias("g"), F.col("rank").alias("r"))
    labels = sorted(r["label"] for r in targets.select("label").distinct().collect())
    pairs = samples.withColumn("target", F.explode(F.array(*map(F.lit, labels)).cast("array<string>")))
    joined = pairs.join(of, (pairs.ngram == of.g) & (pairs.target == of.target), "left").select(
        pairs.label, pairs.target, F.coalesce(F.abs(pairs["rank"] - F.col("r")), F.lit(most)).alias("cost")
    )
    out = joined.groupBy("label", "target").agg(F.sum("cost").alias("cost"), F.count("*").alias("k"))
    return out.select("label", "target", (F.col("cost") + (most - F.col("k")) * most).cast("long").alias("distance"))


def trained(docs: DataFrame, label: str, column: str, **options) -> Categoriser:
    """A categoriser of the labels' texts; the driver gets labels x max_ngrams rows."""
    model = Categoriser(**options)
    rows = profiles(docs, label, column, model.max_ngram_length, model.max_ngrams, model.pattern).orderBy("label", "rank").collect()
    for r in rows:
        model.profiles.setdefault(r["label"], []).append(r["ngram"])
    return model
