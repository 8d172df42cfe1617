"""Severity of toxic text by cumulative-link ordinal regression.

One weight vector over sparse text features serves all grades; a grade above k
has probability logistic(score - threshold k), with ordered thresholds. The sum
of these probabilities is the expected severity.

``labels`` tells toxic from not. The grades between are derived from the
training sample: features much more frequent in its toxic rows are marks, and a
toxic row with more marks than the median toxic row is severe.

The model is fitted on a bounded sample, at most ``sample`` rows of either
label that have a document, taken in the order of a hash of their ids. Every document is scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from citemill.llm.batches import map_texts, text_column

SAMPLE = 2000
BUCKET_BITS = 22
PREFIXES = (4, 5, 6)
LIMIT = 0.35
CACHED_WORDS = 100_000
_WORD = re.compile(r"[^\W\d_]+")
FEATURES = StructType([
    StructField("doc_id", LongType()), StructField("toxic", IntegerType()), StructField("features", ArrayType(IntegerType()))
])


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def word_features(word: str) -> set[int]:
    """Buckets of a word: itself and its first letters, for inflected and compounded forms."""
    names = [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return {xxhash.xxh3_64_intdigest(n) >> (64 - BUCKET_BITS) for n in names}


@dataclass
class Severity:
    """Weights by bucket (those that are not zero) and the ordered thresholds; grades are 0 to their number."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    def telling(self, word: str) -> tuple[int, ...]:
        """The word's features that have a weight."""
        return tuple(f for f in word_features(word) if f in self.weights)

    def score(self, features: set[int]) -> float:
        # In order, as sums of floats depend on it.
        return sum(self.weights[f] for f in sorted(features))

    def expected(self, score: float) -> float:
        return float(sum(1 / (1 + np.exp(np.clip(t - score, -500, 500))) for t in self.thresholds))

    def grade(self, score: float) -> int:
        """The number of thresholds passed: with equal spreads, the grade whose higher grades are less likely than not."""
        return sum(score >= t for t in self.thresholds)


def _training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, toxic, text) of the sample, at most 2 * ``sample`` rows where ``docs`` does not repeat ids. Labels without
    a document take no place in it."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", "toxic").join(
        docs.select("doc_id"), "doc_id", "left_semi"
    )
    ids = [
        known.where(F.col("toxic") == x).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        .withColumn("toxic", F.lit(x)) for x in (0, 1)
    ]
    chosen = ids[0].unionByName(ids[1])
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = 400, support: float = 1.0, mark_odds: float = 20.0
) -> Severity:
    """The model of the sample. A feature needs the pull of about ``support`` misjudged rows to get a weight. Without
    rows of both labels it has no thresholds and finds nothing toxic."""

    def run(ids: list, toxic: list, texts: list) -> list:
        return [ids, [int(x) for x in toxic], [sorted({f for w in distinct_words(t) for f in word_features(w)}) for t in texts]]

    table = map_texts(_training_rows(docs, labels, sample), run, FEATURES, ["doc_id", "toxic", "text"]).toArrow()
    # The rows come in any order; sums must not depend on it.
    table = table.sort_by("doc_id").combine_chunks()
    features = table["features"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    return fit_rows(
        table["toxic"].to_numpy(), features.flatten().to_numpy(), pc.list_value_length(features).to_numpy(), rounds,
        support / max(1, table.num_rows), mark_odds,
    )


def fit_rows(
    toxic: np.ndarray, features: np.ndarray, sizes: np.ndarray, rounds: int, l1: float, mark_odds: float
) -> Severity:
    """The model of rows given by their labels, their distinct features end to end and the number of each row's.

    Weights are not negative: words are evidence for toxicity or none, so a text without such words stays below the
    first threshold however long it is. They are found by proximal steps on the likelihood with an L1 penalty.
    """
    if not (toxic == 1).any() or not (toxic == 0).any():
        return Severity()
    used, column = np.unique(features, return_inverse=True)
    column, row = column.astype(np.int32), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    in_toxic = np.bincount(column, weights=toxic[row], minlength=len(used))
    in_all = np.bincount(column, minlength=len(used))
    n_toxic = int(toxic.sum())
    rate = (in_toxic + 0.5) / (n_toxic + 1), (in_all - in_toxic + 0.5) / (len(toxic) - n_toxic + 1)
    marks = (rate[0] >= mark_odds * rate[1]) & (in_toxic >= 3)
    marked = np.bincount(row[marks[column]], minlength=len(toxic))
    grades = np.where(toxic == 0, 0, np.where(marked > np.median(marked[toxic == 1]), 2, 1))

    # A feature is there or not; those of one row alone are left out.
    often = in_all[column] >= 2
    row, column = row[often], column[often]
    top = int(grades.max())
    weights = np.zeros(len(used))
    thresholds = np.arange(top) * 2.0 + 2.0
    slope, bend = np.full(len(used), 1e-8), np.full(top, 1e-8)
    for _ in range(rounds):
        score = np.bincount(row, weights=weights[column], minlength=len(toxic))
        # Distribution function at the upper and lower border of each row's grade.
        borders = np.concatenate(([-np.inf], thresholds, [np.inf]))
        upper, lower = (1 / (1 + np.exp(np.clip(score - borders[grades + k], -500, 500))) for k in (1, 0))
        mass = np.maximum(upper - lower, 1e-12)
        pull = (upper + lower - 1) / len(toxic)  # of the log-likelihood along the score
        gradient = np.bincount(column, weights=pull[row], minlength=len(used))
        along = np.array([
            (upper * (1 - upper) / mass)[grades == k].sum() - (lower * (1 - lower) / mass)[grades == k + 1].sum()
            for k in range(top)
        ]) / len(toxic)
        slope += gradient**2
        bend += along**2
        step = 0.5 / np.sqrt(slope)
        weights = np.maximum(weights + step * (gradient - l1), 0)
        thresholds = np.maximum.accumulate(thresholds + 0.5 * along / np.sqrt(bend) + np.arange(top) * 1e-9)
    kept = np.flatnonzero(weights)
    return Severity({int(used[i]): float(weights[i]) for i in kept}, tuple(map(float, thresholds)))


def severity(model: Severity, docs: DataFrame, text: str = "text") -> Column:
    """A struct of expected_severity (0 to the highest grade) and grade. A null text or one without words has 0 and 0."""
    kind = StructType([StructField("expected_severity", DoubleType()), StructField("grade", IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict[str, tuple[int, ...]] = {}

    def run(texts: list) -> list:
        model, out = shared.value, []
        for t in texts:
            found = distinct_words(t)
            if len(cache) > CACHED_WORDS:
                cache.clear()
            for w in found.difference(cache):
                cache[w] = model.telling(w)
            score = model.score({f for fs in map(cache.__getitem__, found) if fs for f in fs})
            out.append(
                {"expected_severity": model.expected(score), "grade": model.grade(score)} if found
                else {"expected_severity": 0.0, "grade": 0}
            )
        return out

    return text_column(run, kind, F.col(text))


def toxic_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: float = LIMIT) -> DataFrame:
    """(doc_id, expected_severity, grade, kept) for each row of ``docs``; documents with an expected severity of ``limit``
    or more are not kept. Needs doc_id and text of ``docs``, doc_id and toxic of ``labels``; other columns are not read."""
    model = fit(docs, labels, sample)
    return docs.select("doc_id", severity(model, docs).alias("s")).select(
        "doc_id", "s.*", (F.col("s.expected_severity") < limit).alias("kept")
    )
