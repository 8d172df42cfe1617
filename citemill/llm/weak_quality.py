"""Text quality from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Their votes
overlap; expectation-maximisation estimates how often each is right, without
any given label, from the number of documents with each combination of votes,
counted over the whole corpus. The posterior of a combination labels its
documents, and these labels train a hashed linear scorer that also judges where
the labellers say little.

Counts cover all documents (at most 3 ** labellers combinations reach the
driver). The scorer is fitted on a bounded sample, at most ``sample`` documents
in the order of a hash of their ids; every document is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from operator import eq

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from citemill.llm.batches import map_texts, text_column

SAMPLE = 4000
BUCKET_BITS = 14
CACHED_WORDS = 100_000
GOOD, BAD, NONE = 1, 0, -1


class Measures:
    """What the labellers look at, of one text."""

    def __init__(self, text: str):
        self.text, self.words = text, text.split()
        words = self.words
        self.n = n = max(1, len(words))
        self.symbols = sum(map(text.count, "#*$%&|<>{}\\^~")) / max(1, len(text))
        self.upper = sum(map(str.isupper, words)) / n
        self.marks = (text.count("!!") + text.count("??")) / n
        self.same = sum(map(eq, words, words[1:])) / n
        self.distinct = len(set(words)) / n
        self.ends = sum(map(text.count, (". ", ", ", ".\n", ",\n", "? ", "! "))) / n
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        self.repeated_lines = 1 - len(set(lines)) / max(1, len(lines))
        self.lines = len(lines)


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


def _prose(m: Measures) -> bool:
    return 0.04 < m.ends < 0.4 and m.upper < 0.1 and m.same < 0.05 and m.symbols < 0.005


# Most know one fault and say nothing of other texts; what one of them does not see is no sign of quality.
LABELLERS: tuple[Callable[[Measures], int], ...] = (
    lambda m: _vote(m.symbols > 0.02, False),
    lambda m: _vote(m.text.count("|") > 0.1 * m.n, False),
    lambda m: _vote(m.upper > 0.3, False),
    lambda m: _vote(m.marks > 0.05, False),
    lambda m: _vote(m.same > 0.2, False),
    lambda m: _vote(m.n >= 50 and m.distinct < 0.3, False),
    lambda m: _vote(m.lines >= 4 and m.repeated_lines > 0.3, False),
    lambda m: _vote(m.n >= 50 and m.ends < 0.02, _prose(m)),
)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each combination of ``votes`` (combinations, labellers), the chances (class, labeller, vote)
    and the share of good, by expectation-maximisation from the majority of the votes."""
    good, bad = (votes == GOOD).sum(1), (votes == BAD).sum(1)
    # A vote for bad is rarer and tells more, so it outweighs one for good.
    posterior = (good + 1) / (good + 2 * bad + 2)
    chances, share = np.zeros((2, votes.shape[1], 3)), 0.5
    for _ in range(rounds):
        for y, weight in ((1, posterior), (0, 1 - posterior)):
            for v in (NONE, BAD, GOOD):
                chances[y, :, v + 1] = ((votes == v) * (weight * counts)[:, None]).sum(0) + 0.1
            chances[y] /= chances[y].sum(1, keepdims=True)
        share = float(np.clip((posterior * counts).sum() / counts.sum(), 1e-6, 1 - 1e-6))
        place = np.arange(votes.shape[1])
        logs = [np.log(chances[y][place, votes + 1]).sum(1) + np.log(p) for y, p in ((0, 1 - share), (1, share))]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - posterior).max() < 1e-10:
            posterior = new
            break
        posterior = new
    return posterior, chances, share


_LETTERS = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a"), (re.compile(r"\d+"), lambda m: "9"))


def shape(word: str) -> int:
    """Bucket of a word's form: letters, capitals and digits as signs, the rest as it is."""
    for pattern, sign in _LETTERS:
        word = pattern.sub(sign, word)
    return xxhash.xxh3_64_intdigest(word[:16]) >> (64 - BUCKET_BITS)


class Features:
    """Hashed features of a text: shares of the forms of its words, and three shares of repetition."""

    EXTRA = 3

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, m: Measures) -> tuple[list[int], list[float]]:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        for w in set(m.words).difference(self.known):
            self.known[w] = shape(w)
        forms = Counter(map(self.known.__getitem__, m.words))
        base = 1 << BUCKET_BITS
        # In order, as sums of floats depend on it.
        places = sorted(forms)
        return (
            [*places, base, base + 1, base + 2],
            [*(forms[p] / m.n for p in places), m.same, max(0.0, 0.5 - m.distinct) if m.n >= 50 else 0.0, m.repeated_lines],
        )


def _train(rows: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, rounds: int = 300, l2: float = 1e-4) -> np.ndarray:
    """Weights and bias of logistic regression on soft labels, by adaptive gradient steps."""
    size = (1 << BUCKET_BITS) + Features.EXTRA
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column, value = np.concatenate(rows), np.concatenate(values)
    weights, slope = np.zeros(size + 1), np.full(size + 1, 1e-8)
    for _ in range(rounds):
        score = np.bincount(owner, weights=weights[column] * value, minlength=len(rows)) + weights[-1]
        pull = (target - 1 / (1 + np.exp(-np.clip(score, -500, 500)))) / len(rows)
        gradient = np.append(np.bincount(column, weights=pull[owner] * value, minlength=size), pull.sum())
        gradient[:-1] -= l2 * weights[:-1] / len(rows)
        slope += gradient**2
        weights += 0.5 * gradient / np.sqrt(slope)
    return weights


def quality(docs: DataFrame, sample: int = SAMPLE, limit: float = 0.5) -> DataFrame:
    """(doc_id, votes, posterior, score, kept) for each row of ``docs`` (doc_id, text; other columns are not read).

    ``posterior`` is the chance of good by the labellers' votes, ``score`` that of the linear scorer; a document is kept
    with a score of ``limit`` or more. A null text or one without words has no votes, posterior and score 0 and is not kept.
    """
    votes_kind = ArrayType(IntegerType())

    def vote(texts: list) -> list:
        out = []
        for t in texts:
            m = Measures(t) if t and not t.isspace() else None
            out.append([f(m) for f in LABELLERS] if m else None)
        return out

    counted = docs.select(text_column(vote, votes_kind, "text").alias("votes")).where("votes IS NOT NULL").groupBy("votes").count().collect()
    combinations = sorted((tuple(r[0]), r[1]) for r in counted)
    if combinations:
        table = np.array([v for v, _ in combinations])
        posterior, _, _ = estimate(table, np.array([n for _, n in combinations], dtype=np.float64))
        by_votes = {v: float(p) for (v, _), p in zip(combinations, posterior)}
    else:
        by_votes = {}

    kind = StructType([
        StructField("doc_id", LongType()), StructField("posterior", DoubleType()), StructField("places", ArrayType(IntegerType())),
        StructField("values", ArrayType(DoubleType())),
    ])

    def featured(ids: list, texts: list) -> list:
        features, out = Features(), [[], [], [], []]
        for i, t in zip(ids, texts):
            if t and not t.isspace():
                m = Measures(t)
                places, values = features(m)
                for column, x in zip(out, (i, by_votes[tuple(f(m) for f in LABELLERS)], places, values)):
                    column.append(x)
        return out

    chosen = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = map_texts(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), featured, kind, ["doc_id", "text"]).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("posterior", "ascending")])
    if rows.num_rows:
        weights = _train(
            [np.array(p) for p in rows["places"].to_pylist()], [np.array(v) for v in rows["values"].to_pylist()],
            rows["posterior"].to_numpy(),
        )
    else:
        weights = np.zeros((1 << BUCKET_BITS) + Features.EXTRA + 1)
    shared = docs.sparkSession.sparkContext.broadcast((by_votes, weights))
    result = StructType([StructField("votes", votes_kind), StructField("posterior", DoubleType()), StructField("score", DoubleType())])
    features = Features()

    def judge(texts: list) -> list:
        by_votes, weights = shared.value
        out = []
        for t in texts:
            if not t or t.isspace():
                out.append({"votes": None, "posterior": 0.0, "score": 0.0})
                continue
            m = Measures(t)
            votes = [f(m) for f in LABELLERS]
            places, values = features(m)
            score = float(weights[places] @ np.array(values) + weights[-1])
            out.append({
                "votes": votes, "posterior": by_votes.get(tuple(votes), 0.0), "score": float(1 / (1 + np.exp(-np.clip(score, -500, 500)))),
            })
        return out

    return docs.select("doc_id", text_column(judge, result, "text").alias("j")).select(
        "doc_id", "j.*", (F.col("j.score") >= limit).alias("kept")
    )
