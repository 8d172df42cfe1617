"""Second scoring of the candidates, with a threshold and a safe fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.functions.binding import let
from citemill.functions.text import keywords
from citemill.logs import get_logger
from citemill.operators.ranking import rank_per_question

Scorer = Callable[[Column, Column], Column]


# Keywords to either side of a word that are near it.
NEAR = 7


def lexical_scorer(question: Column, text: Column) -> Column:
    """Share of the question's distinct keywords that the text has, scaled to
    -4 (none) .. 4 (all). Needs no model."""
    def share(asked: Column) -> Column:
        shared = F.size(F.array_intersect(asked, keywords(text))).cast("double")
        return F.coalesce(F.try_divide(shared, F.size(asked).cast("double")), F.lit(0.0))

    return let(F.array_distinct(keywords(question)), share) * 8.0 - 4.0


def proximity_scorer(question: Column, text: Column) -> Column:
    """Words, word pairs and nearness of a question in a text, from -4 to 4.

    Weighs the share of the question's keywords that the text has (0.85), of pairs of neighbouring keywords that stand
    side by side in it (0.10), and of pairs within ``NEAR`` keywords of each other in either order (0.05), after the
    sequential dependence model of Metzler and Croft (2005). A question of one keyword has no pairs.
    """

    joined = lambda a, b: F.concat(a, F.lit(" "), b)

    def met(asked: Column, hits: Column) -> Column:
        """Shares met, from the places of the question's words in the text."""
        at = F.when(F.size(hits) > 0, F.sequence(F.lit(0), F.size(hits) - 1)).otherwise(F.array().cast("array<int>"))
        pairs = F.filter(F.transform(asked, lambda w, i: joined(w, F.get(asked, i + 1))), lambda p: p.isNotNull())
        beside = F.transform(at, lambda k: let(F.get(hits, k), lambda x: let(
            F.get(hits, k + 1), lambda y: F.when(y.i == x.i + 1, joined(x.w, y.w))
        )))
        # At most NEAR words of the question stand within NEAR places to either side.
        around = lambda k: F.slice(hits, F.greatest(k - NEAR, F.lit(0)) + 1, F.lit(2 * NEAR + 1))
        near = F.flatten(F.transform(at, lambda k: let(F.get(hits, k), lambda x: F.transform(
            F.filter(around(k), lambda y: F.abs(y.i - x.i) <= NEAR), lambda y: joined(x.w, y.w)
        ))))
        share = lambda met, of: F.coalesce(F.try_divide(F.size(F.array_intersect(of, met)).cast("double"), F.size(of)), F.lit(0.0))
        words_met = share(F.transform(hits, lambda h: h.w), asked)
        return let(pairs, lambda ps: words_met * 0.85 + share(beside, ps) * 0.10 + share(near, ps) * 0.05)

    def scored(asked: Column, words: Column) -> Column:
        placed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        return let(F.filter(placed, lambda h: F.array_contains(asked, h.w)), lambda hits: met(asked, hits)) * 8.0 - 4.0

    # Null texts and questions have no words.
    none = F.array().cast("array<string>")
    return let(F.coalesce(F.array_distinct(keywords(question)), none), lambda asked: let(
        F.coalesce(keywords(text), none), lambda words: scored(asked, words)
    ))


def model_scorer(
    load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], timeout_sec: float
) -> Scorer:
    """Scorer over a loaded pair model. ``load()`` runs once per Python worker.

    A question's pairs are scored together. If they fail or take longer than
    ``timeout_sec``, they alone score null, which sends that question to the
    fallback of :func:`rerank`; the failure is logged.
    """

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        log = get_logger(__name__)
        try:
            predict = load()
        except Exception as failure:
            log.warning("rerank model not loaded: %r", failure)
            predict = None
        pool = ThreadPoolExecutor(max_workers=1)
        for question, text in batches:
            scores: list[float | None] = [None] * len(question)
            places: dict[str | None, list[int]] = {}
            for i, q in enumerate(question.to_pylist()):
                places.setdefault(q, []).append(i)
            texts = text.to_pylist()
            for q, own in places.items() if predict is not None else ():
                try:
                    found = pool.submit(predict, [(q, texts[i]) for i in own]).result(timeout=timeout_sec)
                    for i, x in zip(own, map(float, found), strict=True):
                        scores[i] = x
                except Exception as failure:
                    for i in own:
                        scores[i] = None
                    log.warning("rerank of a question with %d candidates failed: %r", len(own), failure)
                    # The late call may go on in its thread; the next question gets another one.
                    pool.shutdown(wait=False)
                    pool = ThreadPoolExecutor(max_workers=1)
            yield pa.array(scores, type=pa.float64())
        pool.shutdown(wait=False)

    return score


def rerank(
    candidates: DataFrame, settings: Settings, scorer: Scorer | None = lexical_scorer
) -> DataFrame:
    """Best candidates per question with a new ``rank``; ``score`` stays.

    ``candidates`` has question_id, question, text and rank. Candidates below
    the threshold, and those with a score that is no number, are dropped; equal
    scores keep the candidate order. Without a scorer, and for a question whose
    scoring failed, the first candidates are taken as they come.
    """
    n = settings.rerank_top_n
    if scorer is None or not settings.rerank_enabled:
        return candidates.where(F.col("rank") <= n).withColumn(
            "rerank_score", F.lit(None).cast("double")
        )
    scored = candidates.withColumn("rerank_score", scorer(F.col("question"), F.col("text")))
    # At most top-k candidates per question share a window.
    failed = F.max(F.col("rerank_score").isNull()).over(Window.partitionBy("question_id"))
    kept = scored.withColumn("failed", failed).where(
        F.col("failed")
        | (~F.isnan("rerank_score") & (F.col("rerank_score") >= settings.rerank_score_threshold))
    )
    used = F.when(~F.col("failed"), F.col("rerank_score"))
    ordered = kept.withColumn("rerank_score", used).withColumnRenamed("rank", "candidate_rank")
    order = [F.col("rerank_score").desc(), F.col("candidate_rank")]
    return rank_per_question(ordered, order, n).drop("failed", "candidate_rank")
