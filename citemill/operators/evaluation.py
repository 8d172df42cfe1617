"""Scoring responses against a golden set."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.functions.binding import let
from citemill.functions.citations import MARKER
from citemill.functions.text import keywords
from citemill.operators.alignment import aligned_judge
from citemill.operators.generation import post_json
from citemill.session import fits

RECALL_AT = (5, 10, 20)
# Lists of test texts up to this length are broadcast.
MAX_LISTED = 100_000
MIN_RECALL, MIN_GROUNDEDNESS = 0.85, 0.90
_SCORES = "groundedness double, relevance double, correctness double"


def recall_at(ids: Column, expected: Column, k: int) -> Column:
    """1.0 when one of the first ``k`` ids is expected, else 0.0."""
    wanted = F.filter(F.transform(expected, lambda e: e.chunk_id), lambda i: i.isNotNull() & (i != ""))
    hit = F.arrays_overlap(F.slice(ids, 1, k), wanted)
    return F.coalesce(hit, F.lit(False)).cast("double")


def source_recall_at(citations: Column, expected: Column, k: int) -> Column:
    """The same on citations, where an expected source without a chunk id is met
    by its company, year and section."""

    def matches(c: Column, e: Column) -> Column:
        described = (
            F.contains(F.lower(c.company), F.lower(e.company))
            & (c.fiscal_year == e.year) & (c.section == e.section)
        )
        return F.when(e.chunk_id.isNotNull(), c.chunk_id == e.chunk_id).otherwise(
            F.coalesce(described, F.lit(False))
        )

    cited = F.slice(citations, 1, k)
    hit = F.exists(expected, lambda e: F.exists(cited, lambda c: matches(c, e)))
    return F.coalesce(hit, F.lit(False)).cast("double")


def _share(of: Column, within: Column) -> Column:
    """Share of the distinct keywords of one text that another has."""
    def share(mine: Column) -> Column:
        shared = F.size(F.array_intersect(mine, keywords(within))).cast("double")
        return F.coalesce(F.try_divide(shared, F.size(mine).cast("double")), F.lit(0.0))

    return let(F.array_distinct(keywords(of)), share)


def lexical_judge(question: Column, context: Column, reference: Column, answer: Column) -> Column:
    """Judge that needs no model: scores are shares of keywords, 0 to 1. Citation
    markers are no part of what an answer says."""
    said = F.regexp_replace(answer, MARKER, " ")
    return F.struct(
        _share(said, context).alias("groundedness"),
        _share(question, said).alias("relevance"),
        _share(reference, said).alias("correctness"),
    )


def chat_judge(settings: Settings, post: Callable = post_json, url: str = "", headers: dict | None = None):
    """Judge over a chat service that replies with a JSON object of scores. A
    failed call gives null scores and is left out of the means."""

    def ask(question: str, context: str, reference: str, answer: str) -> dict:
        grading = (
            "Grade the SYSTEM ANSWER from 0 to 1 as JSON with the keys groundedness (supported by "
            "the CONTEXT), relevance (addresses the QUESTION), correctness (agrees with the "
            f"REFERENCE) and notes.\n\nQUESTION: {question}\nCONTEXT: {context}\n"
            f"REFERENCE: {reference}\nSYSTEM ANSWER: {answer}"
        )
        body = {
            "model": settings.judge_model, "temperature": 0.0, "seed": settings.seed,
            "messages": [{"role": "user", "content": grading}],
            "response_format": {"type": "json_object"},
        }
        reply = post(url, headers or {}, body)
        return json.loads(reply["choices"][0]["message"]["content"])

    @F.pandas_udf(_SCORES)
    def judge(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            rows = []
            for args in zip(*columns):
                try:
                    scores = ask(*args) if all(a is not None for a in args) else None
                except Exception:
                    scores = None
                names = ("groundedness", "relevance", "correctness")
                rows.append({n: None if scores is None else float(scores.get(n, 0)) for n in names})
            yield pd.DataFrame(rows, columns=["groundedness", "relevance", "correctness"])

    return judge


def judge_for(settings: Settings) -> Callable:
    """The judge of the settings: shares of keywords, aligned sentences, or a chat service at the address named."""
    if settings.judge_backend == "lexical":
        return lexical_judge
    if settings.judge_backend == "aligned":
        return aligned_judge
    if not settings.judge_url:
        raise ValueError(f"judge backend {settings.judge_backend} needs eval.judge_url")
    return chat_judge(settings, url=settings.judge_url)


def score_responses(golden: DataFrame, responses: DataFrame, judge=lexical_judge) -> DataFrame:
    """One row per golden question with its recall, abstention and judge scores.

    ``golden`` has question_id and the golden columns; ``responses`` is the
    output of asking them, with ``context``, the text of the cited chunks.
    Questions that should be refused count for abstention only. The judge sees
    answered questions that have a reference answer.
    """
    joined = golden.drop("question").join(responses, "question_id")
    refuse = F.coalesce(F.col("should_abstain"), F.lit(False))
    has_sources = F.coalesce(F.size("expected_sources") > 0, F.lit(False))
    judged = ~refuse & (F.coalesce(F.col("reference_answer"), F.lit("")) != "") & ~F.col("abstained")
    recalls = {
        f"hit_{k}": F.when(~refuse & has_sources, source_recall_at(F.col("citations"), F.col("expected_sources"), k))
        for k in RECALL_AT
    }
    retrieved = {
        f"retrieved_{k}": F.when(~refuse & has_sources, recall_at(F.col("source_ids"), F.col("expected_sources"), k))
        for k in RECALL_AT
    }
    asked = joined.withColumns({**recalls, **retrieved, "judged": judged})
    scores = judge(F.col("question"), F.col("context"), F.col("reference_answer"), F.col("answer"))
    return asked.withColumn("judge", F.when(F.col("judged"), scores)).withColumns({
        "refuse": refuse, "refused": F.when(refuse, F.col("abstained")),
    })


def scorecard(scored: DataFrame, settings: Settings) -> DataFrame:
    """One row of means, counts and the acceptance verdict. Empty means are 0;
    abstention accuracy is null when no question should be refused. The verdict
    uses unrounded means."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    recalls = [mean(f"hit_{k}").alias(f"recall_{k}") for k in RECALL_AT]
    retrieved = [mean(f"retrieved_{k}").alias(f"retrieved_recall_{k}") for k in RECALL_AT]
    shares = (0.5, 0.95) if "timing" in scored.columns else ()
    times = [F.percentile_approx("timing.total_ms", p, 10_000).alias(f"p{int(100 * p)}_ms") for p in shares]
    totals = scored.agg(
        *times, F.count("*").alias("n_questions"), *recalls, *retrieved,
        mean("judge.groundedness").alias("groundedness"), mean("judge.relevance").alias("relevance"),
        F.count_if("refused").alias("abstain_correct"), F.count_if("refuse").alias("abstain_total"),
    )
    passed = (F.col("recall_10") >= MIN_RECALL) & (F.col("groundedness") >= MIN_GROUNDEDNESS)
    rounded = lambda c: F.round(c, 4).alias(c)
    return totals.select(
        F.lit(settings.model_version).alias("model_version"), F.lit(settings.seed).alias("seed"),
        "n_questions", *[rounded(f"recall_{k}") for k in RECALL_AT],
        *[rounded(f"retrieved_recall_{k}") for k in RECALL_AT],
        rounded("groundedness"), rounded("relevance"), "abstain_correct", "abstain_total",
        F.round(F.try_divide(F.col("abstain_correct"), F.col("abstain_total")), 4).alias("abstain_accuracy"),
        passed.alias("phase1_pass"), *[f"p{int(100 * p)}_ms" for p in shares],
    )


def exact_overlap(test: DataFrame, train: DataFrame, column: str = "question") -> DataFrame:
    """Test rows whose text also occurs in the training rows. The training texts
    are cut down to those of the test rows before anything is made distinct; a
    short list of test texts goes to them and they are not shuffled."""
    wanted = test.select(column).distinct()
    wanted = F.broadcast(wanted) if fits(wanted, MAX_LISTED) else wanted
    met = train.select(column).join(wanted, column, "left_semi").distinct()
    return test.join(met, column, "left_semi")
