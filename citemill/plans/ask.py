"""Questions in, cited answers out."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.config import ABSTENTION, GENERATION_ERROR_ANSWER, Settings, hook
from citemill.functions.citations import RANGES
from citemill.functions.filters import among
from citemill.functions.vectors import HashingEmbedder, ModelEmbedder, pick_device
from citemill.operators.citing import conclude
from citemill.operators.generation import Generator, choose_generator
from citemill.operators.keyword import KeywordIndex
from citemill.operators.prompting import collect_sources, prompt
from citemill.operators.rerank import Scorer, lexical_scorer, model_scorer, proximity_scorer, rerank
from citemill.operators.retrieval import retrieve
from citemill.session import fits, spread_by_key, stage
from citemill.sources.store import snapshot_hash
from citemill.timing import TIMING, StageClock

# Keys up to this number are listed in the filter of the scan.
LISTED_KEYS = 200
MIN_QUESTION, MAX_QUESTION = 3, 2000
BAD_QUESTION = f"a question has {MIN_QUESTION} to {MAX_QUESTION} characters"
_SOURCES = (
    "array<struct<rank:int,text:string,company:string,fiscal_year:int,section:string,"
    "chunk_id:string,source_url:string>>"
)


def valid_question(question: Column) -> Column:
    return F.coalesce(F.length(question).between(MIN_QUESTION, MAX_QUESTION), F.lit(False))


def with_payload(
    candidates: DataFrame, store: DataFrame, questions: DataFrame, settings: Settings
) -> DataFrame:
    """Candidates with their question and the text and metadata of their chunks,
    partitioned by question.

    Ranking reads keys and vectors only; texts are read for the winners. There
    are at most ``fused_top_k`` winners per question: for very few questions
    their keys are listed in the filter of the scan, which skips what holds none
    of them; while the questions are few enough, the keys are broadcast and the
    store is not shuffled.
    """
    if fits(questions, LISTED_KEYS // settings.fused_top_k):
        candidates = stage(candidates, "candidates")
        keys = [r[0] for r in candidates.select("chunk_id").distinct().collect()]
        store = store.where(among(F.col("chunk_id"), keys))
    small = fits(questions, settings.broadcast_rows // settings.fused_top_k)
    found = store.drop("embedding").join(F.broadcast(candidates) if small else candidates, "chunk_id")
    return spread_by_key(found, "question_id").join(questions, "question_id")


def embedder_for(settings: Settings) -> HashingEmbedder | ModelEmbedder:
    """The embedder of the settings: a model where a loader is named, else word hashing."""
    if settings.embed_loader:
        device = pick_device(settings.device)
        return ModelEmbedder(
            lambda: hook(settings.embed_loader)(device), settings.embed_dim,
            settings.batch_size_cpu if device == "cpu" else settings.batch_size_gpu, settings.normalize,
            settings.document_instruction, settings.query_instruction,
        )
    return HashingEmbedder(
        settings.embed_dim, settings.normalize,
        settings.document_instruction, settings.query_instruction,
    )


def scorer_for(settings: Settings) -> Scorer:
    """The scorer of the settings: a pair model where a loader is named, else shared keywords, or their nearness too."""
    if settings.rerank_loader:
        return model_scorer(hook(settings.rerank_loader), settings.rerank_timeout_sec)
    scorers = {"lexical": lexical_scorer, "proximity": proximity_scorer}
    if settings.rerank_scorer not in scorers:
        raise ValueError(f"unknown scorer {settings.rerank_scorer}")
    return scorers[settings.rerank_scorer]


def ask_many(
    store: DataFrame,
    questions: DataFrame,
    settings: Settings,
    where: dict | None = None,
    embedder=None,
    scorer: Scorer | None | str = "settings",
    generator: Generator | None = None,
    index: KeywordIndex | None = None,
    any_length: bool = False,
    snapshot: str | None = None,
    clock: Callable[[], float] | None = None,
) -> DataFrame:
    """One response row per question (question_id, question).

    A question without candidates above the threshold is not sent to the
    generator; it abstains. A question of another length than is allowed is not
    asked, and its response says so, unless it may have ``any_length``. Responses
    carry ``snapshot``, the hash of the store they are answered from. With a
    ``clock`` (seconds) the stages are run one after another and ``timing`` says
    how long each took; otherwise it is null and all runs as one job.
    """
    timer = StageClock(clock) if clock else None
    timed = timer.mark if timer else (lambda name, df: df)
    generator = generator or choose_generator(settings)
    scorer = scorer_for(settings) if scorer == "settings" else scorer
    allowed = F.col("question").isNotNull() if any_length else valid_question(F.col("question"))
    valid = questions.where(allowed)
    found = timed("retrieval", retrieve(store, valid, settings, embedder or embedder_for(settings), where, index))
    candidates = with_payload(found, store, valid, settings)
    sourced = timed("rerank", collect_sources(rerank(candidates, settings, scorer)).withColumn(
        "sources", F.col("sources").cast(_SOURCES)
    ).join(valid, "question_id"))
    generated = sourced.withColumn("prompt", prompt(F.col("question"), F.col("sources"))).withColumn(
        "generation", generator(F.col("question"), F.col("sources"), F.col("prompt"))
    )
    generated = timed("generation", generated)
    answered = conclude(generated).select(
        "question_id", "answer", "citations", "out_of_range", "abstained", "truncated", "error",
        F.transform("sources", lambda s: s.chunk_id).alias("source_ids"),
        F.col("generation.cost_usd").alias("cost_usd"),
    )
    empty = F.array()
    return questions.select("question_id", "question").join(answered, "question_id", "left").select(
        "question_id",
        "question",
        F.when(~allowed, GENERATION_ERROR_ANSWER).otherwise(F.coalesce("answer", F.lit(ABSTENTION))).alias("answer"),
        F.coalesce("citations", empty.cast(answered.schema["citations"].dataType)).alias("citations"),
        F.coalesce("out_of_range", empty.cast(RANGES)).alias("out_of_range"),
        F.coalesce("source_ids", empty.cast("array<string>")).alias("source_ids"),
        F.when(~allowed, False).otherwise(F.coalesce("abstained", F.lit(True))).alias("abstained"),
        F.coalesce("truncated", F.lit(False)).alias("truncated"),
        F.when(~allowed, BAD_QUESTION).otherwise(F.col("error")).alias("error"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.lit(settings.model_version).alias("model_version"),
        F.lit(snapshot).cast("string").alias("corpus_snapshot_hash"),
        (timer.column(F.col("answer").isNotNull()) if timer else F.lit(None).cast(TIMING)).alias("timing"),
    )


def ask(
    store: DataFrame, question: str, settings: Settings, where: dict | None = None,
    snapshot: str | None = None, **parts
) -> dict:
    """Answer one question now, as a plain dict with the ``timing`` of its stages and a wall-clock ``total_ms``.

    ``snapshot`` is the store's hash where the caller keeps it between questions;
    otherwise all stored keys are read for it.
    """
    if not MIN_QUESTION <= len(question) <= MAX_QUESTION:
        raise ValueError(BAD_QUESTION)
    started = time.monotonic()
    asked = store.sparkSession.createDataFrame([(0, question)], "question_id int, question string")
    snapshot = snapshot or snapshot_hash(store).first()[0]
    parts = {"clock": time.monotonic, **parts}
    response = ask_many(store, asked, settings, where, snapshot=snapshot, **parts).drop("question_id").first()
    return {
        **response.asDict(recursive=True),
        "total_ms": int((time.monotonic() - started) * 1000),
    }
