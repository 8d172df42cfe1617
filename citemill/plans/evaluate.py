"""Ask a golden set and score the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.operators.evaluation import lexical_judge, score_responses, scorecard
from citemill.plans.ask import ask_many
from citemill.session import fits, stage


def with_context(responses: DataFrame, store: DataFrame, settings: Settings) -> DataFrame:
    """Add ``context``: the texts of the cited chunks, in citation order."""
    cited = responses.select("question_id", F.posexplode(
        F.transform("citations", lambda c: c.chunk_id)
    ).alias("place", "chunk_id"))
    few = fits(responses, settings.broadcast_rows // settings.rerank_top_n)
    texts = store.select("chunk_id", "text").join(F.broadcast(cited) if few else cited, "chunk_id")
    # A response cites at most as many chunks as it was given sources.
    contexts = texts.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "text"))).alias("texts")
    ).select("question_id", F.array_join(F.transform("texts", lambda c: c.text), " | ").alias("context"))
    return responses.join(contexts, "question_id", "left").withColumn(
        "context", F.coalesce("context", F.lit(""))
    )


def evaluate(
    store: DataFrame, golden: DataFrame, settings: Settings, judge=lexical_judge, **parts
) -> tuple[DataFrame, DataFrame]:
    """Per-question scores and the one-row scorecard, over all golden questions
    whatever their length. Questions are asked without filters. The responses are staged: they are read twice, and asking a
    generator again costs money and may answer differently."""
    asked = ask_many(store, golden.select("question_id", "question"), settings, any_length=True, **parts)
    responses = stage(asked, "responses")
    scored = score_responses(golden, with_context(responses, store, settings), judge)
    return scored, scorecard(scored, settings)
