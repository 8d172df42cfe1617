"""Candidate retrieval: dense, optionally fused with keyword search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.operators.dense import dense_topk_batch, filtered
from citemill.operators.fusion import fuse
from citemill.operators.keyword import KeywordIndex, keyword_search


def retrieve(
    store: DataFrame,
    questions: DataFrame,
    settings: Settings,
    embedder,
    where: dict | None = None,
    index: KeywordIndex | None = None,
    unfiltered_keywords: bool = False,
    key: str = "chunk_id",
) -> DataFrame:
    """Candidates per question: question_id, key, rank, score.

    A filter that admits nothing gives no candidates; it is never widened. The
    filter holds for both legs; ``unfiltered_keywords`` lets the keyword leg
    search everything, for the questions the dense leg answered.
    """
    asked = questions.select(
        "question_id", "question", embedder.queries(F.col("question")).alias("embedding")
    )
    dense = dense_topk_batch(store, asked, settings, where, key)
    if not settings.hybrid_enabled:
        return dense.select("question_id", key, "rank", "score")
    index = index or KeywordIndex.build(store, settings, key)
    allowed = None if where is None or unfiltered_keywords else filtered(store, where)
    keyword = keyword_search(index, questions, settings, allowed)
    return fuse(dense, keyword, settings, key, needs_dense=where is not None).drop("rrf")
