"""Reciprocal rank fusion of the dense and the keyword ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.operators.ranking import rank_per_question


def fuse(
    dense: DataFrame, keyword: DataFrame, settings: Settings, key: str = "chunk_id", needs_dense: bool = False
) -> DataFrame:
    """Candidates of both legs per question: question_id, key, rank, score, rrf.

    Each leg has question_id, key, rank and score. Equal sums keep the dense
    order, then the keyword order. A candidate of the keyword leg shows score 0.
    ``needs_dense`` leaves out questions that the dense leg has no row for.
    """
    leg = lambda df, name: df.select(
        "question_id", key, F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score")
    )
    share = lambda rank: F.coalesce(1.0 / (F.lit(settings.rrf_k) + F.col(rank)), F.lit(0.0))
    both = leg(dense, "dense").join(leg(keyword, "keyword"), ["question_id", key], "full_outer")
    if needs_dense:
        # At most the two legs' best rows per question share a window.
        answered = F.max(F.col("dense_rank").isNotNull()).over(Window.partitionBy("question_id"))
        both = both.withColumn("_answered", answered).where("_answered").drop("_answered")
    fused = both.withColumns({
        "rrf": share("dense_rank") + share("keyword_rank"),
        "score": F.when(F.col("keyword_rank").isNotNull(), 0.0).otherwise(F.col("dense_score")),
    })
    order = [
        F.col("rrf").desc(), F.col("dense_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last(),
    ]
    return rank_per_question(fused, order, settings.fused_top_k).select(
        "question_id", key, "rank", "score", "rrf"
    )
