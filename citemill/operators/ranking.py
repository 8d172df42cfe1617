"""Top-k per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_per_question(
    df: DataFrame, order: list[Column], k: int, question: str = "question_id"
) -> DataFrame:
    """Add ``rank`` (from 1) and keep the first ``k`` rows per question.

    Spark pushes the ``rank <= k`` limit below the shuffle, so every task sends
    at most k rows per question, however many candidates one question has.
    ``order`` must end in a unique column.
    """
    window = Window.partitionBy(question).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
