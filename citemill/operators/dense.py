"""Exact cosine top-k over stored embeddings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.functions.filters import compile_filter
from citemill.functions.vectors import SCORE_DECIMALS, cosine_to, unit_rows, usable_rows
from citemill.operators.ranking import rank_per_question
from citemill.session import checkpoint_folder, delete_at_exit, fits, stage

# Questions of one pass over the corpus, about.
QUESTION_BLOCK = 2048
# Scores computed at once: corpus rows times questions.
SCORE_CELLS = 500_000


def filtered(store: DataFrame, where: dict | None) -> DataFrame:
    """The stored rows a metadata filter admits."""
    condition = compile_filter(where, store.columns)
    return store if condition is None else store.where(condition)


def dense_topk(
    store: DataFrame, query: list[float], k: int, where: dict | None = None, key: str = "chunk_id"
) -> DataFrame:
    """The ``k`` rows most similar to one vector: key, score, rank.

    Only the key and the embedding are read; take other columns by joining the
    k keys back to the store.
    """
    scored = filtered(store, where).select(
        key, cosine_to(query)(F.col("embedding")).alias("score")
    )
    best = scored.where(F.col("score").isNotNull()).orderBy(F.col("score").desc(), F.col(key)).limit(k)
    return rank_per_question(
        best.withColumn("question_id", F.lit(0)), [F.col("score").desc(), F.col(key)], k
    ).drop("question_id")


class BestRows:
    """The k best rows per question seen so far, ties by smallest key."""

    def __init__(self, question_ids: np.ndarray, questions: np.ndarray, k: int):
        self.question_ids, self.questions, self.k = question_ids, questions, k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, ids: np.ndarray, corpus: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, corpus = ids[order], corpus[order]
        scores = np.round(corpus @ self.questions.T, SCORE_DECIMALS)
        keep = np.ones(scores.shape, dtype=bool)
        if len(ids) > self.k:
            floor = np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k]
            above, level = scores > floor, scores == floor
            keep = above | (level & (np.cumsum(level, axis=0) <= self.k - above.sum(axis=0)))
        row, question = np.nonzero(keep)
        self.parts.append((question, ids[row], scores[row, question]))
        self.held += len(row)
        if self.held > 8 * self.k * len(self.question_ids):
            self.parts = [self._reduced()]
            self.held = len(self.parts[0][0])

    def _reduced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        question, ids, scores = (np.concatenate(column) for column in zip(*self.parts))
        order = np.lexsort((ids, -scores, question))
        question, ids, scores = question[order], ids[order], scores[order]
        first = np.searchsorted(question, question, side="left")
        keep = np.arange(len(question)) - first < self.k
        return question[keep], ids[keep], scores[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        question, ids, scores = self._reduced()
        return self.question_ids[question], ids, scores


def sortable(values: np.ndarray) -> np.ndarray:
    """Keys in a sortable numpy type."""
    return values.astype(str) if values.dtype == object else values


def dense_topk_batch(
    store: DataFrame,
    questions: DataFrame,
    settings: Settings,
    where: dict | None = None,
    key: str = "chunk_id",
) -> DataFrame:
    """The best rows for every question: question_id, key, score, rank.

    ``questions`` has question_id and embedding. Up to ``broadcast_questions``
    questions travel to the corpus partitions as one matrix; more go in several
    passes. The corpus is never shuffled: a task scores whole blocks and passes
    on only its best rows. Rows and questions whose embedding is null, of another
    size or not all numbers are left out; ``check_vectors`` lists them.
    """
    k = settings.top_k_dense
    corpus = filtered(store, where).select(key, "embedding")
    question_type = questions.schema["question_id"].dataType.simpleString()
    key_type = store.schema[key].dataType.simpleString()
    schema = f"question_id {question_type}, {key} {key_type}, score double"
    if fits(questions, settings.broadcast_questions):
        best = _against_matrix(corpus, questions, k, key, schema)
    else:
        best = _in_passes(corpus, questions, k, key, schema)
    return rank_per_question(best, [F.col("score").desc(), F.col(key)], k)


def question_matrix(questions: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and unit vectors of questions (question_id, embedding), of those with the most usual size; None without any."""
    rows = questions.select("question_id", "embedding").toArrow()
    vectors = rows["embedding"].combine_chunks()
    sizes = [n for n in pc.list_value_length(vectors).to_pylist() if n]
    if not sizes:
        return None
    usable, matrix = usable_rows(vectors, max(set(sizes), key=sizes.count))
    ids = rows["question_id"].to_numpy()[usable]
    return (ids, unit_rows(matrix)) if len(ids) else None


def _against_matrix(
    corpus: DataFrame, questions: DataFrame, k: int, key: str, schema: str
) -> DataFrame:
    asked = question_matrix(questions)
    if asked is None:
        return corpus.sparkSession.createDataFrame([], schema)
    return _scored(corpus, corpus.sparkSession.sparkContext.broadcast(asked), k, key, schema)


def _scored(corpus: DataFrame, shared, k: int, key: str, schema: str) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        best = BestRows(ids, matrix, k)
        rows = max(SCORE_CELLS // len(ids), 1)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                usable, vectors = usable_rows(part.column(1), matrix.shape[1])
                if usable.any():
                    stored = sortable(part.column(0).to_numpy(zero_copy_only=False)[usable])
                    best.add(stored, unit_rows(vectors))
        if best.parts:
            names = ["question_id", key, "score"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows()], names=names)

    return corpus.mapInArrow(score, schema)


def _in_passes(corpus: DataFrame, questions: DataFrame, k: int, key: str, schema: str) -> DataFrame:
    """The corpus stays where it is; blocks of questions travel to it one after
    another. The questions are embedded once, and each pass leaves only its best
    rows, in the shared folder, before the next one begins."""
    spark = corpus.sparkSession
    questions = stage(questions.select("question_id", "embedding"), "questions")
    blocks = -(-questions.count() // (QUESTION_BLOCK // 2))
    block = F.pmod(F.xxhash64("question_id"), F.lit(blocks))
    path = f"{checkpoint_folder(spark).rstrip('/')}/passes-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    written = 0
    for i in range(blocks):
        asked = question_matrix(questions.where(block == i))
        if asked is not None:
            shared = spark.sparkContext.broadcast(asked)
            found = _scored(corpus, shared, k, key, schema)
            rank_per_question(found, [F.col("score").desc(), F.col(key)], k).drop("rank").write.parquet(f"{path}/pass={i}")
            shared.destroy()
            written += 1
    return spark.read.schema(schema).parquet(path) if written else spark.createDataFrame([], schema)
