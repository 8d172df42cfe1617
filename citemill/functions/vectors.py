"""Embedding and vector expressions.

Words are cut in the JVM; hashing and vector arithmetic work on whole Arrow
batches: Spark has no vector type and evaluates array lambdas element by element.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from citemill.functions.text import words

# Scores are compared at this precision, so that equal vectors tie everywhere.
SCORE_DECIMALS = 9
# Words of a batch worked on at a time, about.
SLICE_WORDS = 200_000


def list_matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as one float64 matrix."""
    if len(column) == 0:
        return np.zeros((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(column), -1)


def usable_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are vectors of ``dim`` numbers, and those rows
    as a matrix. A null, a list of another length and one with null or NaN are not."""
    lengths = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    usable = lengths == dim
    matrix = list_matrix(column.filter(pa.array(usable))).reshape(int(usable.sum()), dim)
    sound = np.isfinite(matrix).all(axis=1)
    usable[usable] = sound
    return usable, matrix[sound]


def float_lists(matrix: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list<float> column."""
    rows, dim = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.astype(np.float32).ravel()))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def cosine_to(query: list[float]) -> Callable[[Column], Column]:
    """Cosine similarity of an embedding column to one query vector, null for
    what is no vector of its size."""
    vector = unit_rows(np.asarray(query, dtype=np.float64).reshape(1, -1))[0]

    @F.arrow_udf("double")
    def score(embedding: pa.Array) -> pa.Array:
        usable, matrix = usable_rows(embedding, len(vector))
        scores = np.full(len(embedding), np.nan)
        scores[usable] = np.round(unit_rows(matrix) @ vector, SCORE_DECIMALS)
        return pa.array(scores, mask=~usable)

    return score


def vector_norm(embedding: Column) -> Column:
    squares = F.aggregate(
        embedding, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def has_nan(embedding: Column) -> Column:
    return F.exists(embedding, lambda x: F.isnan(x))


def _word_slot(word: str, dim: int) -> int:
    """Slot 1..dim of a word, negative for half of the words."""
    digest = hashlib.md5(word.encode()).hexdigest()
    slot = int(digest[:8], 16) % dim + 1
    return -slot if digest[8] < "8" else slot


def _word_slots(words: pa.Array, dim: int) -> np.ndarray:
    """The slots of an array of words; ``SLICE_WORDS`` are strings at a time."""
    slots = np.empty(len(words), dtype=np.int32)
    for start in range(0, len(words), SLICE_WORDS):
        part = words.slice(start, SLICE_WORDS)
        slots[start : start + len(part)] = [_word_slot(w, dim) for w in part.to_pylist()]
    return slots


def _hash_words(dim: int, normalize: bool) -> Callable[[Column], Column]:
    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        ends = np.cumsum(texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        # Every distinct word of the batch is hashed once.
        coded = texts.flatten().dictionary_encode()
        slots = _word_slots(coded.dictionary, dim)
        indices = coded.indices.to_numpy(zero_copy_only=False)
        matrix = np.empty((len(texts), dim), dtype=np.float32)
        # About SLICE_WORDS words are summed up at a time; a longer text goes alone.
        row = first = 0
        while row < len(texts):
            last = max(int(np.searchsorted(ends, first + SLICE_WORDS, side="right")), row + 1)
            lengths = np.diff(ends[row:last], prepend=first)
            flat = slots[indices[first : ends[last - 1]]]
            cell = np.repeat(np.arange(last - row), lengths) * dim + np.abs(flat) - 1
            sums = np.bincount(cell, weights=np.sign(flat), minlength=(last - row) * dim).reshape(last - row, dim)
            matrix[row:last] = unit_rows(sums) if normalize else sums
            row, first = last, int(ends[last - 1])
        return float_lists(matrix)

    return vectors


class HashingEmbedder:
    """Deterministic embedder that needs no model: signed word hashing."""

    def __init__(
        self,
        dim: int = 64,
        normalize: bool = True,
        document_prefix: str = "search_document: ",
        query_prefix: str = "search_query: ",
    ):
        self.dim = dim
        self.document_prefix = document_prefix
        self.query_prefix = query_prefix
        self._vectors = _hash_words(dim, normalize)

    def documents(self, text: Column) -> Column:
        return self._embed(self.document_prefix, text)

    def queries(self, text: Column) -> Column:
        return self._embed(self.query_prefix, text)

    def _embed(self, prefix: str, text: Column) -> Column:
        # The prefix is part of the model input only; the stored text stays as is.
        return self._vectors(F.filter(words(F.concat(F.lit(prefix), text)), lambda w: w != ""))


def pick_device(setting: str = "auto", available: Iterator[str] | list[str] = ()) -> str:
    """Device for a model: environment, then setting, then the best available."""
    override = os.environ.get("EMBED_DEVICE")
    if override:
        return override
    if setting != "auto":
        return setting
    present = set(available)
    return next((device for device in ("cuda", "mps") if device in present), "cpu")


class ModelEmbedder:
    """Embedder over a loaded model: ``load()`` runs once per Python worker and
    returns a function from a list of texts to a list of vectors."""

    def __init__(
        self,
        load: Callable[[], Callable[[list[str]], object]],
        dim: int,
        batch_size: int = 16,
        normalize: bool = True,
        document_prefix: str = "search_document: ",
        query_prefix: str = "search_query: ",
    ):
        self.dim = dim
        self.document_prefix = document_prefix
        self.query_prefix = query_prefix

        @F.arrow_udf("array<float>")
        def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode = load()
            for batch in batches:
                texts = batch.to_pylist()
                parts = [
                    np.asarray(encode(texts[i : i + batch_size]), dtype=np.float64)
                    for i in range(0, len(texts), batch_size)
                ]
                matrix = np.vstack(parts) if parts else np.zeros((0, dim))
                yield float_lists(unit_rows(matrix) if normalize else matrix)

        self._embed = embed

    def documents(self, text: Column) -> Column:
        return self._embed(F.concat(F.lit(self.document_prefix), text))

    def queries(self, text: Column) -> Column:
        return self._embed(F.concat(F.lit(self.query_prefix), text))
