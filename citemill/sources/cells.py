"""Vectors on disk in k-means cells, searched exactly with few cells read.

Each row lies in the cell of its nearest centre, with the distance of its unit vector to the centre; a cell's largest
distance is its radius. By the triangle inequality no row of a cell is nearer to a question than the distance to the
centre less the radius, and none with another distance to the centre than the question's by more than the k-th best is
near enough. So cells are read in the order of their bounds until no further one can hold a better row, and inside a
cell only the ring in reach. Nothing is approximate unless ``most_cells`` says how many cells to read for a question.

Cells are folders (``cell=c``), so a search reads them by partition filter; rows of a cell are sorted by their distance,
so row groups outside the ring are skipped. How much is saved depends on the vectors: clustered ones save most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citemill.config import Settings
from citemill.functions.vectors import unit_rows, usable_rows
from citemill.operators.dense import BestRows, question_matrix, sortable
from citemill.operators.ranking import rank_per_question
from citemill.session import fits, stage
from citemill.sources.pointer import delete_folder, folders, pointer_version, read_pointer, write_pointer

# Rows that centres are fitted on, and rounds of fitting. Every row is indexed.
SAMPLE, ROUNDS = 20_000, 12
SEED = 5
# Distances are compared with this much to spare, above what floating point loses.
SLACK = 1e-5


def fit_centres(vectors: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centres of unit vectors by Lloyd's rounds, begun at rows drawn by chance."""
    draw = np.random.default_rng(seed)
    centres = vectors[draw.choice(len(vectors), min(cells, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        mine = nearest(vectors, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, vectors)
        counts = np.bincount(mine, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(vectors @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)


class CellStore:
    """Rows (key, embedding) in cells below one path; the last ``write`` is the current one."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings, key: str = "chunk_id"):
        self.spark, self.path, self.settings, self.key = spark, path.rstrip("/"), settings, key

    def exists(self) -> bool:
        return pointer_version(self.spark, self.path) > 0

    def write(self, rows: DataFrame, cells: int | None = None, source=None) -> None:
        """Index all ``rows``. Null vectors and those of another size or not all numbers are left out, as in every
        search. ``cells`` defaults to the square root of the number of rows, 4,096 at most."""
        rows = rows.select(self.key, "embedding")
        sample = rows.where("embedding IS NOT NULL").orderBy(F.xxhash64(self.key), self.key).limit(SAMPLE)
        asked = question_matrix(sample.select(F.col(self.key).alias("question_id"), "embedding"))
        vectors = asked[1] if asked else np.zeros((1, 1))
        centres = fit_centres(vectors, cells or min(max(int(rows.count() ** 0.5), 1), 4096))
        shared, dim = self.spark.sparkContext.broadcast(centres), vectors.shape[1]
        schema = T.StructType([*rows.schema.fields, T.StructField("distance", T.DoubleType()), T.StructField("cell", T.IntegerType())])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                usable, found = usable_rows(batch.column(1), dim)
                if usable.any():
                    unit = unit_rows(found)
                    cell = nearest(unit, shared.value)
                    far = np.linalg.norm(unit - shared.value[cell], axis=1)
                    kept = [c.filter(pa.array(usable)) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(far), pa.array(cell.astype(np.int32))], names=schema.names)

        taken = [int(n.rpartition("=")[2]) for n in folders(self.spark, self.path) if n.startswith("version=")]
        version = pointer_version(self.spark, self.path)
        folder = max([version, *taken]) + 1
        path = f"{self.path}/version={folder}"
        # A large cell is split over several files.
        rows.mapInArrow(place, schema).hint("rebalance", "cell").sortWithinPartitions("cell", "distance").write.partitionBy("cell").parquet(path)
        shared.destroy()
        radii = self.spark.read.schema(schema).parquet(path).groupBy("cell").agg(F.max("distance").alias("r"), F.count("*").alias("n")).collect()
        self.spark.createDataFrame(
            [(r.cell, centres[r.cell].tolist(), r.r, r.n) for r in radii], "cell int, centre array<double>, radius double, n long"
        ).coalesce(1).write.parquet(f"{self.path}/centres/version={folder}")
        layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        write_pointer(self.spark, self.path, version + 1, {"folder": folder, "layout": layout, "dim": dim, "source": source})
        for name in folders(self.spark, self.path):
            if name.startswith("version=") and int(name.rpartition("=")[2]) < folder - 1:
                delete_folder(self.spark, f"{self.path}/{name}")

    @property
    def source(self):
        return (read_pointer(self.spark, self.path) or {}).get("source")

    def search(self, questions: DataFrame, k: int | None = None, most_cells: int | None = None) -> DataFrame:
        """The best rows for every question (question_id, embedding): question_id, key, score, rank.

        Equal to ``dense_topk_batch`` over the same rows. At most ``broadcast_questions`` questions are searched at a
        time; more go in blocks, one after another. With ``most_cells`` no more cells than that are read for a question,
        and rows in others may be missed.
        """
        k, pointer = k or self.settings.top_k_dense, read_pointer(self.spark, self.path)
        if pointer is None:
            raise ValueError(f"nothing is indexed at {self.path}")
        layout = T.DataType.fromDDL(pointer["layout"])
        found_type = ", ".join((
            f"question_id {questions.schema['question_id'].dataType.simpleString()}", f"{self.key} {layout[self.key].dataType.simpleString()}",
            "score double",
        ))
        rows = self.spark.read.schema(layout).parquet(f"{self.path}/version={pointer['folder']}")
        centres = self.spark.read.parquet(f"{self.path}/centres/version={pointer['folder']}").orderBy("cell").collect()
        most, blocks = self.settings.broadcast_questions, 1
        if not fits(questions, most):
            questions = stage(questions.select("question_id", "embedding"), "questions")
            blocks = -(-questions.count() // max(most // 2, 1))
        block, found = F.pmod(F.xxhash64("question_id"), F.lit(blocks)), []
        self.cells_read: list[float] = []
        for i in range(blocks):
            asked = question_matrix(questions.where(block == i))
            if asked is not None and centres and asked[1].shape[1] == pointer["dim"]:
                search = _Search(rows, self.key, found_type, centres, asked, k)
                found.append(search.run(most_cells))
                self.cells_read.append(search.cells_read())
        empty = self.spark.createDataFrame([], found_type)
        return rank_per_question(reduce(DataFrame.unionByName, found, empty), [F.col("score").desc(), F.col(self.key)], k)


class _Search:
    """Rounds of reading cells in the order of their bounds."""

    def __init__(self, rows: DataFrame, key: str, found_type: str, centres: list, asked: tuple, k: int):
        self.rows, self.key, self.found_type, self.k = rows, key, found_type, k
        self.ids, self.vectors = asked
        self.cells = np.array([c.cell for c in centres])
        self.sizes = np.array([c.n for c in centres])
        matrix = np.array([c.centre for c in centres])
        # Distance of each question to each centre, and to the nearest row that the cell can hold.
        square = (self.vectors**2).sum(axis=1)[:, None] + (matrix**2).sum(axis=1)[None, :] - 2 * self.vectors @ matrix.T
        self.far = np.sqrt(np.maximum(square, 0))
        self.bound = np.maximum(self.far - np.array([c.radius for c in centres])[None, :], 0) - SLACK
        self.read = np.zeros(self.far.shape, dtype=bool)
        self.reach = np.full(len(self.ids), np.inf)
        self.found: DataFrame | None = None

    def run(self, most_cells: int | None) -> DataFrame:
        order = np.argsort(self.bound + 1e-9 * self.far, axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        # First the cells that hold k rows between them, then twice as many in each round.
        ahead = np.take_along_axis(np.cumsum(self.sizes[order], axis=1), place, axis=1) - self.sizes[None, :]
        upto = (ahead < self.k).sum(axis=1)
        limit = len(self.cells) if most_cells is None else most_cells
        while True:
            wanted = (place < np.minimum(upto, limit)[:, None]) & (self.bound <= self.reach[:, None]) & ~self.read
            if wanted.any():
                self._read(wanted)
            left = (place < limit) & (self.bound <= self.reach[:, None]) & ~self.read
            if not left.any():
                return self.found
            upto = upto * 2

    def _read(self, wanted: np.ndarray) -> None:
        self.read |= wanted
        use = wanted.any(axis=0)
        cells = self.cells[use].tolist()
        shared = self.rows.sparkSession.sparkContext.broadcast(
            (self.ids, self.vectors, {c: np.flatnonzero(wanted[:, i]) for i, c in zip(np.flatnonzero(use), cells)})
        )
        rows = self.rows.where(F.col("cell").isin(cells))
        # The ring of each cell that some question can reach.
        low = np.where(wanted, self.far - self.reach[:, None] - SLACK, np.inf).min(axis=0)[use]
        high = np.where(wanted, self.far + self.reach[:, None] + SLACK, -np.inf).max(axis=0)[use]
        rows = rows.where(F.col("distance").between(float(low.min()), float(high.max())))
        new = _score_cells(rows, self.key, self.found_type, shared, self.k)
        found = new if self.found is None else self.found.unionByName(new)
        best = rank_per_question(found, [F.col("score").desc(), F.col(self.key)], self.k)
        staged = stage(best, "cells-found")
        shared.destroy()
        self.found = staged.drop("rank")
        last = {r.question_id: r.score for r in staged.where(F.col("rank") == self.k).select("question_id", "score").collect()}
        # Scores are cosines of unit vectors: a distance of d is a cosine of 1 - d * d / 2.
        reach = [np.sqrt(max(2 - 2 * last[q], 0)) + SLACK if q in last else np.inf for q in self.ids.tolist()]
        self.reach = np.minimum(self.reach, reach)

    def cells_read(self) -> float:
        """Share of the cells read, over all questions."""
        return float(self.read.mean())


def _score_cells(rows: DataFrame, key: str, found_type: str, shared, k: int) -> DataFrame:
    """The best rows of each cell of a batch for the questions that want it."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, questions, asked = shared.value
        for batch in batches:
            cell = batch.column(2).to_numpy(zero_copy_only=False)
            keys = sortable(batch.column(0).to_numpy(zero_copy_only=False))
            _, vectors = usable_rows(batch.column(1), questions.shape[1])
            vectors = unit_rows(vectors)
            for c in np.unique(cell).tolist():
                mine, which = np.flatnonzero(cell == c), asked[c]
                best = BestRows(ids[which], questions[which], k)
                best.add(keys[mine], vectors[mine])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], names=["question_id", key, "score"])

    return rows.select(key, "embedding", "cell").mapInArrow(score, found_type)
