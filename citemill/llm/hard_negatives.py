"""Hard negatives of anchor vectors, filtered by rotated one-bit codes.

Every vector is rotated and coded by the signs of its components. The code's alignment with the vector, its mean
absolute component, is stored, and what the code leaves over is coded again, ``LEVELS`` times; the length of the last
rest is stored too. For an anchor, quantised to ``PLANES`` bit planes, the inner product with each code is a sum of
popcounts, and the sum of those by their alignments estimates the score. What the estimate lacks is the inner product
of the anchor with the rest and of the coded part with the anchor's quantisation error, which Cauchy and Schwarz bound
by the products of lengths: the interval holds always, not likely. Pairs whose interval cannot enter a result are
dropped, all others are scored in integers.

How the work is dealt: codes are made once and kept beside the vectors. A block of at most ``ANCHORS`` anchors travels
to the rows, which stay where they are; a task keeps its best rows for each anchor, and only those are shuffled. More
anchors go in passes, one after another, each written to the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from citemill.session import checkpoint_folder, delete_at_exit, stage

LEVELS, PLANES = 4, 8
SEED = 13
# Anchors of one pass, cells (anchors times rows) looked at together, and pairs scored together.
ANCHORS = 4096
CELLS = 1_000_000
SCORED = 50_000
SCALE = 256
# Components beyond this cannot be scored in a long.
LARGEST = 1 << 26
NONE = np.iinfo(np.int64).min

CODED = StructType([
    StructField("vec_id", LongType()), StructField("label", LongType()), StructField("vector", ArrayType(IntegerType())),
    StructField("codes", ArrayType(LongType())), StructField("weights", ArrayType(DoubleType())),
    StructField("length", DoubleType()), StructField("rest", DoubleType()),
])


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _padded(column: pa.Array, dim: int, kind) -> np.ndarray:
    """Rows of a list column as a matrix; shorter rows end in zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dim).all():
        return values.astype(kind).reshape(len(column), dim)
    out = np.zeros((len(column), dim), dtype=kind)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _lists(matrix: np.ndarray) -> pa.Array:
    rows, size = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * size), pa.array(matrix.ravel()))


def sign_codes(vectors: np.ndarray, turn: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, levels, words of 64 bits), the alignment of each, and the length of what they leave over."""
    rest = vectors @ turn.T
    rows, dim = rest.shape
    words = -(-dim // 64)
    codes, weights = np.zeros((rows, levels, words), dtype=np.uint64), np.zeros((rows, levels))
    for level in range(levels):
        signs = np.zeros((rows, words * 64), dtype=bool)
        signs[:, :dim] = rest > 0
        codes[:, level] = np.packbits(signs, axis=1, bitorder="little").view(np.uint64)
        weights[:, level] = np.abs(rest).mean(axis=1)
        rest = rest - weights[:, level : level + 1] * np.where(signs[:, :dim], 1.0, -1.0)
    return codes, weights, np.linalg.norm(rest, axis=1)


def coded_vectors(embeddings: DataFrame, relabel: Column, scale: int = SCALE, levels: int = LEVELS) -> DataFrame:
    """Integer vectors (floor of ``scale`` times each component) with their codes, a row for each vec_id."""
    x = F.col("embedding")
    out_of_range = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * scale) >= LARGEST))
    usable = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~out_of_range)
    rows = usable.select("vec_id", relabel.cast("long").alias("label"), "embedding")
    single = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.label", "r.embedding")
    dim = max(usable.agg(F.max(F.size("embedding"))).first()[0] or 1, 1)
    shared = embeddings.sparkSession.sparkContext.broadcast(rotation(dim))
    schema = to_arrow_schema(CODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = np.floor(scale * _padded(batch.column(2), dim, np.float64))
                codes, weights, rest = sign_codes(vectors, shared.value, levels)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), _lists(vectors.astype(np.int32)).cast(schema.field(2).type),
                    _lists(codes.reshape(len(vectors), -1).view(np.int64)).cast(schema.field(3).type),
                    _lists(weights).cast(schema.field(4).type), pa.array(np.linalg.norm(vectors, axis=1)), pa.array(rest),
                ], schema=schema)

    return stage(single.mapInArrow(run, CODED), "coded")


class _Rows:
    """Coded rows of one batch."""

    def __init__(self, batch: pa.RecordBatch, dim: int, levels: int):
        self.ids, self.labels = (batch.column(i).to_numpy() for i in (0, 1))
        self.vectors = _padded(batch.column(2), dim, np.int64)
        words = -(-dim // 64)
        self.codes = _padded(batch.column(3), levels * words, np.int64).view(np.uint64).reshape(-1, levels, words)
        self.weights = _padded(batch.column(4), levels, np.float64)
        self.length, self.rest = (batch.column(i).to_numpy() for i in (5, 6))

    def part(self, a: int, b: int) -> _Rows:
        out = object.__new__(_Rows)
        for name, value in vars(self).items():
            setattr(out, name, value[a:b])
        return out


class Anchors:
    """Anchors as bit planes: the rotated anchor is ``low + step * u`` with u of ``planes`` bits, up to ``error``."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, turn: np.ndarray, levels: int, planes: int = PLANES):
        self.ids, self.labels, self.vectors, self.levels = ids, labels, vectors, levels
        turned = vectors @ turn.T
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << planes) - 1), 1e-9)
        u = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        read = self.low[:, None] + self.step[:, None] * u
        self.total = read.sum(axis=1)
        self.error, self.length = np.linalg.norm(turned - read, axis=1), np.linalg.norm(turned, axis=1)
        words = -(-u.shape[1] // 64)
        bits = np.zeros((planes, len(ids), words * 64), dtype=bool)
        for j in range(planes):
            bits[j, :, : u.shape[1]] = u >> j & 1
        self.planes = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)

    def intervals(self, rows: _Rows) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the score of each anchor with each row."""
        estimate = np.zeros((len(self.ids), len(rows.ids)))
        for level in range(self.levels):
            dots = np.zeros(estimate.shape, dtype=np.int32)
            for word in range(self.planes.shape[2]):
                code = rows.codes[:, level, word]
                for j, plane in enumerate(self.planes[:, :, word]):
                    dots += np.bitwise_count(plane[:, None] & code[None, :]).astype(np.int32) << j
            ones = np.bitwise_count(rows.codes[:, level]).sum(axis=1)
            # The code has +1 where a bit is set and -1 elsewhere.
            along = 2 * (self.low[:, None] * ones[None, :] + self.step[:, None] * dots) - self.total[:, None]
            estimate += along * rows.weights[None, :, level]
        within = self.length[:, None] * rows.rest[None, :] + self.error[:, None] * (rows.length + rows.rest)[None, :]
        # The last term is far above what floating point loses on the way.
        within += 1e-6 * (1 + self.length[:, None] * rows.length[None, :])
        return estimate - within, estimate + within


class Best:
    """The k best (score, smaller id first) of each of ``groups`` groups."""

    def __init__(self, groups: int, k: int):
        self.k, self.groups = k, groups
        self.group, self.ids, self.scores = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.floor = np.full(groups, NONE)

    def add(self, group: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        group, ids, scores = (np.concatenate(x) for x in ((self.group, group), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, group))
        group, ids, scores = group[order], ids[order], scores[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        keep = place < self.k
        self.group, self.ids, self.scores = group[keep], ids[keep], scores[keep]
        last = place[keep] == self.k - 1
        self.floor[self.group[last]] = self.scores[last]


def _scores(anchors: Anchors, rows: _Rows, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    parts = [
        np.einsum("ij,ij->i", anchors.vectors[a[i : i + SCORED]], rows.vectors[r[i : i + SCORED]]) for i in range(0, len(a), SCORED)
    ]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _near(anchors: Anchors, rows: _Rows, best: Best) -> None:
    """Adds the best rows of each anchor's own label, the anchor left out."""
    own = (anchors.labels[:, None] == rows.labels[None, :]) & (anchors.ids[:, None] != rows.ids[None, :])
    low, high = anchors.intervals(rows)
    cut = best.floor.astype(np.float64)
    if own.shape[1] > best.k:
        # At least k rows of this part score as much as their lower bounds.
        low[~own] = -np.inf
        cut = np.maximum(cut, np.partition(low, own.shape[1] - best.k, axis=1)[:, own.shape[1] - best.k])
    a, r = np.nonzero(own & (high >= cut[:, None]))
    best.add(a, rows.ids[r], _scores(anchors, rows, a, r))


def _below(anchors: Anchors, rows: _Rows, best: Best, least: np.ndarray, most: np.ndarray) -> None:
    """Adds the best rows of other labels with a score from ``least`` to ``most``, for each positive of each anchor."""
    per = least.shape[1]
    floor = best.floor.reshape(least.shape)
    low, high = anchors.intervals(rows)
    cut = np.where(least <= most, np.maximum(least, floor), np.iinfo(np.int64).max).min(axis=1)
    possible = (high >= cut[:, None]) & (low <= most.max(axis=1)[:, None])
    a, r = np.nonzero(possible & (anchors.labels[:, None] != rows.labels[None, :]))
    scores = _scores(anchors, rows, a, r)
    inside = (scores[:, None] >= least[a]) & (scores[:, None] <= most[a])
    i, p = np.nonzero(inside)
    best.add(a[i] * per + p, rows.ids[r[i]], scores[i])


def _best_rows(coded: DataFrame, anchors, dim: int, levels: int, k: int, groups: int, visit, schema: str) -> DataFrame:
    """(g, other, score): the best rows of each task, g a number of a group. ``visit`` adds what a part of the rows has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        them, *more = anchors.value
        best = Best(groups, k)
        size = max(CELLS // len(them.ids), 1)
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                visit(them, _Rows(part, dim, levels), best, *more)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.group, best.ids, best.scores)], names=["g", "other", "score"])

    return coded.mapInArrow(run, schema)


def _ranked(df: DataFrame, k: int, *group: str) -> DataFrame:
    window = Window.partitionBy(*group).orderBy(F.col("score").desc(), "other")
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _block(rows: pa.Table, dim: int, turn: np.ndarray, levels: int) -> Anchors:
    rows = rows.combine_chunks()
    vectors = _padded(rows["vector"].combine_chunks(), dim, np.int64)
    return Anchors(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), vectors, turn, levels)


def hard_negatives(
    embeddings: DataFrame, is_anchor: Column, relabel: Column | None = None, positives: int = 5, negatives: int = 5,
    percent: int = 80, scale: int = SCALE, levels: int = LEVELS, anchors_at_once: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``embeddings`` has vec_id, embedding and label; other columns are not read. ``is_anchor`` is a condition on vec_id,
    ``relabel`` what a label becomes first. An anchor's positives are its first rows of the same label, itself left out;
    a positive's negatives are the first rows of other labels with ``percent * positive <= 100 * negative <= 100 *
    positive`` (a negative positive score has none). First is the highest score, then the smallest vec_id; fewer are
    given where there are fewer.

    A null id, label or vector, and a vector with a null or non-finite component, or one that ``scale`` takes beyond
    2^26, take no part. A shorter vector ends in zeros. Of rows that repeat a vec_id the one with the smallest label
    and then vector counts. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    coded = coded_vectors(embeddings, F.col("label") if relabel is None else relabel, scale, levels)
    chosen = coded.where(is_anchor).select("vec_id", "label", "vector")
    count, first = chosen.count(), coded.select(F.size("vector")).first()
    found = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long, rank int"
    folder = f"{checkpoint_folder(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    blocks = -(-count // anchors_at_once)
    for number in range(blocks):
        mine = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).toArrow()
        if mine.num_rows:
            _write_pass(f"{folder}/pass={number}", coded, mine, first[0], positives, negatives, percent, levels)
    out = spark.read.schema(found).parquet(folder) if count else spark.createDataFrame([], found)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _write_pass(
    path: str, coded: DataFrame, mine: pa.Table, dim: int, positives: int, negatives: int, percent: int, levels: int
) -> None:
    spark = coded.sparkSession
    anchors = _block(mine, dim, rotation(dim), levels)
    n, triple = len(anchors.ids), "g long, other long, score long"
    shared = spark.sparkContext.broadcast((anchors,))
    near = _ranked(_best_rows(coded, shared, dim, levels, positives, n, _near, triple), positives, "g").toArrow()
    g, place = near["g"].to_numpy(), near["rank"].to_numpy() - 1
    # No positive: a range that holds nothing.
    least, most = np.full((n, positives), 1), np.full((n, positives), NONE)
    names = np.zeros((n, positives), dtype=np.int64)
    most[g, place] = near["score"].to_numpy()
    least[g, place] = -((-percent * most[g, place]) // 100)
    names[g, place] = near["other"].to_numpy()
    ranges = spark.sparkContext.broadcast((anchors, least, most))
    below = _ranked(_best_rows(coded, ranges, dim, levels, negatives, n * positives, _below, triple), negatives, "g")
    groups = spark.createDataFrame(pa.table({
        "g": np.arange(n * positives), "anchor_id": np.repeat(anchors.ids, positives), "positive_id": names.ravel(),
        "positive_score": most.ravel(),
    }))
    # At most anchors_at_once * positives groups.
    below.join(F.broadcast(groups), "g").select(
        "anchor_id", "positive_id", "positive_score", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"), "rank"
    ).write.parquet(path)
    for used in (shared, ranges):
        used.destroy()


def label_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the vectors whose vec_id is divisible by 100; labels of ids divisible by 7 are moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings, F.col("vec_id") % 100 == 0, moved)
