"""Passages that repeat across documents, found by difference-cover anchors.

A difference cover D of a period v holds, for any two positions i and j, an
offset below v that takes both to a residue in D. So two equal windows of
``window`` words share an equal anchor of ``window - v + 1`` words that starts
at a cover position in either document, and hashing the cover positions alone
(6 of 31) finds every match. Around anchors that another document has, matches
are extended: every window there is hashed in full with 128 bits, and the
smallest document of each window decides. Counting goes by groups that are
combined before the shuffle; no group of equal passages is gathered or paired.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import combinations
from math import isqrt

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from citemill.llm.batches import flat, map_texts, window_hashes, word_hashes, words
from citemill.session import stage

WINDOW, PERIOD = 50, 31
EMPTY = hashlib.sha256(b"").hexdigest()


@lru_cache(maxsize=8)
def difference_cover(period: int) -> tuple[int, ...]:
    """Residues whose differences give every residue of ``period``: the smallest such set for short periods, else
    the first residues and the multiples of their number."""
    if period <= 40:
        for size in range(1, period + 1):
            for rest in combinations(range(2, period), max(0, size - 2)):
                cover = ((0, 1) + rest)[:size]
                if len({(x - y) % period for x in cover for y in cover}) == period:
                    return cover
    step = isqrt(period - 1) + 1
    return tuple(sorted({*range(step), *range(0, period, step)}))


def _anchor_places(length: int, cover: tuple[int, ...], period: int) -> np.ndarray:
    places = np.arange(length)
    return places[np.isin(places % period, cover)]


FIRST = StructType([
    StructField("doc_id", LongType()), StructField("part", LongType()), StructField("n_words", LongType()), StructField("text1", LongType()),
    StructField("text2", LongType()), StructField("whole", StringType()), StructField("anchors", ArrayType(LongType())),
])
WINDOWS = StructType([
    StructField("doc_id", LongType()), StructField("part", LongType()), StructField("window1", LongType()), StructField("window2", LongType()),
    StructField("starts", ArrayType(IntegerType())),
])
KEPT = StructType([
    StructField("doc_id", LongType()), StructField("part", LongType()), StructField("n_removed", LongType()),
    StructField("kept_sha256", StringType()),
])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _first(window: int, period: int):
    cover, width = difference_cover(period), window - period + 1

    def run(ids: list, parts: list, texts: list) -> list:
        split = [words(t) for t in texts]
        tokens, ends = flat(split)
        (hashes,) = word_hashes(tokens, (1,))
        anchors = window_hashes(hashes, width).view(np.int64)
        out, one, two, whole = [], [], [], []
        for ws, start in zip(split, ends[:-1].tolist()):
            joined = b" ".join(ws)
            digest = xxhash.xxh3_128_intdigest(joined)
            one.append(_signed(digest >> 64))
            two.append(_signed(digest & (1 << 64) - 1))
            whole.append(hashlib.sha256(joined).hexdigest())
            # A text below the window holds no match.
            n = len(ws) - width + 1 if len(ws) >= window else 0
            out.append(anchors[start + _anchor_places(n, cover, period)])
        return [ids, parts, [len(w) for w in split], one, two, whole, out]

    return run


def _windows(window: int, period: int):
    cover, width = difference_cover(period), window - period + 1

    def run(ids: list, parts: list, places: list, texts: list) -> list:
        tokens, ends = flat([words(t) for t in texts])
        first, second = word_hashes(tokens, (2, 3))
        one = window_hashes(first, window)
        two = window_hashes(second, window, 0xD6E8FEB86659FD93)
        doc, of, h1, h2, starts = [], [], [], [], []
        for i, part, found, a, b in zip(ids, parts, places, ends[:-1].tolist(), ends[1:].tolist()):
            at = _anchor_places(b - a - width + 1, cover, period)
            found = np.array(found)
            at = at[found[found < len(at)]]
            near = np.zeros(b - a + 1, dtype=np.int32)
            np.add.at(near, np.maximum(0, at - period + 1), 1)
            np.add.at(near, at + 1, -1)
            at = np.flatnonzero(np.cumsum(near)[: b - a - window + 1])
            # Windows of one document with equal words are one row.
            order = np.lexsort((at, two[a + at], one[a + at]))
            at = at[order]
            x, y = one[a + at], two[a + at]
            new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(at) else at
            doc += [i] * len(new)
            of += [part] * len(new)
            h1.append(x[new])
            h2.append(y[new])
            starts += np.split(at.astype(np.int32), new[1:]) if len(at) else []
        join = lambda found: (np.concatenate(found) if found else np.zeros(0, np.uint64)).view(np.int64)
        return [doc, of, join(h1), join(h2), starts]

    return run


def _cut(window: int):
    def run(ids: list, parts: list, starts: list, texts: list) -> list:
        removed, digests = [], []
        for at, text in zip(starts, texts):
            ws = words(text)
            change = np.zeros(len(ws) + 1, dtype=np.int32)
            at = np.array(at, dtype=np.int64)
            at = at[at + window <= len(ws)]
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
            left = np.flatnonzero(np.cumsum(change[:-1]) == 0)
            removed.append(len(ws) - len(left))
            digests.append(hashlib.sha256(b" ".join([ws[k] for k in left.tolist()])).hexdigest())
        return [ids, parts, removed, digests]

    return run


def _parted(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text): ``part`` tells the texts of one doc_id apart, and is zero where there is one text alone."""
    rows, code = docs.select("doc_id", "text"), F.coalesce(F.xxhash64("text"), F.lit(0))
    many = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(code).alias("low"), F.max(code).alias("high")).where("low < high")
    many = stage(many.select("doc_id", F.lit(True).alias("many")), "many")
    if many.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("long").alias("part"), "text")
    told = rows.join(many, "doc_id", "left")
    return told.select("doc_id", F.when(F.col("many"), code).otherwise(0).cast("long").alias("part"), "text")


def shared_passages(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs`` (doc_id, text; other columns are not read).

    A word is removed when a window of ``window`` words that covers it also starts in a document with a smaller doc_id.
    Windows are judged on the input. ``kept_sha256`` is of the kept words joined by one space. A null text has no
    words; a text of fewer words than the window keeps all. A row without doc_id is no source and loses nothing. Rows
    that repeat a doc_id are one document for the comparison: none is a source for another, and each loses what is in a
    document with a smaller doc_id.
    """
    if not 1 <= period <= window:
        raise ValueError("the period must be between 1 and the window")
    docs, row = _parted(docs), ["doc_id", "part"]
    first = stage(map_texts(docs, _first(window, period), FIRST, [*row, "text"]), "anchors")
    long = first.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    # Later copies of a whole text lose every word; the first stands for them as a source too.
    texts = long.groupBy("text1", "text2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
    copies = stage(
        long.select(*row, "text1", "text2").join(texts.where("source < last"), ["text1", "text2"])
        .where("doc_id > source").select(*row).distinct(), "copies",
    )

    each = long.select(*row, F.posexplode("anchors").alias("place", "anchor"))
    apart = [F.min("doc_id").alias("low"), F.max("doc_id").alias("high")]
    common = each.groupBy("anchor").agg(*apart).where("low < high").select("anchor")
    found = stage(each.join(common, "anchor").join(copies, row, "left_anti"), "found")
    # Without the copies, fewer anchors are in two documents.
    common = found.groupBy("anchor").agg(*apart).where("low < high").select("anchor")
    places = found.join(common, "anchor").groupBy(*row).agg(F.collect_list("place").alias("places"))
    near = stage(
        docs.where("text IS NOT NULL").join(places, row).select(*row, "places", "text"), "near"
    )

    windows = stage(map_texts(near, _windows(window, period), WINDOWS, [*row, "places", "text"]), "windows")
    repeated = windows.groupBy("window1", "window2").agg(*apart).where("low < high").drop("high")
    starts = (
        windows.join(repeated, ["window1", "window2"]).where("doc_id > low")
        .groupBy(*row).agg(F.flatten(F.collect_list("starts")).alias("starts"))
    )
    cut = map_texts(near.select(*row, "text").join(starts, row), _cut(window), KEPT, [*row, "starts", "text"])
    cut = cut.groupBy(*row).agg(F.max("n_removed").alias("n_removed"), F.max("kept_sha256").alias("kept_sha256"))
    gone = F.col("copy") & (F.col("n_words") >= window)
    return (
        first.select(*row, "n_words", "whole").join(copies.withColumn("copy", F.lit(True)), row, "left")
        .join(cut, row, "left")
        .select(
            "doc_id", "n_words",
            F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(gone, EMPTY).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        )
    )
