"""Near-duplicate documents by simhash fingerprints that differ in few bits.

Two 64-bit fingerprints that differ in at most 2 bits have at least 6 of their 8 bytes in common, place by place. The
inverted index therefore lists fingerprints by bytes and their places. A list of one byte would hold 1/256 of the
corpus and tally most pairs in vain, so lists are kept by every six of the eight places at once: a pair that reaches
the 6 matches is together in a list, one that does not in none. A list holds at most 65,536 different fingerprints,
as two bytes are free, however large the corpus is. Within it shared bytes are tallied, pairs that reach the count are
verified bit by bit, and each link is written by one list only.

How the work is dealt: equal fingerprints are one entry of the index; entries are shuffled and sorted by list and
stream through numpy. A list of more than ``SMALL`` looks up the 136 two-byte differences of at most two bits instead
of its pairs, so its work and its links are in proportion to its entries. Links become components by repeated joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from citemill.llm.batches import text_column
from citemill.llm.components import components
from citemill.session import stage

SEED, BITS = 42, 2
PLACES = 8
SMALL = 24
CHUNK = 50_000
# The two places that a list leaves free.
FREE = tuple(combinations(range(PLACES), BITS))


def fingerprint(text: str | None, width: int) -> int:
    """The fingerprint as a signed number; zero without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    digest, ends = xxhash.xxh64_intdigest, ends[width - 1 :].tolist()
    counts, n = np.zeros(64, dtype=np.int64), len(ends)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text from its shingles of ``width`` words, repeats included."""

    def run(texts: list) -> list:
        return [fingerprint(t, width) for t in texts]

    return docs.select("doc_id", text_column(run, LongType(), "text").alias("fp"))


def _entries(classes: DataFrame) -> DataFrame:
    """(place, rest, fp): the entry of each fingerprint in each of its lists."""

    def mask(free: tuple[int, int]) -> int:
        kept = ~sum(0xFF << 8 * p for p in free) & (1 << 64) - 1
        return kept - (1 << 64) if kept >> 63 else kept

    lists = F.explode(F.array(*[
        F.struct(F.lit(i).alias("place"), F.col("fp").bitwiseAND(F.lit(mask(free))).alias("rest")) for i, free in enumerate(FREE)
    ]))
    return classes.select("fp", lists.alias("e")).select("e.place", "e.rest", "fp")


def _keep(x: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
    """Which differences x of two entries of a list are links that this list writes: places in common are tallied, the
    count and the bits are checked, and of the lists that hold a pair the first one writes it."""
    differ = x.view(np.uint8).reshape(-1, PLACES) != 0
    enough = PLACES - differ.sum(axis=1) >= PLACES - bits
    ok = enough & (np.bitwise_count(x) <= bits)
    # One place differs: seven lists hold the pair, which have that place and another one free.
    one = differ.sum(axis=1) == 1
    at = differ.argmax(axis=1)
    other = np.where(at == 0, 1, 0)
    free = np.array(FREE)[place]
    low, high = np.minimum(at, other), np.maximum(at, other)
    return ok & (~one | ((free[:, 0] == low) & (free[:, 1] == high)))


def _pairs_of_small(group: np.ndarray, place: np.ndarray, fp: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links in lists of few entries, which lie side by side."""
    for step in range(1, SMALL):
        i = np.flatnonzero(group[:-step] == group[step:]) if step < len(group) else np.zeros(0, dtype=np.int64)
        if not len(i):
            return
        ok = i[_keep(fp[i] ^ fp[i + step], place[i], bits)]
        yield fp[ok], fp[ok + step]


def _pairs_of_large(place: int, fp: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links in one list of many entries: every difference that two free bytes allow is looked up."""
    low, high = FREE[place]
    first, second = ((fp >> np.uint64(8 * p)) & np.uint64(0xFF) for p in (low, high))
    free = (first | second << np.uint64(8)).astype(np.int64)
    found = np.full(1 << 16, -1, dtype=np.int64)
    found[free] = np.arange(len(fp))
    steps = [sum(1 << b for b in bs) for k in range(1, bits + 1) for bs in combinations(range(16), k)]
    for step in steps:
        other = found[free ^ step]
        i = np.flatnonzero(other > np.arange(len(fp)))
        if len(i):
            ok = i[_keep(fp[i] ^ fp[other[i]], np.full(len(i), place), bits)]
            yield fp[ok], fp[other[ok]]


def _list_links(bits: int):
    """Links of sorted entries. A list may run over several batches: the last one of a batch waits for the next."""

    def links(place: np.ndarray, rest: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(fp), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (rest[1:] != rest[:-1])
        group = np.cumsum(new) - 1
        sizes = np.bincount(group) if len(group) else np.zeros(0, dtype=np.int64)
        small = (sizes[group] > 1) & (sizes[group] <= SMALL)
        found = list(_pairs_of_small(group[small], place[small], fp[small], bits))
        starts = np.flatnonzero(new)
        for g in np.flatnonzero(sizes > SMALL).tolist():
            a, b = starts[g], starts[g] + sizes[g]
            found += _pairs_of_large(int(place[a]), fp[a:b], bits)
        for x, y in found:
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns = [columns[0], columns[1], columns[2].view(np.uint64)]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            place, rest, _ = columns
            last = (place == place[-1]) & (rest == rest[-1])
            cut = len(last) - int(last.sum())
            held = [c[cut:] for c in columns]
            yield from links(*[c[:cut] for c in columns])
        if held is not None:
            yield from links(*held)

    return run


def fingerprint_links(classes: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (x, y) between all different fingerprints of ``classes`` (fp) that differ in at most ``bits`` bits (1 or
    2), each once."""
    if not 1 <= bits <= BITS:
        raise ValueError("bits is 1 or 2: lists are kept by six of eight bytes")
    entries = _entries(classes)
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(parts, "place", "rest").sortWithinPartitions("rest", "place")
    return dealt.mapInArrow(_list_links(bits), "x long, y long")


def simhash_components(docs: DataFrame, width: int = 3, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text; other columns are not read).

    A-Z is lower-cased. A text with fewer than ``width`` words is one shingle; a null or blank text has the fingerprint
    zero and links like any other. ``component_id`` is the smallest doc_id reachable over fingerprints that differ in at
    most ``bits`` bits. Rows without doc_id link like others and have the component of those they reach, null if none
    of them has an id. Rows that repeat a doc_id each have the component of their own text.
    """
    signed = stage(fingerprints(docs, width), "fingerprints")
    classes = stage(signed.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = components(stage(fingerprint_links(classes.select("fp"), bits), "links"), "x", "y")
    named = classes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = stage(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "labels")
    return signed.join(labels, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
