"""Near-duplicate documents by minhash with tensored banding.

Two collections of ``keys`` small hash keys are computed for each document,
each key of ``hashes`` minhashes. A table of the usual banding is a pair of one
key from either collection, so ``keys ** 2`` tables of ``2 * hashes`` minhashes
cost ``2 * keys * hashes`` minhashes. Documents at the threshold of 0.8 share
no table with probability 2e-4 at the defaults, at 0.9 with 1e-7.

How the work is dealt:

* documents with the same shingle set are one class from the start;
* only keys that another class has are paired, which few documents have;
* a table's classes are tied to its smallest one, its head. The classes of a
  head are cut into blocks of bounded size, and each pair of blocks is a group of
  its own: candidates (a shared table) are confirmed there on full sets, and
  only links that join something leave the task. No pair is written out, a hot
  head becomes many groups, and nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from citemill.llm.batches import map_texts
from citemill.llm.components import components
from citemill.llm.minhash import half_keys, jaccard_at_least, set_hashes, shingle_sets
from citemill.session import stage

KEYS, HASHES = 13, 3
BLOCK_SHINGLES = 1_000_000
SIGNATURE = StructType([
    StructField("doc_id", LongType()), StructField("n_shingles", LongType()), StructField("set1", LongType()),
    StructField("set2", LongType()), StructField("a", ArrayType(LongType())), StructField("b", ArrayType(LongType())),
])


def signatures(docs: DataFrame, width: int, keys: int = KEYS, hashes: int = HASHES) -> DataFrame:
    """Size and hash of each document's shingle set and its two collections of keys (null without shingles)."""

    def run(ids: list, texts: list) -> list:
        sets = shingle_sets(texts, width)
        full = [i for i, s in enumerate(sets) if len(s)]
        one, two, a, b = ([None] * len(ids) for _ in range(4))
        if full:
            some = [sets[i] for i in full]
            totals = set_hashes(some).view(np.int64).tolist()
            first, second = (half_keys(some, keys, hashes, seed).view(np.int64).tolist() for seed in (1, 2))
            for i, total, x, y in zip(full, totals, first, second):
                one[i], two[i], a[i], b[i] = *total, x, y
        return [ids, [len(s) for s in sets], one, two, a, b]

    return map_texts(docs, run, SIGNATURE, ["doc_id", "text"])


def _shared(reps: DataFrame, side: str) -> DataFrame:
    """(id, keys): the numbered keys of one collection that another class has too."""
    each = reps.select("id", F.posexplode(side).alias("place", "key")).select(
        "id", F.xxhash64("place", "key").alias("key")
    )
    common = each.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    return each.join(common, "key").groupBy("id").agg(F.collect_list("key").alias(side))


def _block_links(width: int, percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        head = key[0].as_py()
        rows = table.select(["id", "heads", "a", "b", "text", "side"]).to_pydict()
        ids, left, right = np.array(rows["id"]), np.array(rows["side"]) != 1, np.array(rows["side"]) != 0
        n = len(ids)
        sets = shingle_sets(rows["text"], width)
        sizes = np.array([len(s) for s in sets])
        a, b = np.array(rows["a"]), np.array(rows["b"])
        # Classes that share a smaller head are compared in that head's group.
        lower = sorted({h for hs in rows["heads"] for h in hs if h < head})
        place = {h: i for i, h in enumerate(lower)}
        marks = np.zeros((n, len(lower)), dtype=np.float32)
        for i, hs in enumerate(rows["heads"]):
            for h in hs:
                if h < head:
                    marks[i, place[h]] = 1
        parent = list(range(n))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = []
        others = np.flatnonzero(right)
        for i in np.flatnonzero(left).tolist():
            js = others[others > i] if right[i] else others
            ok = (a[js] == a[i]).any(axis=1) & (b[js] == b[i]).any(axis=1)
            ok &= 100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i])
            js = js[ok]
            if len(js) and lower:
                js = js[marks[js] @ marks[i] == 0]
            for j in js.tolist():
                x, y = find(i), find(j)
                if x != y and jaccard_at_least(sets[i], sets[j], percent):
                    parent[y] = x
                    links.append((ids[i], ids[j]))
        return pa.table({
            "x": pa.array([int(x) for x, _ in links], pa.int64()), "y": pa.array([int(y) for _, y in links], pa.int64())
        })

    return run


def class_links(texts: DataFrame, reps: DataFrame, width: int, percent: int, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Confirmed links (x, y) that connect whatever classes are alike.

    ``reps`` (id, n_shingles, a, b) has a row for each class, ``texts`` (id, text) the text of its representative.
    """
    halves = stage(_shared(reps, "a").join(_shared(reps, "b"), "id"), "halves")
    tables = stage(
        halves.select("id", F.explode("a").alias("p"), "b").select("id", "p", F.explode("b").alias("q"))
        .select("id", F.xxhash64("p", "q").alias("key")), "tables",
    )
    heads = tables.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").select("key", "head")
    # A class is under the heads of its tables, its own name among them when it is one.
    under = stage(tables.join(heads, "key").select("head", "id").distinct(), "under")
    sized = reps.select("id", "n_shingles", "a", "b")
    tied = under.groupBy("id").agg(F.collect_list("head").alias("heads"))  # at most keys ** 2
    members = stage(texts.join(tied, "id").join(sized, "id"), "members")
    parts = (
        under.join(members.select("id", "n_shingles"), "id").groupBy("head")
        .agg(F.ceil(F.sum("n_shingles") / F.lit(block)).cast("int").alias("parts"))
    )
    placed = (
        under.join(members, "id").join(parts, "head")
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        # Group (i, j) holds parts i and j, with i <= j; a part is side 0 as i, 1 as j, 2 as both.
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "head", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
            F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("side"),
            "id", "heads", "a", "b", "text",
        )
    )
    return placed.groupBy("head", "i", "j").applyInArrow(_block_links(width, percent), "x long, y long")


def near_duplicates(
    docs: DataFrame, shingle_words: int = 5, percent: int = 80, keys: int = KEYS, hashes: int = HASHES,
    block: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; other columns are not read).

    Documents are linked when 100 * intersection >= ``percent`` * union of their distinct shingles. ``component_id`` is
    the smallest doc_id reachable. A null or blank text has no shingles and is linked with nothing. A row without
    doc_id is linked with nothing and kept, its component null. Rows that repeat a doc_id share its component.
    """
    signed = stage(signatures(docs, shingle_words, keys, hashes), "signed")
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    reps = stage(
        known.groupBy("set1", "set2").agg(
            F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("a").alias("a"), F.first("b").alias("b")
        ), "classes",
    )
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("id IS NOT NULL AND text IS NOT NULL")
    links = stage(class_links(texts, reps, shingle_words, percent, block), "links")
    found = components(links, "x", "y")
    classes = reps.select("set1", "set2", F.col("id").alias("first")).join(
        found.select(F.col("node").alias("first"), "component"), "first", "left"
    ).select("set1", "set2", F.coalesce("component", "first").alias("component"))
    return signed.join(classes, ["set1", "set2"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )
