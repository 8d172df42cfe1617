"""Benchmark decontamination: every passage of the corpus is a query against an index of the test items.

The items are indexed for BM25 with block-max WAND: postings sorted by item in
blocks that keep their largest weight. A weight is divided by the item's own
score, so an item's score against a passage is the share of itself that is
found there, and one threshold serves all items. Terms are pairs of neighbouring
words: single words are so common that the bounds of nearly every passage reach
the threshold. A passage retrieves all items
at or above it: terms whose bounds cannot reach the threshold together are
passed over, and blocks that cannot are skipped.

Passages are windows of words that overlap by half, as long as two items of the
greatest length, so that any item lies whole in one. Retrieved items are then
verified: the question (the item without its last part) and the answer (its last
part) must both be in the document, in words that follow each other. An item too
short for a run in either part must be there as a whole. In scripts that are
written without spaces every character is a word.

The index is made of the benchmark alone. Its size is checked against a bound
before it is sent to the executors; larger sets of items are dealt in parts by
their ids, and the parts are built one after the other. Weights in a part are
those of the whole benchmark, whose counts Spark takes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from math import log

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from citemill.llm.batches import map_texts, text_column
from citemill.session import stage

K1, B = 1.2, 0.75
SHARE = 0.5
QUESTION, ANSWER = 0.7, 0.7
ANSWER_SHARE = 0.25
RUN = 3
BLOCK = 16
INDEX_CHARS = 50_000_000
HITS = StructType([
    StructField("doc_id", LongType()), StructField("item_id", LongType()), StructField("score", DoubleType()),
    StructField("question_overlap", DoubleType()), StructField("answer_overlap", DoubleType()),
])
# Letters and vowel signs of scripts without spaces between words: Thai, Lao, Burmese, Khmer, Tai, kana, Bopomofo and Han.
_UNSPACED = (
    "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ebd\u0ec0-\u0ece\u0edc-\u0edf\u1000-\u103f\u1050-\u108f\u109a-\u109d\u1780-\u17b3\u17b6-\u17d3"
    "\u17d7\u17dc\u17dd\u1950-\u19cf\u1a20-\u1a7c\u3005-\u3007\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3105-\u312f\u31a0-\u31bf"
    "\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9fe\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003fffd"
)
_WORD = re.compile(r"[^\W_]+")
_WORD_OR_CHARACTER = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_MAYBE_UNSPACED = re.compile("[\u0e01-\U0010ffff]")


def terms(text: str | None) -> list[str]:
    """Words in lower case; characters where a script has no spaces."""
    if not text:
        return []
    return (_WORD_OR_CHARACTER if not text.isascii() and _MAYBE_UNSPACED.search(text) else _WORD).findall(text.lower())


def pairs(words: list[str]) -> list[tuple[str, ...]]:
    """The index terms of a text: neighbouring words, or the only word by itself."""
    return list(zip(words, words[1:])) or [tuple(words)] * len(words)


@dataclass(slots=True)
class Postings:
    """Items that have a term, ascending, with their weights, and the largest weight of each block and of all."""

    items: list[int]
    weights: list[float]
    block_max: list[float] = field(default_factory=list)
    most: float = 0.0


@dataclass(slots=True)
class Counts:
    """Of all items: their number, mean and greatest length in terms, and the items that have a term, for those of a part."""

    items: int
    mean: float
    longest: int
    having: dict[tuple, int]


class Index:
    """BM25 index of items given as (item_id, text). ``counts`` are those of all items if these are a part of them."""

    def __init__(
        self, items: list[tuple[int, str]], k1: float = K1, b: float = B, block: int = BLOCK, counts: Counts | None = None
    ):
        # Rows without id or words cannot be found; an id's rows in the order of their texts.
        listed = sorted((i, t) for i, t in items if i is not None and terms(t))
        self.ids = [i for i, _ in listed]
        items_words = [terms(t) for _, t in listed]
        self.terms = [pairs(ws) for ws in items_words]
        self.block = block
        found: dict[tuple, dict[int, int]] = {}
        for n, ts in enumerate(self.terms):
            for t in ts:
                own = found.setdefault(t, {})
                own[n] = own.get(n, 0) + 1
        if counts is None:
            counts = Counts(
                len(listed), sum(map(len, self.terms)) / len(listed) if listed else 1.0, max(map(len, self.terms), default=0),
                {t: len(own) for t, own in found.items()},
            )
        self.longest, mean = counts.longest, counts.mean
        self.postings: dict[tuple, Postings] = {}
        own_score = [0.0] * len(listed)
        raw: dict[tuple, dict[int, float]] = {}
        for t, own in found.items():
            idf = log(1 + (counts.items - counts.having[t] + 0.5) / (counts.having[t] + 0.5))
            raw[t] = {
                n: idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(self.terms[n]) / mean)) for n, tf in own.items()
            }
            for n, w in raw[t].items():
                own_score[n] += w
        for t, weights in raw.items():
            ns = sorted(weights)
            ws = [weights[n] / own_score[n] for n in ns]
            self.postings[t] = Postings(ns, ws, [max(ws[i : i + block]) for i in range(0, len(ws), block)], max(ws))
        self.bounds = {t: p.most for t, p in self.postings.items()}
        # Items of one word: texts of more words have no such term.
        self.single: dict[str, list[int]] = {}
        self.runs = []
        for n, ts in enumerate(items_words):
            if len(ts) == 1:
                self.single.setdefault(ts[0], []).append(n)
            if len(ts) < 2 * RUN:
                # Too short for a run of words in either part: the whole item is question and answer.
                self.runs.append((len(ts), {tuple(ts)}, {tuple(ts)}))
                continue
            # The answer is the last part of the item, one run of words at least.
            answer = max(RUN, round(len(ts) * ANSWER_SHARE))
            self.runs.append((RUN, _runs(ts[:-answer]), _runs(ts[-answer:])))

    def retrieve(self, query: set[tuple], least: float) -> list[tuple[int, float]]:
        """(number of item, score) of all items with a score of ``least`` or more, by block-max WAND."""
        lists = [self.postings[t] for t in sorted(query) if t in self.postings]
        at = [0] * len(lists)
        out, slack, size = [], 1e-9, self.block
        order = list(range(len(lists)))
        while True:
            order = sorted((k for k in order if at[k] < len(lists[k].items)), key=lambda k: lists[k].items[at[k]])
            # The pivot is the first list up to which the bounds reach the threshold.
            bound, pivot = 0.0, -1
            for place, k in enumerate(order):
                bound += lists[k].most
                if bound + slack >= least:
                    pivot = place
                    break
            if pivot < 0:
                return out
            item = lists[order[pivot]].items[at[order[pivot]]]
            while pivot + 1 < len(order) and lists[order[pivot + 1]].items[at[order[pivot + 1]]] == item:
                pivot += 1
            # Blocks where the item would be, if the lists before the pivot have it.
            ahead = [bisect_left(lists[k].items, item, at[k]) for k in order[: pivot + 1]]
            tight = sum(lists[k].block_max[a // size] for k, a in zip(order, ahead) if a < len(lists[k].items))
            if tight + slack >= least:
                score = 0.0
                for k, a in zip(order, ahead):
                    if a < len(lists[k].items) and lists[k].items[a] == item:
                        score += lists[k].weights[a]
                        a += 1
                    at[k] = a
                if score + slack >= least:
                    out.append((item, score))
            else:
                # No item before the nearest end of these blocks, or the next list's item, can reach it.
                ends = [
                    lists[k].items[min(len(lists[k].items), (a // size + 1) * size) - 1] + 1
                    for k, a in zip(order, ahead) if a < len(lists[k].items)
                ]
                if pivot + 1 < len(order):
                    ends.append(lists[order[pivot + 1]].items[at[order[pivot + 1]]])
                target = max(item + 1, min(ends, default=item + 1))
                for k in order[: pivot + 1]:
                    at[k] = bisect_left(lists[k].items, target, at[k])

    def leaks(self, words: list[str], least: float, question: float, answer: float) -> list[tuple[int, float, float, float]]:
        """(item_id, score, question overlap, answer overlap) of the items that a text of these words gives away."""
        ts = pairs(words)
        width = max(2 * self.longest, 1)
        # The bounds of all words of a window are above those of its distinct words; most windows end here.
        get = self.bounds.get
        if not ts:
            return []
        # The only word of an item is all of its score.
        best = {n: 1.0 for w in self.single.keys() & set(words) for n in self.single[w]} if self.single and least <= 1 else {}
        sums = np.zeros(len(ts) + 1)
        np.cumsum(np.array(list(map(get, ts, repeat(0.0)))), out=sums[1:])
        starts = np.arange(0, max(1, len(ts) - width // 2), max(1, width // 2))
        reach = sums[np.minimum(starts + width, len(ts))] - sums[starts] + 1e-9 >= least
        for start in starts[reach].tolist():
            for n, score in self.retrieve(set(ts[start : start + width]), least):
                best[n] = max(score, best.get(n, 0.0))
        out = []
        if best:
            of_length: dict[int, set[tuple[str, ...]]] = {}
            for n, score in sorted(best.items()):
                length, *parts = self.runs[n]
                if length not in of_length:
                    of_length[length] = _runs(words, length)
                asked, told = (len(r & of_length[length]) / len(r) for r in parts)
                if asked >= question and told >= answer:
                    out.append((self.ids[n], score, asked, told))
        return out


def _runs(ts: list[str], length: int = RUN) -> set[tuple[str, ...]]:
    """Runs of ``length`` words."""
    return {tuple(ts[i : i + length]) for i in range(len(ts) - length + 1)}


def _distinct_terms(texts: list) -> list[dict]:
    """The number of index terms of each text and the distinct ones, written as words with a space between."""
    found = [pairs(terms(t)) for t in texts]
    return [{"n": len(ts), "terms": sorted({" ".join(t) for t in ts})} for ts in found]


def _indexes(items: DataFrame, bound: int) -> Iterator[Broadcast]:
    """Indexes of the items in parts of at most ``bound`` characters (the rows of one item_id at least), one at a time.
    All rows of an item_id are in one part."""
    items = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    context = items.sparkSession.sparkContext
    size = items.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    if size <= bound:
        rows = [tuple(r) for r in items.distinct().toLocalIterator()]
        if rows:
            yield context.broadcast(Index(rows))
        return
    # Several buckets go to a part, so that parts come near the bound though buckets differ in size.
    part = F.pmod(F.xxhash64("item_id"), F.lit(4 * -(-size // max(1, bound))))
    kind = StructType([StructField("n", LongType()), StructField("terms", ArrayType(StringType()))])
    listed = stage(
        items.distinct().select("item_id", "text", part.alias("part"), text_column(_distinct_terms, kind, "text").alias("t"))
        .select("item_id", "text", "part", "t.*").where("n > 0"), "items",
    )
    total = listed.agg(F.count("*").alias("items"), F.mean("n").alias("mean"), F.max("n").alias("longest")).first()
    found = listed.select("part", F.explode("terms").alias("term")).groupBy("term", "part").count()
    having = stage(found.join(found.groupBy("term").agg(F.sum("count").alias("having")), "term").select("term", "part", "having"), "having")
    parts: list[list[int]] = []
    filled = 0
    for row in listed.groupBy("part").agg(F.sum(F.length("text").cast("long")).alias("size")).orderBy("part").collect():
        if not parts or filled + row["size"] > bound:
            parts.append([])
            filled = 0
        parts[-1].append(row["part"])
        filled += row["size"]
    for chosen in parts:
        counts = Counts(total["items"], total["mean"], total["longest"], {
            tuple(r[0].split(" ")): r[1]
            for r in having.where(F.col("part").isin(chosen)).select("term", "having").distinct().toLocalIterator()
        })
        rows = [tuple(r) for r in listed.where(F.col("part").isin(chosen)).select("item_id", "text").toLocalIterator()]
        yield context.broadcast(Index(rows, counts=counts))


def leaked_items(
    docs: DataFrame, items: DataFrame, share: float = SHARE, question: float = QUESTION, answer: float = ANSWER,
    index_chars: int = INDEX_CHARS,
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for each document and item it gives away.

    ``docs`` (doc_id, text) are read whole, in passages; ``items`` (item_id, text) are the benchmark. An item is
    retrieved by a passage with ``share`` of its BM25 score and leaked if the document has ``question`` of the runs of
    three words of its question and ``answer`` of those of its answer; one of fewer than six words, if the document has
    it whole, in words that follow each other. Null texts and texts without words give
    nothing, nor do items without words; repeated rows of ``docs`` give repeated rows, those of ``items`` count once.
    """
    results = []
    for index in _indexes(items, index_chars):

        def run(ids: list, texts: list, index=index) -> list:
            # An item listed with several texts is one: the best of them.
            best: dict[tuple[int, int], tuple] = {}
            for place, (i, t) in enumerate(zip(ids, texts)):
                for hit in index.value.leaks(terms(t), share, question, answer) if t else ():
                    key, row = (place, hit[0]), (i, *hit)
                    best[key] = max(best.get(key, row), row, key=lambda r: r[2:])
            return [list(c) for c in zip(*best.values())] if best else [[] for _ in HITS.fields]

        results.append(map_texts(docs, run, HITS, ["doc_id", "text"]))
    if not results:
        return docs.sparkSession.createDataFrame([], HITS)
    out = results[0]
    for other in results[1:]:
        out = out.unionByName(other)
    return out


def is_clean(docs: DataFrame, items: DataFrame, text: str = "text", **limits: float) -> Column:
    """A condition true for texts that give no item away, in one pass without a shuffle. A null text is clean."""
    limits = {"share": SHARE, "question": QUESTION, "answer": ANSWER} | limits
    condition = F.lit(True)
    for index in _indexes(items, INDEX_CHARS):

        def run(texts: list, index=index) -> list:
            return [not t or not index.value.leaks(terms(t), limits["share"], limits["question"], limits["answer"]) for t in texts]

        condition = condition & text_column(run, BooleanType(), F.col(text))
    return condition
