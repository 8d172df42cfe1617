"""BM25 keyword search over an inverted index held in plain tables.

An index that is written (``sources.keyword_store``) also has its postings in blocks, each with its largest weight, and
the terms of each document. Then a search reads the best blocks first, completes the documents found there, and so knows
a score that the k-th document reaches at least. Of the other blocks it reads only those that can lead to more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.functions.filters import among
from citemill.functions.stopwords import EFFECTIVE_STOPWORDS
from citemill.functions.text import WORD_GAP, is_keyword, words
from citemill.functions.tokens import char_ranges
from citemill.functions.vectors import SCORE_DECIMALS
from citemill.operators.ranking import rank_per_question
from citemill.session import HELD_ROWS, fits, held, stage

SALTS = 32
# Scores (question, document) summed up in one task, about, and the most tasks they are dealt to.
TASK_SCORES, MOST_PARTITIONS = 2_000_000, 20_000
# Blocks of a term: its postings by weight, in steps of this share of the largest weight there can be.
LEVELS = 16
# Postings read first for a question, and documents completed of them, as multiples of k.
FIRST_POSTINGS, FIRST_DOCS = 10, 3
# Documents up to this number are listed in the filter of the scan.
LISTED_KEYS = 200
# What names a document in a written index.
DOC = ("segment", "doc")
# Postings that a task sorts at a time, about, and runs that it hands on at a time.
RUN_POSTINGS, RUN_ROWS = 2_000_000, 100_000
# Bounds and scores add up in other orders; what differs by less is taken to be equal.
SLACK = 1e-6
# Question terms up to this number are listed in the filter of the scan.
LISTED_TERMS = 200
_GAP = re.compile(WORD_GAP)
_NO_KEYWORDS = {"", *EFFECTIVE_STOPWORDS}


def saturation(tf, dl, avg_dl, settings: Settings):
    """Weight of a posting without that of its term, below k1 + 1. Of columns, or of arrays and a mean length."""
    k1, b = settings.bm25_k1, settings.bm25_b
    length = (1 - b) + b * dl / avg_dl
    return tf * (k1 + 1) / (tf + k1 * length)


def _counted(texts: pa.Array) -> pa.Array:
    """(dl, terms) of lower-case texts. About ``SLICE_CHARS`` characters are words at a time."""
    parts, sizes, lengths = [], [0], []
    for a, b in char_ranges(texts, max(len(texts), 1)):
        terms, uses = [], []
        for text in texts.slice(a, b - a).to_pylist():
            found = Counter(_GAP.split(text or ""))
            for word in _NO_KEYWORDS & found.keys():
                del found[word]
            own = sorted(found)
            terms += own
            uses += map(found.__getitem__, own)
            sizes.append(len(own))
            lengths.append(found.total())
        parts.append(pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(uses, pa.int32())], names=["term", "tf"]))
    kind = pa.struct([("term", pa.string()), ("tf", pa.int32())])
    flat = pa.concat_arrays(parts) if parts else pa.array([], kind)
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), flat)
    return pa.StructArray.from_arrays([pa.array(lengths, pa.int32()), lists], names=["dl", "terms"])


def term_counts(text: Column) -> Column:
    """(dl, terms) of a text: its number of keywords, and each different one with its tf, in order. Words are those of
    ``functions.text.keywords``: the text is lower-cased in the JVM, as there, and only cut and counted in Python, where
    a word costs a fraction of what it does as a list element in the JVM. No shuffle is needed."""
    return F.arrow_udf(_counted, "struct<dl:int,terms:array<struct<term:string,tf:int>>>")(F.lower(text))


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows with ``terms`` in parts of about ``most`` postings, one row at least."""
    kept, size = [], 0
    for batch in batches:
        ends = np.concatenate([[0], np.cumsum(_lengths(batch["terms"]))])
        start = 0
        while start < batch.num_rows:
            end = max(int(np.searchsorted(ends, ends[start] + most - size, side="right")) - 1, start + (not kept))
            kept.append(batch.slice(start, end - start))
            size, start = size + ends[end] - ends[start], end
            if start < batch.num_rows or size >= most:
                yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
                kept, size = [], 0
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _inverted(rows: pa.RecordBatch, average: float, settings: Settings) -> Iterator[pa.RecordBatch]:
    """The runs of some documents, by term and falling level."""
    found = rows["terms"].flatten()
    if not len(found):
        return
    at = np.repeat(np.arange(rows.num_rows), _lengths(rows["terms"]))
    coded = pc.struct_field(found, 0).dictionary_encode()
    by_name = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(by_name), np.int64)
    rank[by_name] = np.arange(len(by_name))
    tf, dl = pc.struct_field(found, 1).to_numpy(zero_copy_only=False), rows["dl"].to_numpy()[at]
    weight = saturation(tf, dl, average, settings)
    level = np.minimum(LEVELS - 1, np.floor(weight * LEVELS / (settings.bm25_k1 + 1))).astype(np.int64)
    block = rank[coded.indices.to_numpy()] * LEVELS + (LEVELS - 1 - level)
    order = np.argsort(block, kind="stable")
    block, at = block[order], at[order]
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    ends = np.append(starts, len(block)).astype(np.int32)
    lists = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (rows["doc"].to_numpy()[at], tf[order], dl[order]))
    runs = pa.RecordBatch.from_arrays([
        coded.dictionary.take(pa.array(by_name[block[starts] // LEVELS])).cast(pa.string()),
        pa.array((LEVELS - 1 - block[starts] % LEVELS).astype(np.int32)), pa.array(np.diff(ends).astype(np.int64)),
        pa.array(np.maximum.reduceat(weight[order], starts)), *lists,
    ], names=["term", "level", "n", "top", "docs", "tfs", "dls"])
    for first in range(0, runs.num_rows, RUN_ROWS):
        yield runs.slice(first, RUN_ROWS)


def posting_runs(forward: DataFrame, average: float, settings: Settings) -> DataFrame:
    """Postings of documents (doc, dl, terms) in runs: of a term and level the documents that one part of a task holds, with
    their number and the largest weight. Parts have about ``RUN_POSTINGS`` postings. No shuffle is needed."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, RUN_POSTINGS):
            yield from _inverted(part, average, settings)

    return forward.select("doc", "dl", "terms").mapInArrow(
        runs, "term string, level int, n long, top double, docs array<long>, tfs array<int>, dls array<int>"
    )


def run_postings(runs: DataFrame, *own: str) -> DataFrame:
    """(segment, ``own``, doc, tf, dl): the postings of runs."""
    each = runs.select("segment", *own, "tfs", "dls", F.posexplode("docs").alias("i", "doc"))
    return each.select("segment", *own, "doc", F.col("tfs")[F.col("i")].alias("tf"), F.col("dls")[F.col("i")].alias("dl"))


def doc_bits(docs: DataFrame) -> DataFrame:
    """(segment, word, bits): documents (segment, doc) as bits, so that a long list of them can still go to all tasks."""
    return docs.groupBy("segment", F.shiftright("doc", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(doc & 63L)))").alias("bits"))


def marked(rows: DataFrame, bits: DataFrame, there: bool = True) -> DataFrame:
    """``rows`` (segment, doc, ...) of documents that have a bit, or of those that have none."""
    known = rows.withColumn("word", F.shiftright("doc", 6)).join(bits, ["segment", "word"], "inner" if there else "left")
    bit = F.coalesce(F.expr("shiftright(bits, int(doc & 63L)) & 1L"), F.lit(0))
    return known.where(bit == int(there)).select(*rows.columns)


def document_terms(docs: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Postings: one row per document and term, with ``tf`` and the document
    length ``dl``. The terms of a document are counted on its row, so postings are not shuffled. Only documents whose
    key repeats, as a null one may, meet on (key, dl, term), where their counts add up."""
    repeats = docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("again"))
    if fits(repeats, 0):
        return _own_terms(docs, key, text)
    repeats, rows = held(repeats, "repeated")
    repeats, same = repeats if rows is None else F.broadcast(repeats), F.col(key).eqNullSafe(F.col("again"))
    together = _own_terms(docs.join(repeats, same, "left_semi"), key, text).groupBy(key, "dl", "term").agg(F.sum("tf").alias("tf"))
    return _own_terms(docs.join(repeats, same, "left_anti"), key, text).unionByName(together)


def _own_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    # The outer form keeps Spark from taking the words twice, once to test for an empty array.
    counted = docs.select(key, term_counts(F.col(text)).alias("c")).select(key, "c.dl", F.explode_outer("c.terms").alias("t"))
    return counted.where("t IS NOT NULL").select(key, "dl", "t.term", F.col("t.tf").cast("long").alias("tf"))


def term_idf(postings: DataFrame, n_docs: Column, epsilon: float) -> DataFrame:
    """``df`` and ``idf`` of every term. A term in more than half of the
    documents would weigh negative; it gets a share of the mean weight instead.
    The mean covers all terms, negative ones too."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.withColumn("raw_idf", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.agg(F.lit(epsilon) * F.avg("raw_idf")).scalar()
    idf = F.when(F.col("raw_idf") < 0, floor).otherwise(F.col("raw_idf"))
    return raw.select("term", "df", idf.alias("idf"))


@dataclass
class KeywordIndex:
    """Postings, term weights and corpus totals. ``stats`` is one row with
    ``n_docs`` (documents without a term count too) and ``avg_dl``."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    key: str = "chunk_id"
    # Of a written index: (term, level, n, top) of each run, (segment, doc, key, dl, terms), the documents no longer in it as
    # (segment, word, bits), and the runs of its segments (``posting_runs``), of which ``postings`` are the rows.
    blocks: DataFrame | None = None
    forward: DataFrame | None = None
    gone: DataFrame | None = None
    runs: DataFrame | None = None

    @classmethod
    def of(cls, postings: DataFrame, docs: DataFrame, settings: Settings, key: str) -> KeywordIndex:
        """Index of given postings; ``docs`` is only counted."""
        n_docs = docs.agg(F.count("*")).scalar()
        stats = postings.agg(
            n_docs.alias("n_docs"), F.try_divide(F.sum("tf"), n_docs).alias("avg_dl")
        )
        return cls(postings, term_idf(postings, n_docs, settings.bm25_epsilon), stats, key)

    @classmethod
    def build(
        cls, docs: DataFrame, settings: Settings, key: str = "chunk_id", text: str = "text"
    ) -> KeywordIndex:
        """Index for a few searches: every table is computed once and staged."""
        index = cls.of(stage(document_terms(docs, key, text), "postings"), docs, settings, key)
        return cls(index.postings, stage(index.terms, "terms"), stage(index.stats, "stats"), key)

    @classmethod
    def write(
        cls, docs: DataFrame, path: str, settings: Settings, key: str = "chunk_id", text: str = "text"
    ) -> KeywordIndex:
        """Index kept at ``path``. Postings are clustered by term, so that a
        search reads the row groups of its own terms; a frequent term spans
        several files."""
        spark = docs.sparkSession
        document_terms(docs, key, text).repartitionByRange("term", key).sortWithinPartitions(
            "term"
        ).write.mode("overwrite").parquet(f"{path}/postings")
        index = cls.of(spark.read.parquet(f"{path}/postings"), docs, settings, key)
        index.terms.write.mode("overwrite").parquet(f"{path}/terms")
        index.stats.write.mode("overwrite").parquet(f"{path}/stats")
        return cls.read(spark, path, key)

    @classmethod
    def read(cls, spark: SparkSession, path: str, key: str = "chunk_id") -> KeywordIndex:
        tables = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "stats"))
        return cls(*tables, key=key)

    def weights(self, settings: Settings) -> Column:
        """Score of one posting joined to its term, for one use of the term."""
        return F.col("idf") * saturation(F.col("tf"), F.col("dl"), self.stats.select("avg_dl").scalar(), settings)

    def live(self, rows: DataFrame) -> DataFrame:
        """``rows`` (segment, doc, ...) without those of documents that were replaced or removed."""
        return rows if self.gone is None else marked(rows, self.gone, there=False)


def query_terms(questions: DataFrame) -> DataFrame:
    """Keywords of each question with how often it repeats them."""
    exploded = questions.select("question_id", F.explode(words(F.col("question"))).alias("term"))
    return (
        exploded.where(is_keyword(F.col("term")))
        .groupBy("question_id", "term").agg(F.count("*").alias("uses"))
    )


def by_document(
    postings: DataFrame, key: list[str], stats: DataFrame, questions: DataFrame, allowed: DataFrame | None = None
) -> DataFrame:
    """``postings`` (of ``allowed`` documents) dealt by document, so that scores (question, document) need no shuffle of
    their own. There are enough partitions for the scores of each, one for every document and question at most, to stay
    in memory."""
    n_docs, n_questions = stats.first()["n_docs"], questions.count()
    least = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.repartition(min(max(least, -(-n_docs * n_questions // TASK_SCORES)), MOST_PARTITIONS), *key)
    # An inner join, as a semi join would be moved below the terms and meet all postings.
    return dealt if allowed is None else dealt.join(allowed.select(*key).distinct(), key)


def keyword_search(
    index: KeywordIndex,
    questions: DataFrame,
    settings: Settings,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Best documents per question: question_id, key, rank, score.

    ``allowed`` limits the documents (one column, the key); it meets only the
    postings of the question's terms. Question terms are broadcast while few, and
    a short list of them goes to the scan, which skips the row groups of others. Their postings are then dealt by
    document, where all scores of a document are summed: what is shuffled grows with the postings, not with documents
    times questions. Otherwise both sides meet on (term, salt), with the postings of a term spread over the salts, so
    that a frequent term is not one task's work. There scores are summed map-side before they are shuffled.
    """
    if index.blocks is not None:
        return BlockSearch(index, questions, settings, allowed).best()
    key = index.key
    terms = query_terms(questions)
    postings = index.postings
    few = terms.select("term").distinct().limit(LISTED_TERMS + 1).collect()
    if len(few) <= LISTED_TERMS:
        postings = postings.where(among(F.col("term"), [r[0] for r in few]))
    weighted = terms.join(index.terms.select("term", "idf"), "term")
    if fits(terms, settings.broadcast_rows):
        number = F.row_number().over(Window.orderBy("term")).alias("number")  # at most broadcast_rows terms
        numbered = terms.select("term").distinct().select("term", number)
        own = postings.join(F.broadcast(numbered), "term").select(key, "number", "tf", "dl")
        own, allowed = by_document(own, [key], index.stats, questions, allowed), None
        hits = own.join(F.broadcast(weighted.join(numbered, "term").drop("term")), "number")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salted = weighted.withColumn("salt", salts)
        own = postings.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        hits = own.join(salted, ["term", "salt"])
    if allowed is not None:
        hits = hits.join(allowed.select(key), key, "left_semi")
    scored = hits.groupBy("question_id", key).agg(
        F.round(F.sum(F.col("uses") * index.weights(settings)), SCORE_DECIMALS).alias("score")
    )
    positive = scored.where(F.col("score") > 0)
    return rank_per_question(positive, [F.col("score").desc(), F.col(key)], settings.bm25_top_k)


class BlockSearch:
    """Exact BM25 top-k that reads the blocks of a written index it cannot do without.

    ``first`` and ``needed`` are the blocks read to find the threshold and the candidates. A block is needed when its
    largest weight and the largest ones of the question's other terms together reach the threshold, and its term is
    essential: terms whose largest weights together stay below the threshold can lead to no candidate alone. Partial
    sums of the needed blocks, with all that the terms left out could add, bound each candidate; those still in reach
    get their exact score from the terms of the document. What is shuffled are the postings of needed blocks and, where many
    documents are in reach, those of their terms that are asked for, both dealt by document.
    """

    def __init__(self, index: KeywordIndex, questions: DataFrame, settings: Settings, allowed: DataFrame | None = None):
        self.index, self.settings, self.questions, self.k = index, settings, questions, settings.bm25_top_k
        self.allowed = None if allowed is None else index.forward.join(allowed.select(index.key), index.key, "left_semi").select(*DOC)
        asked, rows = held(query_terms(questions), "asked")
        listed = None if rows is None else rows["term"].unique().to_pylist()
        self._listed = (lambda df: df.where(among(F.col("term"), listed))) if listed and len(listed) <= LISTED_TERMS else (lambda df: df)
        self.few = rows is not None or fits(asked, settings.broadcast_rows // LEVELS)
        self.weighted, _ = held(
            self._listed(index.terms).select("term", "idf").join(self._small(asked), "term")
            .select("question_id", "term", (F.col("uses") * F.col("idf")).alias("weight")), "weighted",
        )
        self.avg_dl = index.stats.first()["avg_dl"]
        # A row for each question, term and level: small, whatever the number of postings.
        blocks = self._listed(index.blocks).join(self._small(asked.select("term").distinct()), "term", "left_semi")
        blocks = blocks.groupBy("term", "level").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
        bounds = self._small(self.weighted).join(blocks, "term").withColumn(
            "bound", F.greatest("weight", F.lit(0.0)) * F.col("top")
        )
        best = F.max("bound").over(Window.partitionBy("question_id", "term"))
        self.bounds, _ = held(bounds.withColumn("best", best), "bounds")
        order = Window.partitionBy("question_id").orderBy(F.col("bound").desc(), "term", F.col("level").desc())
        before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        self.first = self.bounds.where("bound > 0").withColumn("before", before).where(F.col("before") < FIRST_POSTINGS * self.k)
        self.thresholds, _ = held(self._thresholds(), "thresholds")
        self.needed, _ = held(self._needed(), "needed")

    def _small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.few else df

    def _sums(self, blocks: DataFrame, *more: str) -> DataFrame:
        """(question_id, segment, doc, partial): what the postings of some blocks add up to, for documents that are allowed."""
        index, asked = self.index, blocks.select("question_id", "term", "level", "weight", *more)
        runs = self._listed(index.runs)
        if self.few:
            # Each posting once, whatever the number of questions that need it, and with a number for its block.
            number = F.row_number().over(Window.orderBy("term", "level")).alias("block")
            numbered = blocks.select("term", "level").distinct().select("term", "level", number)
            postings = index.live(run_postings(runs.join(F.broadcast(numbered), ["term", "level"]), "block"))
            postings = by_document(postings, [*DOC], index.stats, self.questions, self.allowed)
            hits = postings.join(F.broadcast(asked.join(numbered, ["term", "level"]).drop("term", "level")), "block")
        else:
            hits = index.live(run_postings(runs, "term", "level").join(asked, ["term", "level"]))
            if self.allowed is not None:
                hits = hits.join(self.allowed, [*DOC], "left_semi")
        return hits.groupBy("question_id", *DOC, *more).agg(F.sum(self._part()).alias("partial"))

    def _part(self) -> Column:
        return F.col("weight") * saturation(F.col("tf"), F.col("dl"), F.lit(self.avg_dl), self.settings)

    def _exact(self, found: DataFrame) -> DataFrame:
        """Scores of (question_id, segment, doc) from all terms of the documents; positive ones, with the key. Where many are
        found, those of other questions for the same documents too, as these are exact as well."""
        index, key = self.index, self.index.key
        found = stage(found.select("question_id", *DOC), "found")
        found, rows = held(found, "found") if fits(found, HELD_ROWS) else (found, None)
        docs = None if rows is None else rows["doc"].unique().to_pylist()
        forward = index.forward.where(among(F.col("doc"), docs)) if docs and len(docs) <= LISTED_KEYS else index.forward
        few = rows is not None or fits(found, self.settings.broadcast_rows)
        if few:
            live = forward.join(F.broadcast(found.select(*DOC).distinct()), [*DOC], "left_semi")
        else:
            bits, rows = held(doc_bits(found), "found-bits")
            live = marked(forward, F.broadcast(bits) if rows is not None or fits(bits, self.settings.broadcast_rows) else bits)
        # The terms of a document are taken apart once, however many questions found it.
        each = live.select(*DOC, key, "dl", F.explode("terms").alias("t")).select(*DOC, key, "dl", "t.term", "t.tf")
        each = self._listed(each)
        if few or not self.few:
            mine = each.join(self._small(self.weighted), "term")
            mine = mine.join(F.broadcast(found) if few else found, ["question_id", *DOC], "left_semi")
        else:
            # Of many documents only terms that are asked for are dealt out, and scores are summed where they are.
            number = F.row_number().over(Window.orderBy("term")).alias("number")
            numbered = self.weighted.select("term").distinct().select("term", number)
            own = each.join(F.broadcast(numbered), "term").drop("term")
            own = by_document(own, [*DOC], index.stats, self.questions)
            mine = own.join(F.broadcast(self.weighted.join(numbered, "term").drop("term")), "number")
        scored = mine.groupBy("question_id", *DOC, key).agg(F.round(F.sum(self._part()), SCORE_DECIMALS).alias("score"))
        return scored.where(F.col("score") > 0)

    def _thresholds(self) -> DataFrame:
        """(question_id, threshold): a score that k documents reach, zero where fewer are known."""
        partial = self._sums(self.first)
        some = rank_per_question(partial, [F.col("partial").desc(), *map(F.col, DOC)], FIRST_DOCS * self.k)
        ranked = rank_per_question(self._exact(some), [F.col("score").desc(), F.col(self.index.key)], self.k)
        return ranked.where(F.col("rank") == self.k).select("question_id", F.col("score").alias("threshold"))

    def _needed(self) -> DataFrame:
        """Blocks that can hold a document of the result, with ``rest``: what the terms left out could add to it."""
        terms = self.bounds.select("question_id", "term", "best").distinct()
        up = Window.partitionBy("question_id").orderBy("best", "term").rowsBetween(Window.unboundedPreceding, 0)
        summed = terms.join(self._small(self.thresholds), "question_id", "left").withColumns({
            "threshold": F.coalesce("threshold", F.lit(0.0)) - SLACK,
            "up_to": F.sum("best").over(up), "total": F.sum("best").over(Window.partitionBy("question_id")),
        })
        rest = F.coalesce(F.max(F.when(F.col("up_to") < F.col("threshold"), F.col("up_to"))).over(Window.partitionBy("question_id")), F.lit(0.0))
        essential = summed.withColumn("rest", rest).where(F.col("up_to") >= F.col("threshold")).drop("best")
        needed = self.bounds.join(self._small(essential), ["question_id", "term"])
        return needed.where(F.col("bound") + F.col("total") - F.col("best") >= F.col("threshold"))

    def best(self) -> DataFrame:
        found = self._sums(self.needed, "rest", "threshold").where(F.col("partial") + F.col("rest") >= F.col("threshold"))
        return rank_per_question(self._exact(found), [F.col("score").desc(), F.col(self.index.key)], self.k).drop(*DOC)

    def postings_read(self) -> tuple[int, int]:
        """Postings of the blocks needed, added up over the questions, and of all blocks of their terms."""
        return tuple(df.agg(F.sum("n")).first()[0] or 0 for df in (self.needed, self.bounds))
