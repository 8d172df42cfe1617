"""From filings to a searchable store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.operators.checks import check_store, check_vectors
from citemill.operators.chunking import chunk_filings
from citemill.operators.dense import dense_topk
from citemill.plans.ask import embedder_for
from citemill.session import spread, stage
from citemill.sources.keyword_store import KeywordStore
from citemill.sources.store import ChunkStore, merge_upsert


def embed_chunks(chunks: DataFrame, settings: Settings, embedder=None) -> DataFrame:
    embedder = embedder or embedder_for(settings)
    return chunks.withColumn("embedding", embedder.documents(F.col("text")))


def build_index(
    filings: DataFrame, store: ChunkStore, settings: Settings, embedder=None, replace: bool = True,
    keywords: KeywordStore | None = None,
) -> None:
    """Chunk and embed filings and write them to the store, in one job.

    ``replace`` drops older chunks of the same filings; otherwise chunks are
    only inserted or updated by id. A keyword index follows the write: it gets the
    same chunks, forgets those that left, and notes the version of the store.
    """
    chunks = embed_chunks(chunk_filings(spread(filings), settings), settings, embedder)
    if keywords is None:
        (store.replace_filings if replace else store.upsert)(chunks)
        return
    chunks, behind = stage(chunks, "chunks"), keywords.source != store.version()
    mine = chunks.select("accession_number").distinct()
    left = store.scan().join(mine, "accession_number", "left_semi").select("chunk_id").join(chunks, "chunk_id", "left_anti")
    left = stage(left, "left") if replace else None
    (store.replace_filings if replace else store.upsert)(chunks)
    if behind:
        index_keywords(store, keywords)
    else:
        keywords.upsert(chunks, gone=left, source=store.version())


def index_keywords(store: ChunkStore, keywords: KeywordStore) -> None:
    """Index all chunks of the store, in place of whatever was indexed before."""
    held = store.scan().select("chunk_id", "text")
    gone = keywords.keys().join(held, "chunk_id", "left_anti") if keywords.exists() else None
    keywords.upsert(held, gone=gone, source=store.version())


@dataclass
class IndexReport:
    stored: int
    id_problems: int
    vector_problems: int
    rewrite_delta: int
    sample: list[str]

    @property
    def passed(self) -> bool:
        return not (self.id_problems or self.vector_problems or self.rewrite_delta)


def verify_index(
    filings: DataFrame, store: ChunkStore, settings: Settings, embedder=None,
    smoke_question: str = "What are the principal risk factors?",
) -> IndexReport:
    """Re-derive the chunks and compare: same ids, sound vectors, ids that a
    repeated write would leave as they are, and a query that finds something.
    The store is only read."""
    embedder = embedder or embedder_for(settings)
    produced = embed_chunks(chunk_filings(spread(filings), settings), settings, embedder)
    before = store.count()
    ids = check_store(store.scan().select("chunk_id", "text"), produced.select("chunk_id", "text")).count()
    vectors = check_vectors(store.scan(), settings.embed_dim).count()
    delta = merge_upsert(store.ids(), produced.select("chunk_id")).count() - before
    asked = store.spark.createDataFrame([(smoke_question,)], "question string")
    vector = asked.select(embedder.queries(F.col("question")).alias("v")).first()["v"]
    found = dense_topk(store.scan(), vector, 3).orderBy("rank").collect()
    return IndexReport(before, ids, vectors, delta, [r["chunk_id"] for r in found])
