"""Queries on search: embeddings, dense top-k, keyword search and fusion."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.catalog import sqltext as q
from citemill.catalog.registry import Tables, built_once, query
from citemill.config import Settings
from citemill.operators.dense import dense_topk as topk_one
from citemill.operators.dense import dense_topk_batch as topk_many
from citemill.operators.dense import filtered
from citemill.operators.keyword import KeywordIndex, document_terms, keyword_search
from citemill.operators.retrieval import retrieve
from citemill.plans.ask import embedder_for
from citemill.session import checkpoint_folder, delete_at_exit
from citemill.sources.cells import CellStore
from citemill.sources.keyword_store import KeywordStore

SETTINGS = Settings()
HYBRID = replace(SETTINGS, hybrid_enabled=True)
ENGLISH = {"section": "en"}
# One question, with a word used twice and words in most and in few documents.
QUESTION = "La que la der und nicht thing whether ententre"


def document_store(t: Tables, embed: bool = True) -> DataFrame:
    """Whole documents as stored chunks."""
    rows = t.texts.select(
        F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("company"), F.col("lang").alias("section")
    )
    return rows.withColumn("embedding", embedder_for(SETTINGS).documents(F.col("text"))) if embed else rows


def keyword_index(t: Tables) -> KeywordIndex:
    return built_once("document postings", t, lambda: KeywordIndex.build(document_store(t, embed=False), SETTINGS))


def new_keyword_store(t: Tables) -> KeywordStore:
    path = f"{checkpoint_folder(t.spark).rstrip('/')}/keywords-{uuid.uuid4().hex}"
    delete_at_exit(t.spark, path)
    return KeywordStore(t.spark, path, SETTINGS)


def block_index(t: Tables) -> KeywordIndex:
    """The index as it is written, with blocks."""

    def build() -> KeywordIndex:
        held = new_keyword_store(t)
        held.upsert(document_store(t, embed=False))
        return held.index()

    return built_once("document blocks", t, build)


def one_question(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(0, QUESTION)], "question_id bigint, question string")


ONE_QUESTION = f"questions AS (SELECT 0 AS question_id, '{QUESTION}' AS question)"
RANKED = "SELECT question_id, chunk_id, rank, score FROM {}"


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("question_id", "chunk_id", "rank", "score")


@query(q.with_(q.DOCUMENT_STORE, q.POSTINGS) + "SELECT chunk_id, term, tf, dl FROM posting JOIN length USING (chunk_id)")
def postings(t: Tables) -> DataFrame:
    return document_terms(document_store(t, embed=False)).select("chunk_id", "term", "tf", "dl")


@query(q.with_(q.DOCUMENT_STORE, q.POSTINGS) + "SELECT n AS n_docs, round(avg_dl, 6) AS avg_dl FROM corpus")
def keyword_stats(t: Tables) -> DataFrame:
    return keyword_index(t).stats.select("n_docs", F.round("avg_dl", 6).alias("avg_dl"))


@query(q.with_(q.DOCUMENT_STORE, q.POSTINGS) + "SELECT term, df, round(idf, 6) AS idf FROM idf")
def keyword_idf(t: Tables) -> DataFrame:
    return keyword_index(t).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(q.with_(q.DOCUMENT_STORE, ONE_QUESTION, q.POSTINGS, q.KEYWORD) + RANKED.format("keyword"))
def keyword_topk(t: Tables) -> DataFrame:
    return _ranked(keyword_search(keyword_index(t), one_question(t), SETTINGS))


@query(q.with_(q.DOCUMENT_STORE, q.QUESTIONS, q.POSTINGS, q.KEYWORD) + RANKED.format("keyword"))
def keyword_topk_batch(t: Tables) -> DataFrame:
    return _ranked(keyword_search(keyword_index(t), t.questions, SETTINGS))


_ENGLISH_KEYWORD = q.KEYWORD.replace(
    "/*keyword where*/", "WHERE chunk_id IN (SELECT chunk_id FROM store WHERE section = 'en')"
)
_ENGLISH_DENSE = q.DENSE.replace("/*dense where*/", "WHERE section = 'en'")


@query(q.with_(q.DOCUMENT_STORE, q.QUESTIONS, q.POSTINGS, _ENGLISH_KEYWORD) + RANKED.format("keyword"))
def keyword_topk_filtered(t: Tables) -> DataFrame:
    allowed = filtered(document_store(t, embed=False), ENGLISH)
    return _ranked(keyword_search(keyword_index(t), t.questions, SETTINGS, allowed))


@query(q.with_(q.DOCUMENT_STORE, ONE_QUESTION, q.POSTINGS, q.KEYWORD) + RANKED.format("keyword"))
def keyword_blocks(t: Tables) -> DataFrame:
    """The same rows from the written index, of which only blocks in reach are read."""
    return _ranked(keyword_search(block_index(t), one_question(t), SETTINGS))


@query(q.with_(q.DOCUMENT_STORE, q.QUESTIONS, q.POSTINGS, q.KEYWORD) + RANKED.format("keyword"))
def keyword_blocks_batch(t: Tables) -> DataFrame:
    return _ranked(keyword_search(block_index(t), t.questions, SETTINGS))


@query(q.with_(q.DOCUMENT_STORE, q.QUESTIONS, q.POSTINGS, _ENGLISH_KEYWORD) + RANKED.format("keyword"))
def keyword_blocks_filtered(t: Tables) -> DataFrame:
    allowed = filtered(document_store(t, embed=False), ENGLISH)
    return _ranked(keyword_search(block_index(t), t.questions, SETTINGS, allowed))


def _upserted(t: Tables) -> KeywordStore:
    """Three writes: documents of which some have another text or do not stay, then the rest and the right texts."""
    held, docs = new_keyword_store(t), document_store(t, embed=False).select("chunk_id", "text")
    early = docs.where("chunk_id % 4 <> 3").withColumn("text", F.when(F.col("chunk_id") % 4 == 1, F.concat(F.lit("thing whether thing "), "text")).otherwise(F.col("text")))
    passing = docs.where("chunk_id % 10 = 0").select((-1 - F.col("chunk_id")).alias("chunk_id"), "text")
    held.upsert(early.unionByName(passing))
    held.upsert(docs.where("chunk_id % 4 IN (1, 3)"), gone=passing.where("chunk_id % 20 = -1"))
    held.remove(passing.where("chunk_id % 20 <> -1"))
    return held


@query(q.with_(q.DOCUMENT_STORE, q.QUESTIONS, q.POSTINGS, q.KEYWORD) + RANKED.format("keyword"))
def keyword_after_upsert(t: Tables) -> DataFrame:
    """An index that followed writes gives what one built anew gives."""
    return _ranked(keyword_search(_upserted(t).index(), t.questions, SETTINGS))


@query(q.with_(q.DOCUMENT_STORE, q.POSTINGS) + "SELECT term, df, round(idf, 6) AS idf FROM idf")
def keyword_idf_after_upsert(t: Tables) -> DataFrame:
    return _upserted(t).index().terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(q.with_(q.DOCUMENT_STORE, q.QUESTIONS, q.POSTINGS, q.KEYWORD) + RANKED.format("keyword"))
def keyword_after_compaction(t: Tables) -> DataFrame:
    held = _upserted(t)
    held.compact()
    held.clean()
    return _ranked(keyword_search(held.index(), t.questions, SETTINGS))


@query(q.with_(q.DOCUMENT_STORE, q.STORE_VECTORS) + "SELECT chunk_id, slot, round(v, 6) AS v FROM sv WHERE v <> 0")
def embed_documents(t: Tables) -> DataFrame:
    vectors = document_store(t).select("chunk_id", F.posexplode_outer("embedding").alias("slot", "v"))
    return vectors.where(F.col("v") != 0).select("chunk_id", "slot", F.round(F.col("v").cast("double"), 6).alias("v"))


@query(q.with_(q.QUESTIONS, q.QUESTION_VECTORS) + "SELECT question_id, slot, round(v, 6) AS v FROM qv WHERE v <> 0")
def embed_questions(t: Tables) -> DataFrame:
    vector = embedder_for(SETTINGS).queries(F.col("question"))
    vectors = t.questions.select("question_id", F.posexplode(vector).alias("slot", "v"))
    return vectors.where(F.col("v") != 0).select("question_id", "slot", F.round(F.col("v").cast("double"), 6).alias("v"))


_EXAMPLE = "(SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]"


def _by_example(where: str) -> str:
    return f"""
    SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank
    FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_EXAMPLE}), 9) AS score
          FROM embeddings WHERE {where}) ORDER BY score DESC, vec_id LIMIT 20"""


def _example(t: Tables) -> list[float]:
    return t.embeddings.where("vec_id = 0").first()["embedding"]


@query(_by_example("true"))
def dense_topk(t: Tables) -> DataFrame:
    best = topk_one(t.embeddings, _example(t), SETTINGS.top_k_dense, key="vec_id")
    return best.select("vec_id", "score", "rank")


@query(_by_example("label IN (1, 3, 5)"))
def dense_topk_filtered(t: Tables) -> DataFrame:
    best = topk_one(t.embeddings, _example(t), SETTINGS.top_k_dense, {"label": {"$in": [1, 3, 5]}}, "vec_id")
    return best.select("vec_id", "score", "rank")


_CENTRES = """
WITH vectors AS ({vectors}),
slot AS (SELECT label, unnest(range(64)) AS s, unnest(embedding)::DOUBLE AS v FROM embeddings),
centre AS (SELECT label, list(m ORDER BY s) AS c FROM (SELECT label, s, avg(v) AS m FROM slot GROUP BY ALL) GROUP BY label),
scored AS (
  SELECT c.label AS question_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 9) AS score
  FROM centre c, vectors e)
SELECT question_id, vec_id, rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""
_ALL_VECTORS = "SELECT vec_id, embedding FROM embeddings"


def _centres(t: Tables) -> DataFrame:
    """The mean vector of every label."""
    slots = t.embeddings.select("label", F.posexplode("embedding").alias("slot", "v"))
    means = slots.groupBy("label", "slot").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "v"))), lambda s: s.v).alias("embedding")
    ).withColumnRenamed("label", "question_id")


def _near_centres(t: Tables, vectors: DataFrame, settings: Settings) -> DataFrame:
    """Vectors nearest to the mean vector of every label."""
    best = topk_many(vectors, _centres(t), settings, key="vec_id")
    return best.select("question_id", "vec_id", "rank", "score")


def cell_index(t: Tables) -> CellStore:
    """All vectors in cells, written once in a session."""

    def build() -> CellStore:
        path = f"{checkpoint_folder(t.spark).rstrip('/')}/cells-{uuid.uuid4().hex}"
        delete_at_exit(t.spark, path)
        held = CellStore(t.spark, path, SETTINGS, "vec_id")
        held.write(t.embeddings)
        return held

    return built_once("vector cells", t, build)


@query(_by_example("true"))
def dense_topk_cells(t: Tables) -> DataFrame:
    """The same rows from the index in cells, of which only those in reach are read."""
    asked = t.embeddings.where("vec_id = 0").select(F.lit(0).alias("question_id"), "embedding")
    return cell_index(t).search(asked).select("vec_id", "score", "rank")


@query(_CENTRES.format(vectors=_ALL_VECTORS))
def dense_topk_batch(t: Tables) -> DataFrame:
    return _near_centres(t, t.embeddings, SETTINGS)


@query(_CENTRES.format(vectors=_ALL_VECTORS))
def dense_topk_passes(t: Tables) -> DataFrame:
    """The same with more questions than go at once."""
    return _near_centres(t, t.embeddings, replace(SETTINGS, broadcast_questions=0))


@query(_CENTRES.format(vectors=_ALL_VECTORS))
def dense_topk_cells_batch(t: Tables) -> DataFrame:
    return cell_index(t).search(_centres(t)).select("question_id", "vec_id", "rank", "score")


@query(_CENTRES.format(vectors=_ALL_VECTORS + " WHERE vec_id % 5 NOT IN (1, 2, 3)"))
def dense_topk_broken(t: Tables) -> DataFrame:
    """Embeddings that are null, hold NaN or have another size take no places."""
    embedding = (
        F.when(F.col("vec_id") % 5 == 1, F.lit(None))
        .when(F.col("vec_id") % 5 == 2, F.transform("embedding", lambda x, i: F.when(i == 7, F.lit(float("nan"))).otherwise(x)))
        .when(F.col("vec_id") % 5 == 3, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    )
    return _near_centres(t, t.embeddings.withColumn("embedding", embedding), SETTINGS)


@query(q.with_(q.DOCUMENT_STORE, q.QUESTIONS, q.DENSE) + RANKED.format("dense"))
def retrieve_dense(t: Tables) -> DataFrame:
    return _ranked(retrieve(document_store(t), t.questions, SETTINGS, embedder_for(SETTINGS)))


def _hybrid(t: Tables, where: dict | None = None, **options) -> DataFrame:
    return retrieve(
        document_store(t), t.questions, HYBRID, embedder_for(SETTINGS), where, keyword_index(t), **options
    )


_HYBRID_SQL = q.with_(q.DOCUMENT_STORE, q.QUESTIONS, q.POSTINGS, q.KEYWORD, q.DENSE, q.FUSED)


@query(_HYBRID_SQL + RANKED.format("fused"))
def rrf_hybrid(t: Tables) -> DataFrame:
    return _ranked(_hybrid(t))


@query(q.with_(q.DOCUMENT_STORE, q.QUESTIONS, q.POSTINGS, _ENGLISH_KEYWORD, _ENGLISH_DENSE, q.FUSED) + RANKED.format("fused"))
def hybrid_filtered(t: Tables) -> DataFrame:
    return _ranked(_hybrid(t, ENGLISH))


@query(q.with_(q.DOCUMENT_STORE, q.QUESTIONS, q.POSTINGS, q.KEYWORD, _ENGLISH_DENSE, q.FUSED) + RANKED.format("fused"))
def hybrid_unfiltered_keywords(t: Tables) -> DataFrame:
    """A filter on the dense leg only."""
    return _ranked(_hybrid(t, ENGLISH, unfiltered_keywords=True))


@query(q.with_(q.DOCUMENT_STORE, q.QUESTIONS) + "SELECT question_id, 0 AS chunk_id, 0 AS rank, 0.0::DOUBLE AS score FROM questions WHERE false")
def hybrid_filter_empty(t: Tables) -> DataFrame:
    """A filter that admits nothing is not widened."""
    nothing = {"section": "no such section"}
    return _ranked(_hybrid(t, nothing))
