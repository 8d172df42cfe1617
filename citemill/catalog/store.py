"""Queries on the stored chunk table: upsert, filters, identity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.catalog.registry import Tables, built_once, query
from citemill.config import Settings
from citemill.operators import ingest
from citemill.operators.dense import filtered
from citemill.schemas import FILING, STORED_CHUNK
from citemill.session import checkpoint_folder, delete_at_exit
from citemill.sources import files, store


@query("""
SELECT doc_id, quality AS value FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT vec_id, label FROM embeddings
""")
def upsert_merge(t: Tables) -> DataFrame:
    existing = t.labels.select("doc_id", F.col("quality").alias("value"))
    new = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("value"))
    return store.merge_upsert(existing, new, "doc_id")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity AS value FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT o_orderkey, 0, o_totalprice FROM orders WHERE o_orderstatus = 'F'
""")
def replace_owner(t: Tables) -> DataFrame:
    existing = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("value"))
    new = t.orders.where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.col("o_totalprice").alias("value")
    )
    return store.merge_replace(existing, new, "l_orderkey")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def stale_ids(t: Tables) -> DataFrame:
    return store.stale_ids(t.labels, t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id")


@query("""
SELECT coalesce(l.doc_id, e.vec_id) AS doc_id, CASE WHEN e.vec_id IS NULL THEN 'left' ELSE 'right' END AS side
FROM labels l FULL JOIN embeddings e ON l.doc_id = e.vec_id WHERE l.doc_id IS NULL OR e.vec_id IS NULL
""")
def id_symmetric_diff(t: Tables) -> DataFrame:
    return store.id_difference(t.labels, t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id")


@query("SELECT sha256(text) AS text_sha, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(t: Tables) -> DataFrame:
    return store.repeated(t.texts.select(F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha")), "text_sha")


@query("""
SELECT substr(md5(concat_ws('-', count(*), sum(('0x' || substr(h, 1, 15))::BIGINT), sum(('0x' || substr(h, 16, 15))::BIGINT))), 1, 12)
  AS corpus_snapshot_hash FROM (SELECT md5(doc_id::VARCHAR) AS h FROM documents)
""")
def snapshot_hash(t: Tables) -> DataFrame:
    return store.snapshot_hash(t.documents, "doc_id")


def _chunks(t: Tables) -> DataFrame:
    """Whole documents in the columns of stored chunks."""
    known = {
        "chunk_id": F.col("doc_id").cast("string"), "text": F.col("text"), "ticker": F.col("source"), "section": F.col("lang"),
        "accession_number": (F.col("doc_id") % 97).cast("string"), "chunk_index_in_section": F.col("n_chars").cast("int"),
    }
    return t.texts.select(*[
        known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in STORED_CHUNK.fields
    ])


def _store(t: Tables, name: str, **settings) -> store.ChunkStore:
    path = f"{checkpoint_folder(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    delete_at_exit(t.spark, path)
    return store.ChunkStore(t.spark, path, Settings(**settings))


def _written(t: Tables) -> store.ChunkStore:
    """All documents in a store, written once in a session."""

    def build() -> store.ChunkStore:
        written = _store(t, "documents-store")
        written.upsert(_chunks(t))
        return written

    return built_once("document store", t, build)


def _plain() -> list:
    columns = {"doc_id": F.col("chunk_id").cast("long"), "source": F.col("ticker"), "n_chars": F.col("chunk_index_in_section").cast("long")}
    return [c.alias(n) for n, c in columns.items()]


@query("SELECT doc_id, source, n_chars, md5(text) AS text_md5 FROM documents WHERE doc_id IN (0, 7, 42, 150)")
def get_by_ids(t: Tables) -> DataFrame:
    found = _written(t).get(["0", "7", "42", "150"])
    return found.select(*_plain(), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents")
def store_count(t: Tables) -> DataFrame:
    written = _written(t)
    return written.ids().agg(F.count_distinct("chunk_id").alias("ids")).select(F.lit(written.count()).alias("n"), "ids")


@query("SELECT doc_id, source, n_chars, CASE WHEN doc_id % 3 = 0 THEN 'changed' ELSE md5(text) END AS text FROM documents")
def upsert_rebucketed(t: Tables) -> DataFrame:
    """Two writes with other bucket settings: no id twice, none lost."""
    rows = _chunks(t).withColumn("text", F.md5(F.encode("text", "UTF-8")))
    first = _store(t, "rebucketed", store_buckets=8)
    first.upsert(rows)
    store.ChunkStore(t.spark, first.path, Settings(store_buckets=16)).upsert(
        rows.where(F.col("chunk_id").cast("long") % 3 == 0).withColumn("text", F.lit("changed"))
    )
    return first.scan().select(*_plain(), "text")


_VERSION = """SELECT {n} AS version, count(*) AS n, count(*) FILTER (text_md5 = 'changed') AS n_changed, substr(md5(concat_ws('-', count(*),
    sum(('0x' || substr(h, 1, 15))::BIGINT), sum(('0x' || substr(h, 16, 15))::BIGINT))), 1, 12) AS corpus_snapshot_hash
  FROM (SELECT md5(doc_id::VARCHAR) AS h, {text} AS text_md5 FROM documents WHERE {where})"""


@query(" UNION ALL ".join((
    _VERSION.format(n=1, text="md5(text)", where="doc_id % 5 <> 2"),
    _VERSION.format(n=2, text="CASE WHEN doc_id % 97 = 3 THEN 'changed' ELSE md5(text) END", where="doc_id % 5 <> 2 OR doc_id % 97 = 3"),
    _VERSION.format(n=3, text="CASE WHEN doc_id % 97 = 3 THEN 'changed' ELSE md5(text) END", where="true"),
)))
def store_versions(t: Tables) -> DataFrame:
    """Three writes, each read as of then: rows, changed rows, and the hash kept by buckets."""
    rows = _chunks(t).withColumn("text", F.md5(F.encode("text", "UTF-8")))
    number = F.col("chunk_id").cast("long")
    held = _store(t, "versions", store_buckets=8)
    held.upsert(rows.where(number % 5 != 2))
    held.replace_filings(rows.where(number % 97 == 3).withColumn("text", F.lit("changed")))
    held.upsert(rows.where((number % 5 == 2) & (number % 97 != 3)))
    return held.spark.createDataFrame([
        (v, held.scan(v).count(), held.scan(v).where("text = 'changed'").count(), held.snapshot(v)) for v in held.versions()
    ], "version int, n long, n_changed long, corpus_snapshot_hash string")


@query("""
SELECT source AS ticker, doc_id::VARCHAR AS accession_number, lang AS section,
  md5(CASE WHEN doc_id % 4 = 1 THEN 'second' ELSE text END) AS text_md5 FROM documents
""")
def filings_roundtrip(t: Tables) -> DataFrame:
    """All documents as filings, many per ticker and task, written in two runs."""
    text = F.when(F.col("doc_id") % 4 == 1, "second").otherwise(F.col("text"))

    def filings(text) -> DataFrame:
        known = {
            "ticker": F.col("source"), "accession_number": F.col("doc_id").cast("string"),
            "parsed_sections": F.array(F.struct(F.lit(0).alias("ord"), F.col("lang").alias("section"), text.alias("text"))),
        }
        return t.texts.select("doc_id", *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FILING.fields])

    path = f"{checkpoint_folder(t.spark).rstrip('/')}/filings-{uuid.uuid4().hex}"
    delete_at_exit(t.spark, path)
    files.write_filings(filings(F.col("text")).where("doc_id % 4 <> 2").drop("doc_id"), path)
    files.write_filings(filings(text).where("doc_id % 4 IN (1, 2)").drop("doc_id"), path)
    return files.read_filings(t.spark, path).select(
        "ticker", "accession_number", F.explode("parsed_sections").alias("s")
    ).select("ticker", "accession_number", "s.section", F.md5(F.encode("s.text", "UTF-8")).alias("text_md5"))


@query("SELECT page_id, CASE WHEN page_id % 9 = 4 THEN 'failed' ELSE 'ok' END AS status FROM pages")
def ingest_isolated(t: Tables) -> DataFrame:
    """Pages that the parser fails on have an error; the others have their text."""
    page = F.when(F.col("page_id") % 9 == 4, F.concat("html", F.lit("<![foo[x]]>"))).otherwise(F.col("html"))
    parsed = t.pages.select("page_id", files.parsed_html(page).alias("p"))
    return parsed.select("page_id", F.when(F.col("p.error").isNotNull() & F.col("p.text").isNull(), "failed").otherwise("ok").alias("status"))


FILTERS = {
    "where_eq": ({"lang": {"$eq": "en"}}, "lang = 'en'"),
    "where_bare": ({"lang": "de"}, "lang = 'de'"),
    "where_and": ({"lang": "en", "source": {"$eq": "src1"}}, "lang = 'en' AND source = 'src1'"),
    "where_or": ({"$or": [{"lang": "fr"}, {"n_chars": {"$gt": 5000}}]}, "lang = 'fr' OR n_chars > 5000"),
    "where_in": ({"source": {"$in": ["src1", "src2"]}}, "source IN ('src1', 'src2')"),
    "where_nin": ({"source": {"$nin": ["src1", "src2"]}}, "source NOT IN ('src1', 'src2')"),
    "where_ne": ({"lang": {"$ne": "en"}}, "lang <> 'en'"),
    "where_range": ({"n_chars": {"$gte": 500, "$lt": 1500}}, "n_chars >= 500 AND n_chars < 1500"),
    "where_nested": (
        {"$and": [{"$or": [{"lang": "de"}, {"lang": "es"}]}, {"n_chars": {"$lte": 2000}}]},
        "(lang = 'de' OR lang = 'es') AND n_chars <= 2000",
    ),
}


def _filter_query(name: str, where: dict, sql: str) -> None:
    query(f"SELECT doc_id, lang, source FROM documents WHERE {sql}", name)(
        lambda t: filtered(t.documents, where).select("doc_id", "lang", "source")
    )


for _name, (_where, _sql) in FILTERS.items():
    _filter_query(_name, _where, _sql)


@query("""
SELECT d.doc_id FROM documents d WHERE NOT EXISTS (
  SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)
""")
def incremental_skip(t: Tables) -> DataFrame:
    """Documents whose recorded and present checksums differ, or that have no
    record: a label of quality 0 stands for a changed raw text."""
    planned = t.documents.select(F.col("source").alias("ticker"), F.col("doc_id").alias("accession_number"), "text")
    named = t.documents.select("doc_id", F.col("source").alias("ticker"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    processed = t.labels.join(named, "doc_id").select(
        "ticker", F.col("doc_id").alias("accession_number"),
        F.when(F.col("quality") == 1, F.col("sha")).otherwise("").alias("file_sha256"),
    )
    cached = named.select("ticker", F.col("doc_id").alias("accession_number"), F.col("sha").alias("file_sha256"))
    return ingest.to_fetch(planned, processed, cached).select(F.col("accession_number").alias("doc_id"))


# Orders stand in for filings: customer as ticker, priority 1-URGENT as the
# amended form, and the month of the order as the report period.
_FILINGS_SQL = """
WITH filing AS (
  SELECT o_custkey AS ticker, o_orderkey AS accession_number, strftime(o_orderdate, '%Y-%m') AS period, o_orderdate AS filed,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '10-K/A' ELSE '10-K' END AS form_type FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker, form_type ORDER BY filed DESC, accession_number DESC) AS r FROM filing)
"""


def _filings(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("accession_number"),
        F.date_format("o_orderdate", "yyyy-MM").alias("fiscal_year_end_date"),
        F.col("o_orderdate").alias("filing_date"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "10-K/A").otherwise("10-K").alias("form_type"),
    )


@query(_FILINGS_SQL + """
SELECT o.ticker, coalesce(a.accession_number, o.accession_number) AS accession_number,
       coalesce(a.form_type, o.form_type) AS form_type
FROM (SELECT * FROM ranked WHERE form_type = '10-K' AND r = 1) o
LEFT JOIN (SELECT * FROM ranked WHERE form_type = '10-K/A' AND r = 1) a ON a.ticker = o.ticker AND a.period = o.period
""")
def amend_prefer(t: Tables) -> DataFrame:
        return ingest.choose_filings(_filings(t), Settings()).select("ticker", "accession_number", "form_type")


@query(_FILINGS_SQL + "SELECT ticker, form_type, accession_number FROM ranked WHERE r <= 2")
def latest_per_ticker(t: Tables) -> DataFrame:
    order = [F.col("filing_date").desc(), F.col("accession_number").desc()]
    return ingest.latest_per_key(_filings(t), ["ticker", "form_type"], order, 2).select(
        "ticker", "form_type", "accession_number"
    )


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def not_ingested(t: Tables) -> DataFrame:
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return ingest.not_ingested(t.customer, urgent, "c_custkey")
