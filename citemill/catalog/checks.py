"""Quality gates over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.catalog import sqltext as q
from citemill.catalog.registry import Tables, query
from citemill.config import Settings
from citemill.operators import checks, ingest

SETTINGS = Settings()
# Fixed value: the replacement character, put into every fiftieth document here
# and in the SQL, since no document has it.
_BROKEN = "CASE WHEN doc_id % 50 = 0 THEN concat(text, '�') WHEN doc_id % 70 = 0 THEN concat('Ã©', text) ELSE text END"


@query(f"SELECT doc_id FROM (SELECT doc_id, {_BROKEN} AS text FROM documents) WHERE "
       + " OR ".join(f"contains(text, '{mark}')" for mark in checks.MOJIBAKE))
def mojibake(t: Tables) -> DataFrame:
    return checks.check_mojibake(t.texts.select("doc_id", F.expr(_BROKEN).alias("text")), ["doc_id"])


@query(rf"""
SELECT doc_id, round(r, 6) AS junk_ratio FROM (
  SELECT doc_id, text, length(regexp_replace(text, '[\p{{L}}\p{{N}}{q.SPACES}]+', '', 'g')) / length(text)::DOUBLE AS r FROM documents)
WHERE length(text) >= 200 AND r >= 0.15
""")
def junk_ratio(t: Tables) -> DataFrame:
    return checks.check_junk(t.texts, ["doc_id"])


@query(r"SELECT round(avg(regexp_matches(text, '\p{Lu}')::INT), 6) AS upper_share FROM documents")
def upper_share(t: Tables) -> DataFrame:
    return checks.upper_share(t.texts).select(F.round("upper_share", 6).alias("upper_share"))


@query("""
WITH scaled AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * label / 4) AS v, label FROM embeddings),
norm AS (SELECT vec_id, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM scaled)
SELECT vec_id, 'norm' AS problem FROM norm WHERE NOT (n > 0.9 AND n < 1.1)
UNION ALL SELECT vec_id, 'dimension' FROM embeddings WHERE label = 7
UNION ALL SELECT vec_id, 'nan' FROM embeddings WHERE label = 9
""")
def vector_sanity(t: Tables) -> DataFrame:
    """Vectors are scaled by a quarter of their label, lose an (always zero-free)
    slot under label 7 and gain a NaN under label 9, so that every rule fires."""
    scale = F.transform("embedding", lambda x: x.cast("double") * F.col("label") / 4)
    broken = (
        F.when(F.col("label") == 7, F.concat(scale, F.array(F.lit(0.0))))
        .when(F.col("label") == 9, F.concat(F.array(F.lit(float("nan"))), F.slice(scale, 2, 63)))
        .otherwise(scale)
    )
    return checks.check_vectors(t.embeddings.select("vec_id", broken.alias("embedding")), 64, "vec_id")


@query("SELECT sha256(text) AS chunk_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_chunks(t: Tables) -> DataFrame:
    return checks.check_chunk_ids(t.texts.select(F.sha2(F.encode("text", "UTF-8"), 256).alias("chunk_id")))


@query("""
SELECT s.source, w.lang AS missing FROM (SELECT DISTINCT source FROM documents) s,
  (SELECT unnest(['en', 'de', 'xx']) AS lang) w
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = s.source AND d.lang = w.lang)
""")
def group_sections(t: Tables) -> DataFrame:
    return checks.check_group_sections(t.documents, "source", ["en", "de", "xx"], "lang")


@query("""
SELECT page_id, unnest(list_filter([CASE WHEN NOT starts_with(url, 'https://') THEN 'not https' END,
                        CASE WHEN NOT contains(url, 'example.org') THEN 'wrong host' END], lambda x: x IS NOT NULL)) AS problem FROM pages
""")
def url_check(t: Tables) -> DataFrame:
    return checks.check_urls(t.pages, ["page_id"], "url", "example.org")


@query(f"SELECT doc_id::VARCHAR AS chunk_id FROM documents WHERE {q.n_tokens('text')} > 2048")
def oversize_chunks(t: Tables) -> DataFrame:
    chunks = t.texts.select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    return checks.check_chunk_size(chunks, SETTINGS)


def _order_chunks(t: Tables) -> DataFrame:
    """Orders as chunks with some metadata missing or wrong."""
    return t.orders.select(
        F.col("o_orderkey").alias("chunk_id"), F.lit("c").alias("company"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise("T").alias("ticker"), F.lit("1").alias("cik"),
        F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("fiscal_year"), F.lit("s").alias("section"),
        F.col("o_custkey").cast("string").alias("accession_number"),
        F.concat(F.when(F.col("o_orderstatus") == "F", "http").otherwise("https"), F.lit("://x")).alias("source_url"),
    )


@query("""
SELECT o_orderkey AS chunk_id, unnest(list_filter([
  CASE WHEN o_orderstatus = 'P' THEN 'missing field' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'empty ticker' END,
  CASE WHEN o_orderstatus = 'F' THEN 'bad source url' END], lambda x: x IS NOT NULL)) AS problem FROM orders
""")
def chunk_metadata(t: Tables) -> DataFrame:
    return checks.check_chunk_metadata(_order_chunks(t))


_TICKERS = "['PFE', 'MRK', 'JNJ', 'ABBV', 'BMY', 'LLY', 'AMGN', 'GILD', 'REGN', 'VRTX', 'MRNA', 'BIIB']"


def _customer_filings(t: Tables) -> DataFrame:
    """Customers as filings: a ticker and a company of the fixed lists, a CIK
    that is no number for debtors, and years beyond the plausible range."""
    tickers = F.array(*[F.lit(x) for x in SETTINGS.tickers])
    names = F.array(*[F.lit(f"{part} Inc") for part in checks.NAME_PARTS.values()])
    year = (F.col("c_custkey") % 40 + 1995).cast("int")
    return t.customer.select(
        F.col("c_custkey").alias("accession_number"),
        F.get(tickers, F.col("c_nationkey") % 12).alias("ticker"),
        F.get(names, (F.col("c_nationkey") % 13).cast("int")).alias("company"),
        F.when(F.col("c_acctbal") < 0, "n/a").otherwise(F.col("c_custkey").cast("string")).alias("cik"),
        year.alias("fiscal_year"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("1999"), F.lit("-12-31")))
        .otherwise(F.concat(year.cast("string"), F.lit("-12-31"))).alias("fiscal_year_end_date"),
    ).withColumn("company_name", F.coalesce("company", F.lit("")))


@query(f"""
WITH f AS (
  SELECT c_custkey AS accession_number, {_TICKERS}[c_nationkey % 12 + 1] AS ticker,
    c_nationkey % 13 = c_nationkey % 12 AS right_name, c_acctbal < 0 AS bad_cik, c_custkey % 40 + 1995 AS y,
    c_mktsegment = 'MACHINERY' AS fixed_period FROM customer)
SELECT ticker, accession_number, unnest(list_filter([
  CASE WHEN NOT right_name THEN 'company name' END, CASE WHEN bad_cik THEN 'cik' END,
  CASE WHEN y NOT BETWEEN 2000 AND 2030 THEN 'fiscal year' END,
  CASE WHEN fixed_period AND y <> 1999 THEN 'period' END], lambda x: x IS NOT NULL)) AS problem FROM f
""")
def filing_metadata(t: Tables) -> DataFrame:
    return checks.check_filing_metadata(_customer_filings(t))


def _document_filings(t: Tables) -> DataFrame:
    """Documents as filings of three sections, some short, blank or with page
    furniture at the start."""
    part = lambda i, label, e: F.struct(
        F.lit(i).alias("ord"), F.lit(label).alias("section"), F.expr(e).alias("text")
    )
    return t.texts.select(
        F.col("source").alias("ticker"), F.col("doc_id").alias("accession_number"),
        F.array(*[part(i, *item) for i, item in enumerate(_PARTS.items())]).alias("parsed_sections"),
    )


_PARTS = {
    "Item 1": "CASE WHEN doc_id % 5 = 0 THEN concat('12 ', text) ELSE text END",
    "Item 7": "CASE WHEN doc_id % 7 = 0 THEN concat('Table of Contents ', text) ELSE text END",
    "Item 8": "CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END",
}


@query("WITH p AS (" + " UNION ALL ".join(
    f"SELECT source AS ticker, doc_id AS accession_number, '{label}' AS section, {e} AS text FROM documents"
    for label, e in _PARTS.items()
) + """)
SELECT ticker, accession_number, section, unnest(list_filter([
  CASE WHEN trim(text) = '' THEN 'empty' END,
  CASE WHEN section <> 'Item 8' AND length(text) < 500 THEN 'too short' END,
  CASE WHEN starts_with(lower(text), 'table of contents') THEN 'table of contents' END,
  CASE WHEN regexp_matches(text, '^[0-9]{1,4}\\s') THEN 'leading page number' END], lambda x: x IS NOT NULL)) AS problem FROM p
""")
def section_check(t: Tables) -> DataFrame:
    return checks.check_sections(_document_filings(t))


@query("""
WITH f AS (SELECT DISTINCT d.source AS ticker FROM documents d JOIN labels l USING (doc_id)),
row AS (
  SELECT d.source AS ticker, d.doc_id, l.quality = 1 AS sound, l.toxic = 1 AS no_url FROM documents d JOIN labels l USING (doc_id))
SELECT source AS ticker, 'no processed filing' AS problem FROM (
  SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT ticker FROM f))
UNION ALL SELECT ticker, 'invalid checksum' FROM row WHERE NOT sound
UNION ALL SELECT ticker, 'invalid source url' FROM row WHERE no_url
UNION ALL SELECT ticker, 'missing required sections' FROM row
UNION ALL SELECT ticker, 'raw text missing or changed' FROM row WHERE NOT sound
""")
def ingest_check(t: Tables) -> DataFrame:
    """Labelled documents as ingested filings: quality 0 stands for a changed
    checksum, toxic for a missing URL, and Item 1A is never there."""
    sha = F.sha2(F.encode("text", "UTF-8"), 256)
    named = t.documents.select("doc_id", F.col("source").alias("ticker"), sha.alias("sha"))
    filings = named.join(t.labels, "doc_id").select(
        "ticker", F.col("doc_id").alias("accession_number"),
        F.when(F.col("quality") == 1, F.col("sha")).otherwise("changed").alias("file_sha256"),
        F.when(F.col("toxic") == 1, "").otherwise("https://x").alias("source_url"),
        F.array(*[
            F.struct(F.lit(i).alias("ord"), F.lit(s).alias("section"), F.lit("t").alias("text"))
            for i, s in enumerate(("Item 1", "Item 7"))
        ]).alias("parsed_sections"),
    )
    cached = named.select("ticker", F.col("doc_id").alias("accession_number"), F.col("sha").alias("file_sha256"))
    return checks.check_ingest(filings, named, cached)


@query("SELECT count(*) FILTER (quality = 1) AS ok, count(*) FILTER (quality <> 1) AS failed FROM labels")
def ingest_counts(t: Tables) -> DataFrame:
    return ingest.ingest_counts(t.labels.withColumn("status", F.when(F.col("quality") == 1, "ok").otherwise("failed")))


@query("""
SELECT l.doc_id AS chunk_id, 'stale' AS problem FROM labels l WHERE l.doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT vec_id, 'lost' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)
""")
def store_check(t: Tables) -> DataFrame:
    return checks.check_store(
        t.labels.withColumnRenamed("doc_id", "chunk_id"), t.embeddings.withColumnRenamed("vec_id", "chunk_id")
    )


@query("""
SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) WHERE p % 20 = 0
""")
def every_twentieth(t: Tables) -> DataFrame:
    return checks.every_nth(t.documents.select("doc_id", "lang", "source", "n_chars"), 20, "doc_id")
