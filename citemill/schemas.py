"""Explicit schemas of the tables that cross a stage boundary."""

from pyspark.sql import types as T

SECTIONS = T.ArrayType(
    T.StructType([
        T.StructField("ord", T.IntegerType()),
        T.StructField("section", T.StringType()),
        T.StructField("text", T.StringType()),
    ])
)

# One filing, as held between ingest and chunking. Dates stay strings.
FILING = T.StructType([
    T.StructField("company_name", T.StringType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("cik", T.StringType()),
    T.StructField("form_type", T.StringType()),
    T.StructField("fiscal_year", T.IntegerType()),
    T.StructField("fiscal_year_end_date", T.StringType()),
    T.StructField("filing_date", T.StringType()),
    T.StructField("accession_number", T.StringType()),
    T.StructField("accession_number_original", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("file_sha256", T.StringType()),
    T.StructField("ingested_at", T.StringType()),
    T.StructField("parsed_sections", SECTIONS),
])

# The same filing in its JSON file, where sections are an object.
FILING_JSON = T.StructType(
    [f for f in FILING.fields if f.name != "parsed_sections"]
    + [T.StructField("parsed_sections", T.MapType(T.StringType(), T.StringType()))]
)

CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("cik", T.StringType()),
    T.StructField("fiscal_year", T.IntegerType()),
    T.StructField("fiscal_year_end_date", T.StringType()),
    T.StructField("form_type", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("accession_number", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("chunk_index_in_section", T.IntegerType()),
])

# Columns of a chunk other than its key and text.
CHUNK_METADATA = [f.name for f in CHUNK.fields if f.name not in ("chunk_id", "text")]

STORED_CHUNK = T.StructType(
    CHUNK.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
)

CITATION = T.StructType([
    T.StructField("n", T.IntegerType()),
    T.StructField("company", T.StringType()),
    T.StructField("fiscal_year", T.IntegerType()),
    T.StructField("section", T.StringType()),
    T.StructField("chunk_id", T.StringType()),
    T.StructField("source_url", T.StringType()),
])

GENERATION = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("truncated", T.BooleanType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("cost_usd", T.DoubleType()),
    T.StructField("error", T.StringType()),
])

GOLDEN = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("reference_answer", T.StringType()),
    T.StructField("expected_sources", T.ArrayType(
        T.StructType([
            T.StructField("company", T.StringType()),
            T.StructField("year", T.IntegerType()),
            T.StructField("section", T.StringType()),
            T.StructField("chunk_id", T.StringType()),
        ])
    )),
    T.StructField("question_type", T.StringType()),
    T.StructField("should_abstain", T.BooleanType()),
])
