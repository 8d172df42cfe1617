"""Quality gates. Each returns the violating rows; no rows means passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.config import MIN_REQUIRED_CHARS, REQUIRED_SECTIONS, Settings
from citemill.functions.hashing import is_sha256
from citemill.functions.text import has_upper, junk_ratio, strip, token_count
from citemill.functions.vectors import has_nan, vector_norm
from citemill.operators.sections import required_missing
from citemill.schemas import CHUNK_METADATA
from citemill.session import stage
from citemill.sources.files import checksum_mismatch
from citemill.sources.store import id_difference, repeated

# The replacement character and sequences of wrongly decoded text.
MOJIBAKE = ("�", "Ã©", "Ã¨", "â€™", "â€œ", "â€\x9d", "Ã ", "Ã¢")
# Part of the company name each ticker stands for.
NAME_PARTS = {
    "PFE": "pfizer", "MRK": "merck", "JNJ": "johnson", "ABBV": "abbvie", "BMY": "bristol",
    "LLY": "lilly", "AMGN": "amgen", "GILD": "gilead", "REGN": "regeneron", "VRTX": "vertex",
    "MRNA": "moderna", "BIIB": "biogen",
}
MIN_YEAR, MAX_YEAR = 2000, 2030
MAX_JUNK, JUNK_MIN_CHARS = 0.15, 200


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(True)) for c in conditions])


def problems(df: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """Rows that violate a check, one output row per violation. A check is a
    Column that is true where the row is wrong; null counts as wrong."""
    named = [F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()]
    return df.select(*keys, F.explode(F.array_compact(F.array(*named))).alias("problem"))


def sections_of(filings: DataFrame) -> DataFrame:
    return filings.select("ticker", "accession_number", F.explode("parsed_sections").alias("part")).select(
        "ticker", "accession_number", F.col("part.section").alias("section"), F.col("part.text").alias("text")
    )


def check_ingest(filings: DataFrame, expected: DataFrame, cached: DataFrame) -> DataFrame:
    """Acceptance of an ingest run: every expected ticker has a filing with a
    checksum, a URL, its required sections and an intact raw text."""
    missing = expected.select("ticker").distinct().join(filings.select("ticker"), "ticker", "left_anti")
    wrong = problems(filings, ["ticker"], {
        "invalid checksum": ~is_sha256(F.col("file_sha256")),
        "invalid source url": ~F.startswith(F.col("source_url"), F.lit("http")),
        "missing required sections": F.size(required_missing(F.col("parsed_sections"))) > 0,
    })
    return (
        missing.withColumn("problem", F.lit("no processed filing")).unionByName(wrong)
        .unionByName(checksum_mismatch(filings, cached).select(
            "ticker", F.lit("raw text missing or changed").alias("problem")
        ))
    )


def check_mojibake(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Texts with a replacement character or traces of a wrong decoding."""
    bad = any_of([F.contains(F.col(text), F.lit(mark)) for mark in MOJIBAKE])
    return texts.where(bad).select(*keys)


def check_filing_metadata(filings: DataFrame) -> DataFrame:
    """Names that do not fit the ticker, CIKs that are no number, implausible
    years, and years that differ from the report period."""
    expected = F.lit(None).cast("string")
    for ticker, part in NAME_PARTS.items():
        expected = F.when(F.col("ticker") == ticker, part).otherwise(expected)
    period = F.substring("fiscal_year_end_date", 1, 4)
    year = F.when(F.rlike(period, F.lit(r"^\d{4}$")), period.cast("int"))
    return problems(filings, ["ticker", "accession_number"], {
        "company name": expected.isNotNull() & ~F.contains(F.lower("company_name"), expected),
        "cik": ~F.rlike("cik", F.lit(r"^\d+$")),
        "fiscal year": ~F.col("fiscal_year").between(MIN_YEAR, MAX_YEAR),
        "period": year.isNotNull() & (year != F.col("fiscal_year")),
    })


def check_sections(filings: DataFrame) -> DataFrame:
    """Empty sections, short required sections, and page furniture at the start."""
    head = F.substring("text", 1, 40)
    return problems(sections_of(filings), ["ticker", "accession_number", "section"], {
        "empty": F.coalesce(strip(F.col("text")), F.lit("")) == "",
        "too short": F.col("section").isin(*REQUIRED_SECTIONS) & (F.length("text") < MIN_REQUIRED_CHARS),
        "table of contents": F.startswith(F.lower(head), F.lit("table of contents")),
        "leading page number": F.rlike(head, F.lit(r"^\d{1,4}\s")),
    })


def check_junk(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Texts of some length with too many characters that carry no content."""
    ratio = junk_ratio(F.col(text))
    return texts.where((F.length(text) >= JUNK_MIN_CHARS) & (ratio >= MAX_JUNK)).select(
        *keys, F.round(ratio, 6).alias("junk_ratio")
    )


def check_urls(rows: DataFrame, keys: list[str], url: str = "source_url", host: str = "sec.gov") -> DataFrame:
    """Rows whose URL is not https or not on the expected host."""
    return problems(rows, keys, {
        "not https": ~F.startswith(F.col(url), F.lit("https://")),
        "wrong host": ~F.contains(F.col(url), F.lit(host)),
    })


def check_chunk_ids(chunks: DataFrame) -> DataFrame:
    return repeated(chunks)


def check_chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Chunks with a missing field, an empty ticker or a URL that is not https."""
    required = [c for c in CHUNK_METADATA if c in (
        "company", "ticker", "cik", "fiscal_year", "section", "accession_number", "source_url",
    )]
    return problems(chunks, ["chunk_id"], {
        "missing field": any_of([F.col(c).isNull() for c in required]),
        "empty ticker": F.col("ticker") == "",
        "bad source url": ~F.startswith(F.col("source_url"), F.lit("https://")),
    })


def check_group_sections(
    chunks: DataFrame, group: str, wanted: list[str], section: str = "section"
) -> DataFrame:
    """Wanted sections that a group has no chunk of."""
    held = chunks.groupBy(group).agg(F.collect_set(
        F.when(F.col(section).isin(wanted), F.col(section))
    ).alias("held"))
    return held.select(group, F.explode(F.array_except(F.lit(wanted), "held")).alias("missing"))


def check_chunk_size(chunks: DataFrame, settings: Settings) -> DataFrame:
    """Chunks the embedding model would cut off."""
    return chunks.where(token_count(F.col("text")) > settings.max_seq_length).select("chunk_id")


def upper_share(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Share of texts with an upper-case letter; near 1 unless casing was lost."""
    return chunks.agg(F.avg(has_upper(F.col(text)).cast("double")).alias("upper_share"))


def check_vectors(store: DataFrame, dim: int, key: str = "chunk_id") -> DataFrame:
    """Embeddings of the wrong size, not of unit length, or with NaN."""
    norm = vector_norm(F.col("embedding"))
    return problems(store, [key], {
        "dimension": F.size("embedding") != dim,
        "norm": F.isnan(norm) | (norm <= 0.9) | (norm >= 1.1),
        "nan": has_nan(F.col("embedding")),
    })


def check_store(stored: DataFrame, produced: DataFrame) -> DataFrame:
    """Differences between what is stored and what a run produced: stale and
    lost ids, ids produced twice and, where both have texts, ids whose text
    changed. An id covers only the start of its text, so the whole is compared."""
    side = F.when(F.col("side") == "left", "stale").otherwise("lost")
    problems = id_difference(stored, produced).select("chunk_id", side.alias("problem"))
    double = repeated(produced).select("chunk_id", F.lit("repeated").alias("problem"))
    found = problems.unionByName(double)
    if "text" not in stored.columns or "text" not in produced.columns:
        return found
    digest = lambda df, name: df.select("chunk_id", F.md5(F.encode("text", "UTF-8")).alias(name))
    changed = digest(stored, "_old").join(digest(produced, "_new"), "chunk_id").where(
        ~F.col("_old").eqNullSafe(F.col("_new"))
    ).select("chunk_id", F.lit("changed").alias("problem")).distinct()
    return found.unionByName(changed)


def every_nth(df: DataFrame, n: int, order: str) -> DataFrame:
    """Every ``n``-th row in the order of a column of distinct values, the first
    included. Row numbers come from per-partition counts after a range sort, so
    no task sees more than its own partition. The values alone are sorted and
    numbered, once: the bounds of a range sort come from a sample, so a second
    run may cut the partitions elsewhere."""
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(order).repartitionByRange(n_parts, order).sortWithinPartitions(order)
    numbered = stage(ordered.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition, so this window is as small as the partition list.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    position = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    joined = numbered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    chosen = joined.where(position % n == 0).select(order)
    return df.join(chosen, df[order].eqNullSafe(chosen[order]), "left_semi")
