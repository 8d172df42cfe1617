"""Choosing, describing and re-checking the filings to ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.functions.hashing import text_sha256

KNOWN_FORMS = ("10-K", "10-K/A")


def check_plan(settings: Settings) -> int:
    """Number of filings a run would fetch; too many raises ``ValueError``."""
    planned = len(settings.tickers) * max(settings.num_fiscal_years, 1)
    if planned > settings.max_filings_per_run:
        raise ValueError(
            f"{planned} planned filings exceed the limit of {settings.max_filings_per_run}"
        )
    return planned


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key in the given order.

    The ``rank <= n`` filter lets Spark keep only n rows per key before the
    shuffle, so a key that holds most rows costs no more than another.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def choose_filings(filings: DataFrame, settings: Settings) -> DataFrame:
    """Latest original filing per ticker, replaced by the latest amendment when
    that covers the same period."""
    newest = [F.col("filing_date").desc(), F.col("accession_number").desc()]
    years = max(settings.num_fiscal_years, 1)
    originals = latest_per_key(
        filings.where(F.col("form_type") == KNOWN_FORMS[0]), ["ticker"], newest, years
    )
    if not settings.prefer_amended:
        return originals
    amended = latest_per_key(filings.where(F.col("form_type") == KNOWN_FORMS[1]), ["ticker"], newest)
    period = ["ticker", "fiscal_year_end_date"]
    columns = [c for c in filings.columns if c not in period]
    joined = originals.alias("o").join(
        amended.select(*period, F.struct(*columns).alias("amendment")), period, "left"
    )
    chosen = [
        F.when(F.col("amendment").isNotNull(), F.col(f"amendment.{c}"))
        .otherwise(F.col(f"o.{c}")).alias(c)
        for c in columns
    ]
    return joined.select(*period, *chosen).select(*filings.columns)


def first_filled(*values: Column) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def fiscal_year(period: Column, as_of: int | None = None) -> Column:
    """Year of a report period; ``as_of`` where the period names none."""
    return F.coalesce(F.substring(period, 1, 4).try_cast("int"), F.lit(as_of).cast("int"))


def known_form(form: Column) -> Column:
    return F.when(form.isin(*KNOWN_FORMS), form).otherwise(KNOWN_FORMS[0])


def describe_filings(raw: DataFrame, as_of: int | None = None) -> DataFrame:
    """Filing columns from raw filing metadata.

    ``raw`` has company, ticker, cik, form, accession_number, accession_no,
    period_of_report, filing_date, three candidate URLs, raw text and
    ``parsed_sections``.
    """
    return raw.select(
        F.coalesce(F.col("company"), F.col("ticker")).alias("company_name"),
        "ticker",
        F.coalesce(F.col("cik").cast("string"), F.lit("")).alias("cik"),
        known_form(F.col("form")).alias("form_type"),
        fiscal_year(F.col("period_of_report"), as_of).alias("fiscal_year"),
        F.coalesce(F.col("period_of_report"), F.lit("")).alias("fiscal_year_end_date"),
        F.coalesce(F.col("filing_date"), F.lit("")).alias("filing_date"),
        first_filled(F.col("accession_number"), F.col("accession_no")).alias("accession_number"),
        F.lit(None).cast("string").alias("accession_number_original"),
        first_filled(F.col("filing_url"), F.col("homepage_url"), F.col("url")).alias("source_url"),
        text_sha256(F.coalesce(F.col("raw_text"), F.lit(""))).alias("file_sha256"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ingested_at"),
        "parsed_sections",
    )


def to_fetch(planned: DataFrame, processed: DataFrame, cached: DataFrame) -> DataFrame:
    """Planned filings that are not already ingested and intact.

    ``processed`` holds the recorded checksum, ``cached`` the checksum of the
    raw bytes now; a filing is skipped only when both exist and agree.
    """
    key = ["ticker", "accession_number"]
    intact = processed.select(*key, "file_sha256").join(
        cached.select(*key, "file_sha256"), key + ["file_sha256"], "left_semi"
    )
    return planned.join(intact.select(*key), key, "left_anti")


def not_ingested(expected: DataFrame, ingested: DataFrame, key: str = "ticker") -> DataFrame:
    """Expected keys with no ingested row."""
    return expected.select(key).distinct().join(ingested.select(key), key, "left_anti")


def ingest_counts(results: DataFrame) -> DataFrame:
    """How many filings were parsed and how many failed."""
    return results.agg(
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") != "ok").alias("failed"),
    )
