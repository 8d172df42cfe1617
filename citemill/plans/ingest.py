"""From raw filings to processed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.operators.ingest import (
    check_plan, choose_filings, describe_filings, first_filled, to_fetch,
)
from citemill.operators.sections import extract_sections, gate_sections
from citemill.schemas import FILING
from citemill.session import path_exists, stage
from citemill.sources.files import parsed_html, read_filings, read_raw, write_filings, write_raw


def ingest(
    raw: DataFrame, processed_path: str, raw_path: str, settings: Settings, as_of: int | None = None
) -> DataFrame:
    """Ingest the chosen filings of ``raw`` that are not already there intact.

    ``raw`` has one row per filing: ticker, company, cik, form,
    accession_number, accession_no, period_of_report, filing_date, filing_url,
    homepage_url, url, raw_text, html and ``items``, a map of item label to text
    that is null where the lookup failed. Returns one row per filing tried, with
    ``status`` and what is missing; a filing that fails a gate is not written and
    does not stop the others.
    """
    check_plan(settings)
    spark = raw.sparkSession
    listed = raw.where(F.col("ticker").isin(list(settings.tickers))).withColumns({
        "accession_number": first_filled(F.col("accession_number"), F.col("accession_no")),
        "form_type": F.col("form"), "fiscal_year_end_date": F.col("period_of_report"),
    })
    chosen = choose_filings(listed, settings).drop("form_type", "fiscal_year_end_date")
    if path_exists(spark, processed_path) and path_exists(spark, raw_path):
        chosen = to_fetch(chosen, read_filings(spark, processed_path), read_raw(spark, raw_path))
    # Pages are turned into text only where the heading search will need it.
    page = F.when(F.col("items").isNull(), F.col("html"))
    read = chosen.withColumn("page", parsed_html(page)).withColumns({
        "text": F.col("page.text"), "error": F.col("page.error"), "failed": F.col("items").isNull(),
    })
    gated = gate_sections(extract_sections(read.drop("page"), "items", "text", "failed"))
    # A page that cannot be parsed fails its filing, whatever was found without it.
    status = F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("status"))
    tried = stage(gated.withColumn("status", status), "parsed")
    sound = tried.where(F.col("status") == "ok")
    write_raw(sound.withColumn("raw_text", F.coalesce("raw_text", F.lit(""))), raw_path)
    write_filings(describe_filings(sound, as_of).select(*FILING.names), processed_path)
    return tried.select("ticker", "accession_number", "status", "missing", "truncated", "warnings", "error")
