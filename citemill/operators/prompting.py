"""The prompt that carries a question and its numbered sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.config import ABSTENTION

# Fixed value: the rules every generator is given.
SYSTEM_PROMPT = (
    "You are a research assistant answering questions strictly from the provided CONTEXT.\n\n"
    "Rules:\n"
    "1. Use only the provided CONTEXT to answer. Do not use outside knowledge, even if you know "
    "the answer.\n"
    "2. Every factual claim must be supported by an inline citation. Cite each source as its own "
    "bracketed number: write [1][2], NEVER [1, 2] or [1-3]. Use only numbers that appear in the "
    "CONTEXT block.\n"
    "3. If the answer is not contained in the CONTEXT, your ENTIRE reply must be exactly: "
    f'"{ABSTENTION}" Do not add any other text, and do not guess.\n'
    "4. Do not invent quantities, names, dates, or company-specific details.\n"
    "5. Keep the answer concise. Use short paragraphs or bullets. End with a \"Sources\" list."
)


def source_line(source: Column) -> Column:
    """One numbered source; ``source`` is a struct of rank, text and metadata."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        F.lit("["), source.rank.cast("string"), F.lit("] "), blank(source.text),
        F.lit("\n    (Source: "), F.coalesce(source.company, F.lit("Unknown")),
        F.lit(" "), blank(source.fiscal_year), F.lit(" 10-K, "), blank(source.section),
        F.lit(", chunk "), blank(source.chunk_id), F.lit(")"),
    )


def collect_sources(reranked: DataFrame) -> DataFrame:
    """One row per question with ``sources``, its few chunks in rank order."""
    fields = ("rank", "text", "company", "fiscal_year", "section", "chunk_id", "source_url")
    return reranked.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("sources")
    )


def prompt(question: Column, sources: Column) -> Column:
    context = F.array_join(F.transform(sources, source_line), "\n\n")
    return F.concat(
        F.lit("QUESTION:\n"), question, F.lit("\n\nCONTEXT:\n"), context, F.lit("\n\nANSWER:")
    )
