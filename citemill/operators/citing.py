"""From a generated text to a cited answer, an abstention or an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.config import ABSTENTION, GENERATION_ERROR_ANSWER
from citemill.functions.citations import RANGES, is_abstention, marker_ranges, numbers_within, ranges_beyond
from citemill.schemas import CITATION

_CITATIONS = f"array<{CITATION.simpleString()}>"


def resolve_citations(ranges: Column, sources: Column) -> Column:
    """Citations for the numbers that name a source, in marker order."""
    blank = lambda c: F.coalesce(c, F.lit(""))

    def citation(n: Column) -> Column:
        source = F.get(sources, (n - 1).cast("int"))
        return F.struct(
            n.cast("int").alias("n"), blank(source.company).alias("company"),
            F.coalesce(source.fiscal_year, F.lit(0)).alias("fiscal_year"),
            blank(source.section).alias("section"), blank(source.chunk_id).alias("chunk_id"),
            blank(source.source_url).alias("source_url"),
        )

    return F.transform(numbers_within(ranges, F.size(sources)), citation).cast(_CITATIONS)


def out_of_range(ranges: Column, sources: Column) -> Column:
    """Ranges of numbers that name no source."""
    return ranges_beyond(ranges, F.size(sources))


def conclude(generated: DataFrame) -> DataFrame:
    """Add answer, citations, out_of_range, abstained, ungrounded, truncated and
    error to rows of ``sources`` and ``generation``.

    A generation error is reported as such and is no abstention. An abstention
    has no citations. An answer without a valid citation becomes an abstention.
    """
    none = F.array().cast(_CITATIONS)
    error, text = F.col("generation.error"), F.col("generation.text")
    marked = generated.withColumns({
        "_failed": error.isNotNull(), "_declined": is_abstention(text),
    }).withColumn(
        "_ranges",
        F.when(F.col("_failed") | F.col("_declined"), F.array().cast(RANGES))
        .otherwise(marker_ranges(text)),
    ).withColumns({
        "citations": resolve_citations(F.col("_ranges"), F.col("sources")),
        "out_of_range": out_of_range(F.col("_ranges"), F.col("sources")),
    })
    uncited = F.size("citations") == 0
    return marked.withColumns({
        "answer": F.when(F.col("_failed"), GENERATION_ERROR_ANSWER)
        .when(~F.col("_declined") & uncited, ABSTENTION).otherwise(text),
        "abstained": ~F.col("_failed") & (F.col("_declined") | uncited),
        "ungrounded": ~F.col("_failed") & ~F.col("_declined") & uncited,
        "citations": F.when(uncited, none).otherwise(F.col("citations")),
        "truncated": ~F.col("_failed") & F.col("generation.truncated"),
        "error": error,
    }).drop("_failed", "_declined", "_ranges")
