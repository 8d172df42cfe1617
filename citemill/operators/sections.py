"""Section extraction from filings, and the gates on what was found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.config import (
    MIN_REQUIRED_CHARS, MIN_SECTION_CHARS, OPTIONAL_SECTIONS, REQUIRED_SECTIONS, SECTION_LABELS,
)
from citemill.functions.binding import let
from citemill.functions.text import SPACES, normalize_text, strip

# Pages often write the spaces of a heading as U+00A0 and its like.
_GAP = rf"[{SPACES}]"

# Headings that open a section, in filing order.
SECTION_HEADINGS = (
    ("Item 1", rf"(?i)item{_GAP}*1[.{SPACES}]+business"),
    ("Item 1A", rf"(?i)item{_GAP}*1a[.{SPACES}]+risk{_GAP}+factors"),
    ("Item 7", rf"(?i)item{_GAP}*7[.{SPACES}]+management"),
    ("Item 7A", rf"(?i)item{_GAP}*7a"),
    ("Item 8", rf"(?i)item{_GAP}*8[.{SPACES}]+financial{_GAP}+statements"),
    ("Item 9A", rf"(?i)item{_GAP}*9a"),
)

_SECTIONS = "array<struct<ord:int,section:string,text:string>>"


def _section(order: int, label: str, text: Column) -> Column:
    return F.struct(
        F.lit(order).alias("ord"), F.lit(label).alias("section"), text.alias("text")
    ).cast("struct<ord:int,section:string,text:string>")


def labelled_sections(items: Column) -> Column:
    """Sections from a map of item label to raw text: the known labels, in order,
    normalised, without stubs."""
    cleaned = F.array(*[
        _section(i, label, normalize_text(F.try_element_at(items, F.lit(label))))
        for i, label in enumerate(SECTION_LABELS)
    ])
    return F.filter(
        cleaned,
        lambda s: (F.length(s.text) >= MIN_SECTION_CHARS) & (F.lower(s.text) != "none"),
    )


def headed_sections(text: Column) -> Column:
    """Sections found by their headings in the whole text of a filing.

    A section starts at the first match of its heading and ends at the first
    later match of the next heading in the list, else at the end of the text.
    """

    def found(whole: Column, i: int) -> Column:
        label, pattern = SECTION_HEADINGS[i]

        def body(start: Column) -> Column:
            rest = F.substring(whole, start, F.length(whole))
            if i + 1 == len(SECTION_HEADINGS):
                return F.when(start > 0, _section(i, label, strip(rest)))
            # Searched from the second character on, so that the section's own
            # first character cannot open the next one.
            span = let(rest, lambda r: let(
                F.regexp_instr(F.substring(r, F.lit(2), F.length(r)), F.lit(SECTION_HEADINGS[i + 1][1])),
                lambda stop: F.when(stop > 0, F.substring(r, F.lit(1), stop)).otherwise(r),
            ))
            return F.when(start > 0, _section(i, label, strip(span)))

        return let(F.regexp_instr(whole, F.lit(pattern)), body)

    return let(text, lambda whole: F.array_compact(
        F.array(*[found(whole, i) for i in range(len(SECTION_HEADINGS))])
    ))


def extract_sections(df: DataFrame, items: str, text: str, failed: str) -> DataFrame:
    """Add ``parsed_sections``. The heading search runs only for filings whose
    item lookup failed as a whole; a missing item does not trigger it."""
    return df.withColumn(
        "parsed_sections",
        F.when(F.col(failed), headed_sections(F.col(text)))
        .otherwise(labelled_sections(F.col(items)))
        .cast(_SECTIONS),
    )


def present(sections: Column) -> Column:
    return F.transform(sections, lambda s: s.section)


def required_missing(sections: Column) -> Column:
    """Required sections that are absent."""
    return F.array_except(F.lit(list(REQUIRED_SECTIONS)), present(sections))


def optional_missing(sections: Column) -> Column:
    return F.array_except(F.lit(list(OPTIONAL_SECTIONS)), present(sections))


def required_truncated(sections: Column) -> Column:
    """Required sections that are present but too short to be real."""
    short = F.filter(
        sections,
        lambda s: s.section.isin(*REQUIRED_SECTIONS) & (F.length(s.text) < MIN_REQUIRED_CHARS),
    )
    return present(short)


def gate_sections(df: DataFrame) -> DataFrame:
    """Add ``missing``, ``truncated``, ``warnings`` and ``status`` (ok or failed)."""
    sections = F.col("parsed_sections")
    gated = df.withColumns({
        "missing": required_missing(sections),
        "truncated": required_truncated(sections),
        "warnings": optional_missing(sections),
    })
    bad = reduce(lambda a, b: a | b, [F.size(c) > 0 for c in ("missing", "truncated")])
    return gated.withColumn("status", F.when(bad, "failed").otherwise("ok"))
