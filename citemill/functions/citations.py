"""Citation markers and abstention, as array expressions on an answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citemill.config import ABSTENTION
from citemill.functions.text import SPACES, strip

# Fixed value: a bracketed group of numbers and ranges, such as [1], [1, 2-4].
MARKER = rf"\[(\d+(?:[{SPACES}]*[,\-][{SPACES}]*\d+)*)\]"
# Fixed value: quoting a model may put before the abstention phrase.
QUOTING = ">#*-\").“”' "
# A number of more digits than a decimal holds counts as the largest one.
NUMBER = "decimal(38,0)"
RANGES = f"array<struct<first:{NUMBER},last:{NUMBER}>>"
_LARGEST = "9" * 38


def marker_ranges(answer: Column) -> Column:
    """Ranges of numbers cited in ``answer``, in order; a single number is a
    range of one.

    ``[a-b]`` counts up from a to b and is left out when b < a; ``[a-b-c]`` is no
    range and yields nothing. Ranges are never listed number by number, so their
    length costs nothing.
    """
    groups = F.regexp_extract_all(answer, F.lit(MARKER), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    ends = F.transform(parts, lambda p: F.transform(F.split(p, "-"), _number))
    whole = F.filter(ends, lambda e: (F.size(e) == 1) | (F.size(e) == 2) & (F.get(e, F.lit(0)) <= F.get(e, F.lit(1))))
    return F.transform(
        whole, lambda e: F.struct(F.get(e, F.lit(0)).alias("first"), F.get(e, F.size(e) - 1).alias("last"))
    ).cast(RANGES)


def numbers_within(ranges: Column, most: Column) -> Column:
    """Distinct numbers 1 to ``most`` in the ranges, in order of first appearance."""
    inside = F.filter(ranges, lambda r: (r["first"] <= most) & (r["last"] >= 1))
    return F.array_distinct(F.flatten(F.transform(inside, lambda r: F.sequence(
        F.greatest(r["first"], F.lit(1)).cast("int"), F.least(r["last"], most).cast("int")
    ))))


def ranges_beyond(ranges: Column, most: Column) -> Column:
    """The distinct parts of the ranges that are not within 1 to ``most``."""

    def outside(r: Column) -> Column:
        below = F.struct(r["first"].alias("first"), F.least(r["last"], F.lit(0)).cast(NUMBER).alias("last"))
        above = F.struct(F.greatest(r["first"], most + 1).cast(NUMBER).alias("first"), r["last"].alias("last"))
        return F.filter(F.array(below, above), lambda p: p["first"] <= p["last"])

    return F.array_distinct(F.flatten(F.transform(ranges, outside))).cast(RANGES)


def _number(text: Column) -> Column:
    digits = F.regexp_replace(strip(text), "^0+(?=.)", "")
    return F.when(F.length(digits) > len(_LARGEST), F.lit(_LARGEST)).otherwise(digits).cast(NUMBER)


def is_abstention(answer: Column) -> Column:
    """True when the answer leads with the abstention phrase."""
    head = F.lower(F.ltrim(strip(answer), F.lit(QUOTING)))
    return F.startswith(head, F.lit(ABSTENTION.rstrip(".").lower()))
