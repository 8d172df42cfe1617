"""Sentence boundaries learned from the corpus: abbreviations are found without labels.

A word that nearly always has a full stop behind it is an abbreviation. How far its stops exceed what the share of
stops in the corpus explains is a log-likelihood ratio of two binomials; it is weighed down for long words, which are
seldom abbreviations, and for words often seen without a stop, and up for stops inside (Kiss and Strunk, 2006). Only
counts of word types are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.functions.binding import let
from citemill.functions.text import GAPS, strip

# Least score of an abbreviation.
THRESHOLD = 0.3
# Share of stops expected behind an abbreviation.
EXPECTED = 0.99
# Word types taken into an expression.
MAX_TYPES = 100_000

# Words as they stand between white space, without brackets and quotes around them.
_WORD_EDGES = "()[]{}\"'“”‘’«»,;:"
# A stretch of text up to a possible boundary, with the white space behind it.
_STRETCH = rf"(?s).*?[.!?][{GAPS}]+|.+\z"
# The last word of each such stretch but one at the end of the text: tried where a word begins only, and never given back.
_LAST_WORD = rf"(?<![^{GAPS}])([^{GAPS}]++)(?<=[.!?])[{GAPS}]"


def _type(word: Column) -> Column:
    """The word type: lower case, without the stop behind it."""
    return F.regexp_replace(F.lower(F.btrim(word, F.lit(_WORD_EDGES))), r"\.\z", "")


def word_types(texts: DataFrame, text: str = "text") -> DataFrame:
    """(type, with_stop, without_stop): how often each word type stands with a full stop behind it and without."""
    # Each spelling is counted first, and its type taken once. The outer form keeps Spark from splitting twice, once to test
    # for an empty array.
    words = texts.select(F.explode_outer(F.split(text, f"[{GAPS}]+")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("w <> ''")
    bare = F.btrim("w", F.lit(_WORD_EDGES))
    counted = words.select(_type(F.col("w")).alias("type"), F.when(F.endswith(bare, F.lit(".")), F.col("n")).otherwise(0).alias("stop"), "n")
    # With the count in it, the filter stays above the counting and sees each spelling once.
    return counted.where(F.when(F.col("n") > 0, F.rlike("type", F.lit(r"\p{L}")))).groupBy("type").agg(
        F.sum("stop").alias("with_stop"), F.sum(F.col("n") - F.col("stop")).alias("without_stop")
    )


def _log_likelihood(stops: Column, n: Column, share: Column) -> Column:
    """Logarithm of the chance of so many stops in n, but for the number of ways."""
    return stops * F.log(share) + (n - stops) * F.log1p(-share)


def abbreviations(texts: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(type, with_stop, without_stop, score) of the word types that are abbreviations. Null texts have no words."""
    types = word_types(texts, text)
    total = types.agg(
        (F.sum("with_stop") / F.sum(F.col("with_stop") + F.col("without_stop"))).alias("share")
    )
    n, stops = F.col("with_stop") + F.col("without_stop"), F.col("with_stop")
    # Without any stop, or with nothing else, no share tells words apart.
    share = F.least(F.greatest(F.col("share"), F.lit(1e-9)), F.lit(1 - 1e-9))
    ratio = 2 * (_log_likelihood(stops, n, F.lit(EXPECTED)) - _log_likelihood(stops, n, share))
    letters = F.length(F.regexp_replace("type", r"\.", ""))
    inside = F.length("type") - letters
    score = ratio * F.exp(-letters) * (inside + 1) * F.pow(letters.cast("double"), -F.col("without_stop").cast("double"))
    scored = types.where("with_stop > 0").crossJoin(F.broadcast(total)).withColumn("score", score)  # one row of totals
    return scored.where(F.col("score") >= threshold).select("type", "with_stop", "without_stop", "score")


def learned_types(texts: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> list[str]:
    """The abbreviations as a list for ``learned_sentences``. More than ``MAX_TYPES`` ask for a higher threshold."""
    rows = abbreviations(texts, text, threshold).select("type").limit(MAX_TYPES + 1).collect()
    if len(rows) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} abbreviations: raise the threshold")
    return sorted(r[0] for r in rows)


def learned_sentences(text: Column, types: list[str]) -> Column:
    """Sentences of a text: cut at white space after a full stop, ``!`` or ``?``, but not after an abbreviation's stop.
    The white space inside a sentence stays as it is."""
    kinds = set(types)

    def ends(last: Column) -> Column:
        known = _type(last).isin(sorted(kinds)) if kinds else F.lit(False)
        return ~(F.endswith(F.btrim(last, F.lit(_WORD_EDGES)), F.lit(".")) & known)

    def joined(parts: Column, last: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(parts) - 1)
        starts = F.filter(at, lambda i: (i == 0) | F.get(last, i - 1))
        cut = lambda s: F.transform(
            s, lambda i, k: F.array_join(F.slice(parts, i + 1, F.coalesce(F.get(s, k + 1), F.size(parts)) - i), "")
        )
        return let(starts, cut)

    def pieces(body: Column) -> Column:
        stretches = F.regexp_extract_all(body, F.lit(_STRETCH), F.lit(0))
        last_words = F.regexp_extract_all(body, F.lit(_LAST_WORD), F.lit(1))
        return let(stretches, lambda parts: F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(
            let(F.transform(last_words, ends), lambda last: joined(parts, last))
        ))

    return F.filter(F.transform(let(text, pieces), strip), lambda s: s != "")
