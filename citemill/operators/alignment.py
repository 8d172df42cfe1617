"""A judge that aligns sentences word by word and needs no model.

Shares of keywords say that an answer speaks of the same things as its sources,
not that it says the same of them. Here each sentence of an answer is held
against each sentence of the cited texts by the longest common subsequence of
their keywords, so that order counts. All is array expressions on one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citemill.functions.binding import let
from citemill.functions.citations import MARKER
from citemill.functions.text import keywords, sentences, strip

# A sentence with this share of its keywords in one cited sentence, in order, counts as supported.
MIN_SUPPORT = 0.6


def common_length(mine: Column, other: Column) -> Column:
    """Length of the longest common subsequence of two word lists.

    A fold over ``other`` keeps, for each length so far, the first place in
    ``mine`` where a common subsequence of that length can end. A word moves an
    end to its nearest place after the end before, so a step costs the words of
    ``mine``, and words that ``mine`` lacks are left out beforehand.
    """
    places = F.sequence(F.lit(1), F.size(mine))

    def follow(ends: Column, word: Column) -> Column:
        def moved(own: Column) -> Column:
            def nearest(k: Column) -> Column:
                before = F.coalesce(F.get(ends, k - 1), F.lit(0))
                return F.least(F.get(ends, k), F.get(F.filter(own, lambda i: i > before), F.lit(0)))

            return F.filter(F.transform(F.sequence(F.lit(0), F.size(ends)), nearest), lambda e: e.isNotNull())

        return let(F.filter(places, lambda i: F.get(mine, i - 1) == word), moved)

    met = F.filter(other, lambda w: F.array_contains(mine, w))
    folded = F.size(F.aggregate(met, F.array().cast("array<int>"), follow))
    return F.when(F.size(mine) == 0, 0).otherwise(folded)


def sentence_support(text: Column, evidence: Column) -> Column:
    """For each sentence of ``text`` that has keywords: the sentence, the most of its keywords found in order in one
    sentence of ``evidence`` as a share, and the place of the first such sentence (0 if none has any).

    Null texts have no sentences.
    """
    given = F.transform(sentences(F.coalesce(evidence, F.lit(""))), keywords)

    def supported(sources: Column) -> Column:
        def one(sentence: Column) -> Column:
            def best(mine: Column) -> Column:
                lengths = F.transform(sources, lambda other: common_length(mine, other))
                return let(lengths, lambda found: let(F.coalesce(F.array_max(found), F.lit(0)), lambda most: F.struct(
                    strip(sentence).alias("sentence"), F.size(mine).alias("n_words"),
                    F.coalesce(F.try_divide(most.cast("double"), F.size(mine).cast("double")), F.lit(0.0)).alias("support"),
                    F.when(most > 0, F.array_position(found, most)).otherwise(0).cast("int").alias("place"),
                )))

            return let(keywords(sentence), best)

        return F.filter(F.transform(sentences(F.coalesce(text, F.lit(""))), one), lambda s: s["n_words"] > 0)

    return let(given, supported)


def mean_support(text: Column, evidence: Column) -> Column:
    """Mean support of the sentences of ``text``, 0 where it has none."""

    def mean(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0.0), lambda acc, s: acc + s["support"])
        return F.coalesce(F.try_divide(total, F.size(found).cast("double")), F.lit(0.0))

    return let(sentence_support(text, evidence), mean)


def unmarked(answer: Column) -> Column:
    """The answer without its citation markers."""
    return F.regexp_replace(answer, MARKER, " ")


def aligned_judge(question: Column, context: Column, reference: Column, answer: Column) -> Column:
    """Judge of the form of ``evaluation.lexical_judge`` by alignment: the answer against the cited texts, the question
    and the reference against the answer."""
    said = unmarked(answer)
    return F.struct(
        mean_support(said, context).alias("groundedness"), mean_support(question, said).alias("relevance"),
        mean_support(reference, said).alias("correctness"),
    )


def unsupported(answer: Column, context: Column, least: float = MIN_SUPPORT) -> Column:
    """The sentences of an answer that no cited sentence supports to ``least``, in order."""
    found = F.filter(sentence_support(unmarked(answer), context), lambda s: s["support"] < least)
    return F.transform(found, lambda s: s["sentence"])
