"""Token-bounded, overlapping chunks of section text.

Every step is an array expression on the row that holds the section, so a
corpus is chunked without a shuffle and without leaving the JVM. A section is
cut into sentences; one pass over their token counts gives *spans*, each a run
of sentences; spans become text; small chunks join a neighbour and chunks over
the ceiling are cut into windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.functions.binding import let
from citemill.functions.hashing import chunk_id
from citemill.functions.text import sentences, strip, token_count, token_pieces
from citemill.functions.tokens import tokenizer_for
from citemill.operators.boundaries import learned_sentences, learned_types

_SPANS = "array<struct<lo:int,hi:int,kind:string>>"
_STATE = f"struct<lo:int,total:int,seeded:boolean,spans:{_SPANS}>"


def tail_slice(text: Column, tokens: int) -> Column:
    """Text of the last ``tokens`` tokens; the whole text when it has no more."""
    return let(
        token_pieces(text),
        lambda p: F.when(F.size(p) <= tokens, text).otherwise(
            strip(F.array_join(F.slice(p, -tokens, tokens), ""))
        ),
    )


def window_texts(text: Column, size: int, stride: int) -> Column:
    """Windows of ``size`` tokens, one every ``stride`` tokens while any token is
    left; the last windows may lie inside the one before. A text without tokens
    is its own window."""

    def cut(pieces: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(pieces) - 1, F.lit(stride))
        window = lambda i: strip(F.array_join(F.slice(pieces, i + 1, size), ""))
        return F.when(F.size(pieces) == 0, F.array(text)).otherwise(F.transform(starts, window))

    return let(token_pieces(text), cut)


def sentence_spans(counts: Column, size: int, overlap: int) -> Column:
    """Greedy packing of sentences by token count, in order.

    Kinds of span: ``plain`` sentences lo..hi; ``seeded`` the same after the
    tail of sentence lo-1; ``long`` one sentence that needs windows. Positions
    count from 0. The fold keeps the open buffer's first sentence, its token
    total and whether a tail seeds it.
    """

    def state(lo, total, seeded, spans) -> Column:
        return F.struct(lo, total, seeded, spans).cast(_STATE)

    def closed(s: Column, i: Column) -> Column:
        kind = F.when(s.seeded, "seeded").otherwise("plain")
        span = F.array(F.struct(s.lo, i - 1, kind)).cast(_SPANS)
        return F.when(s.lo < i, F.concat(s.spans, span)).otherwise(s.spans)

    def carried(s: Column, i: Column) -> Column:
        # Trailing sentences of the buffer that fit the overlap, walking back and
        # stopping at the first that does not. Every sentence has a token, so at
        # most `overlap` of them fit.
        first = F.greatest(s.lo, i - overlap)

        def walk(b: Column, c: Column) -> Column:
            fits = b.open & (b.total + c <= overlap)
            return F.struct(
                F.when(fits, b.n + 1).otherwise(b.n).alias("n"),
                F.when(fits, b.total + c).otherwise(b.total).alias("total"),
                fits.alias("open"),
            ).cast("struct<n:int,total:int,open:boolean>")

        start = F.struct(F.lit(0), F.lit(0), F.lit(True)).cast("struct<n:int,total:int,open:boolean>")
        return F.aggregate(F.reverse(F.slice(counts, first + 1, i - first)), start, walk)

    def step(s: Column, i: Column, c: Column) -> Column:
        long = F.array(F.struct(i, i, F.lit("long"))).cast(_SPANS)
        # With nothing to carry, the tail of the last sentence seeds the next
        # buffer; that sentence is longer than the overlap, so the tail is exactly
        # `overlap` tokens.
        reopened = lambda k: state(
            i - k.n, F.when(k.n == 0, overlap).otherwise(k.total) + c, k.n == 0, closed(s, i)
        )
        return (
            F.when(c > size, state(i + 1, F.lit(0), F.lit(False), F.concat(closed(s, i), long)))
            .when((s.total + c > size) & (s.lo < i), let(carried(s, i), reopened))
            .otherwise(state(s.lo, s.total + c, s.seeded, s.spans))
        )

    empty = state(F.lit(0), F.lit(0), F.lit(False), F.array().cast(_SPANS))
    return F.aggregate(
        F.sequence(F.lit(0), F.size(counts) - 1),
        empty,
        lambda s, i: let(F.get(counts, i), lambda c: step(s, i, c)),
        lambda s: closed(s, F.size(counts)),
    )


def span_texts(spans: Column, sents: Column, settings: Settings) -> Column:
    """Chunk texts of the spans, in order."""
    size, overlap = settings.chunk_size_tokens, settings.chunk_overlap_tokens

    def texts(span: Column) -> Column:
        joined = F.array_join(F.slice(sents, span.lo + 1, span.hi - span.lo + 1), " ")
        seed = tail_slice(F.get(sents, span.lo - 1), overlap)
        windows = window_texts(F.get(sents, span.lo), size, settings.split_stride)
        return (
            F.when(span.kind == "long", windows)
            .when(span.kind == "seeded", F.array(F.concat(seed, F.lit(" "), joined)))
            .otherwise(F.array(joined))
        )

    return F.flatten(F.transform(spans, texts))


def merge_small(texts: Column, min_tokens: int) -> Column:
    """Join chunks of fewer than ``min_tokens`` tokens to the chunk before; a
    small first group goes to the one after."""
    return F.when(F.size(texts) < 2, texts).otherwise(
        let(F.transform(texts, token_count), lambda counts: merge_counted(texts, counts, min_tokens))
    )


def merge_counted(texts: Column, counts: Column, min_tokens: int) -> Column:
    """``merge_small`` with given token counts, for two chunks or more."""
    positions = F.sequence(F.lit(0), F.size(texts) - 1)
    starts = F.filter(positions, lambda i: (i == 0) | (F.get(counts, i) >= min_tokens))

    def without_small_head(g: Column) -> Column:
        head = F.aggregate(F.slice(counts, F.lit(1), F.get(g, F.lit(1))), F.lit(0), lambda a, c: a + c)
        return F.when(
            (F.size(g) > 1) & (head < min_tokens), F.array_remove(g, F.get(g, F.lit(1)))
        ).otherwise(g)

    def joined(g: Column) -> Column:
        end = lambda k: F.coalesce(F.get(g, k + 1), F.size(texts))
        part = lambda lo, k: F.array_join(F.slice(texts, lo + 1, end(k) - lo), " ")
        return F.transform(g, lambda lo, k: strip(part(lo, k)))

    return let(starts, lambda g: let(without_small_head(g), joined))


def enforce_cap(texts: Column, settings: Settings) -> Column:
    """Cut chunks over the ceiling into windows."""
    size, stride = settings.chunk_size_tokens, settings.split_stride
    return F.flatten(F.transform(
        texts,
        lambda t: F.when(
            token_count(t) > settings.safe_max_tokens, window_texts(t, size, stride)
        ).otherwise(F.array(t)),
    ))


def chunk_texts(text: Column, settings: Settings, split: Callable[[Column], Column] = sentences) -> Column:
    """Ordered chunk texts of a section, as an array; empty for a blank text.
    A text within the limit is one verbatim chunk."""
    size, overlap = settings.chunk_size_tokens, settings.chunk_overlap_tokens

    def packed(sents: Column, counts: Column) -> Column:
        parts = span_texts(sentence_spans(counts, size, overlap), sents, settings)
        return let(
            let(parts, lambda p: merge_small(p, settings.min_chunk_tokens)),
            lambda m: enforce_cap(m, settings),
        )

    def sized(body: Column, sents: Column) -> Column:
        total = lambda n: F.aggregate(n, F.lit(0), lambda a, c: a + c)
        return let(
            F.transform(sents, token_count),
            lambda n: F.when(total(n) <= size, F.array(body)).otherwise(packed(sents, n)),
        )

    return let(
        strip(text),
        lambda body: F.when(body == "", F.array().cast("array<string>")).otherwise(
            let(split(body), lambda s: sized(body, s))
        ),
    )


def chunk_sections(
    sections: DataFrame, settings: Settings, split: Callable[[Column], Column] = sentences
) -> DataFrame:
    """One row per chunk of a table of sections.

    ``sections`` has ``accession_number``, ``section`` and ``text``; its other
    columns are repeated on every chunk. The index restarts in each section.
    ``split`` cuts a text into sentences.
    """
    if settings.tokenizer_loader:
        from citemill.operators.token_chunking import chunk_sections_by_tokens

        return chunk_sections_by_tokens(sections, settings, tokenizer_for(settings), split)
    keep = [c for c in sections.columns if c != "text"]
    exploded = sections.select(
        *keep,
        F.posexplode(chunk_texts(F.col("text"), settings, split)).alias("chunk_index_in_section", "text"),
    )
    key = chunk_id(
        F.col("accession_number"), F.col("section"), F.col("chunk_index_in_section"), F.col("text")
    )
    return exploded.withColumn("chunk_id", key)


def chunk_filings(filings: DataFrame, settings: Settings) -> DataFrame:
    """Chunks of filings in the stored chunk layout. With the learned splitter the
    texts are read once more before, for the abbreviations in them."""
    sections = filings.select(
        F.col("company_name").alias("company"), "ticker", "cik", "fiscal_year",
        "fiscal_year_end_date", "form_type", "accession_number", "source_url",
        F.explode("parsed_sections").alias("part"),
    ).select("*", F.col("part.section").alias("section"), F.col("part.text").alias("text"))
    split = sentences
    if settings.sentence_splitter == "learned":
        types = learned_types(sections)
        split = lambda text: learned_sentences(text, types)
    return chunk_sections(sections.drop("part"), settings, split).select(
        "chunk_id", "text", "company", "ticker", "cik", "fiscal_year", "fiscal_year_end_date",
        "form_type", "section", "accession_number", "source_url", "chunk_index_in_section",
    )
