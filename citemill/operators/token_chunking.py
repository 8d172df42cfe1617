"""Chunks counted in the tokens of a loaded tokenizer.

The same packing as ``chunking``, over arrays of token offsets: Python only says where tokens are, three times (for the
sentences, the packed chunks and the merged ones), and for sections above the limit only but the first time. Folding and
cutting stay expressions on the row, without a shuffle. A cut runs from the start of its first token to the end of its
last, in characters of the text, whatever lies between tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.config import Settings
from citemill.functions.binding import let
from citemill.functions.hashing import chunk_id
from citemill.functions.text import sentences, strip
from citemill.functions.tokens import OFFSETS
from citemill.operators.chunking import merge_counted, sentence_spans


def _cut(text: Column, tokens: Column, first: Column, last: Column) -> Column:
    """Text from token ``first`` to token ``last``, counted from 0."""
    lo, hi = F.get(tokens, first).lo, F.get(tokens, last).hi
    return strip(F.substr(text, lo + 1, hi - lo))


def tail_by_tokens(text: Column, tokens: Column, n: int) -> Column:
    """Text from the n-th last token on; the whole text when it has no more."""
    start = F.get(tokens, F.size(tokens) - n).lo
    return F.when(F.size(tokens) <= n, text).otherwise(strip(F.substr(text, start + 1, F.length(text))))


def windows_by_tokens(text: Column, tokens: Column, size: int, stride: int) -> Column:
    """Windows of ``size`` tokens at every ``stride``-th token, blank ones dropped; a text without tokens is its own."""
    starts = F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(stride))
    window = lambda i: _cut(text, tokens, i, F.least(i + size, F.size(tokens)) - 1)
    return F.when(F.size(tokens) == 0, F.array(text)).otherwise(F.filter(F.transform(starts, window), lambda w: w != ""))


def _span_texts(spans: Column, sents: Column, tokens: Column, settings: Settings) -> Column:
    def texts(span: Column) -> Column:
        joined = F.array_join(F.slice(sents, span.lo + 1, span.hi - span.lo + 1), " ")
        seed = tail_by_tokens(F.get(sents, span.lo - 1), F.get(tokens, span.lo - 1), settings.chunk_overlap_tokens)
        windows = windows_by_tokens(F.get(sents, span.lo), F.get(tokens, span.lo), settings.chunk_size_tokens, settings.split_stride)
        return (
            F.when(span.kind == "long", windows)
            .when(span.kind == "seeded", F.array(F.concat(seed, F.lit(" "), joined))).otherwise(F.array(joined))
        )

    return F.flatten(F.transform(spans, texts))


def chunk_sections_by_tokens(
    sections: DataFrame, settings: Settings, offsets: Callable[[Column], Column], split: Callable[[Column], Column] = sentences
) -> DataFrame:
    """``chunk_sections`` with the tokens of ``offsets``. Sentences that a tokenizer finds no token in count as one."""
    keep = [c for c in sections.columns if c != "text"]
    size, overlap, none = settings.chunk_size_tokens, settings.chunk_overlap_tokens, F.array().cast("array<string>")
    counts = lambda tokens: F.transform(tokens, F.size)
    row = F.struct(*keep).alias("row")
    cut = sections.select(row, strip(F.col("text")).alias("body")).where("body <> ''").select("row", "body", split(F.col("body")).alias("sents"))
    counted = cut.withColumn("tokens", offsets(F.col("sents"))).withColumn(
        "n", F.transform("tokens", lambda t: F.greatest(F.size(t), F.lit(1)))
    ).withColumn("long", F.aggregate("n", F.lit(0), lambda a, c: a + c) > size)
    packed = counted.select("row", "body", "long", F.when(F.col("long"), let(
        sentence_spans(F.col("n"), size, overlap), lambda s: _span_texts(s, F.col("sents"), F.col("tokens"), settings)
    )).otherwise(none).alias("parts")).withColumn("part_tokens", offsets(F.col("parts")))
    merged = packed.select("row", "body", "long", F.when(F.size("parts") < 2, F.col("parts")).otherwise(
        let(counts(F.col("part_tokens")), lambda n: merge_counted(F.col("parts"), n, settings.min_chunk_tokens))
    ).alias("merged")).withColumn("merged_tokens", offsets(F.col("merged")))
    capped = F.flatten(F.zip_with("merged", F.col("merged_tokens").cast(OFFSETS), lambda text, tokens: F.when(
        F.size(tokens) > settings.safe_max_tokens, windows_by_tokens(text, tokens, size, settings.split_stride)
    ).otherwise(F.array(text))))
    texts = F.when(F.col("long"), capped).otherwise(F.array("body"))
    exploded = merged.select("row", F.posexplode(texts).alias("chunk_index_in_section", "text")).select(
        "row.*", "chunk_index_in_section", "text"
    )
    return exploded.withColumn("chunk_id", chunk_id(
        F.col("accession_number"), F.col("section"), F.col("chunk_index_in_section"), F.col("text")
    ))
