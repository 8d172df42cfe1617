"""Tokens of a loaded tokenizer, as offsets of characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from citemill.config import Settings, hook
from citemill.functions.text import SPACES

OFFSETS = "array<array<struct<lo:int,hi:int>>>"
# Characters tokenized at a time; a longer text is tokenized alone.
SLICE_CHARS = 500_000
# A loaded tokenizer: texts -> for each, (start, end) of its tokens in characters.
Tokenize = Callable[[list[str]], list[list[tuple[int, int]]]]


def pattern_tokenizer(path: str = "") -> Tokenize:
    """The tokens of the built-in pattern, for trying the hook without a model."""
    import regex

    token = regex.compile(rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACES}]")
    return lambda texts: [[m.span() for m in token.finditer(t)] for t in texts]


def file_tokenizer(path: str) -> Tokenize:
    """A tokenizer file of the tokenizers library, without special tokens."""
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()

    def tokenize(texts: list[str]) -> list[list[tuple[int, int]]]:
        # Tokens that stand for no character of the text are none of its length.
        return [[(a, b) for a, b in e.offsets if b > a] for e in loaded.encode_batch(texts, add_special_tokens=False)]

    return tokenize


def _pairs(tokenize: Tokenize, texts: list[str]) -> tuple[list[int], np.ndarray]:
    """The number of tokens of each text, and (start, end) of all of them."""
    found = tokenize(texts)
    sizes = [len(spans) for spans in found]
    flat = np.fromiter(chain.from_iterable(chain.from_iterable(found)), dtype=np.int32, count=2 * sum(sizes))
    return sizes, flat.reshape(-1, 2)


def char_ranges(texts: pa.Array, batch: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``batch`` texts and about ``SLICE_CHARS`` characters, one text at least."""
    ends = np.cumsum(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = int(np.searchsorted(ends, before + SLICE_CHARS, side="right"))
        end = min(max(end, start + 1), start + batch)
        yield start, end
        start = end


def offsets_of(load: Callable[[], Tokenize], batch: int = 256) -> Callable[[Column], Column]:
    """Token offsets of each text in a list column. ``load()`` runs once per Python worker. Of a batch of rows, at most
    ``batch`` texts and about ``SLICE_CHARS`` characters are strings and tuples at a time."""

    @F.arrow_udf(OFFSETS)
    def offsets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenize = load()
        for lists in batches:
            texts = lists.flatten()
            found = [_pairs(tokenize, texts[a:b].to_pylist()) for a, b in char_ranges(texts, batch)]
            flat = np.concatenate([np.empty((0, 2), dtype=np.int32), *(pairs for _, pairs in found)])
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["lo", "hi"])
            ends = np.cumsum([0, *chain.from_iterable(sizes for sizes, _ in found)], dtype=np.int32)
            outer = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(ends), pairs))

    # Catalyst copies a deterministic call into the array lambdas that use it, where Python cannot be called.
    return offsets.asNondeterministic()


def tokenizer_for(settings: Settings) -> Callable[[Column], Column]:
    """The offsets column of the settings' tokenizer."""
    return offsets_of(lambda: hook(settings.tokenizer_loader)(settings.tokenizer_path))
