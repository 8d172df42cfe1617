"""Passing columns of texts to Python in Arrow batches, and words as numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import DataType, StructType

SLICE_BYTES = 1_000_000


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes of text each. A longer text is a range of its own."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield start, end
        start = end


def text_column(fn: Callable[[list], list], kind: DataType, text: Column | str) -> Column:
    """A column computed by ``fn`` from lists of texts, a value for each text.

    The other columns stay in the JVM. A batch is bounded by Spark's limit on
    the bytes of an Arrow batch, what ``fn`` sees at once by ``SLICE_BYTES``.
    """
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = [pa.array(fn(batch[a:b].to_pylist()), type=arrow) for a, b in slices(batch)]
            yield pa.concat_arrays(done) if done else pa.array([], type=arrow)

    # The hints are read by Spark at run time, so they must be real types here.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)(text)


def map_texts(
    df: DataFrame, fn: Callable[..., list], schema: StructType, columns: list[str], text: int = -1
) -> DataFrame:
    """Rows made by ``fn`` from lists of the given columns, cut into slices by the lengths of column number ``text``.
    ``fn`` returns a list or array for each field of ``schema``."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(text if text >= 0 else batch.num_columns + text)):
                out = fn(*[c[a:b].to_pylist() for c in batch.columns])
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(out, arrow)], schema=arrow
                )

    return df.select(*columns).mapInArrow(run, schema)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: splitting bytes knows no other white space."""
    return text.encode().split() if text else []


def flat(lists: list[list]) -> tuple[list, np.ndarray]:
    """The lists end to end, and where each begins (one more entry for the end)."""
    ends = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    return [w for x in lists for w in x], ends


def word_codes(tokens: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, equal for equal words, and the distinct words."""
    if not tokens:
        return np.zeros(0, dtype=np.int64), []
    coded = pa.array(tokens, type=pa.binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def word_hashes(tokens: list[bytes], seeds: tuple[int, ...]) -> list[np.ndarray]:
    """64-bit hashes of each word, one array for each seed."""
    codes, distinct = word_codes(tokens)
    digest = xxhash.xxh3_64_intdigest
    return [np.fromiter((digest(w, s) for w in distinct), np.uint64, len(distinct))[codes] for s in seeds]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of each window of ``width`` consecutive entries: a polynomial modulo 2^64, read off prefix sums.

    Entry i is of the window that starts at i; there are ``len - width + 1``.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    odd = np.uint64(base | 1)
    inverse = np.uint64(pow(base | 1, -1, 1 << 64))
    up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, odd))), dtype=np.uint64)
    down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - width, inverse))), dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:], dtype=np.uint64)
    return mixed((sums[width:] - sums[:-width]) * down)
