"""Repetition inside a text by a suffix array over its words.

The suffixes of many texts are sorted at once by prefix doubling: a rank by one
word, then by two, four and so on, where only suffixes that are still equal to
another are sorted again. Longest common prefixes of neighbours are read off
the ranks of all lengths. The deepest interval of common prefixes that a suffix
lies in gives the longest repeat that starts there; those that no repeat to the
left extends are the maximal repeated substrings, whose spans are united.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from citemill.llm.batches import flat, text_column, word_codes, words

SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\v\f\r"
MIN_REPEAT = 8
MAX_COVERED = 45
MAX_LONGEST = 100
KIND = StructType([
    *(StructField(n, LongType()) for n in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")),
    StructField("spans", ArrayType(ArrayType(IntegerType()))), StructField("base_failed", BooleanType()), StructField("kept", BooleanType()),
])


def _ordered(keys: np.ndarray) -> np.ndarray:
    return np.argsort(keys, kind="stable")


def longest_repeats(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run of words that starts there and also elsewhere in its text.

    ``codes`` are the texts' words end to end, ``owner`` the number of the text of each, ascending.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    # A word's rank is the number of words before it in the order of (text, word), so texts never mix.
    keys = owner * (codes.max() + 1) + codes
    order = _ordered(keys)
    sorted_keys = keys[order]
    new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels, h = [rank.copy()], 1
    last = np.concatenate((owner[1:] != owner[:-1], [True]))
    ends = np.flatnonzero(last)[owner - owner[0]] if len(np.unique(owner)) == owner[-1] - owner[0] + 1 else _ends(owner)
    start = rank[order]
    same = np.concatenate((~new[1:], [False])) | ~new
    active = order[same]
    first_active = active
    while len(active):
        # What follows, -1 beyond the end of the text, where a shorter suffix sorts first.
        follow = np.where(active + h <= ends[active], rank[np.minimum(active + h, n)], -1)
        keys = rank[active] * (n + 1) + follow + 1
        order = _ordered(keys)
        active, keys = active[order], keys[order]
        groups = rank[active]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        # Places in the sorted order: the group's first place, plus the place inside the group.
        fresh = np.concatenate(([True], groups[1:] != groups[:-1]))
        inside = np.arange(len(active)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        places = groups + inside
        rank[active] = places[np.flatnonzero(new)][np.cumsum(new) - 1]
        same = np.concatenate((~new[1:], [False])) | ~new
        active = active[same]
        levels.append(rank.copy())
        h *= 2
    # Neighbours in the suffix array share a prefix only if both were equal to another at first.
    at = first_active[_ordered(rank[first_active])]
    left, right = at[:-1].copy(), at[1:].copy()
    near = (rank[right] == rank[left] + 1) & (owner[left] == owner[right])
    left, right = left[near], right[near]
    common = np.zeros(len(left), dtype=np.int64)
    a, b = left.copy(), right.copy()
    for level in range(len(levels) - 1, -1, -1):
        inside = (a <= ends[left]) & (b <= ends[right])
        equal = inside & (levels[level][np.minimum(a, n)] == levels[level][np.minimum(b, n)])
        # Suffixes that end before the level's length have a rank of their own, so equal ranks have it in full.
        common += equal * (1 << level)
        a += equal * (1 << level)
        b += equal * (1 << level)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def _ends(owner: np.ndarray) -> np.ndarray:
    """The last place of each place's text."""
    return np.searchsorted(owner, owner, side="right") - 1


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def measure(texts: list, min_repeat: int, max_covered: int, max_longest: int) -> list:
    split = [words(t) for t in texts]
    tokens, bounds = flat(split)
    codes, _ = word_codes(tokens)
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in split])
    longest = longest_repeats(codes, owner)
    n = len(codes)
    thrice = np.flatnonzero(longest >= 3)
    in_windows = np.concatenate(([0], np.cumsum(_covered(thrice, np.full(len(thrice), 3), n))))
    # A repeat is maximal if the one that starts a word earlier does not hold it.
    before = np.concatenate(([0], longest[:-1]))
    before[bounds[:-1][bounds[:-1] < n]] = 0
    spans = np.flatnonzero((longest >= min_repeat) & (before != longest + 1))
    united = _covered(spans, longest[spans], n)
    covered = np.concatenate(([0], np.cumsum(united)))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], united, [False])).astype(np.int8)))
    out = []
    for text, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist()):
        text, size = text or "", b - a
        repeat_words, cover = int(in_windows[b] - in_windows[a]), int(covered[b] - covered[a])
        most = int(longest[a:b].max()) if size else 0
        failed = size < 50 or 100 * repeat_words > 50 * size
        # United spans may meet at the border of two texts, so they are cut there.
        own = [[max(0, x - a), min(size, y - a)] for x, y in _pairs(edges, a, b)]
        out.append({
            "n_words": size, "word_chars": len(text) - sum(map(text.count, BLANKS)), "n_symbols": sum(map(text.count, SYMBOLS)),
            "n_dup_lines": repeated_lines(text), "n_repeat_words": repeat_words, "n_covered_words": cover,
            "longest_repeat": most, "spans": own, "base_failed": failed,
            "kept": not failed and 100 * cover <= max_covered * size and most <= max_longest,
        })
    return out


def _pairs(edges: np.ndarray, a: int, b: int) -> list:
    starts, ends = edges[0::2], edges[1::2]
    lo, hi = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
    return list(zip(starts[lo:hi].tolist(), ends[lo:hi].tolist()))


def repetition(
    docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text; other columns are not read): doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_covered_words, longest_repeat, spans (in words, end exclusive), base_failed, kept.

    A text is kept unless it fails the base rules, its repeats of ``min_repeat`` words or more cover above
    ``max_covered`` percent of its words, or one repeat is longer than ``max_longest`` words. A null text has no words
    and fails the base rules. Rows are judged one by one, repeated rows alike.
    """
    def run(texts: list) -> list:
        return measure(texts, min_repeat, max_covered, max_longest)

    return docs.select("doc_id", text_column(run, KIND, F.col("text")).alias("r")).select("doc_id", "r.*")
