"""Shingle sets of texts and their minhash signatures, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from citemill.llm.batches import flat, mixed, window_hashes, word_hashes

WORD_SEED = 11


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of ``width`` words.

    A-Z is lower-cased. A text with fewer words is one shingle, one without
    words has none.
    """
    tokens, ends = flat([t.encode().lower().split() if t else [] for t in texts])
    (hashes,) = word_hashes(tokens, (WORD_SEED,))
    windows = window_hashes(hashes, width)
    sets = []
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if end - start >= width:
            sets.append(np.unique(windows[start : end - width + 1]))
        elif end > start:
            # Its length is part of the hash: sequences of another length are other shingles.
            sets.append(mixed(window_hashes(hashes[start:end], end - start) + np.uint64(end - start)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


@lru_cache(maxsize=64)
def _permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    top = np.iinfo(np.uint64).max
    return draw.integers(0, top, count, np.uint64, True), draw.integers(0, top, count, np.uint64, True) | np.uint64(1)


def half_keys(sets: list[np.ndarray], keys: int, hashes: int, seed: int) -> np.ndarray:
    """``keys`` numbers for each non-empty set, each made of ``hashes`` minhashes."""
    sizes = [len(s) for s in sets]
    starts = np.zeros(len(sets), dtype=np.int64)
    np.cumsum(sizes[:-1], out=starts[1:])
    values = np.concatenate(sets)
    xors, odds = _permutations(keys * hashes, seed)
    out = np.zeros((len(sets), keys), dtype=np.uint64)
    for k in range(keys):
        key = np.full(len(sets), np.uint64(k + 1))
        for j in range(k * hashes, (k + 1) * hashes):
            key = mixed(key ^ np.minimum.reduceat((values ^ xors[j]) * odds[j], starts))
        out[:, k] = key
    return out


def set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits for each set, equal for equal sets."""
    return np.array(
        [[int(mixed(s ^ np.uint64(m)).sum(dtype=np.uint64)) for m in (0x51ED270B, 0x2545F491)] for s in sets], dtype=np.uint64
    ).reshape(len(sets), 2)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes; empty sets are like nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate((a, b)), kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(a) + len(b) - shared)
